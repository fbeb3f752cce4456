"""The generic operators' inputs, bound to the driver's tables.

`events` is telemetry (eight assets, one row per event, buckets of an hour) and
`embeddings` are vibration snapshots (four bearings, 64 samples each).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsewright.operators import telemetry as T

HOUR = 3600
#: 2024-01-01 00:00 UTC, in hours.
T0 = 473_352

CHANNELS = T.Channels(
    analogs=("a1", "a2"), reservoir="a1", current="a2", temperature="a1", pressure_in="a1", pressure_out="a2", bucket_s=HOUR, gap_s=6 * 3600.0, windows=(6, 24, 72, 168),
    labels=("w1", "w2", "w3", "w4"), names={"current": "cur", "temperature": "tmp", "reservoir": "res"}, chunk=336,
)

#: (id, start, end, maintenance) in hours; the second has none logged.
FAILURES = [("F1", T0 + 264, T0 + 276, T0 + 290), ("F2", T0 + 360, T0 + 372, None), ("F3", T0 + 480, T0 + 500, T0 + 510), ("F4", T0 + 600, T0 + 606, T0 + 640)]
TRAIN = (T0, T0 + 239)
EXCLUDE = ((T0 + 96, T0 + 110),)
ANTICIPATION, GRACE = 72, 24
MAX_GAP, SMOOTHING, PERSISTENCE = 24, 12, 4
#: Steps of the coarse channels.
COARSE_A1, COARSE_A2 = 150.0, 60.0
#: Different values that are numbered by one window; more are dealt into ranges.
HELD = 200
#: Hours of one task of a series of minutes or scores.
CHUNK = 120

N_SAMPLES = 64
#: Bearings that failed, and how.
KNOWN = [(1, 1, "inner"), (1, 3, "roller"), (1, 4, "outer")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_telemetry(e: DataFrame) -> DataFrame:
    """Rows of `events`, or a stream of them, as telemetry."""
    return e.select(
        (F.col("user_id") % 8).alias("asset"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").alias("tie"), F.col("value").alias("a1"),
        F.regexp_extract("props", r"(\d+)", 1).cast("double").alias("a2"), F.when(F.col("event_type").isin("click", "purchase"), 0).otherwise(1).alias("comp"), (F.col("event_type") == "error").cast("int").alias("lps"),
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_telemetry(table(spark, sf_dir, "events"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.row_signals(telemetry(spark, sf_dir), CHANNELS)


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.buckets(signals(spark, sf_dir), CHANNELS)


def coarse_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of the same telemetry with channels in steps so coarse that they often stand still."""
    t = telemetry(spark, sf_dir).withColumns({"a1": F.floor(F.col("a1") / COARSE_A1).cast("double"), "a2": F.floor(F.col("a2") / COARSE_A2).cast("double")})
    return T.buckets(T.row_signals(t, CHANNELS), CHANNELS)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.features(hours(spark, sf_dir).filter(~T.is_frozen(CHANNELS)), CHANNELS)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset, t, score (the hour's mean of channel a1) and shift."""
    b = hours(spark, sf_dir).select("asset", "t", (F.col("a1_sum") / F.col("n")).alias("score"))
    return T.calendar(b, F.col("t") * HOUR)


def bearings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """test, timestamp, hours, bearing, samples and four signal measures of each snapshot."""
    e = table(spark, sf_dir, "embeddings")
    from pulsewright.operators.vibration import time_domain

    x = time_domain("embedding")
    snap = F.floor(F.col("vec_id") / 4)
    return e.select(F.lit(1).alias("test"), snap.alias("timestamp"), snap.cast("double").alias("hours"), (F.col("vec_id") % 4 + 1).alias("bearing"), "vec_id", F.col("embedding").alias("samples"), x["rms"].alias("rms"), x["peak"].alias("peak"), x["kurtosis"].alias("kurtosis"), x["p2p"].alias("p2p"))

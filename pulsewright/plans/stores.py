"""Sources, sinks, stores and streams as queries: what is written is read back, and what streams is collected, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pulsewright.cluster import new_path, shuffle_partitions, ship
from pulsewright.operators import telemetry as T
from pulsewright.operators import vibration as V
from pulsewright.operators.detectors import ControlLimits
from pulsewright.plans import bindings as B
from pulsewright.plans.catalog import _CL, big, query, r6, threshold_sweep
from pulsewright.schema import ANALOG
from pulsewright.sources import registry, snapshots
from pulsewright.sources import telemetry as S
from pulsewright.streaming import event_time, processor
from pulsewright.streaming.rounds import Rounds

#: Delay of the event-time stream's watermark.
DELAY_S = 6 * 3600
#: Tasks of a stream's state at most: every micro-batch starts them all, and there are eight assets.
STATE_TASKS = 16


def _compressor_rows(spark: SparkSession, d: str) -> DataFrame:
    """The telemetry under the names of a compressor's channels; two of these differ, the others follow them."""
    t = B.telemetry(spark, d)
    analog = [(F.col("a1") if i % 2 == 0 else F.col("a2")).cast("float").alias(c) for i, c in enumerate(ANALOG)]
    return t.select(F.timestamp_micros("us").alias("timestamp"), *analog, F.col("comp").cast("tinyint").alias("COMP"), F.col("lps").cast("tinyint").alias("LPS"), F.col("asset").cast("long").alias("asset"), "tie")


@query
def csv_scan(spark, d):
    """A CSV file with an index column without a name, read as telemetry."""
    path = new_path(spark, "raw-csv")
    own = _compressor_rows(spark, d).select(F.col("tie").alias(" "), F.col("timestamp").cast("string").alias("timestamp"), *ANALOG, "COMP", "LPS")
    own.write.option("header", True).csv(path)
    out = S.read_csv(spark, path)
    return out.select(F.unix_micros("timestamp").alias("us"), r6("TP2"), r6("TP3"), big("COMP", "comp"), big("LPS", "lps"), F.col("Towers").isNull().alias("no_towers"))


@query
def clean_parquet(spark, d):
    """The clean store by asset and day, and a half-open slice of it for replay: partitions and row groups are pruned."""
    path = new_path(spark, "clean")
    S.write_clean(_compressor_rows(spark, d).drop("tie"), path)
    rows = S.replay_slice(S.read_clean(spark, path).filter("asset < 3 and date >= date'2024-01-05'"), "2024-01-05 06:00:00", "2024-01-20 00:00:00")
    return S.as_rows(rows).groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("first"), F.sum(F.col("TP2").cast("double")).alias("s"), F.sum("comp").alias("comp")).select(big("asset"), big("n"), big("first"), F.round("s", 2).alias("tp2"), big("comp"))


@query
def snapshot_files(spark, d):
    """Snapshots as text files named by their time, a matrix of four channels each; found, listed, parsed and mapped to bearings."""
    root = new_path(spark, "snapshots")
    ship(spark)
    e = B.table(spark, d, "embeddings").select((F.col("vec_id") / 4).cast("long").alias("snap"), (F.col("vec_id") % 4).alias("channel"), "embedding")

    def write(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        fs, at = pafs.FileSystem.from_uri(f"{root}/run/set")
        fs.create_dir(at, recursive=True)
        m = np.stack(pdf.sort_values("channel")["embedding"].to_list(), 1).astype(np.float32)
        when = pd.Timestamp("2024-01-01") + pd.Timedelta(hours=int(key[0]))
        with fs.open_output_stream(f"{at}/{when:%Y.%m.%d.%H.%M.%S}") as f:
            f.write("\n".join("\t".join(np.format_float_positional(v, unique=True) for v in row) for row in m).encode())
        return pd.DataFrame({"n": [1]})

    e.groupBy("snap").applyInPandas(write, "n long").count()
    x = snapshots.with_bearing(snapshots.load(spark, root), 2)
    rms = V.time_domain("samples")["rms"]
    return x.select(big(F.round("hours"), "hours"), big("bearing"), big("channel"), r6(rms, "rms"), big(F.size("samples"), "points"))


@query
def model_store(spark, d):
    """Control limits saved and loaded by name, then scored."""
    f = B.features(spark, d)
    path = new_path(spark, "models")
    registry.save(spark, {"limits": ControlLimits(list(_CL)).fit(f.filter(T.training_slice("t", *B.TRAIN, B.EXCLUDE)))}, path)
    return registry.load(spark, path, ["limits"])["limits"].score(f).select(big("asset"), big("t"), r6("score"), (r6("score") > 3.0).alias("above"))


@query
def baseline_store(spark, d):
    """The drift baseline as a JSON file, read back and applied."""
    f, path = B.features(spark, d), new_path(spark, "baseline")
    S.write_json(spark, T.fit_baseline(f, B.CHANNELS, B.TRAIN[1], B.TRAIN[0]).first().asDict(), path)
    saved = S.read_json(spark, path)
    base = spark.createDataFrame([tuple(saved.values())], list(saved))
    return T.apply_drift(f, base, B.CHANNELS).select(big("asset"), big("t"), *[r6(z) for _, z in T.drift_targets(B.CHANNELS)])


@query
def score_store(spark, d):
    """Scores built once and read again."""
    path = new_path(spark, "scores")
    S.cached(spark, path, lambda: B.scores(spark, d).select("asset", "t", "score", "shift"))
    S.cached(spark, path, lambda: B.scores(spark, d).limit(0))
    return S.read_built(spark, path, "scores").select(big("asset"), big("t"), r6("score"), "shift")


@query
def report_csv(spark, d):
    """The sweep's report as one CSV file, read back."""
    path = new_path(spark, "report")
    S.write_report(threshold_sweep(spark, d), path)
    x = spark.read.option("header", True).csv(path)
    number = lambda c: F.col(c).cast("double").alias(c)
    return x.select(number("threshold"), "scenario", big("flagged_early"), big("detected"), number("median_lead_h"), big("false_alerts"), number("false_alerts_per_month"), number("net_value"), number("break_even_per_month"))


def _collected(spark: SparkSession, d: str, score: Callable[[DataFrame], DataFrame], tag: str) -> tuple[str, str, StreamingQuery]:
    """(JSON lines, checkpoint, query) of `score` over the events table as a stream of telemetry rows, run through all of it."""
    rounds = Rounds(B.telemetry(spark, d), ["us", "tie"])
    out, state = new_path(spark, tag), new_path(spark, f"{tag}-state")
    write = lambda df, batch: df.write.mode("overwrite").json(f"{out}/batch={batch}")
    tasks = shuffle_partitions(spark)
    spark.conf.set("spark.sql.shuffle.partitions", min(tasks, STATE_TASKS))  # the query takes it over when it starts
    try:
        q = score(rounds.stream).writeStream.foreachBatch(write).option("checkpointLocation", state).start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
    rounds.feed(q)
    return out, state, q


def _records(df: DataFrame) -> DataFrame:
    cols = [c for c in T.features_of(B.CHANNELS)]
    x = df.select("asset", F.from_json("record", ", ".join(f"`{c}` double" for c in ["t", *cols])).alias("r"))
    return x.select(big("asset"), big("r.t", "t"), *[r6(F.col(f"r.`{c}`"), c) for c in cols])


@query
def stream_scores(spark, d):
    """The stateful stream over all rows, written as JSON lines, with the minutes that its end leaves open."""
    out, state, _ = _collected(spark, d, lambda rows: processor.score_stream(rows, B.CHANNELS), "stream")
    closed = spark.read.schema(processor.SCORED).json(out).select("asset", "record")
    return _records(closed.unionByName(processor.flush_stream(spark, state, B.CHANNELS).select("asset", "record")))


@query
def stream_event_time(spark, d):
    """The event-time stream over all rows: the hours that the watermark has passed, whose rows are as in the batch plan."""
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    event_time.use_event_time(spark)
    try:
        out, _, _ = _collected(spark, d, lambda rows: event_time.score_events(rows, B.CHANNELS, delay=f"{DELAY_S} seconds", silence=90 * 86_400), "by-event-time")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was) if was else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return _records(spark.read.schema(processor.SCORED).json(out))

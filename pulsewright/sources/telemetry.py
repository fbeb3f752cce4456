"""Telemetry sources and sinks: CSV, clean Parquet, caches, models, reports."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsewright.functions.exprs import nan_to_null
from pulsewright.schema import ANALOG, DIGITAL, TELEMETRY, require


def read_csv(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Telemetry of a CSV file with a header: an index column without a name is dropped, channels are narrowed, NaN becomes null.

    Columns are taken by name, as strings, so an index column or another order
    does no harm; nothing is inferred from the data. Rows are not sorted: the
    operators' windows order them.
    """
    raw = spark.read.option("header", True).csv(path)
    require(raw, ["timestamp", *ANALOG])
    analog = [nan_to_null(F.col(c).cast("double")).cast("float").alias(c) for c in ANALOG]
    digital = [F.round(F.col(c).cast("double")).cast("tinyint").alias(c) if c in raw.columns else F.lit(None).cast("tinyint").alias(c) for c in DIGITAL]
    out = raw.select(F.to_timestamp("timestamp").alias("timestamp"), *analog, *digital)
    return out.limit(limit) if limit else out


def as_rows(df: DataFrame, asset: int | str = 0) -> DataFrame:
    """The shape that the telemetry operators take: asset, us, tie, analog channels, comp and lps."""
    require(df, ["timestamp", *ANALOG, "COMP"])
    own = F.col("asset") if "asset" in df.columns else F.lit(asset)
    lps = F.coalesce("LPS", F.lit(0)) if "LPS" in df.columns else F.lit(0)
    return df.select(own.alias("asset"), F.unix_micros(F.col("timestamp").cast("timestamp")).alias("us"), F.lit(0).alias("tie"), *ANALOG, F.col("COMP").cast("int").alias("comp"), lps.cast("int").alias("lps"))


def write_clean(df: DataFrame, path: str) -> None:
    """Parquet by asset and day, so that time and asset filters prune files."""
    own = df if "asset" in df.columns else df.withColumn("asset", F.lit(0))
    own.withColumn("date", F.to_date("timestamp")).repartition("asset", "date").write.mode("overwrite").partitionBy("asset", "date").parquet(path)


def read_clean(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([*TELEMETRY, T.StructField("asset", T.LongType()), T.StructField("date", T.DateType())])
    return spark.read.schema(schema).parquet(path)


def read_built(spark: SparkSession, path: str, first: str) -> DataFrame:
    """A table that an earlier step writes; says which step if it is missing."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"{path} is missing: run {first} first") from e


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
    """Read what an earlier run wrote, or build and write it."""
    if not refresh:
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            pass
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small result as one CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(spark: SparkSession, value: dict | list, path: str) -> None:
    """A model or baseline as a JSON file on whatever file system the path names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()


def read_json(spark: SparkSession, path: str) -> dict | list:
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def log_run(spark: SparkSession, path: str, name: str, params: dict, metrics: dict[str, float]) -> None:
    """Append a run to the table of experiments."""
    row = [(name, json.dumps(params, sort_keys=True, default=str), {k: float(v) for k, v in metrics.items()})]
    spark.createDataFrame(row, "name string, params string, metrics map<string,double>").withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)


def replay_slice(df: DataFrame, start=None, end=None) -> DataFrame:
    """Rows of [start, end)."""
    out = df
    if start is not None:
        out = out.filter(F.col("timestamp") >= F.lit(start).cast("timestamp"))
    if end is not None:
        out = out.filter(F.col("timestamp") < F.lit(end).cast("timestamp"))
    return out

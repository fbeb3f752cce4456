"""Vibration snapshots: folders of text files named by their time, one matrix each."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsewright.cluster import ship

NAME = r"(\d{4}\.\d{2}\.\d{2}\.\d{2}\.\d{2}\.\d{2})$"
LEAST_FILES = 10

# Channels of each bearing, by test.
CHANNELS: Mapping[int, Mapping[int, Sequence[int]]] = {
    1: {1: (0, 1), 2: (2, 3), 3: (4, 5), 4: (6, 7)},
    2: {1: (0,), 2: (1,), 3: (2,), 4: (3,)},
    3: {1: (0,), 2: (1,), 3: (2,), 4: (3,)},
}


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """path, folder, timestamp and hours since the folder's first file; the shallowest folder with at least ten snapshots."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    rows = files.withColumn("name", F.regexp_extract("path", NAME, 1)).filter("name <> ''").withColumn("folder", F.expr("substring_index(path, '/', size(split(path, '/')) - 1)"))
    rows = rows.withColumn("timestamp", F.to_timestamp("name", "yyyy.MM.dd.HH.mm.ss")).filter("timestamp is not null")
    counts = rows.groupBy("folder").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_FILES)
    best = counts.orderBy(F.size(F.split("folder", "/")), "folder").limit(1).select("folder")
    own = rows.join(F.broadcast(best), "folder")
    first = F.min("timestamp").over(Window.partitionBy("folder"))
    return own.select("path", "folder", "timestamp", ((F.unix_micros("timestamp") - F.unix_micros(first)) / 3.6e9).alias("hours"))


def load(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """path, timestamp, hours, channel and samples: a row per snapshot and channel; a file is one row, so it is never split."""
    ship(spark)
    inv = inventory(spark, root)
    if limit:
        inv = inv.orderBy("timestamp").limit(limit)
    content = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                rows = bytes(r.content).decode().strip().splitlines()
                m = np.array([line.split() for line in rows], dtype=np.float32)
                yield pd.DataFrame({"path": r.path, "timestamp": r.timestamp, "hours": r.hours, "channel": range(m.shape[1]), "samples": list(m.T)})

    return content.join(inv, "path").select("path", "timestamp", "hours", "content").mapInPandas(parse, "path string, timestamp timestamp, hours double, channel int, samples array<float>")


def with_bearing(df: DataFrame, test: int) -> DataFrame:
    """Adds test and bearing by the fixed table of channels."""
    pairs = [(c, b) for b, cs in CHANNELS[test].items() for c in cs]
    table = df.sparkSession.createDataFrame(pairs, "channel int, bearing int")
    return df.join(F.broadcast(table), "channel").withColumn("test", F.lit(test))

"""Audits and reports: gaps, profiles, frozen periods, contingency, histograms, regular grids, rank correlation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsewright.cluster import materialise
from pulsewright.operators.chunked import numbered
from pulsewright.operators.intervals import max_in
from pulsewright.operators.order_stats import HELD, average_rank, quantiles, ranked
from pulsewright.operators.windows import islands, ordered


def sampling_gaps(df: DataFrame, keys: Sequence[str], us: str, threshold_s: float = 60.0) -> DataFrame:
    w = ordered(keys, [us])
    out = df.select(*keys, F.lag(us).over(w).alias("gap_start"), F.col(us).alias("gap_end"))
    sec = (F.col("gap_end") - F.col("gap_start")) / F.lit(1e6)
    return out.withColumn("gap_seconds", sec).filter(F.col("gap_seconds") > threshold_s).withColumn("gap_hours", F.col("gap_seconds") / 3600)


def profile(df: DataFrame, signals: Sequence[str], held: int = HELD) -> DataFrame:
    """Missing values, extremes, exact quantiles, mean and sample deviation of each signal, over the unpivoted columns."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("v")) for s in signals])).alias("x")).select("x.*")
    n = F.count(F.lit(1))
    plain = long.groupBy("signal").agg((n - F.count("v")).alias("missing_count"), ((n - F.count("v")) / n * 100).alias("missing_pct"), F.min("v").alias("min"), F.avg("v").alias("mean"), F.max("v").alias("max"), F.stddev_samp("v").alias("std"))
    q = quantiles(long, ["signal"], "v", {"p01": 0.01, "median": 0.5, "p99": 0.99}, held)
    return plain.join(q, "signal", "left").select("signal", "missing_count", "missing_pct", "min", "p01", "median", "mean", "p99", "max", "std")


def frozen_periods(bucketed: DataFrame, frozen, keys: Sequence[str], t: str = "t", least: int = 10, chunk: int | None = None) -> DataFrame:
    """Runs of frozen buckets; an empty bucket ends a run. chunk: units of time of one task of a long series."""
    rows = islands(bucketed.withColumn("_f", frozen), "_f", t, keys, 1, "run", chunk)
    return rows.groupBy(*keys, "run").agg(F.min(t).alias("start"), F.max(t).alias("end"), F.count(F.lit(1)).alias("buckets")).filter(F.col("buckets") >= least)


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of a by b with margins (null stands for all)."""
    return df.cube(a, b).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, x, low: float, high: float, n: int) -> DataFrame:
    return df.groupBy(F.width_bucket(x, F.lit(float(low)), F.lit(float(high)), F.lit(n)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def densify(df: DataFrame, keys: Sequence[str], t: str, step: int = 1) -> DataFrame:
    """A row for every step between each key's first and last; missing ones with nulls."""
    grid = df.groupBy(*keys).agg(F.min(t).alias("_lo"), F.max(t).alias("_hi")).select(*keys, F.explode(F.sequence("_lo", "_hi", F.lit(step).cast("long"))).alias(t))
    return grid.join(df, [*keys, t], "left")


def resample_mean(df: DataFrame, keys: Sequence[str], t: str, cols: Sequence[str], width: int) -> DataFrame:
    """Means of bins of `width`; bins without rows appear with nulls."""
    binned = df.groupBy(*keys, F.floor(F.col(t) / width).alias("bin")).agg(*[F.avg(c).alias(c) for c in cols])
    return densify(binned, keys, "bin")


def spearman(df: DataFrame, keys: Sequence[str], cols: Sequence[str], held: int = HELD) -> DataFrame:
    """Rank correlation of every pair of columns per key, over rows complete in both.

    All pairs are one written table (keys, pair, x, y), and the values of both sides get their ranks
    together (`ranked`), so no window holds a whole series.
    """
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    by = [*keys, "a", "b"]
    rows = df.select(*keys, F.explode(F.array(*pairs)).alias("_p")).select(*keys, "_p.*").filter("x is not null and y is not null")
    rows = materialise(rows, "pairs")
    sides = F.array(*[F.struct(F.lit(c).alias("_side"), F.col(c).alias("_value")) for c in ("x", "y")])
    ranks = ranked(rows.select(*by, F.explode(sides).alias("_s")).select(*by, "_s.*"), [*by, "_side"], "_value", held)
    for c in ("x", "y"):
        own = ranks.filter(F.col("_side") == c).select(*[F.col(k).alias(f"_r_{k}") for k in by], F.col("v").alias("_v"), average_rank().alias(f"_{c}"))
        same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in by]
        rows = rows.join(own, reduce(lambda p, q: p & q, [*same, F.col(c) == F.col("_v")])).drop("_v", *[f"_r_{k}" for k in by])
    return rows.groupBy(*by).agg(F.corr("_x", "_y").alias("rho"))


def group_means(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in cols])


def value_counts(df: DataFrame, c: str, top: int | None = None) -> DataFrame:
    out = df.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("n"), c).limit(top) if top else out


def top_rows(df: DataFrame, by: str, k: int, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(by), *ties).limit(k)


def best_row(df: DataFrame, keys: Sequence[str], by: str, *ties: str) -> DataFrame:
    """The row with the largest value per key, the first by `ties` of equals (max_by would take the last)."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(by), *ties)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def decimate(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: int, chunk: Column | None = None) -> DataFrame:
    """Every step-th row of each series, from its first. chunk: cuts a long series into tasks; it must rise with `order`."""
    if chunk is not None:
        return numbered(df, keys, order, chunk, "_r").filter(F.col("_r") % step == 0).drop("_r")
    return df.withColumn("_r", F.row_number().over(ordered(keys, order)) - 1).filter(F.col("_r") % step == 0).drop("_r")


def interval_max(events: DataFrame, rows: DataFrame, keys: Sequence[str], t: str, x: str) -> DataFrame:
    """Largest x of the rows within each event [start, end] of the same keys. The events are written: they are read three times."""
    return max_in(materialise(events, "events"), rows, keys, t, x, f"max_{x}")

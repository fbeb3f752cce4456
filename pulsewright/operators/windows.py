"""Trailing windows, gaps and islands.

All frames end at the current row: nothing looks ahead. Times are whole numbers
(buckets such as minutes or hours), so a frame (t - w, t] is rangeBetween(-(w-1), 0).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pulsewright.functions.exprs import array_median, col
from pulsewright.operators.chunked import chunk_of, with_runs


def ordered(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def trailing(keys: Sequence[str], t: str, w: int) -> WindowSpec:
    """(t - w, t] on whole-numbered times."""
    return Window.partitionBy(*keys).orderBy(t).rangeBetween(-(w - 1), 0)


def trailing_rows(keys: Sequence[str], order: Sequence[str], n: int) -> WindowSpec:
    return ordered(keys, order).rowsBetween(-(n - 1), 0)


def trailing_median(x: str | Column, frame: WindowSpec) -> Column:
    """Median over a frame: there is no median window function, so the frame's values are collected and sorted."""
    return array_median(F.collect_list(col(x)).over(frame))


def in_chunks(df: DataFrame, t: str, chunk: int, halo: int) -> DataFrame:
    """Cut a long series into chunks of time that carry the `halo` rows' time before them.

    Adds _chunk, to be a partition key of windows that look back at most `halo`,
    and _own; filter on _own afterwards. A single series is then computed by as
    many tasks as it has chunks, at the price of reading 1 + halo/chunk times.
    """
    first = F.floor(F.col(t) / chunk)
    out = df.withColumn("_chunk", F.explode(F.sequence(first, F.floor((F.col(t) + halo) / chunk))))
    return out.withColumn("_own", F.col("_chunk") == F.floor(F.col(t) / chunk))


def with_lookback(df: DataFrame, t: str, start: int, end: int, lookback: int) -> tuple[DataFrame, Column]:
    """(rows of [start - lookback, end), condition for [start, end)).

    A filter on the order key is not pushed below a window by Catalyst. The first
    result is filtered before the windows, so that the scan skips the rest; the
    condition goes after them. Exact for frames that look back at most `lookback`.
    """
    return df.filter((F.col(t) >= start - lookback) & (F.col(t) < end)), (F.col(t) >= start) & (F.col(t) < end)


def prefix_sum_window(df: DataFrame, keys: Sequence[str], t: str, x: str, w: int, name: str) -> DataFrame:
    """Sum over (t - w, t] as the difference of two prefix sums: linear for wide frames, equal up to rounding."""
    run = Window.partitionBy(*keys).orderBy(t).rangeBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(t).rangeBetween(Window.unboundedPreceding, -w)
    out = df.withColumn("_p", F.sum(x).over(run))
    return out.withColumn(name, F.col("_p") - F.coalesce(F.last("_p", True).over(before), F.lit(0.0))).drop("_p")


def persists_time(df: DataFrame, above: str, t: str, keys: Sequence[str], steps: int | Column, max_gap: float, name: str = "alert_flag", chunk: int | None = None, start: str | None = None) -> DataFrame:
    """True once `above` has held for `steps` units of time, the current one included, without a gap over max_gap.

    chunk: units of time of one task of a long series. start: a name for the start of the row's run.
    """
    out = _runs(df, above, t, keys, max_gap, chunk)
    out = out.withColumn(name, F.coalesce(F.col(above) & (F.col(t) - F.col("_run") + 1 >= steps), F.lit(False))).drop("_before", "_runs")
    return out.withColumnRenamed("_run", start) if start else out.drop("_run")


def _runs(df: DataFrame, flag: str, t: str, keys: Sequence[str], max_gap: float, chunk: int | None) -> DataFrame:
    """_run and _runs of with_runs, over chunks or in one window a series."""
    if chunk:
        return with_runs(df, keys, [t], t, flag, max_gap, chunk_of(t, chunk))
    w = ordered(keys, [t])
    goes_on = F.coalesce(F.lag(flag).over(w) & (F.col(t) - F.lag(t).over(w) <= max_gap), F.lit(False))
    out = df.withColumn("_begins", F.coalesce(F.col(flag) & ~goes_on, F.lit(False)))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumns({"_run": F.last(F.when(F.col("_begins"), F.col(t)), True).over(so_far), "_runs": F.sum(F.col("_begins").cast("long")).over(so_far)}).drop("_begins")


def persists_count(df: DataFrame, above: str, keys: Sequence[str], order: Sequence[str], steps: int, name: str = "alert_flag") -> DataFrame:
    """True from the steps-th consecutive true row on."""
    w = ordered(keys, order)
    out = df.withColumn("_island", F.sum((~F.col(above)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.sum(F.col(above).cast("int")).over(ordered([*keys, "_island"], order).rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn(name, F.col(above) & (n >= steps)).drop("_island")


def islands(df: DataFrame, flag: str, t: str, keys: Sequence[str], max_gap: float, name: str = "event_id", chunk: int | None = None) -> DataFrame:
    """The rows with a true flag, numbered by run within their keys; the gap is to the previous row of any flag. chunk as in persists_time."""
    return _runs(df, flag, t, keys, max_gap, chunk).withColumnRenamed("_runs", name).filter(F.col(flag)).drop("_run", "_before")


def sequences(df: DataFrame, keys: Sequence[str], t: str, cols: Sequence[str], n: int) -> DataFrame:
    """Each row with the last n rows of its series as an array, and whether they are without a gap; rows with fewer are left out."""
    frame = trailing_rows(keys, [t], n)
    out = df.withColumn("sequence", F.collect_list(F.struct(t, *cols)).over(frame)).filter(F.size("sequence") == n)
    return out.withColumn("contiguous", F.col(t) - F.element_at("sequence", 1)[t] == n - 1)

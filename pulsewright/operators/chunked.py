"""Runs and row numbers of a series whose chunks of time are separate tasks.

What a chunk must know of all rows before it fits into one row, its link: the last row before
it, the start of the latest run, and how many runs and rows there were. A chunk sums
itself up likewise (first and last row, starts inside it), and summaries merge
associatively: starts and rows add up, the later start wins, and whether a chunk's first row
goes on the run before it follows from the last row of the one before. So links are running
aggregates over one row a chunk, and the rows of one series are worked on by as many tasks
as it has chunks. The input is read twice: once for the summaries, with the columns that
they need, and once for the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsewright.functions.exprs import col


def chunk_of(t: str, size: int) -> Column:
    return F.floor(F.col(t) / size)


def _before(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def _linked(rows: DataFrame, links: DataFrame, part: Sequence[str]) -> DataFrame:
    """Rows with their chunk's link; keys may be null."""
    named = links.withColumnsRenamed({k: f"_link_{k}" for k in part})
    return rows.join(named, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_link_{k}")) for k in part])).drop(*[f"_link_{k}" for k in part])


def with_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], t: str, flag: str | Column, max_gap: float, chunk: Column, previous: Sequence[str] = ()) -> DataFrame:
    """Adds _before (struct of t, flag and `previous` of the row before; null for a series' first), _run and _runs.

    _run: where the latest run of true flags began (t); on a row with a true flag, its own run's
    start. _runs: runs begun so far. A row goes on the run of the row before it if both
    flags are true and they are at most max_gap apart. chunk must rise with `order`.
    """
    keys, part = list(keys), [*keys, "_part"]
    w = Window.partitionBy(*part).orderBy(*order)
    rows = df.withColumns({"_part": chunk, "_flag": F.coalesce(col(flag), F.lit(False))})
    row = F.struct(F.col(t).alias("t"), F.col("_flag").alias("flag"), *[F.col(c) for c in previous])
    goes_on = lambda before: F.coalesce(before["flag"] & (F.col(t) - before["t"] <= max_gap), F.lit(False))

    own = rows.withColumn("_prior", F.lag(row).over(w))
    inside = own.withColumn("_begins", F.col("_prior").isNotNull() & F.col("_flag") & ~goes_on(F.col("_prior")))
    place = F.struct(*order)
    chunks = inside.groupBy(*part).agg(F.min_by(row, place).alias("_head"), F.max_by(row, place).alias("_tail"), F.max(F.when(F.col("_begins"), F.col(t))).alias("_start"), F.sum(F.col("_begins").cast("long")).alias("_n"))
    chunks = chunks.withColumn("_seen", F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_part")))
    joined = F.coalesce(F.col("_seen.flag") & (F.col("_head.t") - F.col("_seen.t") <= max_gap), F.lit(False))
    begins = F.col("_head.flag") & ~joined
    chunks = chunks.withColumns({"_start": F.coalesce("_start", F.when(begins, F.col("_head.t"))), "_n": F.col("_n") + begins.cast("long")})
    earlier = _before(keys)
    links = chunks.select(*part, "_seen", F.last("_start", True).over(earlier).alias("_since"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_had"))

    out = _linked(rows, links, part)
    out = out.withColumn("_before", F.coalesce(F.lag(row).over(w), F.col("_seen")))
    out = out.withColumn("_begins", F.col("_flag") & ~goes_on(F.col("_before")))
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    run = F.coalesce(F.last(F.when(F.col("_begins"), F.col(t)), True).over(so_far), F.col("_since"))
    return out.withColumns({"_run": run, "_runs": F.col("_had") + F.sum(F.col("_begins").cast("long")).over(so_far)}).drop("_part", "_flag", "_seen", "_since", "_had", "_begins")


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, name: str) -> DataFrame:
    """The row's number within its keys, from 0: its number in its chunk and the rows of all chunks before."""
    keys, part = list(keys), [*keys, "_part"]
    rows = df.withColumn("_part", chunk)
    counts = rows.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    links = counts.select(*part, F.coalesce(F.sum("_n").over(_before(keys)), F.lit(0)).alias("_had"))
    out = _linked(rows, links, part)
    return out.withColumn(name, F.col("_had") + F.row_number().over(Window.partitionBy(*part).orderBy(*order)) - 1).drop("_part", "_had")


def with_run_lookback(df: DataFrame, keys: Sequence[str], order: Sequence[str], t: str, start: int, end: int, flag: str | Column, max_gap: float, first: int) -> tuple[DataFrame, Column]:
    """(rows that the runs of [start, end) depend on, condition for [start, end)).

    How far a run reaches back depends on the data. A series' look-back is long enough once it
    holds a row before `start` that surely goes on no run: one without a flag, or one whose
    predecessor is known and broken off or too far away. Nothing before that row matters. It begins
    with `first` and doubles for as long as a series has no such row and there is something left
    before; each round reads its range of time only, and the driver gets one number. The
    filters on t are plain comparisons, so they reach the scan.
    """
    keys = list(keys)
    own = (F.col(t) >= start) & (F.col(t) < end)
    w = Window.partitionBy(*keys).orderBy(*order)
    f = F.coalesce(col(flag), F.lit(False))
    needed = df.filter(own).select(*keys).distinct()
    span, least = first, None
    while True:
        lo = start - span
        rows = df.filter((F.col(t) >= lo) & (F.col(t) < start)).withColumn("_prior", F.lag(F.struct(F.col(t).alias("t"), f.alias("f"))).over(w))
        broken = F.when(F.col("_prior").isNull(), F.col(t) - lo > max_gap).otherwise(~(F.col("_prior.f") & (F.col(t) - F.col("_prior.t") <= max_gap)))
        found = rows.groupBy(*keys).agg(F.max(F.when(~f | broken, F.col(t))).alias("_from"), F.lit(True).alias("_past"))
        known = needed.join(found, keys, "left")
        # a series without any row in a range longer than the gap begins anew in any case
        known = known.withColumn("_from", F.when(F.col("_past").isNull() & F.lit(span > max_gap), F.lit(start)).otherwise(F.col("_from")))
        if not known.filter("_from is null").count():
            break
        least = df.agg(F.min(t)).first()[0] if least is None else least
        if lo <= least:
            break
        span *= 2
    rows = df.filter((F.col(t) >= lo) & (F.col(t) < end)).join(known.select(*keys, "_from"), keys)
    return rows.filter(F.col(t) >= F.coalesce("_from", F.lit(lo))).drop("_from"), own

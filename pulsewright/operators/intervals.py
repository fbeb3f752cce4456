"""Interval joins by bins: each pair once, by an equi-join.

Intervals are sorted into levels by their length; on level k bins are 2**k wide, so an interval of
that level touches three bins at most, whatever its length. A point lies in one bin of each
level that occurs (the driver gets the levels, 64 at most). So both sides become rows with (keys, level, bin),
two to three for an interval and one a level for a point, and what meets in a bin is
about as long as the bin is wide: work follows the input and the pairs, not their product. Skewed
bins are left to AQE's splitting of skewed joins.

Ends are included. An interval with a null end, or whose end lies before its start, has no points;
keys that are null match nothing, as in any equi-join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _level(start: str, end: str) -> Column:
    """The least k with 2**k >= the number of points of the interval."""
    return F.ceil(F.log2((F.col(end) - F.col(start) + 1).cast("double"))).cast("int")


def _bin(x: Column, level: Column) -> Column:
    return F.call_function("shiftright", x.cast("long"), level)


def points_in(points: DataFrame, intervals: DataFrame, keys: Sequence[str], t: str, start: str = "start", end: str = "end") -> DataFrame:
    """Every point (whole number t) with every interval [start, end] of the same keys that holds it.

    Columns of both sides; apart from the keys their names must differ.
    """
    keys = list(keys)
    spans = intervals.filter(F.col(start) <= F.col(end)).withColumn("_level", _level(start, end))
    levels = sorted(r[0] for r in spans.select("_level").distinct().collect())
    spans = spans.withColumn("_bin", F.explode(F.sequence(_bin(F.col(start), F.col("_level")), _bin(F.col(end), F.col("_level")))))
    own = F.array(*[F.struct(F.lit(k).alias("_level"), _bin(F.col(t), F.lit(k)).alias("_bin")) for k in levels]) if levels else F.expr("cast(array() as array<struct<_level:int,_bin:bigint>>)")
    met = points.withColumn("_at", F.explode(own)).select(*points.columns, "_at._level", "_at._bin")
    return met.join(spans, [*keys, "_level", "_bin"]).filter(F.col(t).between(F.col(start), F.col(end))).drop("_level", "_bin")


def overlaps(a: DataFrame, b: DataFrame, keys: Sequence[str], a_ends: tuple[str, str], b_ends: tuple[str, str]) -> DataFrame:
    """Every pair of an interval of a and one of b that have a point in common, once: the later start lies in the other one.

    Columns of both sides; apart from the keys their names must differ.
    """
    a, b = (x.filter(F.col(lo) <= F.col(hi)) for x, (lo, hi) in ((a, a_ends), (b, b_ends)))
    a_later = points_in(a, b, keys, a_ends[0], *b_ends)
    b_later = points_in(b, a, keys, b_ends[0], *a_ends).filter(F.col(b_ends[0]) > F.col(a_ends[0]))
    return a_later.unionByName(b_later)


def with_overlap(a: DataFrame, b: DataFrame, keys: Sequence[str], a_ends: tuple[str, str], b_ends: tuple[str, str], ids: Sequence[str], without: bool = False) -> DataFrame:
    """The rows of a that overlap one of b, or those that overlap none; `ids` tell a's rows apart."""
    hit = overlaps(a.select(*dict.fromkeys([*keys, *ids, *a_ends])), b.select(*keys, *b_ends), keys, a_ends, b_ends).select(*ids).distinct()
    return a.join(hit, list(ids), "left_anti" if without else "left_semi")


def label_points(points: DataFrame, intervals: DataFrame, keys: Sequence[str], t: str, label: str, order: str, ids: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """points with the label of the interval that holds them; the last by `order` if there are several, null for none. `ids` tell points apart."""
    hits = points_in(points.select(*dict.fromkeys([*keys, *ids, t])), intervals, keys, t, start, end)
    best = hits.groupBy(*ids).agg(F.max_by(label, order).alias(label))
    return points.join(best, list(ids), "left")


def max_in(intervals: DataFrame, points: DataFrame, keys: Sequence[str], t: str, x: str, name: str) -> DataFrame:
    """intervals (keys, start, end, ...) with the largest x of the points that they hold."""
    own = points.select(*keys, F.col(t).alias("_t"), F.col(x).alias("_x"))
    best = points_in(own, intervals.select(*keys, "start", "end").distinct(), keys, "_t").groupBy(*keys, "start", "end").agg(F.max("_x").alias(name))
    return intervals.join(best, [*keys, "start", "end"], "left")

"""Exact order statistics over the cluster: quantiles, ranks and medians without one's own value.

Equal values of a key become one row with their number, so a value that a third of all rows
have is one row. Up to HELD of these are numbered by one window a key. More are dealt into
ranges of (key, value), written with the number of their range so that the ranges
stay what they are, counted by range, and numbered within their range from the counts of the
ranges before. A quantile then takes two values, whose ranks are known, out of
one or two ranges; no task holds more than a range.

Nulls have no rank. NaN must have become null (sources see to that). Keys may be null. An
empty table gives no rows; a key whose values are all null has none.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsewright.cluster import materialise, shuffle_partitions

#: Different (key, value) that are numbered without dealing them into ranges.
HELD = 1_000_000
_ALL = "_all"


def ranked(df: DataFrame, keys: Sequence[str], value: str, held: int = HELD) -> DataFrame:
    """keys, v (double), m, n and before: each different value, how many rows have it, how many rows the key has, and how many of them lie before.

    The rows with the value have the ranks before + 1 to before + m. A written table.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("v")).filter("v is not null")
    rows = rows.withColumn("v", F.col("v") + F.lit(0.0))  # -0.0 and 0.0 are one value
    each = materialise(rows.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("m")), "ranks")
    own = keys or [_ALL]
    if not keys:
        each = each.withColumn(_ALL, F.lit(1))
    if each.count() <= held:  # of a written table: from its footers
        to_here = Window.partitionBy(*own).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
        out = each.withColumns({"before": F.coalesce(F.sum("m").over(to_here), F.lit(0)), "n": F.sum("m").over(Window.partitionBy(*own))})
        return out.drop(_ALL)
    parts = max(shuffle_partitions(df.sparkSession), -(-each.count() // held))
    dealt = materialise(each.repartitionByRange(parts, *own, "v").withColumn("_range", F.spark_partition_id()), "ranks-dealt")
    counts = dealt.groupBy(*own, "_range").agg(F.sum("m").alias("_m"))
    earlier = Window.partitionBy(*own).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"_had": F.coalesce(F.sum("_m").over(earlier), F.lit(0)), "n": F.sum("_m").over(Window.partitionBy(*own))}).drop("_m")
    named = counts.withColumnsRenamed({k: f"_k_{k}" for k in [*own, "_range"]})
    within = Window.partitionBy(*own, "_range").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(named, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in [*own, "_range"]]))
    out = out.withColumn("before", F.col("_had") + F.coalesce(F.sum("m").over(within), F.lit(0)))
    return out.select(*keys, "v", "m", "before", "n")


def _at(rank: Column) -> Column:
    """Of a key's ranked values, the one at a rank (from 0)."""
    return F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("m")), F.col("v")))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: Mapping[str, float], held: int = HELD) -> DataFrame:
    """keys and a column for each of qs (name to share): exact, linear between the two ranks next to it.

    Without keys one row, of nulls if there is no value.
    """
    return quantiles_of(ranked(df, keys, value, held), keys, qs)


def quantiles_of(ranks: DataFrame, keys: Sequence[str], qs: Mapping[str, float]) -> DataFrame:
    """The same of a table of `ranked`."""
    place = {n: F.lit(float(q)) * (F.col("n") - 1) for n, q in qs.items()}
    ends = [a for n, p in place.items() for a in (_at(F.floor(p)).alias(f"_lo_{n}"), _at(F.ceil(p)).alias(f"_hi_{n}"))]
    needed = reduce(lambda a, b: a | b, [(F.col("before") <= F.ceil(p)) & (F.floor(p) < F.col("before") + F.col("m")) for p in place.values()])
    found = ranks.filter(needed).groupBy(*keys).agg(F.max("n").alias("n"), *ends)
    share = lambda n: place[n] - F.floor(place[n])
    return found.select(*keys, *[F.when(F.col(f"_lo_{n}") == F.col(f"_hi_{n}"), F.col(f"_lo_{n}")).otherwise(F.col(f"_lo_{n}") * (1 - share(n)) + F.col(f"_hi_{n}") * share(n)).alias(n) for n in qs])


def medians(df: DataFrame, columns: Sequence[str], held: int = HELD) -> dict[str, float | None]:
    """The median of each column, on the driver; null for a column without values."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("_column"), F.col(c).cast("double").alias("_value")) for c in columns])).alias("_x")).select("_x.*")
    return dict.fromkeys(columns) | {r[0]: r[1] for r in quantiles(long, ["_column"], "_value", {"m": 0.5}, held).collect()}


def average_rank() -> Column:
    """Of a row of `ranked`: the mean of the ranks (from 1) of the rows with its value."""
    return F.col("before") + (F.col("m") + 1) / 2.0


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str, held: int = HELD) -> DataFrame:
    """df's rows with a value and its rank (from 1; equal values share the mean of theirs) in the column `name`."""
    ranks = ranked(df, keys, value, held).select(*[F.col(k).alias(f"_r_{k}") for k in keys], F.col("v").alias("_v"), average_rank().alias(name))
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return df.join(ranks, reduce(lambda a, b: a & b, [*same, F.col(value).cast("double") == F.col("_v")])).drop("_v", *[f"_r_{k}" for k in keys])


def median_of_others(df: DataFrame, keys: Sequence[str], value: str, name: str, held: int = HELD) -> DataFrame:
    """df with the median of the values of all other rows with the same keys; null where there are none.

    Without the value at rank r, rank k of the others is rank k of all below r, and k + 1 from r on. So each
    row chooses among the values around the middle, which are four a key. A row without a value loses none.
    """
    keys = list(keys)
    ranks = ranked(df, keys, value, held)
    # of n - 1 others, the middle ones have the ranks lo and hi (from 0)
    lo, hi = F.floor((F.col("n") - 2) / 2), F.floor((F.col("n") - 1) / 2)
    # a row without a value leaves all n
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    group = ranks.groupBy(*keys).agg(F.max("n").alias("_n"), *[_at(r).alias(c) for c, r in (("_a", lo), ("_b", lo + 1), ("_c", hi), ("_d", hi + 1))], ((_at(low) + _at(high)) / 2.0).alias("_all"))
    own = ranks.select(*keys, F.col("v").alias("_v"), F.col("before").alias("_r"))
    named = lambda t: t.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], F.lit(True))
    group = named(group)
    out = df.join(named(own), same & (F.col(value).cast("double") == F.col("_v")), "left").drop(*[f"_k_{k}" for k in keys])
    out = out.join(group, same, "left") if keys else out.join(F.broadcast(group), how="left")  # without keys, one row
    n = F.col("_n")
    lo, hi = F.floor((n - 2) / 2), F.floor((n - 1) / 2)
    pick = lambda k, x, y: F.when(k < F.col("_r"), F.col(x)).otherwise(F.col(y))
    others = F.when(n > 1, (pick(lo, "_a", "_b") + pick(hi, "_c", "_d")) / 2.0)
    return out.withColumn(name, F.when(F.col("_r").isNull(), F.col("_all")).otherwise(others)).drop("_v", "_r", "_n", "_a", "_b", "_c", "_d", "_all", *[f"_k_{k}" for k in keys])

"""Connected components of an edge table: alternating large-star and small-star steps on whole tables.

Each step takes minima by one end, combined before the shuffle and written to the
shared folder, and then joins edges with them. Both sides of that join are plain
tables, so a hub with very many edges is a skewed key that Spark splits over tasks;
nothing is gathered by key. Every step is written, which cuts the lineage. Null ends,
loops and repeated edges are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsewright.cluster import discard, materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges (a, b) with a > b: each node's neighbours are tied to the least of them or itself."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges
    least = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "star-least")
    tied = both.join(least, "a")
    if large:
        out = tied.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    out = materialise(out.filter("a > b").distinct(), "star")
    discard(least)
    return out


def components(edges: DataFrame) -> DataFrame:
    """edges: columns a and b, any order. Returns (node, component) of every node with an edge to another; component is the least node reachable."""
    pairs = edges.filter("a is not null and b is not null and a <> b")
    now = materialise(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star")
    before = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before = seen
        large = _star(now, True)
        small = _star(large, False)
        discard(now, large)
        now = small
    out = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return out.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are cut into blocks, and time is counted in blocks (slots). Ideally all sources
flow at once, each in proportion to its weight, and when one runs out the others go on in
their proportions. In units v of what a weight of one has given, source s of weight w and n blocks
has given min(w v, n), so all together have given t(v) = sum of min(w v, n) by then: its j-th
block (from 0) flows from t(j / w) to t((j + 1) / w), whatever else runs out meanwhile. The block may not be
given before slot floor(t(j / w)), its release, and must be by slot ceil(t((j + 1) / w)), its deadline.
Of any stretch of slots the blocks that lie within it fill no more, as the flows add up to one
block a slot; so taking, in each slot, the released block with the earliest deadline meets all
deadlines, and at every time, over the whole run, each source is less than one block away from its flow.

Weights are exact fractions of the numbers as they are written, whatever their number: nothing is
rounded. Every document is used once and none is dropped. Sources of weight zero come last, evenly.

A block has BLOCK documents, or more where that made more than BLOCKS of them: so the driver,
which takes the slots one after the other, has a bounded number (besides a row a source), hands them on
in files, and the deviation is a millionth of the corpus.

Ranks within a source come from counts per hash bucket, so that a source of any
size is numbered by many tasks; within a bucket the order is by doc_id and, for ties and
rows without an id, by a hash of id and text, so a repeated task gives the same. A null
source is a source of its own, rows that repeat are rows like others, an empty table gives
an empty result. Columns of `docs` that are called like the new ones give way to them in
`place`; `mix` keeps all. Texts are not looked at, but for that hash.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction
from itertools import accumulate, batched

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsewright.cluster import BROADCAST_ROWS, new_path

BLOCK = 32
#: Blocks at most, but for a started one a source.
BLOCKS = 1_000_000
#: Rows of a schedule that the driver turns into a file at once.
ROWS_AT_ONCE = 50_000
#: Without target weights a source weighs its number of documents to this power.
FLATTEN = 0.7
BUCKET_ROWS = 20_000
LEAST_BUCKETS = 256
NO_SOURCE = "\u0000none"


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the proportions of the weights as they are written (0.3 is three tenths)."""
    exact = {s: Fraction(repr(float(w))) for s, w in weights.items()}
    if any(w < 0 for w in exact.values()):
        raise ValueError("weights must not be negative")
    unit = math.lcm(*(w.denominator for w in exact.values()))
    return {s: int(w * unit) for s, w in exact.items()}


class Flow:
    """t(v) of sources with whole weights and numbers of blocks, from slot `start` on, for v = j / w."""

    def __init__(self, blocks: dict[str, int], weights: dict[str, int], start: int = 0):
        order = sorted(blocks, key=lambda s: Fraction(blocks[s], weights[s]))
        self.ends = [Fraction(blocks[s], weights[s]) for s in order]  # when each runs out, in v
        self.given = [start, *accumulate((blocks[s] for s in order), initial=start)][1:]
        self.open = [sum(weights.values()), *(sum(weights.values()) - x for x in accumulate(weights[s] for s in order))]

    def at(self, j: int, w: int) -> tuple[int, int, int]:
        """(floor and ceiling of t(j / w), how many sources have run out)."""
        k = bisect_right(self.ends, Fraction(j, w))
        flown = j * self.open[k]
        return self.given[k] + flown // w, self.given[k] - (-flown // w), k


def schedule(blocks: dict[str, int], weights: dict[str, float]) -> Iterator[tuple]:
    """Rows (source, block, slot, release, deadline, phase: how many sources have run out at its release), slot after slot."""
    whole = whole_weights({s: weights[s] for s, n in blocks.items() if n > 0})
    slot = 0
    for shares in ({s: w for s, w in whole.items() if w > 0}, {s: 1 for s, w in whole.items() if w == 0}):
        names = sorted(shares)
        own = [blocks[s] for s in names]
        flow = Flow({s: blocks[s] for s in names}, shares, slot)
        waiting: list[tuple] = []  # by release

        def window(i: int, j: int, flow: Flow = flow, names: list[str] = names, shares: dict[str, int] = shares) -> tuple:
            release, _, phase = flow.at(j, shares[names[i]])
            return release, flow.at(j + 1, shares[names[i]])[1], i, j, phase

        for i in range(len(names)):
            heapq.heappush(waiting, window(i, 0))
        ready: list[tuple] = []  # by deadline
        for _ in range(sum(own)):
            while waiting and waiting[0][0] <= slot:
                release, deadline, i, j, phase = heapq.heappop(waiting)
                heapq.heappush(ready, (deadline, i, j, release, phase))
            deadline, i, j, release, phase = heapq.heappop(ready)
            yield names[i], j, slot, release, deadline, phase
            if j + 1 < own[i]:
                heapq.heappush(waiting, window(i, j + 1))
            slot += 1


_TABLE = "_src string, block long, slot long, release long, deadline long, phase int"


def _stored(spark: SparkSession, rows: Iterator[tuple]) -> tuple[DataFrame, int]:
    """The rows of a schedule as a table in the shared folder, and their number; the driver holds some of them at a time."""
    path, names, n = new_path(spark, "schedule"), [c.split()[0] for c in _TABLE.split(", ")], 0
    kinds = [pa.string(), *[pa.int64()] * 4, pa.int32()]
    fs, folder = pafs.FileSystem.from_uri(path)
    fs.create_dir(folder)
    for k, part in enumerate(batched(rows, ROWS_AT_ONCE)):
        columns = [pa.array(c, kind) for c, kind in zip(zip(*part, strict=True), kinds, strict=True)]
        pq.write_table(pa.table(columns, names=names), f"{folder}/part-{k:05d}.parquet", filesystem=fs)
        n += len(part)
    return spark.read.schema(_TABLE).parquet(path), n


NEW = ("phase", "block", "place", "slot", "release", "deadline")


def _placed(rows: DataFrame, weights: dict[str, float] | None, block: int) -> DataFrame:
    """rows: row (a struct with doc_id, source and maybe text). Returns row and the columns NEW."""
    spark = rows.sparkSession
    tie = F.xxhash64(*[F.col(f"row.`{c}`") for c in ("doc_id", "text") if c in rows.schema["row"].dataType.names])
    keyed = rows.select("row", F.coalesce(F.col("row.source").cast("string"), F.lit(NO_SOURCE)).alias("_src"), tie.alias("_tie"))
    sizes = {r["_src"]: r["n"] for r in keyed.groupBy("_src").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a source
    block = max(block, -(-sum(sizes.values()) // BLOCKS))
    n_buckets = max(LEAST_BUCKETS, sum(sizes.values()) // BUCKET_ROWS)
    keyed = keyed.withColumn("_bucket", F.pmod("_tie", F.lit(n_buckets)))
    counts = keyed.groupBy("_src", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_src", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = keyed.withColumn("_r", F.row_number().over(Window.partitionBy("_src", "_bucket").orderBy("row.doc_id", "_tie")) - 1).join(counts, ["_src", "_bucket"])
    rank = F.col("_before") + F.col("_r")
    ranked = ranked.select("row", "_src", F.floor(rank / block).alias("block"), (rank % block).alias("place"))

    blocks = {s: -(-n // block) for s, n in sizes.items()}
    named = {NO_SOURCE if s is None else s: w for s, w in (weights or {}).items()}
    table, n_rows = _stored(spark, schedule(blocks, {s: named.get(s, n**FLATTEN) for s, n in sizes.items()}))
    return ranked.join(F.broadcast(table) if n_rows <= BROADCAST_ROWS else table, ["_src", "block"]).select("row", *NEW)


def place(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK) -> DataFrame:
    """`docs` (doc_id, source, ...) with phase, block, place (in the block), slot, release and deadline.

    weights: target weight by source; sources that are not named share what their
    number of documents gives them. The order is by slot, then place.
    """
    return _placed(docs.select(F.struct(*docs.columns).alias("row")), weights, block).select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in NEW], *NEW)


def digest(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """doc_id, source, phase, block, place, slot, release and deadline of every row of `docs`."""
    return place(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source"), weights)


def mix(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The rows of `docs`, sorted over the partitions into the mixed order; columns as they were."""
    mixed = _placed(docs.select(F.struct(*docs.columns).alias("row")), weights, BLOCK)
    return mixed.select("row", "slot", "place").repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").select("row.*")

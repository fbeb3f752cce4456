"""Windows of symbols (bytes or words) that stand in several places: cover, prefix-partitioned groups, names of names.

*Cover.* Of each window of `span` symbols the last least hash of its `gram`-symbol
runs is its sample. It depends on the window alone, so equal windows have their
sample at the same shift: what a difference cover is for, with one suffix
in some tens instead of a fixed share of all. The windows of one sample are
consecutive and make a piece; a piece whose sample stands nowhere else ends here.

*Groups.* Pieces are grouped by their sample, a prefix of all suffixes that begin
there. Equal pieces settle all their windows at once, and one of them stays to
be compared. Groups of more than `most` different pieces are split by longer
prefixes: a piece is halved, and of one half the sample grows to the left, of the
other to the right, as far as all of its windows reach. So prefixes vary in
length until each group fits a task; a window that is itself too frequent ends as
one prefix of full length, and is counted, not gathered.

*Names.* Within a group all strings of the least width are sorted and named by
rank, then triples of names, then triples of those, up to `span` symbols: the
nodes of the group's suffix tree, level by level, cut at depth `span`. Suffixes
that are neighbours there with the same name are equal in `span` symbols.

Samples and equal pieces are told by 64-bit hashes of their symbols and of pairs of
such; names are exact, but for the 64-bit hashes that stand for words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsewright.cluster import discard, materialise, only_rows_of
from pulsewright.llm import textkit as K

#: Different pieces of a group at most; larger groups are split by longer prefixes.
MOST = 128
#: Bytes of contexts that are named at once, unless one group has more.
TOGETHER = 1 << 18
_NAME_BITS = 21

#: a, b: the text's key; windows at..at + n - 1 (in symbols) of the text's bytes s..e - 1.
PIECE = "a long, b long, node long, segment long, at int, n int, s int, e int"


@dataclass
class Symbols:
    values: np.ndarray  # uint64 of each symbol
    cut: np.ndarray  # rows' offsets into them
    starts: np.ndarray | None = None  # of symbols, in bytes; None: each byte is one
    ends: np.ndarray | None = None

    def begin(self, at: np.ndarray) -> np.ndarray:
        return at if self.starts is None else self.starts[at]

    def end(self, at: np.ndarray) -> np.ndarray:
        """Where the symbols before `at` end."""
        return at if self.ends is None else self.ends[at - 1]


Reader = Callable[[np.ndarray, np.ndarray], Symbols]


def of_bytes(data: np.ndarray, offsets: np.ndarray) -> Symbols:
    return Symbols(K.BYTE_VALUE[data], offsets)


def of_words(data: np.ndarray, offsets: np.ndarray) -> Symbols:
    """Words between ASCII white space."""
    starts, ends, at = K.word_spans(data, offsets, K.NON_SPACE)
    return Symbols(K.word_hashes(data, starts, ends), at, starts, ends)


def pieces(x: Symbols, span: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, first window, number of windows, sample's hash, piece's hash) of the pieces of all rows, in order."""
    none = np.zeros(0, np.int64)
    if len(x.values) < span:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    prefix = K.prefix_hash(x.values)
    grams = K.rolling_hash(prefix, gram)
    picked = K.window_min(grams, span - gram + 1)
    rows = np.flatnonzero(np.diff(x.cut) >= span)
    lo, hi = x.cut[rows], x.cut[rows + 1] - span + 1
    first = np.union1d(np.flatnonzero(picked[1:] != picked[:-1]) + 1, lo)
    row = np.searchsorted(lo, first, "right") - 1
    stop = np.minimum(np.append(first[1:], len(picked)), hi[row]) if len(rows) else first
    ok = (row >= 0) & (first < stop)
    row, first, stop = row[ok], first[ok], stop[ok]
    node = grams[picked[first]]
    segment = K.mix(K.span_hash(prefix, first, stop - 1 + span) + (picked[first] - first).astype(np.uint64))
    return rows[row], first, stop - first, node, segment


def find_pieces(read: Reader, span: int, gram: int):
    """Texts (a, b, text) to their pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in K.chunks(batch.column("text")):
                x = read(data, offsets)
                row, first, n, node, segment = pieces(x, span, gram)
                s, e, own = x.begin(first) - offsets[row], x.end(first + n - 1 + span) - offsets[row], pa.array(row)
                keys = [batch.column(k).slice(i, j - i).take(own) for k in ("a", "b")]
                values = [pa.array(v.view(np.int64)) for v in (node, segment)] + [pa.array(v.astype(np.int32)) for v in (first - x.cut[row], n, s, e)]
                yield pa.RecordBatch.from_arrays([*keys, *values], ["a", "b", "node", "segment", "at", "n", "s", "e"])

    return run


def names(base: np.ndarray, width: int, span: int) -> np.ndarray:
    """Names of the strings of `span` symbols from each place on; base has one value for each string of `width`. Equal strings, equal names."""
    ids = np.unique(base, return_inverse=True)[1].astype(np.uint64)
    while width < span:
        step, last = (width, 2 * width) if 3 * width <= span else ((span - width) // 2, span - width)
        n = max(0, len(ids) - last)
        triples = ids[:n] << np.uint64(2 * _NAME_BITS) | ids[step : step + n] << np.uint64(_NAME_BITS) | ids[last : last + n]
        ids = np.unique(triples, return_inverse=True)[1].astype(np.uint64)
        width += last
    return ids.astype(np.int64)


def _base(x: Symbols, data: np.ndarray) -> tuple[np.ndarray, int]:
    if x.starts is not None:
        return x.values, 1
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data),), "<u8", padded.data, strides=(1,)).copy(), 8


def _matched(t: pa.Table, read: Reader, span: int, first_stays: bool) -> pa.RecordBatch:
    """Runs (a, b, at, n) of the repeated windows of whole groups."""
    _, _, data, offsets = next(K.chunks(t.column("ctx"), 1 << 62))
    x = read(data, offsets)
    if len(x.values) >= 1 << _NAME_BITS:
        raise ValueError("a group is too large to be named")
    base, width = _base(x, data)
    name = names(base, width, span)
    n = t.column("n").to_numpy()
    row = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    name = name[x.cut[row] + within]
    if first_stays:
        a = t.column("a").to_numpy()[row]
        order = np.argsort(name, kind="stable")
        new = np.flatnonzero(np.diff(name[order], prepend=-1))
        least = np.minimum.reduceat(a[order], new)
        hit = a > least[np.searchsorted(name[order][new], name)]
    else:
        weight = t.column("w").to_numpy()
        hit = (np.bincount(name, weight[row])[name] > 1) & (weight[row] == 1)
    starts = hit & ~np.concatenate([[False], hit[:-1] & (row[1:] == row[:-1])])
    ends = hit & ~np.concatenate([hit[1:] & (row[1:] == row[:-1]), [False]])
    s, e = np.flatnonzero(starts), np.flatnonzero(ends)
    own = pa.array(row[s])
    at = t.column("at").to_numpy()[row[s]] + within[s]
    return pa.RecordBatch.from_arrays([t.column("a").combine_chunks().take(own), t.column("b").combine_chunks().take(own), pa.array(at.astype(np.int32)), pa.array((e - s + 1).astype(np.int32))], ["a", "b", "at", "n"])


def _match(read: Reader, span: int, first_stays: bool):
    """Rows (node, a, b, at, n, w, ctx), a group after the other, to runs of repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.column("ctx").nbytes for b in held) < TOGETHER:
                continue
            t = pa.Table.from_batches(held)
            node = t.column("node").to_numpy()
            whole = int(np.flatnonzero(node != node[-1])[-1]) + 1 if node[0] != node[-1] else 0  # the last group may go on
            if whole:
                yield _matched(t.slice(0, whole), read, span, first_stays)
                held = t.slice(whole).combine_chunks().to_batches()
        if held:
            yield _matched(pa.Table.from_batches(held), read, span, first_stays)

    return run


SUB = "a long, b long, node long, segment long, at int, n int, w long, ctx binary, g int, gram int"


def _split(read: Reader, span: int, gram: int):
    """Halves of pieces, each with a sample that has grown; g: the sample's place in the piece, below 0 if not known."""

    def halves(x: Symbols, n: int, g: int, gram: int) -> Iterator[tuple[int, int, int, int]]:
        grow = (span - gram + 1) // 2
        if (k := min(n, g - grow + 1)) > 0:
            yield 0, k, g - grow, gram + grow
        if (j := max(0, g - grow + 1)) < n:
            yield j, n - j, g - j, span - grow + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            row = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            for i in range(batch.num_rows):
                data = np.frombuffer(row["ctx"][i], np.uint8)
                x = read(data, np.array([0, len(data)]))
                prefix, g, own = K.prefix_hash(x.values), row["g"][i], row["gram"][i]
                if g < 0:
                    g = int(K.window_min(K.rolling_hash(prefix[: span + 1], gram), span - gram + 1)[0])
                for j, n, at, size in halves(x, row["n"][i], g, own):
                    s, e = np.array([j + at, j]), np.array([j + at + size, j + n - 1 + span])
                    node, segment = K.span_hash(prefix, s, e)
                    segment = K.mix(np.array([segment + np.uint64(at)]))[0]
                    ctx = row["ctx"][i][int(x.begin(s[1:])[0]) : int(x.end(e[1:])[0])]
                    out.append((row["a"][i], row["b"][i], int(node.view(np.int64)), int(segment.view(np.int64)), row["at"][i] + j, n, row["w"][i], ctx, at, size))
            kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.int64(), pa.binary(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 10, kinds, strict=True)], [c.split()[0] for c in SUB.split(", ")])

    return run


def _settle(found: DataFrame, carry: list[str], first_stays: bool) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(runs of equal pieces, one of each of the different pieces of groups that have several with m, their number, tables to discard at the end)."""
    rep = F.struct("a", "b", "at", "n", *carry)
    segments = materialise(found.groupBy("node", "segment").agg(F.sum("w").alias("weight"), F.min("a").alias("least"), F.max("a").alias("most"), F.min(rep).alias("rep")), "repeats-segments")
    again = segments.filter("least < most" if first_stays else "weight > 1").select("node", "segment", "least")
    equal = found.join(again, ["node", "segment"])
    equal = (equal.filter("a > least") if first_stays else equal).select("a", "b", "at", "n")
    groups = segments.groupBy("node").agg(F.count(F.lit(1)).alias("m"), F.min("weight").alias("lightest"))
    groups = materialise(groups.filter("m > 1" if first_stays else "m > 1 and lightest = 1").select("node", "m"), "repeats-groups")
    reps = segments.join(groups, "node").select("node", "m", F.least("weight", F.lit(2)).alias("w"), "rep.*")
    return equal, reps, [segments, groups]


def repeated_windows(found: DataFrame, texts: DataFrame, read: Reader, span: int, gram: int, first_stays: bool = False, most: int = MOST) -> DataFrame:
    """(a, b, runs): of each text that has any, the runs (at, n) of windows that occur again. A table.

    found: the texts' pieces, a table that is discarded here. texts: a, b, text.
    first_stays: only windows that also stand in a text of smaller `a` count; else
    any other place does. A text may be given twice; then its windows occur twice.
    """
    counted = found.groupBy("node").agg(F.min("a").alias("lo"), F.max("a").alias("hi")) if first_stays else found.groupBy("node").agg(F.count(F.lit(1)).alias("k"))
    shared = materialise(counted.filter("lo < hi" if first_stays else "k > 1").select("node"), "repeats-shared")
    alive = materialise(found.join(shared, "node", "left_semi").withColumn("w", F.lit(1).cast("long")), "repeats-alive")
    discard(found, shared)

    equal, reps, old = _settle(alive, ["s", "e"], first_stays)
    keys = materialise(reps.select("a", "b").distinct(), "repeats-keys")
    own = only_rows_of(texts, keys, ["a", "b"]).dropDuplicates(["a", "b"])
    ctx = F.substring(F.col("text").cast("binary"), F.col("s") + 1, F.col("e") - F.col("s"))
    level = materialise(reps.join(own, ["a", "b"]).select("node", "m", "a", "b", "at", "n", "w", ctx.alias("ctx"), F.lit(-1).alias("g"), F.lit(gram).alias("gram")), "repeats-level")
    runs, old = equal, [alive, keys, *old]
    while True:
        old.append(level)
        small = level.filter(F.col("m") <= most).select("node", "a", "b", "at", "n", "w", "ctx").repartition("node").sortWithinPartitions("node")
        matched = materialise(small.mapInArrow(_match(read, span, first_stays), "a long, b long, at int, n int"), "repeats-matched")
        runs, old = runs.unionByName(matched), [*old, matched]
        large = level.filter(F.col("m") > most)
        if large.isEmpty():
            break
        halves = materialise(large.select("a", "b", "at", "n", "w", "ctx", "g", "gram").mapInArrow(_split(read, span, gram), SUB), "repeats-halves")
        equal, level, more = _settle(halves, ["ctx", "g", "gram"], first_stays)
        level, old, runs = materialise(level, "repeats-level"), [*old, halves, *more], runs.unionByName(equal)
    out = materialise(runs.groupBy("a", "b").agg(F.collect_list(F.struct("at", "n")).alias("runs")), "repeats-runs")
    discard(*old)
    return out


def covered(runs: pa.Array, span: int, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """For each text, given its runs and its number of symbols, the mask of the symbols that lie in a window of a run."""
    cut = runs.offsets.to_numpy()
    at, n = (runs.flatten().field(c).to_numpy() for c in ("at", "n"))
    cut = cut - cut[0]
    for r, size in enumerate(sizes):
        s, k = at[cut[r] : cut[r + 1]].astype(np.int64), n[cut[r] : cut[r + 1]]
        depth = np.zeros(size + 1, np.int64)
        np.add.at(depth, s, 1)
        np.add.at(depth, s + k - 1 + span, -1)
        yield np.cumsum(depth[:-1]) > 0

"""Source divergence audit: how the terms of a source differ from those of other sources of its language.

Terms are runs of A-Z, a-z and bytes from 0x80 on, lower-cased in A-Z only. A task
looks the bytes of many texts up in one table to find the boundaries, groups the
slices by xxhash, verifies every slice byte by byte against its group's first (a group
that is not one term is split by its bytes), and hands on counts, not terms: one row for
each (lang, source, term) of what it has seen since it last ran full.

A language keeps its terms of at least LEAST_DOCS documents. With c of N occurrences
and V kept terms, p = 1 + floor(10**9 (c + 2) / (N + 2 V)), and two distributions differ by
the sum of floor((p - q)**2 / (p + q)). All of it is whole numbers: the division is done in three
steps of 1000, so it is exact for up to 9 x 10**15 occurrences.

Pairs of sources: the kept terms of a language are dealt into blocks by a hash, so that a task
holds one block (some BLOCK counts), whatever its language's size. A block is a CSR
matrix of sources x terms. Terms that neither source has count as one product; for the others a
source's row is spread over the terms, compared with all stored entries at once and summed
by reduceat. Blocks add up by (lang, source, other).

Nulls of text, lang and source are ''. A (lang, source) without terms is a group all the same;
a language that keeps none gives zeros. Rows that repeat, or repeat an id, are documents like others. Equal
values rank by the item's UTF-8 bytes. A long text is one chunk of its own. An empty table
gives an empty result. Only text, lang and source are read, whatever other columns are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsewright.cluster import discard, materialise, ship, sized
from pulsewright.llm import textkit as K

LEAST_DOCS = 10
TOP = 10
UNIT = 10**9
#: Counts (of a term in a source) of a block of terms; a task's memory is some 100 bytes for each.
BLOCK = 50_000
#: Counts that a task holds before it hands them on.
HELD = 1_200_000

TERM = np.zeros(256, bool)
TERM[0x61:0x7B] = TERM[0x80:] = True  # after lower-casing


# --- counting ------------------------------------------------------------------------


def grouped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, raw: bytes, hashed=xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """(group of each slice, first slice of each group): equal slices are one group, others are not."""
    slices = [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
    h = np.fromiter(map(hashed, slices), np.uint64, len(slices))
    _, first, group = np.unique(h, return_index=True, return_inverse=True)
    n = ends - starts
    lead = first[group]
    ok = n == n[lead]
    # bytes of all slices against those of their group's first, in one comparison
    own = np.arange(int(n[ok].sum())) - np.repeat(np.cumsum(n[ok]) - n[ok], n[ok])
    same = data[own + np.repeat(starts[ok], n[ok])] == data[own + np.repeat(starts[lead[ok]], n[ok])]
    if not ok.all() or not same.all():  # slices of one hash differ: name them by their bytes
        names: dict[bytes, int] = {}
        group = np.fromiter((names.setdefault(x, len(names)) for x in slices), np.int64, len(slices))
        first = np.unique(group, return_index=True)[1]
    return group, first


def _summed(rows: np.ndarray) -> np.ndarray:
    """Keys (row 0) without repeats, and the sums of the other rows by key."""
    key, inverse = np.unique(rows[0], return_inverse=True)
    out = np.zeros((len(rows), len(key)), np.int64)
    out[0] = key
    for total, x in zip(out[1:], rows[1:], strict=True):
        np.add.at(total, inverse, x)
    return out


class Counts:
    """Occurrences and documents of each (group of documents, term), as sorted keys; terms are numbered as they come."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.terms: dict[bytes, int] = {}
        self.parts: list[np.ndarray] = []
        self.n = 0

    def add(self, text: pa.Array, group_of: np.ndarray) -> None:
        for i, j, data, offsets in K.chunks(text, 16 * K.CHUNK_BYTES):
            low = K.LOWER[data]
            starts, ends, at = K.word_spans(low, offsets, TERM)
            if not len(starts):
                continue
            raw = low.tobytes()
            own, first = grouped(low, starts, ends, raw)
            # a document and a term, with their occurrences; then a group of documents and a term
            pair, n = np.unique(K.row_of_words(at) * len(first) + own, return_counts=True)
            row, term = np.divmod(pair, len(first))
            names = self.terms
            number = np.fromiter((names.setdefault(raw[s:e], len(names)) for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)), np.int64, len(first))
            self._keep((group_of[i:j][row] << 32) | number[term], n, np.ones(len(n), np.int64))

    def _keep(self, key: np.ndarray, n: np.ndarray, docs: np.ndarray) -> None:
        self.parts.append(_summed(np.stack([key, n, docs])))
        self.n += self.parts[-1].shape[1]
        if self.n > HELD:
            self.parts = [_summed(np.concatenate(self.parts, 1))]
            self.n = self.parts[0].shape[1]

    def full(self) -> bool:
        return self.n > HELD // 2 or len(self.terms) > HELD

    def out(self, groups: list[tuple[str, str]], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
        if self.parts:
            counts = _summed(np.concatenate(self.parts, 1))
            lang, source = (pa.array([g[i] for g in groups], pa.string()) for i in (0, 1))
            terms = pa.array(list(self.terms), pa.binary()).cast(pa.string())
            for s in range(0, counts.shape[1], rows):
                key, n, docs = counts[:, s : s + rows]
                group = pa.array(key >> 32)
                yield pa.RecordBatch.from_arrays([lang.take(group), source.take(group), terms.take(pa.array(key & 0xFFFFFFFF)), pa.array(n), pa.array(docs)], _COUNTED)
        self.clear()


_COUNTED = ["lang", "source", "term", "n", "docs"]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, groups, told = Counts(), {}, 0
    for b in batches:
        pairs = zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), strict=True)
        group_of = np.fromiter((groups.setdefault(p, len(groups)) for p in pairs), np.int64, b.num_rows)
        counts.add(b.column("text"), group_of)
        if len(groups) > told:  # a row without a term tells that there is the group
            new = list(groups)[told:]
            told = len(groups)
            none = pa.nulls(len(new), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in new], pa.string()), pa.array([p[1] for p in new], pa.string()), none, pa.array([0] * len(new)), pa.array([0] * len(new))], _COUNTED)
        if counts.full():
            yield from counts.out(list(groups))
            groups, told = {}, 0
    yield from counts.out(list(groups))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents) of `docs`; and a row without a term for each (lang, source)."""
    ship(docs.sparkSession)
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    # tasks have added up what they can: a second partial sum before the shuffle would find next to nothing
    return counted.repartition("lang", "source", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


# --- shares and differences -----------------------------------------------------------


def share(c: np.ndarray, n: np.ndarray | int, v: int) -> np.ndarray:
    """1 + floor(10**9 (c + 2) / (n + 2 v)), exactly."""
    whole = n + 2 * v
    rest, out = c + 2, 0
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest = rest % whole
    return 1 + out


def share_of(c: Column, n: Column, v: Column) -> Column:
    """The same of columns of whole numbers."""
    whole, rest, out = n + 2 * v, c + 2, F.lit(0).cast("long")
    for _ in range(3):
        out, rest = out * 1000 + F.call_function("div", rest * 1000, whole), (rest * 1000) % whole
    return out + 1


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def difference_of(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


class Block:
    """Counts of one block of terms: a CSR matrix of shares, sources x terms, with a row for every source of the language."""

    def __init__(self, total: np.ndarray, v: int, source: np.ndarray, term: np.ndarray, n: np.ndarray):
        """total: occurrences by source; source, term, n: the counts, by source."""
        self.row, self.column = source, term
        self.p, self.none = share(n, total[source], v), share(np.zeros(len(total), np.int64), total, v)
        self.at = np.searchsorted(source, np.arange(len(total) + 1))
        self.width = int(term.max()) + 1 if len(term) else 0

    def from_(self, s: int, cells: int = 1 << 21) -> np.ndarray:
        """Differences of source s from each later one, summed over the block's terms."""
        lo, later = int(self.at[s + 1]), np.arange(s + 1, len(self.none))
        own = slice(int(self.at[s]), lo)
        spread, has = np.full(self.width, self.none[s]), np.zeros(self.width, bool)
        spread[self.column[own]], has[self.column[own]] = self.p[own], True
        column, row = self.column[lo:], self.row[lo:]
        both = has[column]
        here = difference(spread[column], self.p[lo:])  # terms that the other has
        twice = np.where(both, difference(spread[column], self.none[row]), 0)
        sums = self._by_row(np.stack([here - twice, both.astype(np.int64)]), s + 1)
        step = max(1, cells // max(1, own.stop - own.start))
        alone = [difference(self.p[own], self.none[later[k : k + step], None]).sum(1) for k in range(0, len(later), step)]  # as if it had none of ours
        neither = self.width - (own.stop - own.start) - np.diff(self.at)[s + 1 :] + sums[1]
        return sums[0] + (np.concatenate(alone) if alone else 0) + neither * difference(self.none[s], self.none[later])

    def _by_row(self, x: np.ndarray, first: int) -> np.ndarray:
        """Sums of the stored entries of each row from `first` on; reduceat over the rows that have some."""
        at = self.at[first:] - self.at[first]
        out = np.zeros((len(x), len(at) - 1), np.int64)
        some = np.flatnonzero(np.diff(at))
        if len(some):
            out[:, some] = np.add.reduceat(x, at[some], axis=1)
        return out


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by block; a block's first ones name its sources, the others are counts by source."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        ends = pc.run_end_encode(b.column("block")).run_ends.to_numpy() if b.num_rows else []
        start = 0
        for end in ends:
            part = b.slice(start, int(end) - start)
            if held and held[0].column("block")[0] != part.column("block")[0]:
                yield from _block(held)
                held = []
            held.append(part)
            start = int(end)
    if held:
        yield from _block(held)


def _block(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(held).combine_chunks()
    heads = rows.filter(pc.is_null(rows.column("term")))
    names = heads.column("source").combine_chunks()
    counts = rows.filter(pc.is_valid(rows.column("term")))
    source = pc.index_in(counts.column("source"), names).to_numpy().astype(np.int64)
    term = pc.dictionary_encode(counts.column("term").combine_chunks()).indices.to_numpy().astype(np.int64)
    block = Block(heads.column("n").to_numpy(), heads.column("v")[0].as_py(), source, term, counts.column("n").to_numpy())
    lang = rows.column("lang")[0].as_py()
    for s in range(len(names) - 1):
        others = names.slice(s + 1)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(others), pa.string()), pa.array([names[s].as_py()] * len(others), pa.string()), others, pa.array(block.from_(s))], ["lang", "source", "other", "value"])


def pair_differences(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, other and value of each pair of sources of a language, both ways round.

    counts: lang, source, term, n, blocks of kept terms; groups: lang, source, total, v, blocks of all groups.
    """
    block = lambda k: F.concat_ws(":", k.cast("string"), F.col("lang"))
    heads = groups.select("lang", "source", F.lit(None).cast("string").alias("term"), F.col("total").alias("n"), "v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("_k"))
    rows = counts.select("lang", "source", "term", "n", F.lit(0).cast("long").alias("v"), F.pmod(F.xxhash64("term"), F.col("blocks")).alias("_k"))
    both = heads.unionByName(rows).withColumn("block", block(F.col("_k"))).drop("_k")
    sums = both.repartition("block").sortWithinPartitions("block", F.col("term").isNotNull(), "source", "term").mapInArrow(_pairs, "lang string, source string, other string, value long")
    sums = sums.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    ways = F.array(F.struct("source", "other"), F.struct(F.col("other").alias("source"), F.col("source").alias("other")))
    return sums.select("lang", F.explode(ways).alias("w"), "value").select("lang", "w.source", "w.other", "value")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value and rank: every other source of a source's language, and its `top` terms over their share in the language."""
    counted = materialise(term_counts(docs), "audit-counts")
    terms = counted.filter("term is not null")
    kept = terms.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).filter(F.col("docs") >= least_docs)
    kept = materialise(kept.select("lang", "term", "lang_n"), "audit-kept")
    counts = materialise(terms.drop("docs").join(sized(kept), ["lang", "term"]), "audit-terms")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    langs = langs.join(counts.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks")), "lang")
    langs = sized(materialise(langs, "audit-langs"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counted.filter("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = materialise(groups.na.fill({"total": 0, "v": 0, "lang_total": 0, "blocks": 1}), "audit-groups")
    discard(counted, kept)
    full = counts.join(sized(groups), ["lang", "source"])
    p, q = share_of(F.col("n"), F.col("total"), F.col("v")), share_of(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    over = full.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q")
    over = over.select("lang", "source", F.lit("term").alias("part"), "item", difference_of(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    over = over.withColumn("rank", rank).filter(F.col("rank") <= top)
    pairs = pair_differences(full, groups).select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value").withColumn("rank", rank)
    return pairs.unionByName(over)


def digest(docs: DataFrame) -> DataFrame:
    return audit(docs)


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS lang_n FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 10),
c AS (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(lang_n)::HUGEINT AS lang_total FROM kept GROUP BY lang),
t AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * v.v) AS p, 1 + (1000000000 * (k.lang_n + 2)) // (v.lang_total + 2 * v.v) AS q
      FROM g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN t USING (lang, source) LEFT JOIN c USING (lang, source, term)),
pair AS (SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(x.value, 0) AS value FROM g JOIN g o ON g.lang = o.lang AND g.source <> o.source
         LEFT JOIN (SELECT a.lang, a.source, b.source AS other, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
         ON x.lang = g.lang AND x.source = g.source AND x.other = o.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pair UNION ALL FROM term))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 10
"""

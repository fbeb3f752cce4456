"""Substring dedup: truncated suffix trees over prefix-partitioned word suffixes.

A word suffix matters only as far as its first `window` words: the subtree
below that depth is never needed, and two suffixes meet in a node of that depth
or more exactly if those words are equal.  So each suffix tree is cut there.

1. *Prefixes.* Suffixes are grouped by the prefix that begins at their sample, the
   winnowed `gram`-word run that each window chooses by its own words alone.
   Prefixes that occur in one document only are leaves and never leave it.
2. *Groups.* Prefixes of groups that are too large for a task's memory grow, word by
   word on the side where all of the group's suffixes go on, until every group is
   small enough; a window that is too frequent by itself is one single deep node,
   counted before any shuffle (see `repeats`).
3. *Trees.* A task builds the tree of its group level by level, from sorted names of
   1, 3, 9, 27 and `window` words. Of an internal node of full depth with leaves in
   several documents the least document keeps the words, all others lose them. (Deeper
   nodes are not built: a longer repeat is what such nodes cover one after the other. README
   says why suffixes are not grouped from their first word.)

Copies of whole documents are settled by a hash of all words before step 1.
Nulls are empty texts, an empty table gives an empty result, and rows that repeat
an id are settled each by its own text, ties of the least id among them included: all rows of that id keep
the words. Words are told by 64-bit hashes. A very long text is cut up by its samples and taken in
pieces. Only doc_id and text are read, whatever other columns are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsewright.cluster import materialise, only_rows_of, ship
from pulsewright.llm import repeats as R
from pulsewright.llm import textkit as K

WINDOW = 50
GRAM = 20
_SECOND = np.uint64(0x9E3779B97F4A7C15)

_PIECE = pa.struct([("node", pa.int64()), ("segment", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("s", pa.int32()), ("e", pa.int32())])
SKETCH = "doc_id long, rid long, n_words long, s1 long, s2 long, all_sha256 string, pieces array<struct<node:long,segment:long,at:int,n:int,s:int,e:int>>"


def _sketch(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offsets in K.chunks(b.column("text")):
                x = R.of_words(data, offsets)
                s1, s2 = (K.span_hash(K.prefix_hash(v), x.cut[:-1], x.cut[1:]) for v in (x.values, K.mix(x.values ^ _SECOND)))
                row, first, n, node, segment = R.pieces(x, window, gram)
                cut = pa.array(np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32))
                places = (first - x.cut[row], n, x.begin(first) - offsets[row], x.end(first + n - 1 + window) - offsets[row])
                values = pa.StructArray.from_arrays([*(pa.array(v.view(np.int64)) for v in (node, segment)), *(pa.array(v.astype(np.int32)) for v in places)], fields=list(_PIECE))
                shas = [hashlib.sha256(b" ".join(data[s:e].tobytes().split())).hexdigest() for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(i, j - i), b.column("rid").slice(i, j - i), pa.array(np.diff(x.cut).astype(np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(shas), pa.ListArray.from_arrays(cut, values)],
                    ["doc_id", "rid", "n_words", "s1", "s2", "all_sha256", "pieces"],
                )

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, texts, shas = [], [], []
            for i, j, data, offsets in K.chunks(b.column("text")):
                x = R.of_words(data, offsets)
                for r, gone in enumerate(R.covered(b.column("runs").slice(i, j - i), window, np.diff(x.cut))):
                    keep = np.flatnonzero(~gone) + x.cut[r]
                    raw, base = data[offsets[r] : offsets[r + 1]].tobytes(), offsets[r]
                    text = b" ".join(raw[s - base : e - base] for s, e in zip(x.starts[keep].tolist(), x.ends[keep].tolist(), strict=True))
                    removed.append(int(gone.sum()))
                    texts.append(text.decode())
                    shas.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("rid"), pa.array(removed, pa.int64()), pa.array(texts, pa.string()), pa.array(shas, pa.string())], ["doc_id", "rid", "n_removed", "kept_text", "kept_sha256"])

    return run


def removals(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, most: int = R.MOST) -> tuple[DataFrame, DataFrame]:
    """(sketch, cut): a row per document with n_words and all_sha256, and a row per document that loses words.

    `cut` has doc_id, rid, n_removed, kept_text (kept words joined by a space)
    and kept_sha256. Keys are doc_id and rid, a hash of the row's id and text,
    so rows that repeat an id are settled each by its own text.
    """
    ship(docs.sparkSession)
    on = ["doc_id", "rid"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("rid", F.xxhash64("doc_id", "text"))
    sketch = materialise(rows.mapInArrow(_sketch(window, gram), SKETCH), "trees-sketch")
    known = sketch.filter(F.col("doc_id").isNotNull() & (F.col("n_words") >= window))

    first = materialise(known.groupBy("s1", "s2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("s1", "s2", "least"), "trees-first")
    copies = materialise(known.select(*on, "s1", "s2", "n_words").join(first, ["s1", "s2"]).filter("doc_id > least").select(*on, "n_words").distinct(), "trees-copies")
    few = copies.count() <= 500_000
    gone = F.broadcast(copies.select(*on)) if few else copies.select(*on)

    found = materialise(known.join(gone, on, "left_anti").select(F.col("doc_id").alias("a"), F.col("rid").alias("b"), F.explode("pieces").alias("p")).select("a", "b", "p.*"), "trees-pieces")
    runs = R.repeated_windows(found, rows.select(F.col("doc_id").alias("a"), F.col("rid").alias("b"), "text"), R.of_words, window, gram, first_stays=True, most=most).toDF(*on, "runs")
    cut = only_rows_of(rows, runs, on).join(runs, on).select(*on, "text", "runs").mapInArrow(_cut(window), "doc_id long, rid long, n_removed long, kept_text string, kept_sha256 string").dropDuplicates(on)
    nothing = hashlib.sha256(b"").hexdigest()
    whole = copies.select(*on, F.col("n_words").alias("n_removed"), F.lit("").alias("kept_text"), F.lit(nothing).alias("kept_sha256"))
    return sketch, cut.unionByName(whole)


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """`docs` with text cut to the kept words (joined by one space) where words are removed; other texts are unchanged.

    Null and empty texts and rows without a doc_id stay as they are. Rows that
    repeat a doc_id never remove words of each other, as neither id is smaller.
    """
    _, cut = removals(docs, window, gram)
    rid = F.xxhash64(F.col("d.doc_id").cast("long"), F.coalesce(F.col("d.text"), F.lit("")))
    joined = docs.alias("d").join(cut.alias("c"), (F.col("d.doc_id") == F.col("c.doc_id")) & (rid == F.col("c.rid")), "left")
    return joined.select(*[F.coalesce(F.col("c.kept_text"), F.col("d.text")).alias("text") if c == "text" else F.col(f"d.`{c}`") for c in docs.columns])


def digest(docs: DataFrame, window: int = WINDOW, most: int = R.MOST) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of `docs`."""
    sketch, cut = removals(docs, window, most=most)
    out = sketch.select("doc_id", "rid", "n_words", "all_sha256").join(cut.select("doc_id", "rid", "n_removed", "kept_sha256"), ["doc_id", "rid"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha256", "all_sha256").alias("kept_sha256"))


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM documents
), win AS (
  SELECT doc_id, p, md5(array_to_string(ws[p:p + 49], ' ')) AS h2
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM w)
), least AS (SELECT h2, min(doc_id) AS lo FROM win GROUP BY h2),
hit AS (SELECT doc_id, p FROM win JOIN least USING (h2) WHERE lo < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS p FROM hit),
gl AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
k AS (SELECT doc_id, ws, coalesce(ps, []) AS ps, len(ws) AS n FROM w LEFT JOIN gl USING (doc_id)),
kept AS (
  SELECT doc_id, coalesce(string_agg(word, ' ' ORDER BY i), '') AS t FROM (
    SELECT u.doc_id, u.i, u.word FROM (SELECT doc_id, unnest(range(1, n + 1)) AS i, unnest(ws) AS word FROM k) u
    LEFT JOIN gone g ON g.doc_id = u.doc_id AND g.p = u.i WHERE g.p IS NULL) GROUP BY doc_id
)
SELECT k.doc_id, k.n::BIGINT AS n_words, len(k.ps)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM k LEFT JOIN kept USING (doc_id)
"""

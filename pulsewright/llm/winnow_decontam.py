"""Benchmark decontamination by winnowing.

Words are runs of digits, a-z (after lower-casing A-Z) and code points above
ASCII. A benchmark item is cut into windows of `window` consecutive words; an
item of fewer words is one window. Of each full window the least hash of its
`gram`-word grams is its fingerprint. A document keeps the same minimum for
each of its own windows, so equal windows have equal fingerprints: whoever
shares `window` words shares one. Fingerprint hits are extended to the whole
window and confirmed word by word. Windows of short items are looked up whole.

The windows of the benchmark are the stated query set: they are taken in blocks
of at most `BLOCK` windows, each block is sent to all tasks, and the documents
pass it without a shuffle. So nothing that is sent grows with the corpus, and a
block's size is bounded whatever the benchmark's. With several blocks, each has a pass
of its own over the texts, which keeps the hits by a 128-bit hash of the text, and is
let go before the next one; the hits are joined back at the end.

Nulls: a null text has no words; a null item_id or an item without words is
ignored; a null doc_id is an ordinary row. Rows that repeat stay as they are.
An empty benchmark leaves all documents clean, an empty table gives an empty result.
Long texts pass as a chunk of their own. `mark` replaces columns of `docs` that are
called like its own; `decontaminate` keeps all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsewright.cluster import discard, materialise, ship
from pulsewright.llm import textkit as K
from pulsewright.llm.rows import pack, unpack

WINDOW = 10
GRAM = 5
BLOCK = 500_000


def _words(data: np.ndarray, offsets: np.ndarray):
    low = K.LOWER[data]
    starts, ends, at = K.word_spans(low, offsets, K.ALNUM)
    return low, starts, ends, at, K.word_hashes(low, starts, ends)


def _item_windows(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("item_id").to_pylist()
            for i, j, data, offsets in K.chunks(b.column("text")):
                low, starts, ends, at, h = _words(data, offsets)
                out: list[tuple] = []
                for r in range(j - i):
                    a, z = int(at[r]), int(at[r + 1])
                    m = min(window, z - a)
                    if not m:
                        continue
                    texts = [low[s:e].tobytes() for s, e in zip(starts[a:z], ends[a:z], strict=True)]
                    whole = K.gram_hashes(h[a:z], m)
                    prints = whole
                    if m == window:
                        grams = K.gram_hashes(h[a:z], gram)
                        prints = grams[K.window_min(grams, window - gram + 1)]
                    out += [(m, int(w), int(f), ids[i + r], b" ".join(texts[p : p + m])) for p, (w, f) in enumerate(zip(whole.view(np.int64), prints.view(np.int64), strict=True))]
                cols = list(zip(*out, strict=True)) or [()] * 5
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["m", "whole", "print", "item_id", "words"])

    return run


class Block:
    """Windows by length: sorted hashes with the words and items of each; and the fingerprints of the full ones."""

    def __init__(self, rows: list[tuple[int, int, int, list[int], bytes]], window: int):
        self.window = window
        self.by_length = {}
        for m in sorted({r[0] for r in rows}):
            own = sorted(((r[1] & 0xFFFFFFFFFFFFFFFF, bytes(r[4]), tuple(r[3])) for r in rows if r[0] == m))
            self.by_length[m] = np.array([x[0] for x in own], np.uint64), [x[1:] for x in own]
        self.prints = np.unique(np.array([r[2] for r in rows if r[0] == window], np.int64).view(np.uint64))
        self.maybe = {m: _sieve(self.prints if m == window else h) for m, (h, _) in self.by_length.items()}


def _sieve(sorted_hashes: np.ndarray) -> np.ndarray:
    """Which top 22 bits occur: rules out most hashes with one look."""
    out = np.zeros(1 << 22, bool)
    out[(sorted_hashes >> np.uint64(42)).astype(np.int64)] = True
    return out


def _among(h: np.ndarray, sieve: np.ndarray, sorted_hashes: np.ndarray) -> np.ndarray:
    """Mask of the values of h that stand in sorted_hashes."""
    found = sieve[(h >> np.uint64(42)).astype(np.int64)]
    at = np.flatnonzero(found)
    if len(at):
        k = np.searchsorted(sorted_hashes, h[at])
        found[at] = (k < len(sorted_hashes)) & (sorted_hashes[np.minimum(k, len(sorted_hashes) - 1)] == h[at])
    return found


def _hits(block: Block, gram: int, low, starts, ends, at, h) -> Iterator[tuple[int, int, int, tuple]]:
    """(row, first word, length, items) of each occurrence of a window of the block."""
    row = K.row_of_words(at)
    for m, (hashes, what) in block.by_length.items():
        if m == block.window:
            grams = K.gram_hashes(h, gram)
            printed = _among(grams, block.maybe[m], block.prints)
            if not printed.any():
                continue
            p = np.flatnonzero(printed[K.window_min(grams, m - gram + 1)])
        else:
            p = np.flatnonzero(_among(K.gram_hashes(h, m), block.maybe[m], hashes))
        p = p[row[p] == row[p + m - 1]] if len(p) else p
        if not len(p):
            continue
        own = K.span_hash(K.prefix_hash(h), p, p + m)
        for s, x in zip(p.tolist(), own, strict=True):
            k = int(np.searchsorted(hashes, x))
            words = None
            while k < len(hashes) and hashes[k] == x:
                words = words or b" ".join(low[a:z].tobytes() for a, z in zip(starts[s : s + m], ends[s : s + m], strict=True))
                if words == what[k][0]:
                    yield int(row[s]), s - int(at[row[s]]), m, what[k][1]
                k += 1


def _mark(shared, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for b in batches:
            n_words, spans, items = np.zeros(b.num_rows, np.int64), [set() for _ in range(b.num_rows)], [set() for _ in range(b.num_rows)]
            for i, _, data, offsets in K.chunks(b.column("text")):
                words = _words(data, offsets)
                n_words[i : i + len(offsets) - 1] = np.diff(words[3])
                for r, p, m, found in _hits(block, gram, *words):
                    spans[i + r].update(range(p, p + m))
                    items[i + r].update(found)
            old_hits, old_items = b.column("hits").to_pylist(), b.column("items").to_pylist()
            hits = [sorted(x.union(y)) for x, y in zip(spans, old_hits, strict=True)]
            ids = [sorted(x.union(y)) for x, y in zip(items, old_items, strict=True)]
            new = {"n_words": pa.array(n_words), "hits": pa.array(hits, pa.list_(pa.int32())), "items": pa.array(ids, pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_arrays([new.get(n, b.column(k)) for k, n in enumerate(b.schema.names)], b.schema.names)

    return run


def mark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """`docs` with n_words, hits (places of words within windows of the benchmark) and items (their item_ids), row by row."""
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.filter("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text"))
    table = materialise(items.mapInArrow(_item_windows(window, gram), "m int, whole long, print long, item_id long, words binary").groupBy("m", "whole", "print", "words").agg(F.collect_set("item_id").alias("items")), "winnow-windows")
    n_blocks = max(1, -(-table.count() // block))

    def marked(rows: DataFrame, windows: list[tuple]) -> tuple[DataFrame, Broadcast]:
        shared = spark.sparkContext.broadcast(Block(windows, window))
        new = rows.withColumns({"n_words": F.lit(0).cast("long"), "hits": F.array().cast("array<int>"), "items": F.array().cast("array<long>")})
        return new.mapInArrow(_mark(shared, gram), new.schema), shared

    def windows(k: int) -> list[tuple]:
        return [(r["m"], r["whole"], r["print"], r["items"], r["words"]) for r in table.filter(F.expr(f"pmod(whole, {n_blocks}) = {k}")).collect()]

    if n_blocks == 1:
        out, _ = marked(docs, windows(0))
    else:
        text = F.coalesce(F.col("text"), F.lit(""))
        keys = {"_k1": F.xxhash64(text), "_k2": F.xxhash64(F.lit(1), text)}
        found = []
        for k in range(n_blocks):
            rows, shared = marked(docs.select(*[v.alias(c) for c, v in keys.items()], "text"), windows(k))
            found.append(materialise(rows.filter("size(hits) > 0").select(*keys, "hits", "items").dropDuplicates([*keys]), "winnow-hits"))
            shared.destroy()
        every = reduce(DataFrame.unionByName, found).groupBy(*keys).agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(f"_{c}") for c in ("hits", "items")])
        rows, _ = marked(docs, [])
        out = rows.withColumns(keys).join(materialise(every, "winnow-hits"), [*keys], "left").withColumns({c: F.coalesce(f"_{c}", c) for c in ("hits", "items")}).drop(*keys, "_hits", "_items")
        discard(*found)
    discard(table)
    return out


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of `docs`."""
    rows = mark(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark)
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return rows.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that hold no window of the benchmark; columns as they were."""
    return unpack(mark(pack(docs), benchmark).filter(F.size("hits") == 0), docs.columns)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, m, array_to_string(ws[p:p + m - 1], ' ') AS w FROM (
    SELECT item_id, ws, least(10, len(ws)) AS m, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS p FROM b WHERE len(ws) > 0)
), dw AS (
  SELECT doc_id, p, m, array_to_string(ws[p:p + m - 1], ' ') AS w FROM (
    SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM bw) WHERE len(ws) >= m)
), h AS (SELECT doc_id, p, m, item_id FROM dw JOIN bw USING (m, w)),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM h) GROUP BY doc_id),
hw AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + m)) AS p FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN it USING (doc_id) LEFT JOIN hw USING (doc_id)
"""

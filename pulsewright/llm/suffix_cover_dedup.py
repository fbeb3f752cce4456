"""Exact substring dedup over bytes: a cover of the suffixes, names of triples, equal prefixes of neighbours.

Whether two suffixes agree in their first `span` bytes is what a suffix array
tells of neighbours. The steps are those of the difference-cover algorithm:
sample suffixes so that any two have samples at a common shift, name strings by
sorted triples of names, and compare what is left with its neighbours. The
cover is chosen by content, not by residue (see `repeats`): equal windows of
`span` bytes have their sample at the same shift, and one suffix in about 70 is
sampled, not two in three. So the suffixes between samples need no array of their
own: those whose sample stands nowhere else are settled, and the others are sorted
and named in groups.

Copies of whole texts are settled first by a hash of the text: all their bytes
go. Keys of texts are of 128 bits. All tables are keyed by content, so rows that
repeat, share an id or have none need no special case. A null text is empty, an
empty table gives an empty result, ties cannot matter, and matches never cross
texts. A text of any length is cut up by its samples. Columns of any other name are carried, not read.
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
from pulsewright.llm.rows import pack, unpack

SPAN = 200
GRAM = 64


def _cut(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, at = K.rows_as_bytes(b.column("text"))
            removed, spans, kept, shas = [], [], [], []
            for r, gone in enumerate(R.covered(b.column("runs"), span, np.diff(at))):
                text = raw[at[r] : at[r + 1]][~gone].tobytes()
                removed.append(int(gone.sum()))
                spans.append(int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum()))
                kept.append(text.decode("utf-8", "replace"))
                shas.append(hashlib.sha256(text).hexdigest())
            K.tidy()
            yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string()), pa.array(shas, pa.string())], ["k1", "k2", "n_removed", "n_spans", "kept", "kept_sha256"])

    return run


def keyed(docs: DataFrame) -> DataFrame:
    """`docs` with _t (text, null as empty) and its 128-bit key k1, k2."""
    t = docs.withColumn("_t", F.coalesce("text", F.lit("")))
    return t.withColumns({"k1": F.xxhash64("_t"), "k2": F.xxhash64(F.lit(1), "_t")})


def repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, most: int = R.MOST) -> tuple[DataFrame, DataFrame]:
    """(copies, cut): keys of texts that occur in several rows, and k1, k2, n_removed, n_spans, kept, kept_sha256 of other texts that lose bytes."""
    ship(docs.sparkSession)
    rows = keyed(docs.select("doc_id", "text")).filter(F.octet_length("_t") >= span)
    copies = materialise(rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n_rows"), F.min("doc_id").alias("least")).filter("n_rows > 1"), "cover-copies")
    extra = materialise(rows.select("doc_id", "k1", "k2").join(copies, ["k1", "k2"]).filter("not doc_id <=> least").select("doc_id", "k1", "k2").distinct(), "cover-extra")
    few = extra.count() <= 500_000
    drop = F.broadcast(extra) if few else extra
    texts = rows.join(drop.toDF("_id", "_k1", "_k2"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left_anti").select(F.col("k1").alias("a"), F.col("k2").alias("b"), F.col("_t").alias("text"))

    found = materialise(texts.mapInArrow(R.find_pieces(R.of_bytes, span, gram), R.PIECE), "cover-pieces")
    runs = R.repeated_windows(found, texts, R.of_bytes, span, gram, most=most).toDF("k1", "k2", "runs")
    texts = texts.toDF("k1", "k2", "text")
    cut = only_rows_of(texts, runs, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).join(runs, ["k1", "k2"]).mapInArrow(_cut(span), "k1 long, k2 long, n_removed long, n_spans long, kept string, kept_sha256 string")
    return copies, cut.join(copies.select("k1", "k2"), ["k1", "k2"], "left_anti")


def digest(docs: DataFrame, span: int = SPAN, most: int = R.MOST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of `docs`."""
    copies, cut = repeats(docs, span, most=most)
    rows = keyed(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "k1", "k2", F.octet_length("_t").cast("long").alias("n_bytes"), F.sha2(F.col("_t").cast("binary"), 256).alias("sha"))
    info = cut.select("k1", "k2", "n_removed", "n_spans", "kept_sha256", F.lit(False).alias("all")).unionByName(
        copies.select("k1", "k2", F.lit(None).cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"), F.lit(True).alias("all"))
    )
    info = materialise(info, "cover-cut")
    out = rows.join(info, ["k1", "k2"], "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_bytes", F.when(F.col("all"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))


def dedup_bytes(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """`docs` with text cut to the bytes kept; bytes that are no longer UTF-8 at a cut are replaced. Texts without repeats, nulls included, stay as they are."""
    copies, cut = repeats(docs, span)
    info = cut.select("k1", "k2", F.col("kept").alias("_new")).unionByName(copies.select("k1", "k2", F.lit("").alias("_new")))
    rows = keyed(pack(docs)).drop("_t").join(info, ["k1", "k2"], "left")
    return unpack(rows.withColumn("text", F.coalesce("_new", "text")), docs.columns)


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
part AS (SELECT r, b, substr(h, 400 * b + 1, 798) AS x FROM (SELECT r, h, unnest(range(0, (len(h) // 2 + 199) // 200)) AS b FROM d)),
w AS (SELECT r, 200 * b + q AS p, md5(substr(x, 2 * q - 1, 400)) AS k FROM (SELECT r, b, x, unnest(range(1, least(200, len(x) // 2 - 199) + 1)) AS q FROM part WHERE len(x) >= 400)),
again AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
hit AS (SELECT r, p, coalesce(p > lag(p) OVER (PARTITION BY r ORDER BY p) + 200, true) AS new FROM w SEMI JOIN again USING (k)),
run AS (SELECT r, min(p) AS s, max(p) + 200 AS e FROM (SELECT r, p, sum(new::INT) OVER (PARTITION BY r ORDER BY p) AS i FROM hit) GROUP BY r, i),
n AS (SELECT r, sum(e - s) AS n_removed, count(*) AS n_spans FROM run GROUP BY r),
gap AS (
  SELECT r, s AS place, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 1) AS a, s AS z FROM run
  UNION ALL SELECT d.r, 1 + len(h), coalesce(last.e, 1), 1 + len(h) // 2 FROM d LEFT JOIN (SELECT r, max(e) AS e FROM run GROUP BY r) last USING (r)
), kept AS (SELECT r, string_agg(substr(h, 2 * a - 1, 2 * (z - a)), '' ORDER BY place) AS x FROM gap JOIN d USING (r) GROUP BY r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(x)) AS kept_sha256
FROM d JOIN kept USING (r) LEFT JOIN n USING (r)
"""

"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

Learns from text and lang of the documents whose crc32(doc_id as text) mod 4 is
not 2: at most some `PER_LANGUAGE` of a language and `TOTAL` of all (but LEAST_EACH of a language, if it has
them), chosen by a hash of the row. A chosen text is read whole, in a task, which draws a bounded number of
its subwords from all of it (`hashed_grams.POOL`); these go to the driver, texts do not. A fifth
of the texts are kept from training and calibrate both outputs, by logits of their whole texts: the scale of the
logits, so that the score is a probability; and rejection. Predictions use the
text alone, and all of it.

Rejection: a text's evidence is its best logit less the mean of all. Runs of bytes that
training never saw carry none, so a text in another language has little, however sure
the softmax is among the languages it knows. It depends on the length, so slices
of the calibration texts of each length class tell below which evidence only a share of
`REJECTED` of texts in known languages lie.

A text that is null or has no letter is `und` with score 0 and rejected; so is
every text if there is nothing to learn from. A null doc_id counts as not held
out. Rows that repeat get the same prediction, ties go to the first label, an empty
table gives an empty result, and further columns are carried, not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsewright.cluster import discard, materialise, ship
from pulsewright.llm import hashed_grams as H
from pulsewright.llm import textkit as K
from pulsewright.llm.rows import pack, unpack

PER_LANGUAGE = 1500
TOTAL = 12_000
LEAST_EACH = 20
#: Without this many texts none is kept from training.
LEAST_CALIBRATED = 100
#: Share of texts in known languages that may be rejected, at each length class (bytes from which it begins).
REJECTED = 0.0005
LENGTHS = (0, 64, 256, 1024, 4096)
#: Slices of each calibration text in each length class.
DRAWS = 6
UNKNOWN = "und"

_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, total: int = TOTAL) -> H.Model | None:
    """Train on the labelled documents of `docs` that are not held out; None if there are none."""
    usable = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.select("lang", F.col("text").alias("_text"), F.pmod(F.xxhash64(F.col("doc_id").cast("long"), "text"), F.lit(1 << 40)).alias("_h"))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    if not counts:
        return None
    each = max(LEAST_EACH, min(per_language, total // len(counts)))
    wanted = F.lit(False)
    for lang, n in counts.items():
        wanted = wanted | ((F.col("lang") == lang) & (F.col("_h") < int((1 << 40) * min(1.0, each / n))))
    spark = docs.sparkSession
    ship(spark)
    chosen = materialise(usable.filter(wanted).select("_h", F.col("_text").alias("text"), "lang").dropDuplicates(["_h"]), "lang-sample")
    cal = F.lit(chosen.count() >= LEAST_CALIBRATED) & (F.col("_h") % 5 == 4)
    labels = sorted(counts)
    rows = chosen.filter(~cal).mapInArrow(H.drawn(H.LETTERS, "_h", ["_h", "lang"]), "_h long, lang string, n long, pool binary").filter(F.col("n") >= max(H.GRAMS)).collect()
    rows.sort(key=lambda r: r["_h"])
    target = lambda found: np.eye(len(labels))[[labels.index(r["lang"]) for r in found]].reshape(len(found), len(labels))
    model = H.train(H.pool_of(rows), target(rows), labels)
    told = chosen.filter(cal).mapInArrow(_calibration(spark.sparkContext.broadcast(model)), "_h long, lang string, logits array<double>, evidence array<double>").collect()
    if told:
        told.sort(key=lambda r: r["_h"])
        H.calibrate(model, np.array([r["logits"] for r in told]), target(told))
        model.least = least_evidence(np.array([r["evidence"] for r in told], float).reshape(len(told), len(LENGTHS), DRAWS))
    discard(chosen)
    return model


def evidence(logits: np.ndarray) -> np.ndarray:
    return logits.max(1) - logits.mean(1)


def _calibration(shared):
    """Rows (_h, text, lang) to logits of the whole text and the evidence of DRAWS slices in each length class (NaN for none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: H.Model = shared.value
        for b in batches:
            for i, j, data, offsets in K.chunks(b.column("text")):
                low, keys = H.LETTERS[data], b.column("_h").slice(i, j - i)
                logits = model.logits(low, offsets)
                found = np.full((j - i, len(LENGTHS), DRAWS), np.nan)
                for r, key in enumerate(keys.to_pylist()):
                    rng = np.random.default_rng(key)
                    for k, least in enumerate(LENGTHS):
                        n, size = int(offsets[r + 1] - offsets[r]), max(least, 24)
                        if n < size:
                            continue
                        x = low[(offsets[r] + rng.integers(0, n - size + 1, DRAWS))[:, None] + np.arange(size)]
                        enough = (x != 0x20).mean(1) > 0.3  # else too few letters to tell a language by
                        found[r, k] = np.where(enough, evidence(model.logits(x.reshape(-1), np.arange(DRAWS + 1) * size)), np.nan)
                yield pa.RecordBatch.from_arrays([keys, b.column("lang").slice(i, j - i), pa.array(logits.tolist(), pa.list_(pa.float64())), pa.array(found.reshape(j - i, -1).tolist(), pa.list_(pa.float64()))], ["_h", "lang", "logits", "evidence"])

    return run


def least_evidence(found: np.ndarray) -> np.ndarray:
    """The evidence that a text of each length class needs, from slices of texts in known languages (texts x classes x draws); never more than a shorter one's class allows a longer one."""
    out = []
    for k in range(len(LENGTHS)):
        own = found[:, k][~np.isnan(found[:, k])]
        out.append(float(np.quantile(own, REJECTED)) if len(own) >= 100 else out[-1] if out else -np.inf)
    return np.maximum.accumulate(out)


def _predict(shared, take: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: H.Model | None = shared.value
        for b in batches:
            lang, score, ok = np.full(b.num_rows, UNKNOWN, object), np.zeros(b.num_rows), np.ones(b.num_rows, bool)
            for i, j, data, offsets in K.chunks(b.column("text")):
                letters = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])[offsets]
                has = np.diff(letters) > 0
                for r in np.flatnonzero(~has):
                    has[r] = any(c.isalpha() for c in data[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8", "replace"))
                if model is not None and has.any():
                    z = model.logits(H.LETTERS[data], offsets)
                    p = H.softmax(z * model.scale)
                    best = p.argmax(1)
                    if model.least is not None:
                        ok[i:j] = evidence(z) >= model.least[np.searchsorted(LENGTHS, np.diff(offsets), "right") - 1]
                    lang[i:j][has] = np.array(model.labels, object)[best[has]]
                    score[i:j][has] = p.max(1)[has]
            rejected = (lang == UNKNOWN) | ~ok
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(take)), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], [*b.schema.names[:take], "lang_pred", "score", "rejected"])

    return run


def predict(docs: DataFrame, model: H.Model | None, carry: list[str]) -> DataFrame:
    """The columns `carry` of `docs` with lang_pred, score and rejected."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(*carry, F.col("text").alias("text")) if "text" not in carry else docs.select(*carry)
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return rows.mapInArrow(_predict(spark.sparkContext.broadcast(model), len(carry)), T.StructType([*rows.schema.fields[: len(carry)], *new]))


def digest(docs: DataFrame) -> DataFrame:
    rows = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "held_out": held_out(F.col("doc_id"))})
    return predict(rows, fit(docs), ["doc_id", "held_out"])


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of `docs` whose language is not rejected; columns as they were."""
    return unpack(predict(pack(docs), fit(docs), ["rest", "text"]).filter("not rejected"), docs.columns)

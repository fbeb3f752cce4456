"""Quality classifier from weak labels: no gold label is read.

*Labellers.* Heuristics over the measures of the quality rules vote good, bad or
nothing. Their votes make a pattern; all documents are counted by pattern,
and there are at most 3**len(LABELLERS) of them, whatever the corpus.

*Label model.* Expectation-maximisation over the pattern counts estimates, for
each labeller, how it votes on good and on bad documents, and the share of good
ones; each pattern then has a posterior.

*Scorer.* A hashed linear model of byte runs learns the posteriors of at most
`SAMPLE` texts (about half of either side, chosen by a hash of the text), and scores the whole of every
text. A chosen text is read whole, in a task, which draws a bounded number of its byte runs from all of it
(`hashed_grams.POOL`) for the driver to learn from. It generalises where the labellers are silent.

Null and empty texts have score 0 and are not kept. Rows that repeat are scored each by itself, and
their text counts once in training; ids (null or not), sources and further columns, whatever they are
called, are never inputs and are carried as they are. A score of exactly THRESHOLD is kept. A long
text is one chunk of its own. An empty table gives an empty result.
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
from pulsewright.llm import quality_rules
from pulsewright.llm import textkit as K
from pulsewright.llm.rows import pack, unpack

SAMPLE = 3000
THRESHOLD = 0.5

#: Name, a measure in SQL, and where it votes bad and good: (value, bad if above, good if below), or with the signs turned.
LABELLERS = (
    ("symbols", "try_divide(n_symbols, n_words)", ">", 0.1, 0.02),
    ("repeats", "try_divide(n_repeat_words, n_words)", ">", 0.5, 0.1),
    ("stop_words", "try_divide(n_stop_words, n_words)", "<", 0.06, 0.12),
    ("dup_lines", "if(n_lines >= 4, n_dup_lines / n_lines, null)", ">", 0.5, 0.1),
    ("word_length", "try_divide(word_chars, n_words)", ">", 6.5, 6.0),
    ("capitals", "try_divide(n_capitals, word_chars)", ">", 0.3, 0.1),
)


def votes(docs: DataFrame) -> DataFrame:
    """`docs` with `pattern`, a number whose digits to base 3 are the votes (0 none, 1 bad, 2 good); -1 for a text without words."""
    df = quality_rules.measures(docs).withColumn("n_capitals", F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Z]+", "")))
    code: Column = F.lit(0)
    for i, (_, value, sign, bad, good) in enumerate(LABELLERS):
        v = F.expr(value)
        is_bad, is_good = (v > bad, v < good) if sign == ">" else (v < bad, v > good)
        code = code + F.when(is_bad, 1).when(is_good, 2).otherwise(0) * 3**i
    return df.withColumn("pattern", F.when(F.col("n_words") > 0, code).otherwise(-1).cast("int")).select(*docs.columns, "pattern")


def label_model(counts: dict[int, int], rounds: int = 100) -> dict[int, float]:
    """Posterior of each pattern by expectation-maximisation; class 1 starts where most votes are good."""
    patterns = np.array(sorted(k for k in counts if k >= 0), np.int64)
    if not len(patterns):
        return {}
    n = np.array([counts[k] for k in patterns.tolist()], float)
    digits = patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    seen = np.eye(3)[digits]  # patterns x labellers x votes
    lean = (digits == 2).sum(1) - 1.5 * (digits == 1).sum(1)
    post = np.clip(0.5 + 0.2 * lean, 0.05, 0.95)
    for _ in range(rounds):
        rates = []
        for w in (n * (1 - post), n * post):
            r = np.einsum("p,plv->lv", w, seen) + 0.5
            rates.append(np.log(r / r.sum(1, keepdims=True)))
        prior = np.clip((n * post).sum() / n.sum(), 0.01, 0.99)
        logit = np.log(prior / (1 - prior)) + np.einsum("plv,lv->p", seen, rates[1] - rates[0])
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return dict(zip(patterns.tolist(), post.tolist(), strict=True))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: H.Model | None = shared.value
        for b in batches:
            score = np.zeros(b.num_rows)
            for i, j, data, offsets in K.chunks(b.column("text")):
                if model is not None:
                    score[i:j] = model.probabilities(H.SHAPES[data], offsets)[:, 1]
                words = np.concatenate([[0], np.cumsum(K.NON_SPACE[data])])[offsets]
                score[i:j][np.diff(words) == 0] = 0.0
            yield pa.RecordBatch.from_arrays([b.column("rest"), b.column("text"), b.column("rid"), pa.array(score)], ["rest", "text", "rid", "score"])

    return run


def score(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rest, a struct of the columns of `docs` but text, text, rid and score of every row of `docs`; posterior by rid)."""
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = pack(docs).withColumn("rid", F.xxhash64(text))
    voted = materialise(votes(docs.select("text").withColumn("rid", F.xxhash64(text))).select("rid", "pattern"), "weak-votes")
    posteriors = label_model({r["pattern"]: r["n"] for r in voted.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()})  # at most 3**6 + 1 rows
    table = F.broadcast(spark.createDataFrame([(k, v) for k, v in posteriors.items()] or [(-2, 0.0)], "pattern int, posterior double"))
    known = voted.join(table, "pattern", "left").withColumn("posterior", F.coalesce("posterior", F.lit(0.0)))

    usable = known.filter("pattern >= 0").withColumn("good", F.col("posterior") >= 0.5).withColumn("h", F.pmod(F.xxhash64("rid"), F.lit(1 << 30)))
    sizes = {r["good"]: r["n"] for r in usable.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}
    pick = F.lit(False)
    for good, n in sizes.items():
        pick = pick | ((F.col("good") == good) & (F.col("h") < int((1 << 30) * min(1.0, SAMPLE / 2 / n))))
    chosen = materialise(usable.filter(pick).groupBy("rid").agg(F.first("posterior").alias("posterior")), "weak-sample")
    # whole texts stay in the tasks; the driver gets features drawn from all of each
    picked = rows.select("rid", text.alias("text")).join(F.broadcast(chosen), "rid").dropDuplicates(["rid"])
    drawn = picked.mapInArrow(H.drawn(H.SHAPES, "rid", ["rid", "posterior"]), "rid long, posterior double, n long, pool binary").filter(F.col("n") >= max(H.GRAMS))
    sample = sorted(drawn.collect(), key=lambda r: r["rid"])
    model = None
    if sample:
        p = np.array([r["posterior"] for r in sample])
        model = H.train(H.pool_of(sample), np.stack([1 - p, p], 1), ["bad", "good"])
    scored = rows.mapInArrow(_score(spark.sparkContext.broadcast(model)), T.StructType([*rows.schema, T.StructField("score", T.DoubleType())]))
    by_text = materialise(known.groupBy("rid").agg(F.max("posterior").alias("posterior")), "weak-posteriors")
    discard(chosen, voted)
    return scored, by_text


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, score, posterior (of the labellers) and kept of every row of `docs`."""
    scored, by_text = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    out = scored.select(F.col("rest.doc_id").alias("doc_id"), "rid", "score").join(by_text, "rid")
    return out.select("doc_id", "score", "posterior", (F.col("score") >= THRESHOLD).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that score `THRESHOLD` or more; columns as they were."""
    return unpack(score(docs)[0].filter(F.col("score") >= THRESHOLD), docs.columns)

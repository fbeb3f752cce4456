"""The pipeline's stages on a small corpus: what each takes out, and that nothing else goes."""

from __future__ import annotations

import random
import zlib

import numpy as np

import corpus_pipeline
from pulsewright.llm.queries import tokenizer_path

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(12)
    words = {"en": ["the", "house", "with", "thing", "other", "where"], "fr": ["être", "maison", "où", "ça", "déjà", "très"]}

    def text(k, n=80):
        return " ".join(rng.choice(words[k]) + str(rng.randint(0, 50)) for _ in range(n))

    rows = [(i, text(k), k, "hot" if i % 3 else "b") for i in range(400) for k in [("en", "fr")[i % 2]]]
    item = text("en", 30)
    near = rows[10][1].split()
    near[40] = "changed"
    rows += [(500, rows[10][1], "en", "b"), (501, " ".join(near), "en", None), (502, text("en") + " " + item + " " + text("en"), "en", "hot"), (503, None, "en", "b"), (504, "12 34 ...", None, "b")]
    full = [(*r, len(r[1] or "")) for r in rows]
    spark.createDataFrame(full, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / f"out_{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "tokens":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    everything = {r[0] for r in rows}
    assert kept["language_id"] == everything - {503, 504}
    assert kept["near_dedup"] == kept["language_id"] - {500, 501}
    assert kept["decontaminate"] == kept["mix"] == kept["tokens"] == kept["near_dedup"] - {502}

    order = [r.doc_id for r in spark.read.parquet(str(tmp_path / "out_mix")).selectExpr("doc_id", "_metadata.file_name f", "_metadata.row_index i").orderBy("f", "i").collect()]
    tokens = {r.doc_id: r for r in docs.collect()}
    t = Tokenizer.from_file(tokenizer_path())
    texts, start = {r[0]: r[1] for r in rows}, 0
    for i in order:
        ids = [*t.encode(texts[i], add_special_tokens=False).ids, 0]
        assert (tokens[i].start, tokens[i].n_tokens, tokens[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(order)


def test_stages_of_an_empty_table_and_of_clashing_columns(spark, tmp_path):
    extra = "row string, rest long, score double, slot int, hits string, n_words int, _t string, rid long"
    names = [c.split()[0] for c in (COLUMNS + ", " + extra).split(", ")]
    spark.createDataFrame([(1, "none of these words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice(["the", "house", "with", "thing"]) + str(rng.randint(0, 99)) for _ in range(60))
    same = text()
    rows = [(i, text(), "en", "s", 1, "r", 2, 0.5, 3, "h", 4, None, 5) for i in range(150)] + [(900, same, "en", None, 1, "r", 2, 0.5, 3, "h", 4, None, 5)] * 3 + [(901, same, None, "t", 1, "r", 2, 0.5, 3, "h", 4, None, 5), (None, same, "en", "s", *[None] * 9), (902, "", "en", "s", *[None] * 9)]
    for some, want in ((rows, 152), ([], 0)):
        docs = spark.createDataFrame(some, COLUMNS + ", " + extra)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "tokens":
                assert out.columns == names, name
            path = str(tmp_path / f"{len(some)}_{name}")
            out.write.parquet(path)
            docs = spark.read.parquet(path)
        assert docs.count() == want

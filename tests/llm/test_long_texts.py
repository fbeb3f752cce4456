"""Texts longer than what a worker takes at once, through every operator."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest

from pulsewright.llm import language_id, pfair_mix, pii_bootstrap, quality_rules, setsketch_dedup, suffix_cover_dedup, token_files, weak_quality, winnow_decontam
from pulsewright.llm import textkit as K
from pulsewright.llm.queries import tokenizer_path
from tests.llm.test_corpus import base_spans, check_substring_bytes, check_substring_words, prose


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(77)
    long = prose(rng, 32_000, 9000)
    assert len(long) > K.CHUNK_BYTES
    words = long.split(" ")
    other = [w if rng.random() > 0.01 else "changed" for w in words]
    return [(1, long, "en", "a"), (2, " ".join(other), "en", "a"), (3, re.sub("[a-z]", lambda m: m[0].upper(), long), "en", "b"), (4, " ".join(words[20_000:20_100]), "fr", "b"), (5, prose(rng, 80), "fr", None), (6, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_long_texts_dedup(docs, rows):
    check_substring_bytes(docs, 128)
    check_substring_words(docs, 128)
    got = {r.doc_id: r.component_id for r in setsketch_dedup.digest(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}
    assert suffix_cover_dedup.dedup_bytes(docs).columns == docs.columns


def test_long_texts_tokens(docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    got = {r.doc_id: r for r in token_files.digest(docs, tokenizer_path()).collect()}
    start = 0
    for i, text, *_ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_long_texts_rows(spark, docs, rows):
    item = " ".join(rows[0][1].split()[25_000:25_030])
    hit = {r.doc_id: r.n_hit for r in winnow_decontam.digest(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert hit[1] == hit[3] == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", item)) and hit[4] == hit[5] == hit[6] == 0
    n = {r.doc_id: r.n_words for r in quality_rules.digest(docs).collect()}
    assert n == {i: len((t or "").split()) for i, t, *_ in rows}
    found = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in pii_bootstrap.digest(docs).collect()}
    assert found == {i: tuple(len(x) for x in base_spans(t or "").values()) for i, t, *_ in rows}
    for out in (language_id.digest(docs), weak_quality.digest(docs), pfair_mix.digest(docs)):
        assert sorted(r.doc_id for r in out.select("doc_id").collect()) == [1, 2, 3, 4, 5, 6]

"""The source divergence audit against a plain computation with Python's whole numbers."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import pytest

from pulsewright.llm import divergence_audit as D
from pulsewright.llm import textkit as K

SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, value long"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def expected(rows, least, top):
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        terms = TERM.findall((text or "").translate(UPPER))
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in {g[0] for g in counts}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        groups = {s: counts[lang, s] for i, s in counts if i == lang}
        whole = sum(groups.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in groups.items()}, share(whole)
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in groups:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in groups if o != s)
            out += [(lang, s, "pair", o.decode(), -v, k + 1) for k, (v, o) in enumerate(pairs)]
            over = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if groups[s][t] > 0 and p[s][t] > q[t])
            out += [(lang, s, "term", t.decode(), -v, k + 1) for k, (v, t) in enumerate(over[:top])]
    return sorted(out)


def awkward():
    rng = random.Random(9)
    words = ["The", "of", "ÉTÉ", "été", "naïve", "中文", "x", "y", "z", "don't", "A1B", "😀", *["w" + chr(97 + k) for k in range(20)]]
    rows = []
    for k in range(260):
        source = rng.choice(["hot", "hot", "hot", "b", "c", None, "d"])
        mine = words if source != "b" else words[:9] * 3 + words[9:]
        text = rng.choice([" ", "\n", "-", "\x00"]).join(rng.choice(mine) for _ in range(rng.randint(0, 60)))
        rows.append((k, text, rng.choice(["en", "fr", None]), source, "clash", 1, None))
    rows += [(900, None, "en", "silent"), (901, "", "de", "one"), (902, "12 34", "de", "two"), (None, "the of", None, None), (903, "only here", "it", "lonely")]
    rows = [(*r, None, None, None)[:7] for r in rows]
    rows += rows[:5]
    rows.append((904, " ".join("long%s of" % chr(97 + i % 26) for i in range(60_000)), "en", "b", None, None, None))
    return rows


@pytest.mark.parametrize(("least", "block"), [(10, 50_000), (1, 7), (10**6, 10)])
def test_audit_equals_plain_arithmetic(spark, least, block):
    rows = awkward()
    got = D.audit(spark.createDataFrame(rows, SCHEMA).repartition(3), least, 10, block)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == expected(rows, least, 10)


def test_audit_of_an_empty_table(spark):
    assert D.digest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_counts_that_are_handed_on_early_add_up(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(D, "HELD", 20)
    rows = awkward()
    counts, groups, total = D.Counts(), [("en", "a"), ("en", "b")], Counter()
    for s in range(0, len(rows), 40):
        part = [r[1] for r in rows[s : s + 40]]
        counts.add(pa.array(part, pa.string()), np.arange(len(part)) % 2)
        if counts.full():
            for b in counts.out(groups):
                for x in b.to_pylist():
                    total[x["source"], x["term"]] += x["n"]
    for b in counts.out(groups):
        for x in b.to_pylist():
            total[x["source"], x["term"]] += x["n"]
    want = Counter()
    for s in range(0, len(rows), 40):
        for k, r in enumerate(rows[s : s + 40]):
            for t in TERM.findall((r[1] or "").translate(UPPER)):
                want["ab"[k % 2], t] += 1
    assert total == want


def test_slices_of_one_hash_are_told_apart_by_their_bytes():
    words = [b"ab", b"cd", b"ab", b"abc", b"cd", b"x", b"ab"]
    raw = b" ".join(words)
    data = np.frombuffer(raw, np.uint8)
    starts, ends, _ = K.word_spans(data, np.array([0, len(raw)]), D.TERM)
    for hashed in (lambda x: 7, lambda x: len(x), D.xxhash.xxh3_64_intdigest):
        group, first = D.grouped(data, starts, ends, raw, hashed)
        assert [words[first[g]] for g in group] == words and len(first) == 4


def test_shares_are_exact_for_large_counts():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(1, 8 * 10**15)
        v, c = rng.randint(1, 10**9), rng.randint(0, n)
        assert int(D.share(np.array([c]), n, v)[0]) == 1 + 10**9 * (c + 2) // (n + 2 * v)


def test_blocks_of_terms_add_up():
    rng = np.random.default_rng(5)
    dense = rng.integers(0, 4, (6, 40)) * (rng.random((6, 40)) < 0.4)
    dense[2] = 0
    total = dense.sum(1) + 5
    p = D.share(dense, total[:, None], 40)
    want = [[int(D.difference(p[s], p[t]).sum()) for t in range(s + 1, 6)] for s in range(6)]
    for cut in ([0, 40], [0, 13, 14, 40]):
        sums = [np.zeros(5 - s, np.int64) for s in range(6)]
        for lo, hi in pairwise(cut):
            source, term = np.nonzero(dense[:, lo:hi])
            block = D.Block(total, 40, source, term, dense[:, lo:hi][source, term])
            block.width = hi - lo  # columns that no source has do not occur in the library: kept terms have counts
            for s in range(6):
                sums[s] += block.from_(s, cells=8)
        assert [x.tolist() for x in sums] == want

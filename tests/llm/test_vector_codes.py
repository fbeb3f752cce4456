"""Vector codes against a plain search with Python's whole numbers."""

from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from pulsewright.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error string"


def expected(rows, parts, entries, rounds):
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = max((len(v) for _, v, _ in kept), default=0)
    cut = [k * d // parts for k in range(parts + 1)]
    split = lambda v: [tuple((v + [0] * (d - len(v)))[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
    all_parts = [split(v) for _, v, _ in kept]
    books = [[p[k] for p in all_parts[:entries]] for k in range(parts)]

    def assign():
        out = []
        for p in all_parts:
            dist = [[(sum((x - y) ** 2 for x, y in zip(p[k], e, strict=True)), i) for i, e in enumerate(books[k])] for k in range(parts)]
            out.append([min(d) for d in dist])
        return out

    for _ in range(rounds):
        found, members = assign(), defaultdict(list)
        for p, best in zip(all_parts, found, strict=True):
            for k in range(parts):
                members[k, best[k][1]].append(p[k])
        for (k, e), m in members.items():
            books[k][e] = tuple(sum(x) // len(m) for x in zip(*m, strict=True))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found, by_label = assign() if kept else [], defaultdict(int)
    for (_, _, label), best in zip(kept, found, strict=True):
        by_label[label] += sum(b[0] for b in best)
    return sorted(((i, "".join(f"{b[1]:02x}" for b in best), sum(b[0] for b in best), by_label[label], sha) for (i, _, label), best in zip(kept, found, strict=True)), key=repr)


def check(spark, rows):
    got = V.digest(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows, V.PARTS, V.ENTRIES, V.ROUNDS)


def test_codes_equal_a_plain_search(spark):
    rng = random.Random(6)
    rows = [(k, [rng.choice([-1.0, -0.5, 0.0, 0.25, rng.gauss(0, 0.1), rng.gauss(0, 0.1)]) for _ in range(64)], rng.choice([1, 1, 1, 2, None]), "c", "e") for k in range(-20, 180)]
    rows += [(500 + k, rows[3][1], 1, None, None) for k in range(120)]  # one very common vector
    rows += [(501, rows[4][1], 2, None, None), (501, rows[3][1], 1, None, None), (None, rows[5][1], None, None, None), (600, None, 1, None, None), (601, [0.5] * 63 + [None], 1, None, None), (602, [0.5] * 63 + [float("nan")], 1, None, None), (603, [float("-inf")] * 64, 1, None, None)]
    random.Random(1).shuffle(rows)
    check(spark, rows)


@pytest.mark.parametrize("sizes", [[40, 40, 7, 0], [3, 5], [0], []])
def test_codes_of_few_short_and_uneven_vectors(spark, sizes):
    rng = random.Random(8)
    check(spark, [(k, [rng.uniform(-2, 2) for _ in range(n)], k % 2, None, None) for k, n in enumerate(sizes)])


def test_search_inside_the_sphere_finds_what_all_entries_give():
    rng = np.random.default_rng(2)
    for spread in (2, 30, 5000):  # many ties, few, none
        books = V.Codebooks(rng.integers(-spread, spread, (5, 33, 3)))
        x = rng.integers(-spread, spread, (400, 5, 3))
        d = ((x[:, :, None] - books.entries[None]) ** 2).sum(3)
        for before in (np.zeros((400, 5), np.uint8), rng.integers(0, 33, (400, 5)).astype(np.uint8), d.argmin(2).astype(np.uint8)):
            best, least = books.nearest(x, before)
            assert (best == d.argmin(2)).all() and (least == d.min(2)).all()


def test_codes_decode_to_their_entries(spark):
    rng = random.Random(3)
    rows = [(k, [rng.gauss(0, 0.2) for _ in range(32)], k % 3, None, None) for k in range(100)]
    done = V.compress(spark.createDataFrame(rows, SCHEMA))
    back = {r.vec_id: r.whole for r in V.decode(spark, done).collect()}
    error = {r.vec_id: r.error for r in done.codes.collect()}
    for k, v, *_ in rows:
        assert sum((math.floor(256 * x) - y) ** 2 for x, y in zip(v, back[k], strict=True)) == error[k]


def test_components_beyond_exact_squares_are_an_error(spark):
    with pytest.raises(ValueError, match="not supported"):
        V.digest(spark.createDataFrame([(1, [1e12] * 16, 1, None, None)], SCHEMA))

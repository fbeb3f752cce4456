"""Exact quantiles, ranks and interval joins against numpy, pandas and all pairs."""

from __future__ import annotations

import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsewright.operators import audit, intervals
from pulsewright.operators import order_stats as O


def values(seed=1, n=900):
    rng = random.Random(seed)
    rows = [("hot", 5.0) for _ in range(n // 3)] + [(rng.choice(["hot", "a", "b", None]), rng.choice([rng.gauss(0, 1), 5.0, -0.0, 0.0, 1e300, -1e300, None])) for _ in range(n)]
    return [*rows, ("one", 2.5), ("none", None), ("two", 1.0), ("two", 4.0)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(values(), "k string, x double").repartition(5)


@pytest.mark.parametrize("held", [O.HELD, 25])
def test_quantiles_are_exact(df, held):
    qs = {"lo": 0.0, "p": 0.13, "m": 0.5, "q": 0.995, "hi": 1.0}
    got = {r.k: r for r in O.quantiles(df, ["k"], "x", qs, held).collect()}
    by = pd.DataFrame(values(), columns=["k", "x"]).dropna(subset="x").groupby("k", dropna=False).x
    assert set(got) == {"hot", "a", "b", None, "one", "two"}
    for k, xs in by:
        for n, q in qs.items():
            np.testing.assert_allclose(got[None if pd.isna(k) else k][n], np.quantile(xs, q), rtol=1e-12)
    whole = O.quantiles(df, [], "x", qs, held).first()
    np.testing.assert_allclose([whole[n] for n in qs], np.quantile([x for _, x in values() if x is not None], list(qs.values())), rtol=1e-12)
    assert O.quantiles(df.filter("k = 'none'"), ["k"], "x", qs, held).count() == 0
    assert O.quantiles(df.filter("k = 'none'"), [], "x", qs, held).first().m is None


@pytest.mark.parametrize("held", [O.HELD, 25])
def test_ranges_hold_what_they_may(spark, df, held):
    r = O.ranked(df, ["k"], "x", held).toPandas()
    for _, g in r.groupby("k", dropna=False):
        g = g.sort_values("v")
        assert g.before.tolist() == (g.m.cumsum() - g.m).tolist() and (g.n == g.m.sum()).all() and g.v.is_unique


@pytest.mark.parametrize("held", [O.HELD, 25])
def test_average_ranks_and_spearman(spark, df, held):
    got = O.average_ranks(df, ["k"], "x", "r", held).toPandas()
    for _, g in got.groupby("k", dropna=False):
        np.testing.assert_allclose(g.r, g.x.rank())
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b"], 400), "x": rng.integers(0, 20, 400).astype(float), "y": rng.normal(size=400), "z": rng.normal(size=400)})
    pdf.loc[::7, "y"] = np.nan
    rows = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "k string, x double, y double, z double")
    for r in audit.spearman(rows, ["k"], ["x", "y", "z"], held).collect():
        own = pdf[pdf.k == r.k][[r.a, r.b]].dropna()
        np.testing.assert_allclose(r.rho, own[r.a].rank().corr(own[r.b].rank()))


@pytest.mark.parametrize("held", [O.HELD, 25])
def test_median_of_the_others(spark, df, held):
    got = O.median_of_others(df, ["k"], "x", "o", held).collect()
    rows = values()
    assert len(got) == len(rows)
    for r in random.Random(2).sample(got, 150) + [r for r in got if r.k in ("one", "none", "two")]:
        others = [x for k, x in rows if k == r.k and x is not None]
        if r.x is not None:
            others.remove(r.x)
        assert r.o == (statistics.median(others) if others else None) or abs(r.o - statistics.median(others)) < 1e-9 * abs(r.o)
    flat = df.filter("k in ('two', 'one')")
    assert {(r.x, r.o) for r in O.median_of_others(flat, [], "x", "o", held).collect()} == {(1.0, 3.25), (2.5, 2.5), (4.0, 1.75)}


def test_medians_of_columns(spark):
    d = spark.createDataFrame([(1.0, None), (3.0, None), (None, None)], "a double, b double")
    assert O.medians(d, ["a", "b"]) == {"a": 2.0, "b": None}


def spans(seed, n, keys=("a", "b")):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lo = rng.randint(-300, 300)
        out.append((rng.choice(keys), i, lo, lo + rng.choice([0, 0, 1, 3, 17, 64, 900, -2])))
    return out


def test_points_in_intervals_once_each(spark):
    rng = random.Random(4)
    points = [(rng.choice(["a", "b", None]), i, rng.choice([rng.randint(-1300, 1300), 7, None])) for i in range(500)]
    some = [*spans(1, 120), ("a", 500, None, 4), (None, 501, 0, 9)]
    p = spark.createDataFrame(points, "k string, p long, t long")
    s = spark.createDataFrame(some, "k string, i long, start long, end long")
    got = sorted((r.p, r.i) for r in intervals.points_in(p, s, ["k"], "t").collect())
    want = sorted((j, i) for k, j, t in points for q, i, lo, hi in some if k == q and k and t is not None and lo is not None and lo <= t <= hi)
    assert got == want
    assert intervals.points_in(p, s.limit(0), ["k"], "t").count() == 0
    plan = intervals.points_in(p, s, ["k"], "t")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_overlaps_once_each(spark):
    a, b = spans(2, 90), spans(3, 110)
    x = spark.createDataFrame(a, "k string, i long, x0 long, x1 long")
    y = spark.createDataFrame(b, "k string, j long, y0 long, y1 long")
    got = sorted((r.i, r.j) for r in intervals.overlaps(x, y, ["k"], ("x0", "x1"), ("y0", "y1")).collect())
    want = sorted((i, j) for k, i, lo, hi in a for q, j, p, r in b if k == q and lo <= hi and p <= r and lo <= r and hi >= p)
    assert got == want
    for without in (False, True):
        one = {r.i for r in intervals.with_overlap(x, y, ["k"], ("x0", "x1"), ("y0", "y1"), ["i"], without).collect()}
        assert one == ({i for _, i, *_ in a} - {i for i, _ in want} if without else {i for i, _ in want})


def test_labels_and_largest_in_intervals(spark):
    points = [("a", t, float(t % 7)) for t in range(-20, 40)] + [("b", 1, 9.0)]
    some = [("a", 1, 0, 9), ("a", 2, 5, 30), ("a", 3, 100, 110)]
    p = spark.createDataFrame(points, "k string, t long, x double")
    s = spark.createDataFrame(some, "k string, ord long, start long, end long")
    got = {(r.k, r.t): r.name for r in intervals.label_points(p, s.withColumn("name", F.concat(F.lit("f"), "ord")), ["k"], "t", "name", "ord", ["k", "t"]).collect()}
    assert got == {(k, t): next((f"f{o}" for _, o, lo, hi in reversed(some) if k == "a" and lo <= t <= hi), None) for k, t, _ in points}
    best = {r.ord: r.max_x for r in audit.interval_max(s, p, ["k"], "t", "x").collect()}
    assert best == {1: 6.0, 2: 6.0, 3: None}

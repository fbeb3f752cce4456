"""Runs, numbers and look-back over chunks against one task a series and against plain loops."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsewright.operators import alerts, audit
from pulsewright.operators import telemetry as T
from pulsewright.operators import windows as W
from pulsewright.operators.chunked import chunk_of, numbered, with_run_lookback, with_runs


def series(seed, n=400, assets=(0,), steps=(1, 1, 1, 2, 9)):
    rng, rows = random.Random(seed), []
    for a in assets:
        t, on = rng.randint(-50, 50), False
        for _ in range(n):
            t += rng.choice(steps)
            on = on if rng.random() < 0.9 else not on
            rows.append((a, t, None if rng.random() < 0.03 else on, rng.random()))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "asset int, t long, above boolean, score double")


@pytest.mark.parametrize("chunk", [1, 7, 60, 10_000])
def test_one_asset_in_many_tasks_equals_one_task(spark, chunk):
    df = frame(spark, series(3, assets=(0, 1, None)))
    one = W.persists_time(df, "above", "t", ["asset"], 4, 5, start="run")
    many = W.persists_time(df, "above", "t", ["asset"], 4, 5, chunk=chunk, start="run")
    order = ["asset", "t"]
    sort = lambda x, by=order: x.toPandas().sort_values(by, na_position="first").reset_index(drop=True)
    a, b = sort(one), sort(many)
    pd.testing.assert_frame_equal(a[a.above == True], b[a.columns][b.above == True])  # noqa: E712
    assert a.alert_flag.tolist() == b.alert_flag.tolist()
    e, f = (sort(W.islands(df, "above", "t", ["asset"], 5, chunk=c).select("asset", "t", "event_id")) for c in (None, chunk))
    pd.testing.assert_frame_equal(e, f)
    flagged = many.withColumns({"smoothed_score": F.col("score"), "shift": F.lit("x")})
    cols = ["asset", "event_id", "start", "end", "peak_score", "shift", "duration_hours"]
    by_run, by_flag = (sort(x.select(*cols), ["asset", "start"]) for x in (alerts.events_of_runs(flagged, ["asset"], "t", "run"), alerts.events(flagged, ["asset"], "t", max_gap=5, chunk=chunk)))
    pd.testing.assert_frame_equal(by_run, by_flag, check_dtype=False)


def test_links_know_the_row_before_and_the_runs_so_far(spark):
    rows = series(5)
    got = {r.t: r for r in with_runs(frame(spark, rows), ["asset"], ["t"], "t", "above", 5, chunk_of("t", 6), ["score"]).collect()}
    before, run, runs = None, None, 0
    for _, t, above, score in rows:
        if above and not (before and before[2] and t - before[1] <= 5):
            run, runs = t, runs + 1
        r = got[t]
        assert (r._run, r._runs) == (run, runs)
        assert (r._before and tuple(r._before)) == (before and (before[1], bool(before[2]), before[3]))
        before = (0, t, above, score)


def test_generate_in_chunks(spark):
    rows = [(0, i, None, 5.0 if 100 <= i < 250 or 400 <= i < 700 else 0.0) for i in range(900)]
    df = frame(spark, rows).drop("above")
    whole = [x.toPandas().sort_values("t" if k == 0 else "start").reset_index(drop=True) for k, x in enumerate(alerts.generate(df, ["asset"], "t", "score", 1.0, 10, 30))]
    parts = [x.toPandas().sort_values("t" if k == 0 else "start").reset_index(drop=True) for k, x in enumerate(alerts.generate(df, ["asset"], "t", "score", 1.0, 10, 30, chunk=13))]
    for a, b in zip(whole, parts, strict=True):
        pd.testing.assert_frame_equal(a, b[a.columns])
    assert len(whole[1]) == 2


def test_numbers_and_decimation(spark):
    rows = series(8, assets=(0, 1, None))
    got = numbered(frame(spark, rows), ["asset"], ["t"], chunk_of("t", 11), "k").collect()
    for a in (0, 1, None):
        assert [r.k for r in sorted((r for r in got if r.asset == a), key=lambda r: r.t)] == list(range(400))
    df = frame(spark, rows)
    a, b = ({(r.asset, r.t) for r in audit.decimate(df, ["asset"], ["t"], 7, c).collect()} for c in (None, chunk_of("t", 11)))
    assert a == b and len(a) == 3 * 58


def test_frozen_periods_of_the_real_rule(spark):
    rows = [(0, t, 3.0 if t % 5 else 2.0, 0.0) for t in range(40)] + [(0, t, 4.0, 1.0) for t in range(40, 44)]
    b = spark.createDataFrame(rows, "asset int, t long, n double, analog_range_max double")
    for chunk in (None, 3):
        got = audit.frozen_periods(b, T.is_frozen(T.COMPRESSOR), ["asset"], least=4, chunk=chunk).orderBy("start").collect()
        assert [(r.start, r.end, r.buckets) for r in got] == [(5 * k + 1, 5 * k + 4, 4) for k in range(8)]


@pytest.mark.parametrize("first", [1, 40])
def test_look_back_reaches_to_where_runs_begin(spark, tmp_path, first):
    rows = series(11, n=600, assets=(0, 1, 2, 3))
    lo = sorted(t for a, t, *_ in rows if a == 0)[350]
    rows += [(4, t, True, 0.0) for t in range(-3000, lo + 40)]  # a run from the very start
    rows += [(5, -2500, True, 0.0), (5, lo + 3, True, 0.0)]  # nothing for a long time
    rows += [(6, t, True, 0.0) for t in range(lo + 5, lo + 9)]  # nothing before
    path = str(tmp_path / "rows")
    frame(spark, rows).write.parquet(path)
    df = spark.read.parquet(path)
    part, own = with_run_lookback(df, ["asset"], ["t"], "t", lo, lo + 60, "above", 5, first)
    runs = lambda x: {(r.asset, r.t): r.run for r in W.persists_time(x, "above", "t", ["asset"], 4, 5, start="run").filter(own).collect() if r.above}
    assert runs(part) == runs(df)
    assert {r.asset for r in part.collect()} == {r.asset for r in df.filter(own).collect()}
    short = part.filter("asset < 4").agg(F.min("t")).first()[0]
    assert short > lo - 200  # short runs are not read from the start
    assert "PushedFilters: [IsNotNull(t), GreaterThanOrEqual(t," in part._jdf.queryExecution().toString()

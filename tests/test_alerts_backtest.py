from __future__ import annotations

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulsewright.functions.exprs import array_median, clip, first_argmax, register, safe_ratio, shift_label
from pulsewright.operators import alerts, audit, backtest
from pulsewright.operators import windows as W
from pulsewright.operators.economics import break_even, cost_set, net_value, scenarios, warning_value


def series(spark, values, times=None, name="x"):
    return spark.createDataFrame([(0, t, v) for t, v in zip(times or range(len(values)), values, strict=True)], f"asset int, t long, {name} boolean" if isinstance(values[0], bool) else f"asset int, t long, {name} double")


def test_count_persistence(spark):
    x = [bool(v) for v in (0, 1, 1, 1, 0, 1, 1, 1, 1)]
    out = W.persists_count(series(spark, x), "x", ["asset"], ["t"], 3).orderBy("t").collect()
    assert [int(r.alert_flag) for r in out] == [0, 0, 0, 1, 0, 0, 0, 1, 1]


def test_time_persistence_across_a_gap(spark):
    out = W.persists_time(series(spark, [True] * 4, [0, 1, 181, 182]), "x", "t", ["asset"], 3, 5)
    assert not any(r.alert_flag for r in out.collect())


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 9), st.booleans()), min_size=1, max_size=40), st.integers(1, 8))
def test_persistence_and_islands_equal_a_loop(spark, steps, need):
    t, rows, run, prev, flags, events = 0, [], None, (None, False), [], 0
    last_flag = (None, False)
    for gap, above in steps:
        t += gap
        if above and not (prev[1] and prev[0] is not None and t - prev[0] <= 5):
            run = t
        flag = above and t - run + 1 >= need
        if flag and not (last_flag[1] and t - last_flag[0] <= 5):
            events += 1
        rows.append((0, t, above, float(t)))
        flags.append(flag)
        prev, last_flag = (t, above), (t, flag)
    df = spark.createDataFrame(rows, "asset int, t long, above boolean, smoothed_score double")
    out = W.persists_time(df, "above", "t", ["asset"], need, 5)
    assert [r.alert_flag for r in out.orderBy("t").collect()] == flags
    assert alerts.events(out, ["asset"], "t", max_gap=5).count() == events


def test_square_pulse_is_one_event(spark):
    df = series(spark, [5.0 if 100 <= i < 250 else 0.0 for i in range(300)])
    rows, ev = alerts.generate(df, ["asset"], "t", "x", 1.0, 10, 30)
    e = ev.collect()
    assert len(e) == 1 and 100 < e[0].start < 140 and 249 <= e[0].end <= 256


def test_smoothing_is_trailing_and_skips_nulls(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([1.0, None, 3.0, 10.0, 2.0])], "asset int, t long, x double")
    got = [r.smoothed_score for r in alerts.smooth(df, ["asset"], "t", "x", 3).orderBy("t").collect()]
    assert got == [1.0, 1.0, 2.0, 6.5, 3.0]


def test_values_of_warnings(spark):
    c = cost_set()
    df = spark.createDataFrame([(None,), (0.0,), (10.0,), (60.0,), (float("inf"),), (float("nan"),)], "lead double")
    assert [r[0] for r in df.select(warning_value("lead", c)).collect()] == [0, 0, 16000, 21000, 0, 0]
    net = spark.createDataFrame([(60.0,), (10.0,), (None,)], "lead double").agg(net_value("lead", F.lit(4), c), break_even("lead", c)).first()
    assert net[0] == 35000 and net[1] == 74
    assert spark.createDataFrame([(60.0,)], "lead double").agg(break_even("lead", c)).first()[0] == 42
    assert {r.scenario: r.needed for r in scenarios(spark).collect()} == {"24h": 36, "48h": 60, "168h": 180, "336h": 348}
    register(spark)
    assert spark.sql("select value_of_warning(10, 60, 21000, 16000), shift_label(23), shift_label(6)").first()[:] == (16000.0, "Shift 3 (22-06)", "Shift 1 (06-14)")


def hours(h):
    return h * 60


def test_backtest_lead_grace_and_false_alerts(spark):
    start = hours(240)
    w = backtest.failure_windows(spark, [("F1", start, start + hours(6), start + hours(24))], hours(72), hours(24))
    ev = spark.createDataFrame([(start - hours(24), start - hours(20)), (start + hours(20), start + hours(22)), (hours(24), hours(26))], "start long, `end` long")
    d = backtest.failure_details(ev, w).first()
    assert d.detected and d.flagged_early and d.lead_time_hours == 24 and d.detection_delay_hours == 0
    false = backtest.false_alerts(ev, w)
    assert [r.start for r in false.collect()] == [hours(24)]
    lead = F.when(F.col("flagged_early"), F.col("lead_time_hours"))
    assert backtest.failure_details(ev, w).agg(net_value(lead, F.lit(false.count()), cost_set())).first()[0] == 15500
    row = backtest.results_row("m", backtest.failure_details(ev, w), false, 2.0, cost_set()).first()
    assert (row.flagged_early, row.detected_by_end, row.median_lead_h, row.false_alerts, row.false_alerts_per_month, row.net_value_usd) == ("1 / 1", "1 / 1", 24.0, 1, 0.5, 15500)


def test_detection_during_the_failure_is_not_early(spark):
    w = backtest.failure_windows(spark, [("F1", 600, 960, None)], hours(72), hours(24))
    d = backtest.failure_details(spark.createDataFrame([(660, 780)], "start long, `end` long"), w).first()
    assert d.detected and not d.flagged_early and d.lead_time_hours == 0 and d.detection_delay_hours == 1
    late = backtest.failure_details(spark.createDataFrame([(961, 1000)], "start long, `end` long"), w).first()
    assert not late.detected and late.lead_time_hours is None
    capped = backtest.failure_details(spark.createDataFrame([(-hours(500), 700)], "start long, `end` long"), w).first()
    assert capped.lead_time_hours == 72


def test_expressions(spark):
    df = spark.createDataFrame([([3.0, None, 1.0, 2.0], 1.0, 0.0, None), ([], None, 2.0, 5.0), ([4.0, 1.0], 7.0, 7.0, 7.0)], "a array<double>, x double, y double, z double")
    got = df.select(array_median("a"), safe_ratio("x", "y"), clip("x", 2.0, 5.0), first_argmax(["x", "y", "z"], [F.col("x"), F.col("y"), F.col("z")])).collect()
    assert [tuple(r) for r in got] == [(2.0, None, 2.0, "x"), (None, None, None, "z"), (2.5, 1.0, 5.0, "x")]
    shifts = [("night", 22, 6), ("none", 7, 7)]
    assert [r[0] for r in spark.range(24).orderBy("id").select(shift_label("id", shifts)).collect()] == ["night"] * 6 + ["Unassigned"] * 16 + ["night"] * 2


def test_audits(spark):
    t = [0, 10, 100, 110]
    gaps = audit.sampling_gaps(spark.createDataFrame([(0, x * 1_000_000) for x in t], "asset int, us long"), ["asset"], "us").collect()
    assert [(g.gap_start, g.gap_seconds) for g in gaps] == [(10_000_000, 90.0)]
    b = spark.createDataFrame([(0, x, True) for x in (1, 2, 3, 5, 6)] + [(0, 7, False)], "asset int, t long, f boolean")
    assert sorted((r.start, r.buckets) for r in audit.frozen_periods(b, F.col("f"), ["asset"], least=2).collect()) == [(1, 3), (5, 2)]
    df = spark.createDataFrame(pd.DataFrame({"g": [1] * 6, "x": [1.0, 2, 2, 4, 5, 6], "y": [2.0, 1, 4, 3, 6, 9]}))
    want = df.toPandas()[["x", "y"]].rank().corr().iloc[0, 1]
    assert abs(audit.spearman(df, ["g"], ["x", "y"]).first().rho - want) < 1e-12
    assert audit.best_row(df, ["g"], "x", "y").first().x == 6 and audit.decimate(df, ["g"], ["x", "y"], 2).count() == 3

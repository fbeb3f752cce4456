from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsewright.operators import detectors as D
from pulsewright.operators import vibration as V
from pulsewright.operators.lstm import LstmAutoencoder
from pulsewright.sources import registry
from tests.synth import bearing_signal

FREQS = V.defect_frequencies(2000 / 60, 16, 2.815, 0.331, 15.17)


def test_kinematics():
    for k, f in {"bpfo": 236.4, "bpfi": 296.9, "bsf": 139.9, "ftf": 14.8}.items():
        assert abs(FREQS[k] - f) < 0.2


def test_envelope_shows_the_outer_race(spark):
    df = spark.createDataFrame([(0, bearing_signal(FREQS["bpfo"]).tolist()), (1, np.random.default_rng(1).normal(0, 0.05, 20480).tolist())], "id int, samples array<float>")
    hit, noise = V.SpectralFeatures(20480.0, FREQS).add(df).orderBy("id").collect()
    assert hit.env_bpfo > 5 and hit.env_bpfo > 3 * noise.env_bpfo
    x = bearing_signal(FREQS["bpfo"])
    x = x - x.mean()
    assert abs(hit.rms - np.sqrt((x**2).mean())) < 1e-4 and abs(hit.kurtosis - (x**4).mean() / (x**2).mean() ** 2) < 1e-2


def test_time_domain_and_dft_by_array_functions(spark):
    x = np.random.default_rng(3).normal(0, 1, 64)
    df = spark.createDataFrame([(x.tolist(),)], "a array<double>")
    r = df.select(*[c.alias(n) for n, c in V.time_domain("a").items()], V.dft_power("a", 64).alias("p")).first()
    z = x - x.mean()
    np.testing.assert_allclose([r.rms, r.peak, r.crest, r.skewness], [z.std(), abs(z).max(), abs(z).max() / z.std(), (z**3).mean() / z.std() ** 3])
    np.testing.assert_allclose(r.p, np.abs(np.fft.rfft(z * np.hanning(64))) ** 2 / 64, atol=1e-9)
    flat = spark.createDataFrame([([2.0] * 8,)], "a array<double>").select(*[c.alias(n) for n, c in V.time_domain("a").items()]).first()
    assert flat.rms == 0 and flat.crest is None and flat.kurtosis is None


def hi_frame(spark, values, step=1.0):
    return spark.createDataFrame([(1, 1, i * step, float(v)) for i, v in enumerate(values)], "test int, bearing int, hours double, hi double")


def test_onset_needs_persistence(spark):
    hi = hi_frame(spark, [0, 0, 20, 0, 20, 20, 20, 20])
    assert [r.hours for r in V.alarm_episodes(hi, 10.0, 3).collect()] == [6.0]
    assert V.alarm_episodes(hi, 50.0, 3).count() == 0


def test_episodes_and_lead_window(spark):
    hi = hi_frame(spark, [20, 20, 0, 0, 20, 20, 20, 0, 20, 20], 100.0).withColumns({"z_a": F.lit(1.0), "z_b": F.lit(2.0)})
    assert sorted(r.hours for r in V.alarm_episodes(hi, 10.0, 2).collect()) == [100, 500, 900]
    known = spark.createDataFrame([(1, 1, "outer")], "test int, bearing int, known_failure string")
    s = V.onset_summary(hi, 10.0, 2, known, {"z_a": "inner", "z_b": "outer"}, 168.0)
    r = s.first()
    assert r.onset_hours == 900 and r.early_false_alarms == 2 and r.diagnosed == "outer" and r.diagnosis_correct
    e = V.evaluate_onsets(s).first()
    assert (e.detected, e.failed, e.false_alarms) == (1, 1, 2)


def test_cross_bearing_cancels_the_common_mode(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        for b in range(1, 5):
            level = (2.0 if i >= 200 else 1.0) * (5.0 if b == 1 and i >= 350 else 1.0)
            rows.append((1, i, float(i) / 6, b, float(level * np.exp(rng.normal(0, 0.02)))))
    bt = spark.createDataFrame(rows, "test int, timestamp int, hours double, bearing int, rms double")
    hi = V.health_indicator(V.cross_log_ratio(bt, ["rms"]), ["rms"], baseline_hours=24, skip_hours=1, smoothing=6).toPandas()
    mid = hi[hi.timestamp.between(210, 340)]
    assert mid.hi.max() < 6 and hi[(hi.bearing == 1) & (hi.timestamp > 360)].hi.min() > 15


def test_exponential_fit(spark):
    df = spark.createDataFrame([(1, float(h), float(1.5 * np.exp(0.03 * h))) for h in range(60)], "k int, h double, y double")
    r = V.exponential_fit(df, ["k"], F.col("h"), "y").first()
    assert abs(np.exp(r.a) - 1.5) < 1e-6 and abs(r.b - 0.03) < 1e-9


def test_remaining_life_of_a_clean_exponential(spark):
    rows = [(1, b, float(h), float(np.exp(0.05 * max(0, h - 40)))) for b in (1, 2, 3) for h in range(100)]
    hi = spark.createDataFrame(rows, "test int, bearing int, hours double, rms_ratio double")
    known = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "test int, bearing int")
    out = V.remaining_life(hi, known.withColumn("onset_hours", F.lit(40.0)), known).toPandas()
    assert len(out) == 9 and (out.error_h.abs() < 4).all()
    none = V.remaining_life(hi, known.withColumn("onset_hours", F.lit(None).cast("double")), known).toPandas()
    assert none.pred_rul.isna().all()


@pytest.fixture(scope="module")
def healthy(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"asset": 0, "t": np.arange(600), "a": rng.normal(0, 1, 600), "b": rng.normal(5, 2, 600)})
    pdf.loc[5, "a"] = None
    return spark.createDataFrame(pdf)


def odd(spark):
    return spark.createDataFrame([(0, 0, 0.0, 5.0), (0, 1, 9.0, 5.0), (0, 2, 9.0, 25.0), (0, 3, None, 5.0)], "asset int, t int, a double, b double")


def test_control_limits(spark, healthy):
    m = D.ControlLimits(["a", "b"]).fit(healthy)
    s = [r.score for r in m.score(odd(spark)).orderBy("t").collect()]
    assert s[0] < 0.3 and s[1] > 8 and s[2] > 8 and s[3] < 0.3 and m.threshold == 3.0
    assert D.ControlLimits([]).fit(healthy).score(odd(spark)).first().score == 0


def test_isolation_forest_ranks(spark, healthy, tmp_path):
    m = D.IsolationForest(["a", "b"], n_trees=60).fit(healthy)
    s = [r.score for r in m.score(odd(spark)).orderBy("t").collect()]
    assert s[2] > s[1] > s[0] and s[2] > m.threshold
    cl = D.ControlLimits(["a", "b"]).fit(healthy)
    registry.save(spark, {"forest": m, "limits": cl}, str(tmp_path / "models"))
    back = registry.load(spark, str(tmp_path / "models"), ["forest"])
    assert list(back) == ["forest"] and [r.score for r in back["forest"].score(odd(spark)).orderBy("t").collect()] == s
    loaded = registry.load(spark, str(tmp_path / "models"))["limits"].limits
    assert {k: tuple(v) for k, v in loaded.items()} == cl.limits


def test_forest_takes_the_share_asked_for_of_all_rows(spark):
    n = 2000
    pdf = pd.DataFrame({"asset": 0, "t": np.arange(n), "a": np.where(np.arange(n) % 3 == 0, 0.0, np.random.default_rng(1).normal(3, 2, n)), "b": 1.0})
    pdf.loc[7, "a"] = None
    df = spark.createDataFrame(pdf)
    m = D.IsolationForest(["a", "b"], n_trees=20).fit(df)
    assert m.sample == 1600 and m.scale[1] == 1.0
    filled = pdf.a.fillna(pdf.a.median())
    np.testing.assert_allclose([m.fill[0], m.mean[0], m.scale[0]], [pdf.a.median(), filled.mean(), filled.std(ddof=0)])
    assert abs(m.threshold - np.quantile(m.score(df).toPandas().score, 0.99)) < 1e-12
    again = D.IsolationForest(["a", "b"], n_trees=20).fit(df.repartition(7))
    for x, y in zip(m.trees, again.trees, strict=True):
        assert all((x[k] == y[k]).all() for k in "flr")
        np.testing.assert_allclose(x["v"], y["v"])


def test_nodes_too_large_for_a_task_are_split_over_the_cluster(spark, healthy):
    """Whole trees against trees whose upper levels come from aggregates: as deep, and each leaf as many rows as it says."""
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"asset": 0, "t": np.arange(1500), "a": np.where(np.arange(1500) < 700, 2.0, rng.normal(0, 1, 1500)), "b": np.where(np.arange(1500) < 700, 3.0, rng.normal(0, 1, 1500))})
    df = spark.createDataFrame(pdf)  # 700 rows are equal: more than a task may hold, and no node to split
    whole, parts = (D.IsolationForest(["a", "b"], n_trees=120).fit(df, held=h) for h in (10**6, 100))
    x = pdf[["a", "b"]].to_numpy()
    s, q = whole.score_array(x), parts.score_array(x)
    assert np.corrcoef(s, q)[0, 1] > 0.97 and abs(s.mean() - q.mean()) < 0.02 and s[0] < s[700:].mean() and q[0] < q[700:].mean()
    z = (x - parts.mean) / parts.scale
    for t in parts.trees[:5]:
        at = np.zeros(len(z), int)
        for _ in range(60):
            inner = t["f"][at] >= 0
            at = np.where(inner, np.where(z[np.arange(len(z)), np.maximum(t["f"][at], 0)] < t["v"][at], t["l"][at], t["r"][at]), at)
        assert (t["f"][at] < 0).all() and len(set(at[:700].tolist())) == 1


def test_lstm_trains_on_all_gap_free_windows(spark, monkeypatch):
    """Windows end in any batch of Arrow, chunk and group; the threshold is exact, and so are scores."""
    from pulsewright.operators import lstm

    monkeypatch.setattr(lstm, "POOL", 50)
    rows = [(a, i, float(np.sin(i / 3)) + (i == 350) * 4) for a in (0, 1) for i in range(400) if not 200 <= i < 203]
    df = spark.createDataFrame(rows, "asset int, t long, a double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        m = LstmAutoencoder(["a"], seq_len=5, hidden=3, latent=2, epochs=2, batch=16, chunk=30, workers=4).fit(df)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    assert len(m.losses) == 2 and m.losses[1] < m.losses[0]
    assert m.windows == 2 * (196 + 193)  # of each series, before and behind the gap
    own = df.filter("asset = 0").orderBy("t").toPandas()
    x = m.scaled(own.a.to_numpy().reshape(-1, 1))
    at = [i for i in range(len(x) - 4) if own.t[i + 4] - own.t[i] == 4]
    errors = np.tile(m.errors(np.stack([x[i : i + 5] for i in at])), 2)
    assert len(errors) == 2 * (196 + 193) and abs(m.threshold - np.quantile(errors, 1 - m.contamination)) < 1e-9
    s = m.score(df).toPandas().sort_values(["asset", "t"]).reset_index(drop=True)
    want = np.concatenate([[e := m.errors(np.stack([x[i : i + 5] for i in range(len(x) - 4)]))][0][:1].repeat(4), e])
    np.testing.assert_allclose(s.score[: len(x)], want)


def test_thresholds_are_exact_quantiles(spark, healthy):
    q = D.calibrate(healthy.withColumn("s", F.col("b")), ["asset"], "t", "s", 1, 0.995).first().threshold
    assert abs(q - np.quantile(healthy.toPandas().b, 0.995)) < 1e-9


def test_lstm_learns_a_sine_and_its_gradients_are_right(spark):
    m = LstmAutoencoder(["a"], seq_len=5, hidden=3, latent=2, epochs=0)
    x = np.random.default_rng(0).normal(size=(4, 5, 1))
    m._build(np.random.default_rng(1))
    _, g = m._gradients(x)
    for k in m.parts:
        w = m._weights(k)
        at = (1, 1) if w.shape[0] > 1 and w.shape[1] > 1 else (0, 0)
        w[at] += 1e-6
        up = ((m._forward(x)[0] - x) ** 2).mean()
        w[at] -= 2e-6
        down = ((m._forward(x)[0] - x) ** 2).mean()
        w[at] += 1e-6
        assert abs((up - down) / 2e-6 - g[k][at]) < 1e-6, k
    df = spark.createDataFrame([(0, i, float(np.sin(i / 3))) for i in range(400)], "asset int, t long, a double")
    m = LstmAutoencoder(["a"], seq_len=12, hidden=12, latent=6, epochs=30, batch=64, rate=0.01, workers=1).fit(df)
    assert m.losses[-1] < 0.4 * m.losses[0]
    s = m.score(df.withColumn("a", F.when(F.col("t") == 200, 6.0).otherwise(F.col("a")))).toPandas().sort_values("t")
    assert s.score[205] > 5 * s.score[150] and s.score.notna().all()


def test_peaks_in_a_band_and_the_sampling_rate(spark):
    n, rate = 2048, 20480.0
    power = np.zeros(n // 2)
    power[24], power[100], power[101] = 5.0, 9.0, 9.0
    df = spark.createDataFrame([(1, k, float(p)) for k, p in enumerate(power)], "bearing int, pos int, power double")
    got = V.band_peak(df, ["bearing"], rate, n, 200, 400).first()
    assert (got.peak_hz, got.peak_power) == (240.0, 5.0)
    assert V.band_peak(df, ["bearing"], rate, n, 900, 1100).first().peak_hz == 1000.0
    got = V.likelier_rate(df, ["bearing"], n, (20000.0, rate), 240.2).first()
    assert (got.rate, got.peak_hz) == (rate, 240.0)


def test_health_reports(spark):
    from pulsewright.plans import health

    rows = [(1, b, float(h), 30.0 + h if b == 2 and h > 60 else 0.5, float(np.exp(0.02 * h)) if b < 4 else 1.0, 9.0 if b == 2 else 1.0, 2.0) for b in range(1, 5) for h in range(100)]
    hi = spark.createDataFrame(rows, "test int, bearing long, hours double, hi double, rms_ratio double, z_env_bpfo double, z_env_bpfi double")
    known = [{"test": 1, "bearing": 2, "failure": "outer_race"}, {"test": 1, "bearing": 3, "failure": "roller"}]
    out = health.reports(hi, {"known": known, "limit": 10.0, "persistence": 3})
    onset = {r.bearing: r for r in out["onsets"].collect()}
    assert onset[2].onset_hours == 63 and onset[2].diagnosed == "outer_race" and onset[2].diagnosis_correct and onset[2].alarm_hours == "63.0"
    assert onset[3].onset_hours is None and onset[1].known_failure == "none"
    e = out["evaluation"].first()
    assert (e.detected, e.failed, e.median_lead_h, e.false_alarms) == (1, 2, 36.0, 0)
    assert out["life"].filter("bearing = 2").count() == 3 and "naive_rul" in out["naive_life"].columns

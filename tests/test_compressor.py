from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from pulsewright.config import Params
from pulsewright.operators import alerts
from pulsewright.plans import compressor
from pulsewright.schema import SchemaError
from tests.synth import telemetry


def test_raw_rows_to_a_report(spark, tmp_path):
    raw = telemetry(hours=40, frozen=(3, 3.5), gap=(12, 12.4), leak_from=30)
    t0 = int(raw.timestamp[0].timestamp()) // 60
    params = Params(train=(t0 + 60, t0 + 1500), smoothing=10, persistence=20, anticipation=600, grace=120)
    failures = [("F1", t0 + 2100, t0 + 2300, None)]
    feats, _ = compressor.feature_table(spark, spark.createDataFrame(raw), params, failures)
    feats = feats.cache()
    models = compressor.train(feats, params, lstm=False)
    scores = compressor.score(feats, models).cache()
    assert scores.count() == feats.count() and models["isolation_forest"].threshold > 0
    b = compressor.run_backtest(scores, "control_limits", models["control_limits"].threshold, failures, params)
    d = b.details.first()
    assert d.detected and d.failure_id == "F1"
    assert b.report.first().detected_by_end == "1 / 1" and b.rows.count() == scores.count()
    with pytest.raises(SchemaError):
        compressor.score_features(feats.drop("duty_cycle_60m"), models)
    best = compressor.operating_point(scores, "control_limits", failures, params).first()
    smoothed = alerts.smooth(scores, ["asset"], "t", "score_control_limits", params.smoothing).filter(F.col("t").between(*params.train)).toPandas().smoothed_score
    priced = {}
    for q in compressor.QUANTILES:
        r = compressor.run_backtest(scores, "control_limits", float(np.quantile(smoothed, q)), failures, params).report.first()
        priced[q] = r.net_value_usd
    assert best.net_value_usd == max(priced.values()) and best.best_quantile == min(q for q, v in priced.items() if v == max(priced.values()))
    out = compressor.score_raw(spark.createDataFrame(telemetry(hours=3, frozen=None, gap=None)), models)
    assert out.count() == 180


def test_command_line(spark, tmp_path):
    from pulsewright.__main__ import main

    raw = telemetry(hours=26, frozen=None, gap=None, leak_from=23)
    raw.to_csv(tmp_path / "raw.csv", index=False)
    (tmp_path / "p.json").write_text(json.dumps({"train_split": {"start": "2020-03-01 00:00:00", "end": "2020-03-01 20:00:00"}, "alert_logic": {"smoothing_window_minutes": 5, "persistence_minutes": 5}}))
    (tmp_path / "f.json").write_text(json.dumps({"failures": [{"id": "F1", "start": "2020-03-02 01:00:00", "end": "2020-03-02 02:00:00", "maintenance": None}]}))
    base = ["--config", str(tmp_path / "p.json"), "--failures", str(tmp_path / "f.json"), "--data", str(tmp_path)]
    main([*base, "features"])
    main([*base, "models", "--train", "--no-lstm"])
    main([*base, "backtest"])
    main([*base, "replay", "--model", "control_limits"])
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).count() == 2
    assert spark.read.json(str(tmp_path / "replay")).count() > 1400
    points = spark.read.option("header", True).csv(str(tmp_path / "report_operating_points")).collect()
    assert {r.model for r in points} == {"control_limits", "isolation_forest"} and all(float(r.best_quantile) in compressor.QUANTILES and r.net_value_usd for r in points)
    (tmp_path / "q.json").write_text(json.dumps({"train": {}}))
    with pytest.raises(ValueError, match="telemetry"):
        main(["--config", str(tmp_path / "q.json"), "features"])


def test_replay_emits_every_minute_with_the_batch_scores_of_each_detector(spark, tmp_path):
    from pulsewright.__main__ import main

    telemetry(hours=14, frozen=None, gap=None, leak_from=12).to_csv(tmp_path / "raw.csv", index=False)
    (tmp_path / "p.json").write_text(json.dumps({"train_split": {"start": "2020-03-01 00:00:00", "end": "2020-03-01 10:00:00"}, "alert_logic": {"smoothing_window_minutes": 5, "persistence_minutes": 5}}))
    base = ["--config", str(tmp_path / "p.json"), "--data", str(tmp_path)]
    main([*base, "features"])
    main([*base, "models", "--train", "--no-lstm"])
    main([*base, "replay"])
    want = spark.read.parquet(str(tmp_path / "scores")).toPandas().set_index("t").sort_index()
    drift = spark.read.parquet(str(tmp_path / "features")).toPandas().set_index("t").sort_index()
    got = pd.DataFrame([json.loads(r.record) for r in spark.read.json(str(tmp_path / "replay")).collect()]).set_index("t").sort_index()
    assert got.index.tolist() == want.index.tolist()  # the last minute too
    for name in ("control_limits", "isolation_forest"):
        np.testing.assert_allclose(got[f"score_{name}"], want[f"score_{name}"], rtol=1e-6, atol=1e-3)
        assert {f"smoothed_{name}", f"flag_{name}"} <= set(got.columns)
    for z in ("duty_cycle_drift_z", "oil_temp_drift_z"):
        np.testing.assert_allclose(got[z].astype(float), drift[z].astype(float), rtol=1e-6, atol=1e-6)

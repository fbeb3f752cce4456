from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pytest

from pulsewright.operators import telemetry as T
from pulsewright.operators.windows import in_chunks, prefix_sum_window, trailing, with_lookback
from pulsewright.sources.telemetry import as_rows
from pulsewright.streaming.processor import Scorer, replay
from tests.synth import telemetry

C = T.COMPRESSOR
PLAIN = T.Channels(**{**C.__dict__, "chunk": None})


def rows(spark, pdf):
    return as_rows(spark.createDataFrame(pdf))


def small(spark, comp, gap_after=None):
    us = [i * 10_000_000 + (3_600_000_000 if gap_after is not None and i > gap_after else 0) for i in range(len(comp))]
    base = {a: 1.0 for a in C.analogs}
    return spark.createDataFrame(pd.DataFrame([{"asset": 0, "us": u, "tie": 0, **base, "comp": c, "lps": 0} for u, c in zip(us, comp, strict=True)]))


@pytest.fixture(scope="module")
def raw():
    return telemetry()


@pytest.fixture(scope="module")
def feats(spark, raw):
    valid = T.buckets(T.row_signals(rows(spark, raw), C), C).filter(~T.is_frozen(C))
    return T.features(valid, C).toPandas().sort_values("t").reset_index(drop=True)


def test_runs_and_starts(spark):
    out = T.row_signals(small(spark, [1, 0, 0, 0, 1, 0, 0, 1]), C).orderBy("us").toPandas()
    assert out.load_start.tolist() == [0, 1, 0, 0, 0, 1, 0, 0]
    assert out.run_elapsed.tolist() == [0, 0, 10, 20, 0, 0, 10, 0]


def test_a_gap_breaks_a_run(spark):
    out = T.row_signals(small(spark, [0, 0, 0, 1], gap_after=1), C).orderBy("us").toPandas()
    assert out.run_elapsed.tolist() == [0, 10, 0, 0] and out.load_start.sum() == 0


def test_frozen_minutes_are_dropped(spark, raw, feats):
    b = T.buckets(T.row_signals(rows(spark, raw), C), C)
    assert b.filter(T.is_frozen(C)).count() == 60
    t0 = int(raw.timestamp[0].timestamp()) // 60
    assert not feats.t.between(t0 + 600, t0 + 659).any()


def test_features_do_not_look_ahead(spark, raw, feats):
    cut = raw[raw.timestamp < raw.timestamp[0] + pd.Timedelta(hours=15)]
    early = T.features(T.buckets(T.row_signals(rows(spark, cut), C), C).filter(~T.is_frozen(C)), C).toPandas().sort_values("t")
    both = early.iloc[:-1].merge(feats, on="t", suffixes=("", "_all"))
    for c in early.columns.drop(["asset", "t"]):
        np.testing.assert_allclose(both[c].astype(float), both[f"{c}_all"].astype(float), rtol=1e-9)


def test_a_leak_raises_duty_and_decay(spark):
    out = [T.features(T.buckets(T.row_signals(rows(spark, telemetry(hours=12, frozen=None, gap=None, leak_from=x)), C), C), C).toPandas().sort_values("t").iloc[-1] for x in (None, 6.0)]
    assert out[1].duty_cycle_60m > 1.5 * out[0].duty_cycle_60m and out[1].idle_decay_rate_60m > 2 * out[0].idle_decay_rate_60m


def test_chunks_equal_one_series(spark, raw):
    valid = T.buckets(T.row_signals(rows(spark, raw), C), C).filter(~T.is_frozen(C)).cache()
    a = T.features(valid, PLAIN).toPandas().sort_values("t").reset_index(drop=True)
    b = T.features(valid, T.Channels(**{**C.__dict__, "chunk": 300})).toPandas().sort_values("t").reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b[a.columns], rtol=1e-9)


def test_row_signals_in_chunks_equal_one_series(spark, raw):
    df = rows(spark, raw)
    both = [T.row_signals(df, T.Channels(**{**C.__dict__, "chunk": k})).toPandas().sort_values("us").reset_index(drop=True) for k in (None, 7, 60)]
    for other in both[1:]:
        pd.testing.assert_frame_equal(both[0], other[both[0].columns])


def test_drift_shift_and_labels(spark, raw):
    t0 = int(raw.timestamp[0].timestamp()) // 60
    out, base = T.build_features(rows(spark, raw), C, (t0, t0 + 700), [("F1", t0 + 800, t0 + 900), ("F2", t0 + 850, t0 + 950)])
    pdf = out.toPandas()
    healthy = pdf[pdf.t <= t0 + 700]
    assert abs(healthy.duty_cycle_drift_z.mean()) < 1e-9 and abs(healthy.duty_cycle_drift_z.std() - 1) < 1e-9
    assert set(pdf[pdf.t.between(t0 + 850, t0 + 950)].failure_id) == {"F2"} and set(pdf[pdf.t.between(t0 + 800, t0 + 849)].failure_id) == {"F1"}
    assert pdf[pdf.hour == 23]["shift"].unique().tolist() == ["Shift 3 (22-06)"] and pdf[pdf.hour == 6]["shift"].unique().tolist() == ["Shift 1 (06-14)"]
    assert base.count() == 1


def test_training_slice(spark):
    df = spark.range(20).withColumnRenamed("id", "t")
    assert [r.t for r in df.filter(T.training_slice("t", 3, 15, [(5, 7), (10, 10)])).orderBy("t").collect()] == [3, 4, 8, 9, 11, 12, 13, 14, 15]


def test_prefix_sums_and_lookback(spark):
    from pyspark.sql import functions as F

    df = spark.range(400).select(F.lit(1).alias("a"), (F.col("id") * 3 % 997 + F.col("id")).alias("t"), F.sin("id").alias("x")).dropDuplicates(["t"])
    direct = F.sum("x").over(trailing(["a"], "t", 50))
    both = prefix_sum_window(df.withColumn("d", direct), ["a"], "t", "x", 50, "p").toPandas()
    np.testing.assert_allclose(both.d, both.p, atol=1e-9)
    part, own = with_lookback(df, "t", 200, 300, 49)
    sliced = part.withColumn("d", direct).filter(own).toPandas().set_index("t").d
    np.testing.assert_allclose(sliced.sort_index(), both.set_index("t").d.loc[sliced.index].sort_index())
    assert in_chunks(df, "t", 100, 49).filter("_own").count() == df.count()


def test_stream_equals_batch(spark, raw, feats):
    base = {"COMP": "comp", "LPS": "lps"}
    py = raw.rename(columns=base).assign(us=lambda d: d.timestamp.astype("datetime64[us]").astype("int64"), tie=0, asset=0)
    cols = ["us", "tie", *C.analogs, "comp", "lps"]
    limits = {"control_limits": {"duty_cycle_60m": (0.2, 0.05), "oil_temp_std_60m": (1.0, 0.5)}}
    seen = []
    out = pd.DataFrame(replay(py[cols], C, Scorer(limits, {"control_limits": 1.0}, 30, 60), seen.append))
    assert len(seen) == len(out) == len(feats)
    for c in feats.columns.drop(["asset"]):
        np.testing.assert_allclose(out[c].astype(float), feats[c].astype(float), rtol=1e-6, atol=1e-6, err_msg=c)

    from pulsewright.operators import alerts

    scored = spark.createDataFrame(out[["t", "score_control_limits"]].assign(asset=0))
    flagged, ev = alerts.generate(scored, ["asset"], "t", "score_control_limits", 1.0, 30, 60)
    f = flagged.toPandas().sort_values("t")
    np.testing.assert_allclose(f.smoothed_score, out.smoothed_control_limits)
    assert f.alert_flag.tolist() == out.flag_control_limits.tolist()
    assert ev.count() == (out.event_control_limits == "start").sum() > 0


def test_micro_batches_do_not_matter(raw):
    """Rows one by one, in batches and at once; late rows and rows that repeat a time included."""
    from pulsewright.streaming.processor import AssetState

    py = raw.iloc[:900].rename(columns={"COMP": "comp", "LPS": "lps"}).assign(us=lambda d: d.timestamp.astype("datetime64[us]").astype("int64"), tie=0)
    py = pd.concat([py, py.iloc[[100, 101, 300]]]).sort_values("us", kind="stable", ignore_index=True)[["us", "tie", *C.analogs, "comp", "lps"]]
    py = pd.concat([py.iloc[:500], py.iloc[[20, 30]], py.iloc[500:]], ignore_index=True)  # two late rows
    scorer = Scorer({"a": {"duty_cycle_15m": (0.2, 0.05)}}, {"a": 1.0}, 5, 7)
    whole = replay(py, C, scorer)
    for size in (3, 250):
        own, parts = AssetState(C), []
        for s in range(0, len(py), size):
            out = own.push(py.iloc[s : s + size].reset_index(drop=True))
            parts.append(scorer.apply(out, own.carry["alerts"]) if len(out) else out)
            own = AssetState.load(C, *own.saved())
        out = own.flush()
        parts.append(scorer.apply(out, own.carry["alerts"]))
        got = pd.concat([p for p in parts if len(p)], ignore_index=True)
        pd.testing.assert_frame_equal(got, whole, check_dtype=False, rtol=1e-9, atol=1e-9)


def test_structured_stream(spark, raw, feats, tmp_path):
    from pulsewright.streaming.processor import score_stream

    df = rows(spark, raw).select("asset", "us", "tie", *C.analogs, "comp", "lps")
    schema = df.schema
    pdf = df.toPandas().sort_values("us")
    for k, part in enumerate(np.array_split(np.arange(len(pdf)), 3)):
        spark.createDataFrame(pdf.iloc[part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = score_stream(source, C).writeStream.format("memory").queryName("minutes").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    got = pd.DataFrame([json.loads(r.record) for r in spark.sql("select record from minutes").collect()]).sort_values("t").reset_index(drop=True)
    want = feats.iloc[: len(got)]  # the last minute is still open
    assert len(got) == len(feats) - 1
    np.testing.assert_allclose(got.duty_cycle_6h, want.duty_cycle_6h, rtol=1e-6)
    np.testing.assert_allclose(got.oil_temp_excess_24h, want.oil_temp_excess_24h, rtol=1e-6, atol=1e-6)

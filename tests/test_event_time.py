"""The event-time stream: windows from sums, alert rules step by step, and rows out of order against the batch plan."""

from __future__ import annotations

import json
import time

import numpy as np
import pandas as pd
import pytest

from pulsewright.operators import telemetry as T
from pulsewright.streaming import event_time as E
from pulsewright.streaming.processor import Scorer, _minutes, _signals, alert_states, replay
from tests.synth import telemetry

C = T.COMPRESSOR


@pytest.fixture(scope="module")
def rows():
    raw = telemetry(hours=30, frozen=(10, 10.5), gap=(20, 20.5), leak_from=25).rename(columns={"COMP": "comp", "LPS": "lps"})
    out = raw.assign(us=raw.timestamp.astype("datetime64[us]").astype("int64"), tie=0)[["us", "tie", *C.analogs, "comp", "lps"]]
    out.loc[500:520, "Motor_current"] = np.nan
    return out


def sliding(minutes, c, every=10**9):
    """Features of all minutes; the carry goes through JSON and the pages through bytes after every `every` of them."""
    pages, carry, out, touched = {}, {}, [], 0

    def load(k):
        nonlocal touched
        touched += 1
        return pages.get(k)

    for s in range(0, len(minutes), every):
        w = E.Sliding(c, carry, load, pages.__setitem__, lambda k: pages.pop(k, None))
        out += [w.push(m) for m in minutes[s : s + every]]
        carry = json.loads(json.dumps(w.close()))
    return pd.DataFrame(out), pages, touched


def test_sums_queues_and_pages_give_the_windows(rows):
    want = replay(rows, C)
    m = _minutes(_signals(rows.astype(dict.fromkeys(C.analogs, float)), {}, C), C)
    m = m[m.t.isin(want.t)].to_dict("records")
    for every in (10**9, 7):
        got, pages, _ = sliding(m, C, every)
        assert len(pages) <= C.windows[3] // E.PAGE + 2 and len(got) == len(want)
        for c in want.columns:
            np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-6, atol=1e-6, err_msg=c)


def test_a_minute_costs_the_same_however_long_the_windows_are(rows):
    m = _minutes(_signals(rows.astype(dict.fromkeys(C.analogs, float)), {}, C), C).to_dict("records")
    cost = {}
    for longest in (70, 1440):
        c = T.Channels(**{**C.__dict__, "windows": (15, 60, longest - 1, longest)})
        start = time.process_time()
        _, _, touched = sliding(m, c, 1)
        cost[longest] = (time.process_time() - start, touched)
    assert cost[1440][0] < 2 * cost[70][0] and cost[1440][1] < 5.1 * len(m)


def test_alert_steps_equal_the_vectorised_rule():
    rng = np.random.default_rng(2)
    t = np.cumsum(rng.choice([1, 1, 1, 2, 9], 600))
    score = np.where(rng.random(600) < 0.05, np.nan, rng.normal(0, 1, 600) + (np.arange(600) // 60 % 2))
    whole = alert_states(t, score, {}, 0.6, 12, 8, 5)
    for size in (600, 1, 37):
        carry, parts = {}, []
        for s in range(0, 600, size):
            parts.append(E.alert_steps(t[s : s + size], score[s : s + size], carry, 0.6, 12, 8, 5))
            carry = json.loads(json.dumps(carry))
        got = pd.concat(parts, ignore_index=True)
        np.testing.assert_allclose(got.smoothed, whole.smoothed)
        assert got.flag.tolist() == whole.flag.tolist() and got.event.tolist() == whole.event.tolist() and got.flag.any()


def test_rows_out_of_order_give_the_batch_result(spark, tmp_path):
    """Two assets, rows shuffled within eight minutes, in three batches; one asset ends early and its last minute closes all the same."""
    raw = telemetry(hours=6, frozen=(2, 2.2), gap=(4, 4.3), leak_from=5).rename(columns={"COMP": "comp", "LPS": "lps"})
    one = raw.assign(us=raw.timestamp.astype("datetime64[us]").astype("int64"), tie=0)[["us", "tie", *C.analogs, "comp", "lps"]]
    both = pd.concat([one.assign(asset=0), one[one.us < one.us.iloc[0] + 3 * 3600 * 10**6].assign(asset=1)])
    rng = np.random.default_rng(1)
    both = both.iloc[np.argsort(both.us.to_numpy() + rng.integers(0, 8 * 60 * 10**6, len(both)))].reset_index(drop=True)
    late = both.iloc[[5, 40]].assign(tie=1)
    schema = "us long, tie long, " + ", ".join(f"{a} double" for a in C.analogs) + ", comp double, lps double, asset long"
    parts = np.array_split(np.arange(len(both)), 3)
    for k, at in enumerate(parts):
        part = both.iloc[at] if k < 2 else pd.concat([both.iloc[at], late])
        spark.createDataFrame(part.astype({"comp": float, "lps": float}), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken in the order of their times
    E.use_event_time(spark)
    try:
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        scorer = Scorer({"control_limits": {"duty_cycle_60m": (0.2, 0.05)}}, {"control_limits": 1.0}, 5, 7)
        q = E.score_events(source, C, scorer, "10 minutes").writeStream.format("memory").queryName("by_event_time").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(240)
        assert E.late_rows(q) == 2
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = pd.DataFrame([{**json.loads(r.record), "asset": r.asset} for r in spark.sql("select asset, record from by_event_time").collect()])
    end = one.us.max() - 10 * 60 * 10**6
    for asset in (0, 1):
        own = both[both.asset == asset].sort_values(["us", "tie"], ignore_index=True)
        want = replay(own.drop(columns="asset"), C, scorer)
        want = want[(want.t + 1) * 60 * 10**6 <= end].reset_index(drop=True)
        mine = got[got.asset == asset].sort_values("t").reset_index(drop=True)
        assert mine.t.tolist() == want.t.tolist()
        for c in want.columns:
            if c == "event_control_limits":
                assert [x or None for x in mine[c]] == [x or None for x in want[c]]
            else:
                np.testing.assert_allclose(mine[c].astype(float), want[c].astype(float), rtol=1e-6, atol=1e-6, err_msg=c)
    assert got[got.asset == 1].t.max() == (one[one.us < one.us.iloc[0] + 3 * 3600 * 10**6].us.max()) // (60 * 10**6)

"""Streams over tables: bounded micro-batches in the order of time, and what a task holds of them."""

from __future__ import annotations

import json
import os

import numpy as np
import pandas as pd
import pytest

from pulsewright.operators import telemetry as T
from pulsewright.plans import bindings as B
from pulsewright.plans import stores
from pulsewright.streaming import event_time as E
from pulsewright.streaming import processor as P
from pulsewright.streaming import rounds
from tests.synth import telemetry

SF = "/root/testdata/sf0.001"
C = T.COMPRESSOR


@pytest.fixture(scope="module")
def rows():
    raw = telemetry(hours=4, frozen=(2, 2.2), gap=(3, 3.3), leak_from=3.5).rename(columns={"COMP": "comp", "LPS": "lps"})
    return raw.assign(us=raw.timestamp.astype("datetime64[us]").astype("int64"), tie=0)[["us", "tie", *C.analogs, "comp", "lps"]]


def test_rounds_are_in_order_and_of_like_size_also_with_more_files(spark, monkeypatch):
    monkeypatch.setattr(rounds, "ROWS", 250)
    df = spark.createDataFrame([(1000 * (i // 7) * 31 % 50_000, i) for i in range(1000)], "us long, tie long")
    r = rounds.Rounds(df, ["us", "tie"])
    assert r.n == 4 and len(r.groups()) == 4
    spans = [spark.read.parquet(f"{r.cut}/{name}").selectExpr("min((us, tie)) lo", "max((us, tie)) hi", "count(*) n").first() for g in r.groups() for name in g]
    assert sum(s.n for s in spans) == 1000 and all(a.hi < b.lo for a, b in zip(spans, spans[1:], strict=False))
    r.files = [(f"part-{k}", 10) for k in range(21)]
    assert [len(g) for g in r.groups()] == [5, 5, 6, 5] and sum(r.groups(), []) == [name for name, _ in r.files]


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
def test_f1_a_micro_batch_is_bounded_and_no_row_is_lost(spark, monkeypatch):
    monkeypatch.setattr(rounds, "ROWS", 200)
    n = B.telemetry(spark, SF).count()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    _, _, q = stores._collected(spark, SF, lambda df: P.score_stream(df, B.CHANNELS), "bounded")
    taken = [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]
    assert sum(taken) == n and len(taken) == -(-n // 200) and max(taken) < 300
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    cols = ["asset", "t", *T.features_of(B.CHANNELS)]
    got, want = (q.select(*cols).toPandas().sort_values(["asset", "t"], ignore_index=True) for q in (stores.stream_scores(spark, SF), B.features(spark, SF)))
    assert got[["asset", "t"]].values.tolist() == want[["asset", "t"]].values.tolist()
    np.testing.assert_allclose(got[cols[2:]].astype(float), want[cols[2:]].astype(float), rtol=1e-6, atol=2e-6)


class State:
    exists = False

    def update(self, x):
        self.get, self.exists = x, True


def test_f1_a_task_works_on_slices_of_a_micro_batch(rows, monkeypatch):
    seen, push = [], P.AssetState.push
    monkeypatch.setattr(P, "ROWS", 200)
    monkeypatch.setattr(P.AssetState, "push", lambda self, x: seen.append(len(x)) or push(self, x))
    state = State()
    mixed = rows.sample(frac=1, random_state=1)
    got = pd.concat(P._step(C, None)((0,), iter([mixed.iloc[k::3] for k in range(3)]), state))
    assert max(seen) == 200 and sum(seen) == len(rows)
    want = P.replay(rows, C)[:-1]
    got = pd.DataFrame([json.loads(r) for r in got.record])
    assert got.t.tolist() == want.t.tolist()
    for c in want.columns:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-6, atol=1e-6, err_msg=c)


class Map:
    """A map state, and a value state."""

    def __init__(self):
        self.held, self.carry = {}, None

    def containsKey(self, k):
        return k in self.held

    def getValue(self, k):
        return self.held[k]

    def updateValue(self, k, v):
        self.held[k] = v

    def removeKey(self, k):
        del self.held[k]

    def keys(self):
        return list(self.held)

    def exists(self):
        return self.carry is not None

    def get(self):
        return self.carry

    def update(self, x):
        self.carry = x


class Handle:
    def __init__(self):
        self.timers = set()

    def getValueState(self, *names):
        return Map()

    getMapState = getValueState

    def registerTimer(self, at):
        self.timers.add(at)


class Timers:
    def __init__(self, now):
        self.getCurrentWatermarkInMs = lambda: now


def test_f2_a_task_takes_in_and_closes_some_rows_at_a_time(rows, monkeypatch):
    taken, closed, closing, grouped = [], [], E.MinuteProcessor._closed, pd.DataFrame.groupby
    monkeypatch.setattr(P, "ROWS", 200)
    own = E.MinuteProcessor(C, None, 10**9)
    own.init(Handle())
    own._closed = lambda x, carry: closed.append(len(x)) or closing(own, x, carry)
    with monkeypatch.context() as m:
        m.setattr(pd.DataFrame, "groupby", lambda self, *a, **k: taken.append(len(self)) or grouped(self, *a, **k))
        mixed = rows.sample(frac=1, random_state=1)
        list(own.handleInputRows((0,), iter([mixed.iloc[s : s + 90] for s in range(0, len(mixed), 90)]), None))
    assert sum(taken) == len(rows) and max(taken) < 200 + 90
    got = pd.concat(own.handleExpiredTimer((0,), Timers(max(own.handle.timers)), None))
    a_minute = int((rows.us // 60_000_000).value_counts().max())
    assert sum(closed) == len(rows) and max(closed) < 200 + a_minute and not own.open.held
    want = P.replay(rows, C)
    got = pd.DataFrame([json.loads(r) for r in got.record])
    assert got.t.tolist() == want.t.tolist()
    for c in want.columns:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-6, atol=1e-6, err_msg=c)


def test_f3_a_replay_holds_some_rows_at_a_time(rows, monkeypatch):
    """Three assets, one with few rows, whose frames do not end with an asset."""
    monkeypatch.setattr(P, "ROWS", 200)
    table = pd.concat([rows.assign(asset=3), rows.iloc[:5].assign(asset=4), rows.iloc[300:].assign(asset=7)], ignore_index=True)
    read, held, seen, push = 0, [], 0, P.AssetState.push

    def frames():
        nonlocal read
        for s in range(0, len(table), 70):
            read += len(table.iloc[s : s + 70])
            yield table.iloc[s : s + 70]

    def pushed(self, x):
        nonlocal seen
        held.append(read - seen)
        seen += len(x)
        return push(self, x)

    monkeypatch.setattr(P.AssetState, "push", pushed)
    got = pd.concat(P.replayed(frames(), C), ignore_index=True)
    assert seen == len(table) and max(held) < 200 + 70
    for asset, own in table.groupby("asset"):
        want, mine = P.replay(own, C), got[got.asset == asset]
        assert mine.t.tolist() == want.t.tolist()
        for c in want.columns:
            np.testing.assert_allclose(mine[c].astype(float), want[c].astype(float), rtol=1e-6, atol=1e-6, err_msg=c)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
def test_f3_a_table_equals_the_batch_plan(spark):
    cols = ["asset", "t", *T.features_of(B.CHANNELS)]
    want, got = (df.select(*cols).toPandas().sort_values(["asset", "t"], ignore_index=True) for df in (B.features(spark, SF), P.replay_table(B.telemetry(spark, SF), B.CHANNELS)))
    assert got[["asset", "t"]].values.tolist() == want[["asset", "t"]].values.tolist()
    np.testing.assert_allclose(got.astype(float), want.astype(float), rtol=1e-6, atol=1e-6)

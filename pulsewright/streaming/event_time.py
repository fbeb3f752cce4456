"""The stream by event time: rows in any order within the watermark's delay, minutes closed by timers, windows carried as sums.

Rows wait by minute until the watermark has passed the minute's end; a timer then closes it, whether or
not the asset, or any other row of it, comes again. So rows out of order by less than the delay give the batch plan's
result, and the last minute needs no row behind it. Rows later than the watermark are dropped by
Spark, which counts them (`late_rows`). An asset that is silent for `silence` has its state removed;
its windows begin anew should it return.

What a minute costs does not depend on how long the windows are. Each window keeps the sums of its
minutes and where its oldest one stands; a new minute adds its row and takes off those that
have left, which are read from pages of PAGE minutes, so each window touches a page now and then. Extremes
are monotone queues, the smoothing median is a sorted list. Rounding apart, the results are the batch plan's.

A task holds a minute's rows, or some ROWS of an asset, however many a micro-batch has or a timer closes.
"""

from __future__ import annotations

import json
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pulsewright.cluster import ship
from pulsewright.operators.telemetry import MICROS, Channels
from pulsewright.streaming.processor import SCORED, Scorer, _frame, _minutes, _signals, pieces

PAGE = 64


def _pack(x: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(x, preserve_index=False)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as w:
        w.write_table(table)
    return out.getvalue().to_pybytes()


def _unpack(x: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(x).read_all().to_pandas()


def _sum_names(c: Channels) -> list[str]:
    """What windows add up: columns of a minute, and of two channels the minute's mean, its square and whether there is one."""
    return ["n", "loaded_sum", "load_starts", "idle_dp_sum", "idle_dt_sum", "current_loaded_sum", "dp_loaded_sum", "LPS_sum", *dict.fromkeys(f"{a}_sum" for a in (c.current, c.temperature, c.reservoir)), *[f"{k}:{x}" for k in ("cur", "tmp") for x in ("has", "mean", "square")]]


class Sliding:
    """Trailing windows over minutes that come one by one; `carry` is what goes from call to call, pages come from `load` and go to `save`."""

    def __init__(self, c: Channels, carry: dict, load, save, drop):
        self.c, self.carry, self.load, self.save, self.drop = c, carry, load, save, drop
        self.names = _sum_names(c)
        self.at = {n: i for i, n in enumerate(self.names)}
        carry.setdefault("next", 0)
        carry.setdefault("tails", [0] * 4)
        carry.setdefault("queues", {"max": [], "min": []})
        carry.setdefault("middle", {})
        self.sums = np.array(carry.get("sums") or np.zeros((4, len(self.names))), float)
        self.pages: dict[int, np.ndarray] = {}
        self.changed: set[int] = set()

    def _page(self, k: int) -> np.ndarray:
        if k not in self.pages:
            held = self.load(k)
            self.pages[k] = np.frombuffer(held, float).reshape(PAGE, -1).copy() if held else np.zeros((PAGE, len(self.names) + 1))
        return self.pages[k]

    def _row(self, m: dict) -> np.ndarray:
        row = [m.get(n, 0.0) for n in self.names]
        for k, a in (("cur", self.c.current), ("tmp", self.c.temperature)):
            has = m[f"{a}_count"] > 0
            # squares are taken about the first mean, so that little is lost when sums are taken off
            x = m[f"{a}_sum"] / m["n"] - self.carry["middle"].setdefault(k, m[f"{a}_sum"] / m["n"]) if has else 0.0
            for n, v in zip(("has", "mean", "square"), (float(has), x, x * x), strict=True):
                row[self.at[f"{k}:{n}"]] = v
        return np.array(row, float)

    def push(self, m: dict) -> dict:
        """Take the next valid minute (t and its sums); returns its features."""
        c, t, row, own = self.c, int(m["t"]), self._row(m), self.carry
        k, i = divmod(own["next"], PAGE)
        page = self._page(k)
        page[i, 0], page[i, 1:] = t, row
        self.changed.add(k)
        own["next"] += 1
        for w, width in enumerate(c.windows):
            self.sums[w] += row
            while True:
                k, i = divmod(own["tails"][w], PAGE)
                old = self._page(k)[i]
                if old[0] > t - width:
                    break
                self.sums[w] -= old[1:]
                own["tails"][w] += 1
        self._free()
        top, low = self._queue("max", t, m["run_elapsed_max"], max), self._queue("min", t, m[f"{c.reservoir}_lo"], min)
        return self._features(m, top, low)

    def _queue(self, name: str, t: int, v: float, best) -> float:
        """The extreme of the second window: values that a later one beats never matter again."""
        q = self.carry["queues"][name]
        if v == v:
            while q and best(q[-1][1], v) == v:
                q.pop()
            q.append([t, float(v)])
        while q and q[0][0] <= t - self.c.windows[1]:
            q.pop(0)
        return q[0][1] if q else np.nan

    def _free(self) -> None:
        first = min(self.carry["tails"]) // PAGE
        for k in range(self.carry.get("first", 0), first):
            self.drop(k)
            self.pages.pop(k, None)
            self.changed.discard(k)
        self.carry["first"] = first

    def _features(self, m: dict, top: float, low: float) -> dict:
        c, (l1, l2, l3, l4) = self.c, self.c.labels
        cur, tmp, res = c.names["current"], c.names["temperature"], c.names["reservoir"]
        s = lambda x, w: self.sums[w, self.at[x]]
        ratio = lambda a, b, w: s(a, w) / s(b, w) if s(b, w) > 1e-9 else np.nan
        mean = lambda a, w: ratio(f"{a}_sum", "n", w)

        def std(k: str, w: int) -> float:
            n = round(s(f"{k}:has", w))
            return np.sqrt(max(0.0, s(f"{k}:square", w) - s(f"{k}:mean", w) ** 2 / n) / (n - 1)) if n > 1 else np.nan

        out = {"t": int(m["t"])} | {a: m[f"{a}_sum"] / m["n"] if m[f"{a}_count"] > 0 else np.nan for a in c.analogs} | {"loaded_frac": m["loaded_sum"] / m["n"]}
        out |= {f"duty_cycle_{label}": ratio("loaded_sum", "n", w) for w, label in enumerate((l1, l2, l3))}
        out |= {"load_starts_per_hour": s("load_starts", 1), f"max_load_run_min_{l2}": top / 60}
        out |= {f"{cur}_mean_{l1}": mean(c.current, 0), f"{cur}_std_{l1}": std("cur", 0), f"{cur}_mean_{l2}": mean(c.current, 1), f"{cur}_loaded_{l2}": ratio("current_loaded_sum", "loaded_sum", 1)}
        out |= {f"{tmp}_mean_{l1}": mean(c.temperature, 0), f"{tmp}_mean_{l2}": mean(c.temperature, 1), f"{tmp}_std_{l2}": std("tmp", 1), f"{tmp}_excess_{l4}": mean(c.temperature, 1) - mean(c.temperature, 3)}
        out |= {f"delta_p_loaded_{l2}": ratio("dp_loaded_sum", "loaded_sum", 1), f"{res}_mean_{l1}": mean(c.reservoir, 0), f"{res}_min_{l2}": low}
        return out | {f"idle_decay_rate_{l2}": ratio("idle_dp_sum", "idle_dt_sum", 1) * 60, f"lps_frac_{l2}": ratio("LPS_sum", "n", 1), "n_samples": m["n"]}

    def close(self) -> dict:
        """Write what has changed; returns the carry."""
        for k in self.changed:
            self.save(k, self.pages[k].tobytes())
        self.carry["sums"] = self.sums.tolist()
        return self.carry


def alert_steps(t: np.ndarray, score: np.ndarray, carry: dict, threshold: float, smoothing: int, persistence: int, max_gap: int) -> pd.DataFrame:
    """smoothed, flag and event of each minute, one after the other: the window's scores lie in a sorted list, and flags need the last minute only."""
    seen, ordered = carry.setdefault("seen", []), sorted(v for _, v in carry.get("seen", []) if v is not None)
    last, out = carry.get("last"), []
    first = 0
    for now, x in zip(t.tolist(), score.tolist(), strict=True):
        v = None if x is None or x != x else float(x)
        seen.append([int(now), v])
        if v is not None:
            insort(ordered, v)
        while seen[first][0] <= now - smoothing:
            old = seen[first][1]
            if old is not None:
                ordered.pop(bisect_left(ordered, old))
            first += 1
        n = len(ordered)
        smoothed = (ordered[(n - 1) // 2] + ordered[n // 2]) / 2 if n else np.nan
        above = bool(smoothed > threshold)
        near = last is not None and now - last["t"] <= max_gap
        start = (last["start"] if near and last["above"] else int(now)) if above else None
        flag = above and now - start + 1 >= persistence
        held = last is not None and last["flag"]
        out.append((smoothed, flag, "start" if flag and not (held and near) else "end" if held and not flag else None))
        last = {"t": int(now), "above": above, "start": start, "flag": bool(flag)}
    del seen[:first]
    carry["last"] = last
    return pd.DataFrame(out, columns=["smoothed", "flag", "event"]).astype({"smoothed": float, "flag": bool, "event": object})


class MinuteProcessor(StatefulProcessor):
    """One asset's state: a value (sums, queues, alert rules, the row before), pages of minutes, and the rows of minutes that are still open."""

    def __init__(self, c: Channels, scorer: Scorer | None, silence_ms: int):
        self.c, self.scorer, self.silence = c, scorer, silence_ms
        self.bucket_ms = c.bucket_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.own = handle.getValueState("own", "carry string")
        self.pages = handle.getMapState("pages", "page long", "minutes binary")
        self.open = handle.getMapState("open", "t long", "rows binary")

    def _carry(self) -> dict:
        return json.loads(self.own.get()[0]) if self.own.exists() else {"signals": {}, "windows": {}, "alerts": {}, "last": 0}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        carry, last = self._carry(), 0
        for pdf in pieces(rows):
            pdf = pdf[["us", "tie", *self.c.analogs, "comp", "lps"]]
            for t, part in pdf.groupby(pdf["us"] // (self.c.bucket_s * MICROS)):
                k = (int(t),)
                if self.open.containsKey(k):
                    part = pd.concat([_unpack(self.open.getValue(k)[0]), part], ignore_index=True)
                else:
                    self.handle.registerTimer((int(t) + 1) * self.bucket_ms)
                self.open.updateValue(k, (_pack(part),))
                last = max(last, (int(t) + 1) * self.bucket_ms)
        if last > carry["last"]:
            carry["last"] = last
            self.handle.registerTimer(last + self.silence)
        self.own.update((json.dumps(carry),))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, carry = timerValues.getCurrentWatermarkInMs(), self._carry()
        ready = sorted(k[0] for k in self.open.keys() if (k[0] + 1) * self.bucket_ms <= now)
        if ready:
            for rows in pieces(self._taken(t) for t in ready):
                out = self._closed(rows.sort_values(["us", "tie"], kind="stable", ignore_index=True), carry)
                if len(out):
                    yield _frame(key[0], out)
            self.own.update((json.dumps(carry),))
        elif carry["last"] + self.silence <= now and not any(True for _ in self.open.keys()):
            self.own.clear()
            self.pages.clear()
        yield pd.DataFrame()

    def _taken(self, t: int) -> pd.DataFrame:
        """The rows of a minute, which leave the state."""
        rows = _unpack(self.open.getValue((t,))[0])
        self.open.removeKey((t,))
        return rows

    def _closed(self, rows: pd.DataFrame, carry: dict) -> pd.DataFrame:
        """Features, scores and alert states of the minutes of rows, which are whole and in order."""
        c = self.c
        minutes = _minutes(_signals(rows.astype(dict.fromkeys(c.analogs, float)), carry["signals"], c), c)
        load = lambda k: self.pages.getValue((k,))[0] if self.pages.containsKey((k,)) else None
        windows = Sliding(c, carry["windows"], load, lambda k, v: self.pages.updateValue((k,), (v,)), lambda k: self.pages.removeKey((k,)))
        out = []
        for m in minutes.to_dict("records"):
            spread = np.nanmax([m[f"{a}_hi"] - m[f"{a}_lo"] if m[f"{a}_count"] > 0 else np.nan for a in c.analogs] + [-np.inf])
            if not (m["n"] >= c.frozen_rows and spread == 0):
                out.append(windows.push(m))
        carry["windows"] = windows.close()
        out = pd.DataFrame(out)
        return self.scorer.apply(out, carry["alerts"], alert_steps) if self.scorer and len(out) else out

    def close(self) -> None:
        pass


def score_events(rows: DataFrame, c: Channels, scorer: Scorer | None = None, delay: str = "5 minutes", silence: int = 7 * 86_400) -> DataFrame:
    """A stream of rows (asset, us, tie, channels, comp, lps), in any order within `delay`, to a stream of closed minutes (asset, t, n, record as JSON).

    silence: seconds without a row after which an asset's state is removed. The state
    store must be one with several states a key: see `use_event_time`.
    """
    ship(rows.sparkSession)
    cols = ["us", "tie", *c.analogs, "comp", "lps"]
    own = rows.select(F.col("asset").cast("long").alias("asset"), F.col("us").cast("long").alias("us"), F.col("tie").cast("long").alias("tie"), *[F.col(a).cast("double").alias(a) for a in c.analogs], F.col("comp").cast("double").alias("comp"), F.col("lps").cast("double").alias("lps"))
    timed = own.select("asset", *cols, F.timestamp_micros("us").alias("_ts")).withWatermark("_ts", delay)
    return timed.groupBy("asset").transformWithStateInPandas(statefulProcessor=MinuteProcessor(c, scorer, silence * 1000), outputStructType=SCORED, outputMode="append", timeMode="EventTime")


def use_event_time(spark: SparkSession) -> None:
    """Set the state store that score_events needs, for queries that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def late_rows(query) -> int:
    """Rows that a query has dropped as later than its watermark, by its recent progress."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in json.loads(p.json if hasattr(p, "json") else json.dumps(p)).get("stateOperators", []))

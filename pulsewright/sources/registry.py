"""Detector store: one JSON file per detector and a table of thresholds; loads all or those named."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict

import numpy as np
from pyspark.sql import SparkSession

from pulsewright.operators.detectors import ControlLimits, IsolationForest
from pulsewright.operators.lstm import Lstm, LstmAutoencoder
from pulsewright.sources.telemetry import read_json, write_json


def _plain(x):
    if isinstance(x, np.ndarray):
        return {"array": x.tolist(), "kind": str(x.dtype)}
    if isinstance(x, Lstm):
        return {"lstm": x.w.tolist(), "n": x.n}
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    if isinstance(x, list | tuple):
        return [_plain(v) for v in x]
    return x


def _live(x):
    if isinstance(x, dict):
        if "array" in x:
            return np.array(x["array"], dtype=x["kind"])
        if "lstm" in x:
            cell = Lstm(1, x["n"], np.random.default_rng(0))
            cell.w = np.array(x["lstm"])
            return cell
        return {k: _live(v) for k, v in x.items()}
    return [_live(v) for v in x] if isinstance(x, list) else x


KINDS = {"control_limits": ControlLimits, "isolation_forest": IsolationForest, "lstm_autoencoder": LstmAutoencoder}


def save(spark: SparkSession, detectors: dict, folder: str) -> None:
    names = {cls: kind for kind, cls in KINDS.items()}
    for name, d in detectors.items():
        state = {f: getattr(d, f) for f in d.__dataclass_fields__} if not isinstance(d, ControlLimits) else asdict(d)
        write_json(spark, {"kind": names[type(d)], "state": _plain(state)}, f"{folder}/{name}.json")
    write_json(spark, {n: d.threshold for n, d in detectors.items()}, f"{folder}/thresholds.json")


def load(spark: SparkSession, folder: str, names: Sequence[str] | None = None) -> dict:
    thresholds = read_json(spark, f"{folder}/thresholds.json")
    out = {}
    for n in names or thresholds:
        saved = read_json(spark, f"{folder}/{n}.json")
        out[n] = KINDS[saved["kind"]](**_live(saved["state"]))
        if not isinstance(out[n], ControlLimits):
            out[n].threshold = thresholds[n]
    return out

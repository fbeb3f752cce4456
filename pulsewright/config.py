"""Configuration: YAML or JSON files to typed values, read once on the driver."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path

from pulsewright.functions.exprs import DEFAULT_SHIFTS, Shift
from pulsewright.operators.economics import AMOUNTS, cost_set


def load(path: str | Path) -> dict:
    text = Path(path).read_text()
    if str(path).endswith(".json"):
        return json.loads(text)
    import yaml  # only needed for YAML files

    return yaml.safe_load(text)


def bucket_of(when, bucket_s: int = 60) -> int | None:
    """A time (UTC if it names no zone) as a whole-numbered bucket."""
    if when is None:
        return None
    at = when if isinstance(when, datetime) else datetime.fromisoformat(str(when))
    at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
    return int(at.timestamp()) // bucket_s


@dataclass(frozen=True)
class Params:
    train: tuple[int | None, int]
    exclude: tuple[tuple[int, int], ...] = ()
    shifts: tuple[Shift, ...] = DEFAULT_SHIFTS
    smoothing: int = 30
    persistence: int = 60
    quantile: float = 0.995
    anticipation: int = 72 * 60
    grace: int = 24 * 60

    @classmethod
    def from_dict(cls, section: dict, bucket_s: int = 60) -> Params:
        b = lambda x: bucket_of(x, bucket_s)
        hours = 3600 // bucket_s
        alert, test = section.get("alert_logic", {}), section.get("backtest", {})
        shifts = section.get("shifts")
        return cls(
            train=(b(section["train_split"].get("start")), b(section["train_split"]["end"])),
            exclude=tuple((b(x["start"]), b(x["end"])) for x in section.get("train_exclude") or []),
            shifts=tuple((s["label"], s["start_hour"], s["end_hour"]) for s in shifts.values()) if shifts else DEFAULT_SHIFTS,
            smoothing=alert.get("smoothing_window_minutes", 30) * 60 // bucket_s, persistence=alert.get("persistence_minutes", 60) * 60 // bucket_s, quantile=alert.get("threshold_quantile", 0.995),
            anticipation=int(test.get("anticipation_hours", 72) * hours), grace=int(test.get("post_failure_grace_hours", 24) * hours),
        )


def failures(entries: list[dict], bucket_s: int = 60) -> list[tuple]:
    """(id, start, end, maintenance or None) in buckets, in the order of the report."""
    return [(e["id"], bucket_of(e["start"], bucket_s), bucket_of(e["end"], bucket_s), bucket_of(e.get("maintenance"), bucket_s)) for e in entries]


def amounts(path: str | Path) -> dict[str, float]:
    """The amounts and hours that a file states, at its top or in its sections."""
    found = load(path)
    tables = [found, *(v for v in found.values() if isinstance(v, dict))]
    return {k: float(t[k]) for t in tables for k in AMOUNTS if k in t}


def costs(path: str | Path) -> dict[str, float]:
    """The cost set of a file."""
    return cost_set(amounts(path))


def section(found: dict, name: str, keys: tuple[str, ...], needed: bool = True) -> dict:
    """The section of a configuration; a file without one of that name is that section, if it has one of its keys."""
    if name in found:
        return found[name]
    if needed and not any(k in found for k in keys):
        raise ValueError(f"no section {name}, and none of its keys: {', '.join(keys)}")
    return found

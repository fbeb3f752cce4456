"""From scores to alert events: trailing median, strict threshold, persistence, islands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsewright.operators.windows import in_chunks, islands, ordered, persists_time, trailing, trailing_median

MAX_GAP = 5


def smooth(df: DataFrame, keys: Sequence[str], t: str, score: str, window: int = 30, method: str = "median", name: str = "smoothed_score", chunk: int | None = None) -> DataFrame:
    """Trailing median or mean. chunk: units of time of one task of a long series."""
    rows, by = (in_chunks(df, t, chunk, window - 1), [*keys, "_chunk"]) if chunk else (df, list(keys))
    frame = trailing(by, t, window)
    out = rows.withColumn(name, trailing_median(score, frame) if method == "median" else F.avg(score).over(frame))
    return out.filter("_own").drop("_own", "_chunk") if chunk else out


def events(flagged: DataFrame, keys: Sequence[str], t: str, flag: str = "alert_flag", score: str = "smoothed_score", max_gap: float = MAX_GAP, unit_hours: float = 1 / 60, chunk: int | None = None) -> DataFrame:
    """One row per run of flagged rows: event_id within the keys, start, end, duration_hours, peak_score, shift of the first row."""
    rows = islands(flagged, flag, t, keys, max_gap, chunk=chunk)
    return _summed(rows, [*keys, "event_id"], t, score, unit_hours)


def events_of_runs(flagged: DataFrame, keys: Sequence[str], t: str, run: str, flag: str = "alert_flag", score: str = "smoothed_score", unit_hours: float = 1 / 60) -> DataFrame:
    """The same from persists_time's flags, with the start of the run that it gives: no second pass over the series.

    Within a run of rows above the limit the flag comes once and stays, and the next run is
    another event, so the flagged rows of one run are one event. Events are numbered among
    themselves; they are few beside the rows.
    """
    out = _summed(flagged.filter(F.col(flag)), [*keys, run], t, score, unit_hours).drop(run)
    return out.withColumn("event_id", F.row_number().over(ordered(keys, ["start"])).cast("long"))


def _summed(rows: DataFrame, by: Sequence[str], t: str, score: str, unit_hours: float) -> DataFrame:
    shift = [F.min_by("shift", t).alias("shift")] if "shift" in rows.columns else []
    out = rows.groupBy(*by).agg(F.min(t).alias("start"), F.max(t).alias("end"), F.max(score).alias("peak_score"), *shift)
    return out.withColumn("duration_hours", (F.col("end") - F.col("start")) * unit_hours)


def generate(df: DataFrame, keys: Sequence[str], t: str, score: str, threshold, window: int = 30, persistence: int = 60, max_gap: float = MAX_GAP, unit_hours: float = 1 / 60, chunk: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with smoothed_score and alert_flag, events). threshold: a number or the name of a column. chunk: units of time of one task of a long series."""
    out = smooth(df, keys, t, score, window, chunk=chunk)
    limit = F.col(threshold) if isinstance(threshold, str) else F.lit(float(threshold))
    out = out.withColumn("_above", F.coalesce(F.col("smoothed_score") > limit, F.lit(False)))
    out = persists_time(out, "_above", t, keys, persistence, max_gap, chunk=chunk, start="_start").drop("_above")
    return out.drop("_start"), events_of_runs(out, keys, t, "_start", unit_hours=unit_hours)

"""Back-tests: alert events against documented failures, at one or many thresholds, in one plan.

Failures are a small configuration table (a handful of rows, created on the
driver), so its joins are broadcast. Times are whole numbers of `unit_hours`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsewright.operators.economics import total_value, warning_value
from pulsewright.operators.alerts import events_of_runs
from pulsewright.operators.windows import persists_time

DAYS_PER_MONTH = 30.4375


def failure_windows(spark: SparkSession, failures: Sequence[tuple], anticipation: int, grace: int) -> DataFrame:
    """failures: (id, start, end, maintenance or None). The window opens `anticipation` before the start and closes with maintenance, or `grace` after the end, but not before the end."""
    rows = [(i, f[0], f[1], f[2], f[1] - anticipation, max(f[2], f[3] if f[3] is not None else f[2] + grace)) for i, f in enumerate(failures)]
    return spark.createDataFrame(rows, "ord int, failure_id string, f_start long, f_end long, w_start long, w_end long")


def match(events: DataFrame, windows: DataFrame) -> DataFrame:
    """Event and window pairs that overlap, ends included."""
    return events.join(F.broadcast(windows), (events["start"] <= F.col("w_end")) & (events["end"] >= F.col("w_start")))


def false_alerts(events: DataFrame, windows: DataFrame) -> DataFrame:
    return events.join(F.broadcast(windows), (events["start"] <= F.col("w_end")) & (events["end"] >= F.col("w_start")), "left_anti")


def failure_details(events: DataFrame, windows: DataFrame, by: Sequence[str] = (), groups: DataFrame | None = None, unit_hours: float = 1 / 60) -> DataFrame:
    """One row per failure (and group): first alert that starts before the failure ends, detected, flagged_early, lead and delay.

    The lead counts from the window's opening at most. groups: the values of `by` to report even without events.
    """
    hits = match(events, windows).filter(F.col("start") <= F.col("f_end"))
    first = hits.groupBy(*by, "failure_id").agg(F.min("start").alias("first_alert"))
    every = windows if groups is None else groups.crossJoin(F.broadcast(windows))
    out = every.join(first, [*by, "failure_id"], "left")
    lead = (F.col("f_start") - F.greatest("first_alert", "w_start")) * unit_hours
    out = out.withColumn("_lead", F.when(F.col("first_alert").isNotNull(), lead))
    return out.select(
        *by, "failure_id", "f_start", "f_end", "first_alert", F.col("first_alert").isNotNull().alias("detected"), F.coalesce(F.col("_lead") > 0, F.lit(False)).alias("flagged_early"),
        F.when(F.col("_lead").isNotNull(), F.greatest("_lead", F.lit(0.0))).alias("lead_time_hours"), F.when(F.col("_lead").isNotNull(), F.greatest(-F.col("_lead"), F.lit(0.0))).alias("detection_delay_hours"),
    )


def false_by_shift(scored: DataFrame, false_events: DataFrame, per_day: float = 1440.0) -> DataFrame:
    """False alerts a month of each shift's scored time; only shifts with time are listed."""
    exposure = scored.groupBy("shift").agg((F.count(F.lit(1)) / per_day).alias("days"))
    count = false_events.groupBy("shift").agg(F.count(F.lit(1)).alias("n"))
    return exposure.join(count, "shift", "left").select("shift", F.coalesce("n", F.lit(0)).alias("false_alerts"), (F.coalesce("n", F.lit(0)) / F.greatest(F.col("days") / DAYS_PER_MONTH, F.lit(1e-9))).alias("per_month"))


def events_by_threshold(smoothed: DataFrame, thresholds: DataFrame, keys: Sequence[str], t: str, persistence: int, max_gap: float, chunk: int | None = None) -> DataFrame:
    """Events at every threshold at once: scores are smoothed once and each row meets the small table of thresholds.

    thresholds: column threshold, and persistence if it varies.
    """
    rows = smoothed.crossJoin(F.broadcast(thresholds)).withColumn("_above", F.coalesce(F.col("smoothed_score") > F.col("threshold"), F.lit(False)))
    by = [*keys, *thresholds.columns]
    steps = F.col("persistence") if "persistence" in thresholds.columns else F.lit(persistence)
    flagged = persists_time(rows, "_above", t, by, steps, max_gap, chunk=chunk, start="_start")
    return events_of_runs(flagged, by, t, "_start").drop("duration_hours", "shift")


def sweep(smoothed: DataFrame, thresholds: DataFrame, windows: DataFrame, scenarios: DataFrame, keys: Sequence[str], t: str, persistence: int, max_gap: float, eval_start: int, unit_hours: float = 1 / 60, chunk: int | None = None) -> DataFrame:
    """Detections, leads, false alerts, net value and break-even of each threshold under each scenario."""
    by = thresholds.columns
    ev = events_by_threshold(smoothed, thresholds, keys, t, persistence, max_gap, chunk).filter(F.col("end") >= eval_start)
    detail = failure_details(ev, windows, by, thresholds, unit_hours)
    n_false = false_alerts(ev, windows).groupBy(*by).agg(F.count(F.lit(1)).alias("false_alerts"))
    span = smoothed.agg((F.greatest((F.max(t) - eval_start) * unit_hours / 24 / DAYS_PER_MONTH, F.lit(1e-9))).alias("months"))
    valued = detail.withColumn("lead", F.when(F.col("flagged_early"), F.col("lead_time_hours"))).crossJoin(F.broadcast(scenarios))
    out = valued.groupBy(*by, "scenario", "inspection").agg(
        F.sum(F.col("flagged_early").cast("long")).alias("flagged_early"), F.sum(F.col("detected").cast("long")).alias("detected"), F.median("lead").alias("median_lead_h"), F.sum(warning_value("lead")).alias("value")
    )
    out = out.join(n_false, by, "left").join(F.broadcast(span)).withColumn("false_alerts", F.coalesce("false_alerts", F.lit(0)))
    return out.select(
        *by, "scenario", "flagged_early", "detected", "median_lead_h", "false_alerts", (F.col("false_alerts") / F.col("months")).alias("false_alerts_per_month"),
        (F.col("value") - F.col("false_alerts") * F.col("inspection")).alias("net_value"), (F.col("value") / F.col("inspection") / F.col("months")).alias("break_even_per_month"),
    )


def results_row(name: str, detail: DataFrame, n_false: DataFrame, months: float, costs: dict[str, float]) -> DataFrame:
    """One report row: early and detected of all, median lead, false alerts and a month, net value."""
    lead = F.when(F.col("flagged_early"), F.col("lead_time_hours"))
    total = n_false.agg(F.count(F.lit(1)).alias("false_alerts"))
    row = detail.agg(F.sum(F.col("flagged_early").cast("long")).alias("e"), F.sum(F.col("detected").cast("long")).alias("d"), F.count(F.lit(1)).alias("n"), F.median(lead).alias("m"), total_value(lead, costs).alias("v")).join(F.broadcast(total))
    return row.select(
        F.lit(name).alias("model"), F.concat_ws(" / ", F.col("e").cast("string"), F.col("n").cast("string")).alias("flagged_early"), F.concat_ws(" / ", F.col("d").cast("string"), F.col("n").cast("string")).alias("detected_by_end"),
        F.round("m", 1).alias("median_lead_h"), "false_alerts", F.round(F.col("false_alerts") / months, 2).alias("false_alerts_per_month"), F.round(F.col("v") - F.col("false_alerts") * costs["inspection"]).alias("net_value_usd"),
    )

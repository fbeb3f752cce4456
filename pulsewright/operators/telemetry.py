"""Telemetry: causal row signals, buckets, trailing features, baseline, drift, shifts and labels.

Rows have asset, us (microseconds), tie (breaks ties of us), analog channels and
the digital comp and lps. Names of channels and sizes of windows are parameters;
`COMPRESSOR` has the domain's own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsewright.functions.exprs import safe_ratio, shift_label
from pulsewright.operators.chunked import with_runs
from pulsewright.operators.windows import in_chunks, ordered, trailing

MICROS = 1_000_000


@dataclass(frozen=True)
class Channels:
    """Which channel plays which part, and the sizes of buckets, gaps and windows (in buckets)."""

    analogs: tuple[str, ...]
    reservoir: str
    current: str
    temperature: str
    pressure_in: str
    pressure_out: str
    bucket_s: int = 60
    gap_s: float = 60.0
    frozen_rows: int = 3
    windows: tuple[int, int, int, int] = (15, 60, 360, 1440)
    labels: tuple[str, str, str, str] = ("15m", "60m", "6h", "24h")
    chunk: int | None = None  # buckets of one task of a long series; None: one task a series
    names: Mapping[str, str] = field(default_factory=lambda: {"current": "motor_current", "temperature": "oil_temp", "reservoir": "reservoir"})


COMPRESSOR = Channels(
    analogs=("TP2", "TP3", "H1", "DV_pressure", "Reservoirs", "Oil_temperature", "Motor_current"),
    reservoir="Reservoirs", current="Motor_current", temperature="Oil_temperature", pressure_in="TP2", pressure_out="TP3", chunk=14 * 1440,
)


def row_signals(df: DataFrame, c: Channels) -> DataFrame:
    """Adds loaded, load_start, run_elapsed, idle_dp and idle_dt. One sort: all windows share their specification.

    With c.chunk a series is cut into chunks of time, each a partition of its own; what a
    chunk needs of all before it, the last row and the start of the load run, is its link.
    """
    out = df.withColumn("loaded", (1 - F.col("comp")).cast("int"))
    gap = c.gap_s * MICROS
    if c.chunk:
        part = F.floor(F.col("us") / (c.bucket_s * MICROS * c.chunk))
        out = with_runs(out, ["asset"], ["us", "tie"], "us", F.col("loaded") == 1, gap, part, [c.reservoir])
        out = out.withColumns({"_dt": (F.col("us") - F.col("_before.t")) / F.lit(float(MICROS)), "_on": F.col("_before.flag"), "_pr": F.col(f"_before.{c.reservoir}")})
    else:
        w = ordered(["asset"], ["us", "tie"])
        out = out.withColumns({"_dt": (F.col("us") - F.lag("us").over(w)) / F.lit(float(MICROS)), "_on": F.lag("loaded").over(w) == 1, "_pr": F.lag(c.reservoir).over(w)})
        begins = F.when((F.col("loaded") == 1) & ~F.coalesce(F.col("_on") & (F.col("_dt") <= c.gap_s), F.lit(False)), F.col("us"))
        out = out.withColumn("_run", F.last(begins, True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    near = F.coalesce((F.col("_dt") <= c.gap_s) & ~F.col("_on"), F.lit(False))  # and idle before
    idle = (F.col("loaded") == 0) & near
    out = out.withColumns({
        "load_start": ((F.col("loaded") == 1) & near).cast("int"),
        "run_elapsed": F.when(F.col("loaded") == 1, (F.col("us") - F.col("_run")) / F.lit(float(MICROS))).otherwise(0.0),
        "idle_dp": F.when(idle, F.col("_pr").cast("double") - F.col(c.reservoir).cast("double")).otherwise(0.0),
        "idle_dt": F.when(idle, F.col("_dt")).otherwise(0.0),
    })
    return out.drop("_dt", "_on", "_pr", "_run", "_runs", "_before")


def buckets(signals: DataFrame, c: Channels) -> DataFrame:
    """One row per asset and non-empty bucket t; sums, counts and extremes only, so partial aggregation is exact."""
    x = lambda n: F.col(n).cast("double")
    aggs = [F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(x(a)).alias(f"{a}_sum") for a in c.analogs]]
    aggs += [F.max(x(c.current)).alias(f"{c.current}_max"), F.min(x(c.reservoir)).alias(f"{c.reservoir}_min"), F.max(x(c.reservoir)).alias(f"{c.reservoir}_max")]
    aggs += [F.sum(x("loaded")).alias("loaded_sum"), F.sum(x("load_start")).alias("load_starts"), F.max("run_elapsed").alias("run_elapsed_max"), F.sum("idle_dp").alias("idle_dp_sum"), F.sum("idle_dt").alias("idle_dt_sum")]
    aggs += [F.sum(x(c.current) * F.col("loaded")).alias("current_loaded_sum"), F.sum((x(c.pressure_in) - x(c.pressure_out)) * F.col("loaded")).alias("dp_loaded_sum"), F.sum(x("lps")).alias("LPS_sum")]
    spread = [F.max(x(a)) - F.min(x(a)) for a in c.analogs]
    aggs.append((F.greatest(*spread) if len(spread) > 1 else spread[0]).alias("analog_range_max"))
    return signals.groupBy("asset", F.floor(F.col("us") / (c.bucket_s * MICROS)).alias("t")).agg(*aggs)


def is_frozen(c: Channels) -> Column:
    return (F.col("n") >= c.frozen_rows) & (F.col("analog_range_max") == 0)


def features(valid: DataFrame, c: Channels) -> DataFrame:
    """The feature catalogue over valid buckets, by trailing windows (t - w, t]."""
    w1, w2, w3, w4 = c.windows
    l1, l2, l3, l4 = c.labels
    cur, tmp, res = c.names["current"], c.names["temperature"], c.names["reservoir"]
    df, keys = valid, ["asset"]
    if c.chunk:
        df, keys = in_chunks(valid, "t", c.chunk, w4 - 1), ["asset", "_chunk"]
    df = df.withColumns({a: F.col(f"{a}_sum") / F.col("n") for a in c.analogs} | {"loaded_frac": F.col("loaded_sum") / F.col("n")})
    s = lambda x, w: F.sum(x).over(trailing(keys, "t", w))
    mean = lambda x, w: safe_ratio(s(f"{x}_sum", w), s("n", w))
    out = df.select(
        *keys, *(["_own"] if c.chunk else []), "t", *c.analogs, "loaded_frac",
        safe_ratio(s("loaded_sum", w1), s("n", w1)).alias(f"duty_cycle_{l1}"), safe_ratio(s("loaded_sum", w2), s("n", w2)).alias(f"duty_cycle_{l2}"), safe_ratio(s("loaded_sum", w3), s("n", w3)).alias(f"duty_cycle_{l3}"),
        s("load_starts", w2).alias("load_starts_per_hour"),
        (F.max("run_elapsed_max").over(trailing(keys, "t", w2)) / 60.0).alias(f"max_load_run_min_{l2}"),
        mean(c.current, w1).alias(f"{cur}_mean_{l1}"), F.stddev_samp(c.current).over(trailing(keys, "t", w1)).alias(f"{cur}_std_{l1}"), mean(c.current, w2).alias(f"{cur}_mean_{l2}"),
        safe_ratio(s("current_loaded_sum", w2), s("loaded_sum", w2)).alias(f"{cur}_loaded_{l2}"),
        mean(c.temperature, w1).alias(f"{tmp}_mean_{l1}"), mean(c.temperature, w2).alias(f"{tmp}_mean_{l2}"), F.stddev_samp(c.temperature).over(trailing(keys, "t", w2)).alias(f"{tmp}_std_{l2}"),
        (mean(c.temperature, w2) - mean(c.temperature, w4)).alias(f"{tmp}_excess_{l4}"),
        safe_ratio(s("dp_loaded_sum", w2), s("loaded_sum", w2)).alias(f"delta_p_loaded_{l2}"),
        mean(c.reservoir, w1).alias(f"{res}_mean_{l1}"), F.min(f"{c.reservoir}_min").over(trailing(keys, "t", w2)).alias(f"{res}_min_{l2}"),
        (safe_ratio(s("idle_dp_sum", w2), s("idle_dt_sum", w2)) * 60.0).alias(f"idle_decay_rate_{l2}"),
        safe_ratio(s("LPS_sum", w2), s("n", w2)).alias(f"lps_frac_{l2}"),
        F.col("n").alias("n_samples"),
    )
    return out.filter("_own").drop("_own", "_chunk") if c.chunk else out


def features_of(c: Channels) -> list[str]:
    """Names of the feature columns, in their order."""
    (l1, l2, l3, l4), (cur, tmp, res) = c.labels, (c.names[k] for k in ("current", "temperature", "reservoir"))
    return [
        *c.analogs, "loaded_frac", *[f"duty_cycle_{x}" for x in (l1, l2, l3)], "load_starts_per_hour", f"max_load_run_min_{l2}", f"{cur}_mean_{l1}", f"{cur}_std_{l1}", f"{cur}_mean_{l2}", f"{cur}_loaded_{l2}",
        f"{tmp}_mean_{l1}", f"{tmp}_mean_{l2}", f"{tmp}_std_{l2}", f"{tmp}_excess_{l4}", f"delta_p_loaded_{l2}", f"{res}_mean_{l1}", f"{res}_min_{l2}", f"idle_decay_rate_{l2}", f"lps_frac_{l2}", "n_samples",
    ]


def drift_targets(c: Channels) -> list[tuple[str, str]]:
    l2, cur, tmp = c.labels[1], c.names["current"], c.names["temperature"]
    return [(f"duty_cycle_{l2}", "duty_cycle_drift_z"), (f"{cur}_mean_{l2}", f"{cur}_drift_z"), (f"{tmp}_mean_{l2}", f"{tmp}_drift_z"), (f"idle_decay_rate_{l2}", "idle_decay_drift_z")]


def fit_baseline(feats: DataFrame, c: Channels, end: int, start: int | None = None, exclude: Sequence[tuple[int, int]] = ()) -> DataFrame:
    """One row: mu_<x> and sd_<x> of the drift sources over the healthy slice (closed interval of buckets); sd is 1 if it vanishes.

    By default no episodes are excluded, unlike when detectors are trained.
    """
    healthy = feats.filter(training_slice("t", start, end, exclude))
    aggs = []
    for x, _ in drift_targets(c):
        sd = F.stddev_samp(x)
        aggs += [F.avg(x).alias(f"mu_{x}"), F.when(sd > 1e-9, sd).otherwise(1.0).alias(f"sd_{x}")]
    return healthy.agg(*aggs)


def apply_drift(feats: DataFrame, baseline: DataFrame, c: Channels) -> DataFrame:
    """z = (x - mu) / sd; the baseline is one row by construction, so it is broadcast."""
    out = feats.join(F.broadcast(baseline))
    out = out.withColumns({z: (F.col(x) - F.col(f"mu_{x}")) / F.col(f"sd_{x}") for x, z in drift_targets(c)})
    return out.drop(*baseline.columns)


def training_slice(t: str, start: int | None, end: int, exclude: Sequence[tuple[int, int]] = ()) -> Column:
    """Closed interval without the closed intervals of `exclude`."""
    ok = F.col(t) <= end
    if start is not None:
        ok = ok & (F.col(t) >= start)
    for lo, hi in exclude:
        ok = ok & ~F.col(t).between(lo, hi)
    return ok


def calendar(df: DataFrame, seconds: Column, shifts=None) -> DataFrame:
    """Adds hour, day_of_week, is_weekend and shift of a time in seconds (UTC)."""
    ts = F.timestamp_seconds(seconds)
    kw = {} if shifts is None else {"shifts": shifts}
    out = df.withColumns({"hour": F.hour(ts), "day_of_week": F.date_format(ts, "EEEE"), "is_weekend": F.weekday(ts) >= 5})
    return out.withColumn("shift", shift_label("hour", **kw))


def label_failures(df: DataFrame, t: str, failures: Sequence[tuple]) -> DataFrame:
    """is_failure and failure_id of rows within [start, end] of a failure (id, start, end, ...); the last that matches wins."""
    label = F.lit(None).cast("string")
    for f in failures:
        label = F.when(F.col(t).between(f[1], f[2]), F.lit(f[0])).otherwise(label)
    return df.withColumn("failure_id", F.coalesce(label, F.lit("healthy"))).withColumn("is_failure", F.col("failure_id") != "healthy")


def build_features(raw: DataFrame, c: Channels, train: tuple[int | None, int], failures: Sequence[tuple] = (), baseline: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Raw rows to the full feature table, and the baseline: signals on all rows, buckets, frozen ones dropped, then windows."""
    valid = buckets(row_signals(raw, c), c).filter(~is_frozen(c))
    feats = features(valid, c)
    if baseline is None:
        baseline = fit_baseline(feats, c, train[1], train[0])
    out = apply_drift(feats, baseline, c)
    out = calendar(out, F.col("t") * c.bucket_s)
    return label_failures(out, "t", failures), baseline

"""The compressor's own pipeline: features, detectors, scores, alerts, back-test; and scoring of requests."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsewright.cluster import materialise
from pulsewright.config import Params
from pulsewright.operators import alerts, audit, backtest, order_stats
from pulsewright.operators import telemetry as T
from pulsewright.operators.detectors import ControlLimits, IsolationForest, calibrate
from pulsewright.operators.economics import AMOUNTS, cost_set, scenarios
from pulsewright.operators.lstm import LstmAutoencoder
from pulsewright.schema import require
from pulsewright.sources.telemetry import as_rows

# The features of each detector.
CONTROL_FEATURES = ("duty_cycle_60m", "max_load_run_min_60m", "load_starts_per_hour", "idle_decay_rate_60m", "oil_temp_excess_24h")
FOREST_FEATURES = (
    "duty_cycle_15m", "duty_cycle_60m", "duty_cycle_6h", "load_starts_per_hour", "max_load_run_min_60m", "motor_current_loaded_60m", "motor_current_std_15m",
    "oil_temp_excess_24h", "oil_temp_std_60m", "delta_p_loaded_60m", "reservoir_min_60m", "idle_decay_rate_60m", "lps_frac_60m",
)
LSTM_FEATURES = ("TP2", "TP3", "H1", "DV_pressure", "Reservoirs", "Motor_current", "loaded_frac", "oil_temp_excess_24h")

KEYS = ["asset"]


def detectors(lstm: bool = True) -> dict:
    out: dict = {"control_limits": ControlLimits(list(CONTROL_FEATURES)), "isolation_forest": IsolationForest(list(FOREST_FEATURES))}
    if lstm:
        out["lstm_autoencoder"] = LstmAutoencoder(list(LSTM_FEATURES))
    return out


def train(feats: DataFrame, params: Params, lstm: bool = True) -> dict:
    """Fit on the healthy slice; thresholds of the learned detectors are quantiles of its smoothed scores, control limits keep their rule."""
    healthy = feats.filter(T.training_slice("t", params.train[0], params.train[1], params.exclude))
    out = detectors(lstm)
    for d in out.values():
        d.fit(healthy)
        if not isinstance(d, ControlLimits):
            d.threshold = float(calibrate(d.score(healthy), KEYS, "t", "score", params.smoothing, params.quantile, chunk=T.COMPRESSOR.chunk).first().threshold)
    return out


def score(feats: DataFrame, models: dict) -> DataFrame:
    """asset, t, shift, failure columns and score_<model> of each."""
    out = feats
    for name, d in models.items():
        out = d.score(out, f"score_{name}")
    return out.select("asset", "t", "shift", "is_failure", "failure_id", *[f"score_{n}" for n in models])


@dataclass
class Backtest:
    rows: DataFrame
    events: DataFrame
    details: DataFrame
    false_events: DataFrame
    by_shift: DataFrame
    report: DataFrame


def run_backtest(scores: DataFrame, name: str, threshold: float, failures: Sequence[tuple], params: Params, costs: dict[str, float] | None = None) -> Backtest:
    """Alerts of one score column at one threshold against the failures, from the end of training on."""
    spark = scores.sparkSession
    costs = costs or cost_set()
    rows, ev = alerts.generate(scores, KEYS, "t", f"score_{name}", threshold, params.smoothing, params.persistence, chunk=T.COMPRESSOR.chunk)
    ev = ev.filter(F.col("end") >= params.train[1])
    windows = backtest.failure_windows(spark, failures, params.anticipation, params.grace)
    details = backtest.failure_details(ev, windows)
    false = backtest.false_alerts(ev, windows)
    last = scores.agg(F.max("t")).first()[0]
    months = max((last - params.train[1]) / 1440 / backtest.DAYS_PER_MONTH, 1e-9)
    return Backtest(rows, ev, details, false, backtest.false_by_shift(scores.filter(F.col("t") >= params.train[1]), false), backtest.results_row(name, details, false, months, costs))


# The healthy quantiles that a threshold is chosen among.
QUANTILES = (0.95, 0.97, 0.98, 0.99, 0.993, 0.995, 0.997, 0.998, 0.999, 0.9995, 0.9999)


def operating_point(scores: DataFrame, name: str, failures: Sequence[tuple], params: Params, amounts: dict[str, float] | None = None, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """One report row: the healthy quantile of a model's smoothed scores whose threshold is worth most, the least of equals.

    Scores are smoothed once, the thresholds are exact quantiles, and all of them are one sweep.
    """
    spark = scores.sparkSession
    smoothed = materialise(alerts.smooth(scores, KEYS, "t", f"score_{name}", params.smoothing, chunk=T.COMPRESSOR.chunk), "smoothed")
    healthy = smoothed.filter(T.training_slice("t", params.train[0], params.train[1], params.exclude))
    row = order_stats.quantiles(healthy, [], "smoothed_score", {f"q{i}": q for i, q in enumerate(quantiles)}).first()
    grid = spark.createDataFrame([(float(row[f"q{i}"]), float(q)) for i, q in enumerate(quantiles) if row[f"q{i}"] is not None], "threshold double, quantile double")
    cases = scenarios(spark, amounts, [{**AMOUNTS, **(amounts or {})}["parts_delivery_hours"]])
    windows = backtest.failure_windows(spark, failures, params.anticipation, params.grace)
    swept = backtest.sweep(smoothed, grid, windows, cases, KEYS, "t", params.persistence, alerts.MAX_GAP, params.train[1], chunk=T.COMPRESSOR.chunk)
    best = audit.best_row(swept, ["scenario"], "net_value", "quantile")
    return best.select(
        F.lit(name).alias("model"), F.col("quantile").alias("best_quantile"), "threshold", "flagged_early", F.round("median_lead_h", 1).alias("median_lead_h"), F.round("false_alerts_per_month", 2).alias("false_alerts_per_month"),
        F.round("break_even_per_month", 1).alias("break_even_per_month"), F.round("net_value").alias("net_value_usd"),
    )


def score_features(df: DataFrame, models: dict) -> DataFrame:
    """Scores of feature rows; says which columns are missing."""
    need = sorted({f for d in models.values() for f in d.features})
    require(df, need)
    out = df
    for name, d in models.items():
        out = d.score(out, f"score_{name}").withColumn(f"anomaly_{name}", F.col(f"score_{name}") > d.threshold)
    return out


def score_raw(df: DataFrame, models: dict) -> DataFrame:
    """Raw rows to scored minutes, by the batch plan."""
    c = T.COMPRESSOR
    valid = T.buckets(T.row_signals(as_rows(df), c), c).filter(~T.is_frozen(c))
    return score_features(T.features(valid, c), models)


def feature_table(spark: SparkSession, raw: DataFrame, params: Params, failures: Sequence[tuple] = ()) -> tuple[DataFrame, DataFrame]:
    return T.build_features(as_rows(raw), T.COMPRESSOR, params.train, failures)

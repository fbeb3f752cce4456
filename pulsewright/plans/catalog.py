"""Every operator as a query over the driver's tables. Results are rounded to six places, as the oracles are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsewright.cluster import materialise
from pulsewright.functions.exprs import first_argmax, safe_ratio, shift_label
from pulsewright.operators import alerts, audit, backtest, economics, intervals, order_stats
from pulsewright.operators import telemetry as T
from pulsewright.operators import vibration as V
from pulsewright.operators import windows as W
from pulsewright.operators.chunked import chunk_of, with_run_lookback
from pulsewright.operators.detectors import ControlLimits, IsolationForest, calibrate
from pulsewright.operators.lstm import LstmAutoencoder
from pulsewright.plans import bindings as B
from pulsewright.streaming.processor import replay_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def r6(c: str | Column, name: str | None = None) -> Column:
    # sums in another order may fall on either side of a tie: values are moved off the ties of six places first
    x = F.round((F.col(c) if isinstance(c, str) else c).cast("double") + F.lit(1e-9), 6)
    return (x + F.lit(0.0)).alias(name or c)


def big(c: str | Column, name: str | None = None) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long").alias(name or c)


def windows(spark: SparkSession, anticipation: int = B.ANTICIPATION) -> DataFrame:
    return backtest.failure_windows(spark, B.FAILURES, anticipation, B.GRACE)


# --- rows and buckets ---------------------------------------------------------------


@query
def row_signals(spark, d):
    return B.signals(spark, d).select(big("tie"), big("asset"), big("loaded"), big("load_start"), r6("run_elapsed"), r6("idle_dp"), r6("idle_dt"))


@query
def run_elapsed(spark, d):
    s = B.signals(spark, d).filter("loaded = 1")
    return s.groupBy("asset").agg(F.max("run_elapsed").alias("m"), F.avg("run_elapsed").alias("a")).select(big("asset"), r6("m", "longest_run"), r6("a", "mean_run"))


@query
def gap_audit(spark, d):
    return audit.sampling_gaps(B.telemetry(spark, d), ["asset"], "us", 2 * 3600.0).select(big("asset"), big("gap_start"), big("gap_end"), r6("gap_seconds"), r6("gap_hours"))


@query
def longest_gaps(spark, d):
    return audit.top_rows(gap_audit(spark, d), "gap_seconds", 10, "asset", "gap_start")


@query
def interval_histogram(spark, d):
    w = W.ordered(["asset"], ["us", "tie"])
    dt = B.telemetry(spark, d).select(((F.col("us") - F.lag("us").over(w)) / 3.6e9).alias("h")).filter("h is not null")
    return audit.histogram(dt, F.col("h"), 0, 12, 24).select(big("bin"), big("n"))


@query
def range_profile(spark, d):
    p = audit.profile(B.telemetry(spark, d), ["a1", "a2", "comp", "lps"], B.HELD)
    return p.select("signal", big("missing_count"), *[r6(c) for c in ("missing_pct", "min", "p01", "median", "mean", "p99", "max", "std")])


@query
def state_contingency(spark, d):
    c = audit.contingency(B.telemetry(spark, d), "comp", "lps")
    return c.select(F.coalesce(F.col("comp").cast("string"), F.lit("all")).alias("comp"), F.coalesce(F.col("lps").cast("string"), F.lit("all")).alias("lps"), big("n"))


@query
def group_means(spark, d):
    t = B.telemetry(spark, d).withColumn("shift", shift_label(F.floor(F.col("us") / 3.6e9) % 24))
    return audit.group_means(t, ["shift", "comp"], ["a1", "a2"]).select("shift", big("comp"), big("n"), r6("mean_a1"), r6("mean_a2"))


@query
def predicate_share(spark, d):
    return B.telemetry(spark, d).groupBy("asset").agg(F.avg((F.col("a2") > 50).cast("double")).alias("s")).select(big("asset"), r6("s", "share_over_50"))


@query
def interval_value_counts(spark, d):
    t = B.telemetry(spark, d).withColumn("k", F.col("a2").cast("long"))
    return audit.value_counts(t, "k", 10).select("k", big("n"))


@query
def hour_buckets(spark, d):
    h = B.hours(spark, d)
    return h.select(big("asset"), big("t"), *[r6(c) for c in h.columns if c not in ("asset", "t")])


@query
def frozen_periods(spark, d):
    """Runs of at least two hours with three rows and more whose coarse channels stand still."""
    return audit.frozen_periods(B.coarse_hours(spark, d), T.is_frozen(B.CHANNELS), ["asset"], least=2, chunk=B.CHUNK).select(big("asset"), big("start"), big("end"), big("buckets"))


@query
def sparse_periods(spark, d):
    """Runs of at least two hours in which every hour has fewer than three rows."""
    return audit.frozen_periods(B.hours(spark, d), F.col("n") < 3, ["asset"], least=2, chunk=B.CHUNK).select(big("asset"), big("start"), big("end"), big("buckets"))


@query
def run_lookback(spark, d):
    """Load runs of two days, read with as much before them as their runs reach back."""
    raw = B.telemetry(spark, d).withColumn("loaded", (1 - F.col("comp")).cast("int"))
    lo, hi = (B.T0 + 400) * B.HOUR * T.MICROS, (B.T0 + 448) * B.HOUR * T.MICROS
    rows, own = with_run_lookback(raw, ["asset"], ["us", "tie"], "us", lo, hi, F.col("loaded") == 1, B.CHANNELS.gap_s * T.MICROS, 6 * B.HOUR * T.MICROS)
    return T.row_signals(rows, B.CHANNELS).filter(own).select(big("tie"), big("asset"), big("load_start"), r6("run_elapsed"))


@query
def resample_means(spark, d):
    t = B.telemetry(spark, d).withColumn("t", F.floor(F.col("us") / 3.6e9))
    return audit.resample_mean(t, ["asset"], "t", ["a1", "a2"], 12).select(big("asset"), big("bin"), r6("a1"), r6("a2"))


@query
def densify(spark, d):
    b = B.hours(spark, d).select("asset", "t", "n")
    g = audit.densify(b, ["asset"], "t")
    return g.groupBy("asset").agg(F.count(F.lit(1)).alias("hours"), F.count("n").alias("filled")).select(big("asset"), big("hours"), big("filled"))


@query
def distinct_counts(spark, d):
    e = B.table(spark, d, "events")
    return e.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.array_join(F.sort_array(F.collect_set((F.col("user_id") % 8).cast("string"))), ",").alias("assets")).select("event_type", big("users"), "assets")


# --- trailing windows ---------------------------------------------------------------


@query
def trailing_duty(spark, d):
    h = B.hours(spark, d)
    s = lambda x, n: F.sum(x).over(W.trailing(["asset"], "t", n))
    return h.select(big("asset"), big("t"), *[r6(safe_ratio(s("loaded_sum", n), s("n", n)), f"duty_{n}h") for n in (6, 24, 72)])


@query
def trailing_std(spark, d):
    h = B.hours(spark, d).withColumn("m", F.col("a1_sum") / F.col("n"))
    return h.select(big("asset"), big("t"), *[r6(F.stddev_samp("m").over(W.trailing(["asset"], "t", n)), f"std_{n}h") for n in (6, 24)])


@query
def trailing_extrema(spark, d):
    h = B.hours(spark, d)
    w = W.trailing(["asset"], "t", 24)
    return h.select(big("asset"), big("t"), r6(F.max("run_elapsed_max").over(w), "max_run"), r6(F.min("a1_min").over(w), "min_a1"))


@query
def prefix_sums(spark, d):
    h = B.hours(spark, d)
    return W.prefix_sum_window(h, ["asset"], "t", "a1_sum", 168, "s").select(big("asset"), big("t"), F.round("s", 4).alias("sum_168h"))


@query
def idle_decay(spark, d):
    h = B.hours(spark, d)
    w = W.trailing(["asset"], "t", 24)
    return h.select(big("asset"), big("t"), r6(safe_ratio(F.sum("idle_dp_sum").over(w), F.sum("idle_dt_sum").over(w)) * 60.0, "decay"))


@query
def feature_table(spark, d):
    f = B.features(spark, d)
    return f.select(big("asset"), big("t"), *[r6(c) for c in f.columns if c not in ("asset", "t")])


@query
def lookback_slice(spark, d):
    """The features of two days, read with their lookback only."""
    rows, own = W.with_lookback(B.hours(spark, d), "t", B.T0 + 400, B.T0 + 448, 23)
    w = W.trailing(["asset"], "t", 24)
    return rows.withColumn("s", F.sum("n").over(w)).filter(own).select(big("asset"), big("t"), r6("s", "rows_24h"))


@query
def baseline_drift(spark, d):
    f = B.features(spark, d)
    out = T.apply_drift(f, T.fit_baseline(f, B.CHANNELS, B.TRAIN[1], B.TRAIN[0]), B.CHANNELS)
    return out.select(big("asset"), big("t"), *[r6(z) for _, z in T.drift_targets(B.CHANNELS)])


@query
def shift_assign(spark, d):
    return B.scores(spark, d).select(big("asset"), big("t"), big("hour"), "shift")


@query
def calendar_parts(spark, d):
    s = B.scores(spark, d)
    return s.groupBy("day_of_week", "is_weekend").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("m")).select("day_of_week", "is_weekend", big("n"), r6("m", "mean_score"))


@query
def failure_labels(spark, d):
    s = T.label_failures(B.scores(spark, d), "t", B.FAILURES)
    return s.groupBy("asset", "failure_id", "is_failure").agg(F.count(F.lit(1)).alias("n")).select(big("asset"), "failure_id", "is_failure", big("n"))


@query
def failure_labels_by_bins(spark, d):
    """The labels from a table of failures by asset, as many as there may be: by an interval join."""
    rows = [(a, i, f[0], f[1] + 6 * a, f[2] + 6 * a) for a in range(8) for i, f in enumerate(B.FAILURES)] + [(1, 9, "F9", B.T0 + 262, B.T0 + 300)]
    f = spark.createDataFrame(rows, "asset long, ord int, failure_id string, start long, end long")
    s = intervals.label_points(B.scores(spark, d).select("asset", "t"), f, ["asset"], "t", "failure_id", "ord", ["asset", "t"])
    return s.groupBy("asset", F.coalesce("failure_id", F.lit("healthy")).alias("failure_id")).agg(F.count(F.lit(1)).alias("n")).select(big("asset"), "failure_id", big("n"))


@query
def training_slice(spark, d):
    s = B.scores(spark, d).filter(T.training_slice("t", B.TRAIN[0], B.TRAIN[1], B.EXCLUDE))
    return s.groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("m")).select(big("asset"), big("n"), r6("m", "mean_score"))


# --- detectors and alerts -----------------------------------------------------------

_CL = ("duty_cycle_w2", "cur_mean_w2", "tmp_std_w2")


@query
def control_limit_scores(spark, d):
    f = B.features(spark, d)
    cl = ControlLimits(_CL)
    limits = cl.limits_of(f.filter(T.training_slice("t", B.TRAIN[0], B.TRAIN[1], B.EXCLUDE)))
    z = cl.excursion(_CL, lambda x: F.col(f"mu_{x}"), lambda x: F.col(f"sd_{x}"))
    return f.join(F.broadcast(limits)).select(big("asset"), big("t"), r6(z, "score"), (r6(z, "score") > 3.0).alias("above"))


@query
def smoothed_median(spark, d):
    return alerts.smooth(B.scores(spark, d), ["asset"], "t", "score", B.SMOOTHING, chunk=B.CHUNK).select(big("asset"), big("t"), r6("smoothed_score"))


@query
def smoothed_mean(spark, d):
    return alerts.smooth(B.scores(spark, d), ["asset"], "t", "score", B.SMOOTHING, "mean", chunk=B.CHUNK).select(big("asset"), big("t"), r6("smoothed_score"))


@query
def rolling_median_rows(spark, d):
    s = B.scores(spark, d)
    return s.select(big("asset"), big("t"), r6(W.trailing_median("score", W.trailing_rows(["asset"], ["t"], 12)), "median_12"))


@query
def quantile_thresholds(spark, d):
    s = alerts.smooth(B.scores(spark, d).filter(T.training_slice("t", *B.TRAIN, B.EXCLUDE)), ["asset"], "t", "score", B.SMOOTHING)
    q = order_stats.quantiles(s, ["asset"], "smoothed_score", {"q50": 0.5, "q90": 0.9, "q97": 0.97, "q995": 0.995}, B.HELD)
    return q.select(big("asset"), *[r6(n) for n in ("q50", "q90", "q97", "q995")])


_LIMIT = 50.0


def _smoothed(spark, d):
    """Smoothed scores to six places, as the limits meet them."""
    s = alerts.smooth(B.scores(spark, d), ["asset"], "t", "score", B.SMOOTHING, chunk=B.CHUNK)
    return s.withColumn("smoothed_score", F.round(F.col("smoothed_score") + 1e-9, 6))


def _flagged(spark, d):
    s = _smoothed(spark, d).withColumn("above", F.col("smoothed_score") > _LIMIT)
    return W.persists_time(s, "above", "t", ["asset"], B.PERSISTENCE, B.MAX_GAP, chunk=B.CHUNK, start="run")


@query
def persistence_time(spark, d):
    return _flagged(spark, d).select(big("asset"), big("t"), "above", "alert_flag")


@query
def persistence_count(spark, d):
    s = B.scores(spark, d).withColumn("above", F.round("score", 6) > _LIMIT)
    return W.persists_count(s, "above", ["asset"], ["t"], 3).select(big("asset"), big("t"), "above", "alert_flag")


def _events(spark, d):
    return alerts.events_of_runs(_flagged(spark, d), ["asset"], "t", "run", unit_hours=1.0)


@query
def alert_events(spark, d):
    return _events(spark, d).select(big("asset"), big("event_id"), big("start"), big("end"), r6("duration_hours"), r6("peak_score"), "shift")


@query
def episodes(spark, d):
    """Runs of hours whose longest load run within a day is over six hours."""
    h = B.hours(spark, d).withColumn("f", F.max("run_elapsed_max").over(W.trailing(["asset"], "t", 24)) > 6 * 3600)
    rows = W.islands(h, "f", "t", ["asset"], B.MAX_GAP, "run", B.CHUNK)
    return rows.groupBy("asset", "run").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count(F.lit(1)).alias("n")).filter("`end` - start >= 1").select(big("asset"), big("run"), big("start"), big("end"), big("n"))


@query
def sequence_windows(spark, d):
    s = W.sequences(B.scores(spark, d), ["asset"], "t", ["score"], 12)
    return s.select(big("asset"), big("t"), "contiguous", r6(F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x["score"]) / 12, "mean_of_12"))


# --- back-test and economics --------------------------------------------------------


@query
def incident_match(spark, d):
    m = backtest.match(_events(spark, d), windows(spark))
    return m.select(big("asset"), big("event_id"), "failure_id", big("start"), big("end"), big("w_start"), big("w_end"))


@query
def event_failure(spark, d):
    """The failure an event is booked on: the last that matches."""
    m = backtest.match(_events(spark, d), windows(spark)).groupBy("asset", "event_id").agg(F.max_by("failure_id", "ord").alias("failure_id"))
    return m.select(big("asset"), big("event_id"), "failure_id")


@query
def false_alerts(spark, d):
    return backtest.false_alerts(_events(spark, d), windows(spark)).select(big("asset"), big("event_id"), big("start"), big("end"))


@query
def false_alerts_by_shift(spark, d):
    s = backtest.false_by_shift(B.scores(spark, d), backtest.false_alerts(_events(spark, d), windows(spark)), 24.0)
    return s.select("shift", big("false_alerts"), r6("per_month"))


def _leads(spark, d, anticipation: int = B.ANTICIPATION):
    return backtest.failure_details(_events(spark, d).filter(F.col("end") >= B.TRAIN[1]), windows(spark, anticipation), unit_hours=1.0)


@query
def lead_times(spark, d):
    return _leads(spark, d).select("failure_id", big("first_alert"), "detected", "flagged_early", r6("lead_time_hours"), r6("detection_delay_hours"))


@query
def median_lead(spark, d):
    return _leads(spark, d).agg(F.median(F.when(F.col("flagged_early"), F.col("lead_time_hours"))).alias("m"), F.sum(F.col("detected").cast("long")).alias("detected")).select(r6("m", "median_lead_h"), big("detected"))


def _early():
    return F.when(F.col("flagged_early"), F.col("lead_time_hours"))


@query
def net_value(spark, d):
    n = backtest.false_alerts(_events(spark, d).filter(F.col("end") >= B.TRAIN[1]), windows(spark)).agg(F.count(F.lit(1)).alias("n_false"))
    c = economics.cost_set()
    v = _leads(spark, d).agg(economics.total_value(_early(), c).alias("v")).join(F.broadcast(n))
    return v.select(big("n_false"), r6(F.col("v") - F.col("n_false") * c["inspection"], "net_value"))


@query
def break_even(spark, d):
    return _leads(spark, d).agg(economics.break_even(_early(), economics.cost_set()).alias("b")).select(r6("b", "break_even_false_alerts"))


@query
def parts_scenarios(spark, d):
    x = _leads(spark, d).withColumn("lead", _early()).crossJoin(F.broadcast(economics.scenarios(spark)))
    return x.groupBy("scenario").agg(F.sum(economics.warning_value("lead")).alias("v")).select("scenario", r6("v", "value"))


_THRESHOLDS = (46.0, 48.0, 50.0, 52.0, 54.0)


def _sweep(spark, d):
    th = spark.createDataFrame([(x,) for x in _THRESHOLDS], "threshold double")
    return backtest.sweep(_smoothed(spark, d), th, windows(spark), economics.scenarios(spark), ["asset"], "t", B.PERSISTENCE, B.MAX_GAP, B.TRAIN[1], 1.0, B.CHUNK)


@query
def threshold_sweep(spark, d):
    return _sweep(spark, d).select("threshold", "scenario", big("flagged_early"), big("detected"), r6("median_lead_h"), big("false_alerts"), r6("false_alerts_per_month"), r6("net_value"), r6("break_even_per_month"))


@query
def operating_point(spark, d):
    return audit.best_row(_sweep(spark, d).withColumn("net_value", F.round("net_value", 6)), ["scenario"], "net_value", "threshold").select("scenario", "threshold", r6("net_value"))


@query
def anticipation_sensitivity(spark, d):
    out = None
    ev = _events(spark, d).filter(F.col("end") >= B.TRAIN[1])
    grid = [backtest.failure_windows(spark, B.FAILURES, a, B.GRACE).withColumn("anticipation", F.lit(a)) for a in (12, 24, 48, 72)]
    for g in grid:
        out = g if out is None else out.unionByName(g)
    hits = backtest.match(ev, out).filter(F.col("start") <= F.col("f_end")).groupBy("anticipation", "failure_id", "f_start", "w_start").agg(F.min("start").alias("first"))
    early = hits.filter(F.col("f_start") > F.greatest("first", "w_start"))
    return early.groupBy("anticipation").agg(F.count(F.lit(1)).alias("n")).select(big("anticipation"), big("n", "flagged_early"))


@query
def persistence_sensitivity(spark, d):
    grid = spark.createDataFrame([(_LIMIT, p) for p in (2, 4, 8, 16)], "threshold double, persistence long")
    ev = backtest.events_by_threshold(_smoothed(spark, d), grid, ["asset"], "t", 0, B.MAX_GAP, B.CHUNK)
    return ev.groupBy("persistence").agg(F.count(F.lit(1)).alias("n")).select(big("persistence"), big("n", "events"))


@query
def persistence_pivot(spark, d):
    grid = spark.createDataFrame([(_LIMIT, p) for p in (2, 4, 8, 16)], "threshold double, persistence long")
    ev = backtest.events_by_threshold(_smoothed(spark, d), grid, ["asset"], "t", 0, B.MAX_GAP, B.CHUNK)
    p = ev.groupBy("asset").pivot("persistence", [2, 4, 8, 16]).agg(F.count(F.lit(1)))
    return p.select(big("asset"), *[big(F.coalesce(F.col(f"`{k}`"), F.lit(0)), f"p{k}") for k in (2, 4, 8, 16)])


@query
def alert_triage(spark, d):
    x = audit.interval_max(_events(spark, d).select("asset", "event_id", "start", "end"), B.hours(spark, d), ["asset"], "t", "run_elapsed_max")
    return x.select(big("asset"), big("event_id"), r6("max_run_elapsed_max"), (F.col("max_run_elapsed_max") > 6 * 3600).alias("looks_like_leak"))


@query
def score_normalised(spark, d):
    """0 at the healthy median, 1 at the threshold."""
    s = B.scores(spark, d)
    m = order_stats.quantiles(s.filter(T.training_slice("t", *B.TRAIN, B.EXCLUDE)), [], "score", {"m": 0.5}, B.HELD)
    return s.join(F.broadcast(m)).select(big("asset"), big("t"), r6((F.col("score") - F.col("m")) / (60.0 - F.col("m")), "normalised"))


@query
def decimated(spark, d):
    return audit.decimate(B.scores(spark, d), ["asset"], ["t"], 5, chunk_of("t", B.CHUNK)).select(big("asset"), big("t"), r6("score"))


@query
def spearman(spark, d):
    f = B.hours(spark, d).select("asset", (F.col("a1_sum") / F.col("n")).alias("x"), (F.col("a2_sum") / F.col("n")).alias("y"), F.col("loaded_sum").alias("z"))
    return audit.spearman(f, ["asset"], ["x", "y", "z"], B.HELD).select(big("asset"), "a", "b", r6("rho"))


@query
def event_overlaps(spark, d):
    """Pairs of alert events of an asset at a low and a high limit that have an hour in common; and the low ones without any."""
    limits = spark.createDataFrame([(48.0,), (52.0,)], "threshold double")
    ev = materialise(backtest.events_by_threshold(_smoothed(spark, d), limits, ["asset"], "t", 2, B.MAX_GAP, B.CHUNK), "events")
    low = ev.filter("threshold = 48").select("asset", F.col("start").alias("low_start"), F.col("end").alias("low_end"))
    high = ev.filter("threshold = 52").select("asset", F.col("start").alias("high_start"), F.col("end").alias("high_end"))
    ends = ("low_start", "low_end"), ("high_start", "high_end")
    both = intervals.overlaps(low, high, ["asset"], *ends)
    alone = intervals.with_overlap(low, high, ["asset"], *ends, ["asset", "low_start"], without=True).withColumns({c: F.lit(None).cast("long") for c in ends[1]})
    return both.unionByName(alone).select(big("asset"), *[big(c) for e in ends for c in e])


# --- vibration ----------------------------------------------------------------------

_HI = ("rms", "peak", "kurtosis")


@query
def wave_time_domain(spark, d):
    x = V.time_domain("embedding")
    return B.table(spark, d, "embeddings").select(big("vec_id"), *[r6(c, n) for n, c in x.items()])


_BANDS = {"low": (1, 8), "mid": (9, 20), "high": (21, 32)}


def _bands(p: str = "power"):
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    part = lambda lo, hi: F.aggregate(F.slice(p, lo + 1, hi - lo + 1), F.lit(0.0), lambda a, x: a + x)
    return {n: part(*b) / total for n, b in _BANDS.items()}


@query
def wave_spectrum_bands(spark, d):
    s = B.table(spark, d, "embeddings").select("vec_id", V.dft_power("embedding", B.N_SAMPLES).alias("power"))
    return s.select(big("vec_id"), *[r6(c, f"band_{n}") for n, c in _bands().items()])


@query
def mean_spectrum(spark, d):
    s = B.table(spark, d, "embeddings").select("label", V.dft_power("embedding", B.N_SAMPLES).alias("power"))
    return V.mean_spectrum(s, ["label"], "power").select(big("label"), big("pos"), r6("power"))


@query
def bearing_max(spark, d):
    e = B.bearings(spark, d).withColumn("snap", F.floor(F.col("timestamp") / 2))
    return V.bearing_max(e, ["rms", "peak"], ["snap", "bearing"]).select(big("snap"), big("bearing"), r6("rms"), r6("peak"))


@query
def cross_entity_ratio(spark, d):
    x = V.cross_log_ratio(B.bearings(spark, d), _HI)
    return x.select(big("timestamp"), big("bearing"), *[r6(f"lr_{c}") for c in _HI])


def _health(spark, d):
    x = V.cross_log_ratio(B.bearings(spark, d), _HI)
    return V.health_indicator(x, _HI, smoothing=6)


@query
def health_indicator(spark, d):
    return _health(spark, d).select(big("timestamp"), big("bearing"), *[r6(f"z_{c}") for c in _HI], r6("hi_raw"), r6("hi"), r6("rms_ratio"))


@query
def hi_driver(spark, d):
    h = _health(spark, d)
    z = [F.greatest(F.round(f"z_{c}", 6), F.lit(0.0)) for c in _HI]
    return h.select(big("timestamp"), big("bearing"), first_argmax(list(_HI), z).alias("hi_driver"))


_K, _P = 1.0, 2


@query
def alarm_episodes(spark, d):
    h = _health(spark, d).withColumn("hi", F.round("hi", 6))
    return V.alarm_episodes(h, _K, _P).select(big("bearing"), r6("hours"))


def _summary(spark, d, k=_K, p=_P, grid=None):
    known = spark.createDataFrame(B.KNOWN, "test int, bearing long, known_failure string")
    h = _health(spark, d).withColumn("hi", F.round("hi", 6)).withColumns({f"z_{c}": F.round(f"z_{c}", 6) for c in _HI})
    by = grid.columns if grid is not None else []
    h = h.crossJoin(F.broadcast(grid)) if by else h
    return V.onset_summary(h, k, p, known, {"z_rms": "outer", "z_peak": "inner", "z_kurtosis": "roller"}, 60.0, by=by)


@query
def onset_summary(spark, d):
    s = _summary(spark, d)
    return s.select(
        big("bearing"), "known_failure", r6("life_hours"), r6("onset_hours"), r6("hours_before_failure"), r6("onset_pct_life"), big("alarm_episodes"), big("early_false_alarms"), F.array_join(F.transform("alarm_hours", lambda x: x.cast("long").cast("string")), ",").alias("alarm_hours"), "diagnosed", F.col("diagnosis_correct").cast("string").alias("diagnosis_correct")
    )


@query
def onset_evaluation(spark, d):
    return V.evaluate_onsets(_summary(spark, d)).select(big("detected"), big("failed"), r6("median_lead_h"), big("false_alarms"))


@query
def k_sweep(spark, d):
    """Alarms over a grid of limits and persistences, in one plan."""
    grid = spark.createDataFrame([(k, p) for k in (0.5, 1.0, 1.5) for p in (1, 2, 4)], "k double, p long")
    h = _health(spark, d).withColumn("hi", F.round("hi", 6)).crossJoin(F.broadcast(grid))
    e = V.alarm_episodes(h, "k", "p", ["k", "p", "test", "bearing"])
    return e.groupBy("k", "p").agg(F.count(F.lit(1)).alias("n"), F.min("hours").alias("first")).select("k", big("p"), big("n"), r6("first", "first_alarm"))


@query
def exp_fit(spark, d):
    return V.exponential_fit(_health(spark, d), ["bearing"], F.col("hours"), "rms_ratio").select(big("bearing"), r6("a"), r6("b"), big("points"))


def _rul(spark, d):
    known = spark.createDataFrame([(t, b) for t, b, _ in B.KNOWN], "test int, bearing long")
    onsets = known.withColumn("onset_hours", F.lit(20.0) + F.col("bearing"))
    return V.remaining_life(_health(spark, d), onsets, known)


@query
def loo_rul(spark, d):
    return _rul(spark, d).select(big("bearing"), "eval_fraction", r6("hi_fail"), r6("own_eol"), r6("t_eval"), r6("actual_rul"), F.round("pred_rul", 3).alias("pred_rul"))


@query
def rul_error(spark, d):
    x = _rul(spark, d).groupBy("eval_fraction").agg(F.median(F.abs("error_h")).alias("m"))
    return x.select("eval_fraction", F.round("m", 3).alias("median_abs_error"))


@query
def naive_rul(spark, d):
    known = spark.createDataFrame(B.KNOWN, "test int, bearing long, known_failure string")
    life = B.bearings(spark, d).groupBy("test", "bearing").agg(F.max("hours").alias("life_hours")).join(F.broadcast(known), ["test", "bearing"])
    s = life.withColumn("onset_hours", F.lit(20.0) + F.col("bearing") * 3)
    return V.naive_life(s).select(big("bearing"), "eval_fraction", r6("actual_rul"), r6("naive_rul"), r6("abs_error"))


@query
def onset_economics(spark, d):
    """Each limit of the onset rule priced, in one plan: warnings by their lead, false alarms by inspections."""
    c = economics.cost_set(parts_delivery_hours=12.0, scheduling_hours=4.0)
    grid = spark.createDataFrame([(0.5,), (1.0,), (1.5,)], "k double")
    s = _summary(spark, d, "k", _P, grid)
    e = V.evaluate_onsets(s, by=["k"]).select("k", "false_alarms")
    v = s.groupBy("k").agg(economics.total_value("hours_before_failure", c).alias("v")).join(e, "k")
    return v.select("k", big("false_alarms"), r6(F.col("v") - F.col("false_alarms") * c["inspection"], "net_value"))


@query
def summary_report(spark, d):
    """Onset summary joined with the remaining life at 75 %: one row per bearing."""
    life = _rul(spark, d).filter("eval_fraction = 0.75").select("test", "bearing", "actual_rul", F.round("pred_rul", 3).alias("rul75_pred"))
    s = _summary(spark, d).join(life, ["test", "bearing"], "left")
    return s.select(big("bearing"), "known_failure", r6("life_hours"), r6("onset_hours"), r6("actual_rul", "rul75_actual"), "rul75_pred")


@query
def kinematics(spark, d):
    """Defect frequencies of each part's bearing at its own shaft speed."""
    hz = F.col("p_size") * 50 / F.lit(60.0)
    x = V.defect_frequencies(hz, 16, 2.815, 0.331, 15.17)
    return B.table(spark, d, "part").select(big("p_partkey"), *[r6(x[k], k) for k in ("bpfo", "bpfi", "bsf", "ftf")])


# --- not SQL: models, long transforms, streams --------------------------------------


@query
def envelope_spectrum(spark, d):
    f = V.SpectralFeatures(20480.0, V.defect_frequencies(2000 / 60, 16, 2.815, 0.331, 15.17), tol=0.5)
    e = B.table(spark, d, "embeddings").select("vec_id", "embedding")
    return f.add(e, "embedding").drop("embedding")


@query
def iforest_scores(spark, d):
    f = B.features(spark, d).select("asset", "t", "duty_cycle_w1", "cur_mean_w2", "tmp_std_w2", "load_starts_per_hour")
    m = IsolationForest(("duty_cycle_w1", "cur_mean_w2", "tmp_std_w2", "load_starts_per_hour")).fit(f.filter(T.training_slice("t", *B.TRAIN, B.EXCLUDE)))
    return m.score(f).select("asset", "t", "score", (F.col("score") > m.threshold).alias("above"))


@query
def lstm_scores(spark, d):
    grid = audit.densify(B.hours(spark, d).select("asset", "t", "a1_sum", "n", "loaded_sum"), ["asset"], "t").select("asset", "t", (F.col("a1_sum") / F.col("n")).alias("x"), (F.col("loaded_sum") / F.col("n")).alias("y"))
    m = LstmAutoencoder(("x", "y"), chunk=B.CHUNK).fit(grid.filter(T.training_slice("t", *B.TRAIN)))
    return m.score(grid).select("asset", "t", "score")


@query
def module_a(spark, d):
    """End to end: features once, three detectors trained on the healthy slice and calibrated, all scores, and a back-test report of each."""
    feats = materialise(B.features(spark, d), "features")
    healthy = feats.filter(T.training_slice("t", *B.TRAIN, B.EXCLUDE))
    models = {"control_limits": ControlLimits(_CL), "isolation_forest": IsolationForest(("duty_cycle_w1", "cur_mean_w2", "tmp_std_w2", "load_starts_per_hour")), "lstm_autoencoder": LstmAutoencoder(("a1", "a2", "loaded_frac"), seq_len=6, chunk=B.CHUNK)}
    scored = feats
    for name, m in models.items():
        m.fit(healthy)
        scored = m.score(scored, f"score_{name}")
    scored = materialise(T.calendar(scored, F.col("t") * B.HOUR).select("asset", "t", "shift", *[f"score_{n}" for n in models]), "scores")
    report, last = None, scored.agg(F.max("t")).first()[0]
    for name, m in models.items():
        limit = m.threshold if name == "control_limits" else calibrate(scored.filter(T.training_slice("t", *B.TRAIN, B.EXCLUDE)), ["asset"], "t", f"score_{name}", B.SMOOTHING, chunk=B.CHUNK).first().threshold
        _, ev = alerts.generate(scored, ["asset"], "t", f"score_{name}", limit, B.SMOOTHING, B.PERSISTENCE, B.MAX_GAP, 1.0, B.CHUNK)
        ev = materialise(ev.filter(F.col("end") >= B.TRAIN[1]), "events")
        months = max((last - B.TRAIN[1]) / 24 / backtest.DAYS_PER_MONTH, 1e-9)
        row = backtest.results_row(name, backtest.failure_details(ev, windows(spark), unit_hours=1.0), backtest.false_alerts(ev, windows(spark)), months, economics.cost_set())
        report = row if report is None else report.unionByName(row)
    return report


@query
def stream_replay_features(spark, d):
    """The stream's expressions over each asset's rows, with the last minute flushed; equal to feature_table."""
    out = replay_table(B.telemetry(spark, d), B.CHANNELS)
    return out.select("asset", "t", *[r6(c) for c in T.features_of(B.CHANNELS)])

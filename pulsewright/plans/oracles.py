"""The catalogue's queries in DuckDB SQL, written on their own: what each operator must return."""

from __future__ import annotations

from pulsewright.plans import bindings as B

T0, (LO, HI), (XLO, XHI) = B.T0, B.TRAIN, B.EXCLUDE[0]
GAP, SMOOTH, PERSIST = B.MAX_GAP, B.SMOOTHING, B.PERSISTENCE
TRAIN = f"t BETWEEN {LO} AND {HI} AND NOT (t BETWEEN {XLO} AND {XHI})"
LIMIT = 50.0


def shift(h: str) -> str:
    return f"CASE WHEN {h} >= 6 AND {h} < 14 THEN 'Shift 1 (06-14)' WHEN {h} >= 14 AND {h} < 22 THEN 'Shift 2 (14-22)' ELSE 'Shift 3 (22-06)' END"


def r6(x: str, name: str | None = None) -> str:
    return f"round(CAST({x} AS DOUBLE) + 1e-9, 6) + 0.0 AS {name or x}"


RAW = r"""raw AS (
  SELECT user_id % 8 AS asset, epoch_us(ts) AS us, event_id AS tie, value AS a1, CAST(regexp_extract(props, '(\d+)', 1) AS DOUBLE) AS a2,
    CASE WHEN event_type IN ('click', 'purchase') THEN 0 ELSE 1 END AS comp, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS lps FROM events)"""
SIG = f"""{RAW}, lagged AS (
  SELECT *, 1 - comp AS loaded, lag(1 - comp) OVER w AS pl, lag(a1) OVER w AS pr, (us - lag(us) OVER w) / 1e6 AS dt FROM raw WINDOW w AS (PARTITION BY asset ORDER BY us, tie)
), marked AS (
  SELECT *, CASE WHEN loaded = 1 AND pl = 0 AND dt <= 21600 THEN 1 ELSE 0 END AS load_start,
    CASE WHEN loaded = 1 AND NOT coalesce(pl = 1 AND dt <= 21600, false) THEN us END AS begins,
    CASE WHEN loaded = 0 AND pl = 0 AND dt <= 21600 THEN pr - a1 ELSE 0 END AS idle_dp, CASE WHEN loaded = 0 AND pl = 0 AND dt <= 21600 THEN dt ELSE 0 END AS idle_dt FROM lagged
), sig AS (
  SELECT *, CASE WHEN loaded = 1 THEN (us - last_value(begins IGNORE NULLS) OVER (PARTITION BY asset ORDER BY us, tie ROWS UNBOUNDED PRECEDING)) / 1e6 ELSE 0 END AS run_elapsed FROM marked)"""
HRS = f"""{SIG}, hrs AS (
  SELECT asset, us // 3600000000 AS t, count(*)::DOUBLE AS n, sum(a1) AS a1_sum, sum(a2) AS a2_sum, max(a2) AS a2_max, min(a1) AS a1_min, max(a1) AS a1_max, sum(loaded)::DOUBLE AS loaded_sum, sum(load_start)::DOUBLE AS load_starts,
    max(run_elapsed) AS run_elapsed_max, sum(idle_dp) AS idle_dp_sum, sum(idle_dt) AS idle_dt_sum, sum(a2 * loaded) AS current_loaded_sum, sum((a1 - a2) * loaded) AS dp_loaded_sum, sum(lps)::DOUBLE AS LPS_sum,
    greatest(max(a1) - min(a1), max(a2) - min(a2)) AS analog_range_max FROM sig GROUP BY 1, 2)"""
COARSE = RAW.replace("raw AS", "fine AS", 1) + f", raw AS (SELECT * REPLACE (floor(a1 / {B.COARSE_A1}) AS a1, floor(a2 / {B.COARSE_A2}) AS a2) FROM fine)"
_W = {"w1": 6, "w2": 24, "w3": 72, "w4": 168}
_WIN = ", ".join(f"{w} AS (PARTITION BY asset ORDER BY t RANGE BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for w, n in _W.items())


def ratio(a: str, b: str, w: str) -> str:
    return f"CASE WHEN sum({b}) OVER {w} > 0 THEN sum({a}) OVER {w} / sum({b}) OVER {w} END"


FEATURES = {
    "a1": "m1", "a2": "m2", "loaded_frac": "loaded_sum / n",
    "duty_cycle_w1": ratio("loaded_sum", "n", "w1"), "duty_cycle_w2": ratio("loaded_sum", "n", "w2"), "duty_cycle_w3": ratio("loaded_sum", "n", "w3"),
    "load_starts_per_hour": "sum(load_starts) OVER w2", "max_load_run_min_w2": "max(run_elapsed_max) OVER w2 / 60",
    "cur_mean_w1": ratio("a2_sum", "n", "w1"), "cur_std_w1": "stddev_samp(m2) OVER w1", "cur_mean_w2": ratio("a2_sum", "n", "w2"), "cur_loaded_w2": ratio("current_loaded_sum", "loaded_sum", "w2"),
    "tmp_mean_w1": ratio("a1_sum", "n", "w1"), "tmp_mean_w2": ratio("a1_sum", "n", "w2"), "tmp_std_w2": "stddev_samp(m1) OVER w2", "tmp_excess_w4": f"{ratio('a1_sum', 'n', 'w2')} - {ratio('a1_sum', 'n', 'w4')}",
    "delta_p_loaded_w2": ratio("dp_loaded_sum", "loaded_sum", "w2"), "res_mean_w1": ratio("a1_sum", "n", "w1"), "res_min_w2": "min(a1_min) OVER w2",
    "idle_decay_rate_w2": f"60 * ({ratio('idle_dp_sum', 'idle_dt_sum', 'w2')})", "lps_frac_w2": ratio("LPS_sum", "n", "w2"), "n_samples": "n",
}
FEATS = f"""{HRS}, valid AS (SELECT *, a1_sum / n AS m1, a2_sum / n AS m2 FROM hrs WHERE NOT (n >= 3 AND analog_range_max = 0)),
feats AS (SELECT asset, t, {", ".join(f"{x} AS {n}" for n, x in FEATURES.items())} FROM valid WINDOW {_WIN})"""
SC = f"""{HRS}, sc AS (SELECT asset, t, a1_sum / n AS score, t % 24 AS hour, {shift("(t % 24)")} AS shift FROM hrs)"""


def smoothed(rows: str = "sc", fn: str = "median") -> str:
    return f"SELECT *, round({fn}(score) OVER (PARTITION BY asset ORDER BY t RANGE BETWEEN {SMOOTH - 1} PRECEDING AND CURRENT ROW) + 1e-9, 6) AS smoothed_score FROM {rows}"


def flags(rows: str, limit: str = str(LIMIT), steps: str = str(PERSIST), by: str = "asset") -> str:
    """CTEs fl0..flagged on rows with smoothed_score."""
    return f"""fl0 AS (SELECT *, smoothed_score > {limit} AS above FROM {rows}),
fl1 AS (SELECT *, lag(above) OVER w AS pa, t - lag(t) OVER w AS g FROM fl0 WINDOW w AS (PARTITION BY {by} ORDER BY t)),
fl2 AS (SELECT *, CASE WHEN above AND NOT coalesce(pa AND g <= {GAP}, false) THEN t END AS begins FROM fl1),
fl3 AS (SELECT *, last_value(begins IGNORE NULLS) OVER (PARTITION BY {by} ORDER BY t ROWS UNBOUNDED PRECEDING) AS st FROM fl2),
flagged AS (SELECT * EXCLUDE (pa, begins), coalesce(above AND t - st + 1 >= {steps}, false) AS alert_flag FROM fl3),
is0 AS (SELECT *, CASE WHEN alert_flag AND NOT coalesce(lag(alert_flag) OVER w AND g <= {GAP}, false) THEN 1 ELSE 0 END AS new FROM flagged WINDOW w AS (PARTITION BY {by} ORDER BY t)),
is1 AS (SELECT *, sum(new) OVER (PARTITION BY {by} ORDER BY t ROWS UNBOUNDED PRECEDING) AS event_id FROM is0),
ev AS (SELECT {by}, event_id::BIGINT AS event_id, min(t) AS "start", max(t) AS "end", max(smoothed_score) AS peak_score, arg_min(shift, t) AS shift FROM is1 WHERE alert_flag GROUP BY {by}, event_id)"""


EV = f"{SC}, sm AS ({smoothed()}), {flags('sm')}"


def failure_rows(anticipation: int = B.ANTICIPATION) -> str:
    rows = ", ".join(f"({i}, '{f[0]}', {f[1]}, {f[2]}, {f[1] - anticipation}, {max(f[2], f[3] if f[3] is not None else f[2] + B.GRACE)})" for i, f in enumerate(B.FAILURES))
    return f"(VALUES {rows}) AS fw(ord, failure_id, f_start, f_end, w_start, w_end)"


FW = f"fw AS (SELECT * FROM {failure_rows()})"
MATCH = '"start" <= w_end AND "end" >= w_start'
DETAIL = f"""{FW}, eve AS (SELECT * FROM ev WHERE "end" >= {HI}),
det AS (SELECT fw.*, (SELECT min("start") FROM eve WHERE {MATCH} AND "start" <= f_end) AS first_alert FROM fw),
ld AS (SELECT *, CASE WHEN first_alert IS NOT NULL THEN CAST(f_start - greatest(first_alert, w_start) AS DOUBLE) END AS lead FROM det),
fd AS (SELECT *, coalesce(lead > 0, false) AS flagged_early, CASE WHEN lead > 0 THEN lead END AS early FROM ld)"""


def worth(lead: str, needed: str = "60") -> str:
    return f"CASE WHEN {lead} IS NULL OR {lead} <= 0 THEN 0.0 WHEN {lead} >= {needed} THEN 21000.0 ELSE 16000.0 END"


_HI = ("rms", "peak", "kurtosis")
_ARR = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
WAVE = f"""w0 AS (SELECT vec_id, label, {_ARR} AS a FROM embeddings), w1 AS (SELECT *, list_avg(a) AS mu FROM w0), w2 AS (SELECT vec_id, label, a, list_transform(a, lambda x: x - mu) AS x FROM w1),
w3 AS (SELECT *, list_avg(list_transform(x, lambda v: v * v)) AS m2, list_avg(list_transform(x, lambda v: v * v * v)) AS m3, list_avg(list_transform(x, lambda v: v * v * v * v)) AS m4 FROM w2),
wave AS (SELECT vec_id, label, x, sqrt(m2) AS rms, greatest(list_max(x), -list_min(x)) AS peak, list_max(a) - list_min(a) AS p2p, greatest(list_max(x), -list_min(x)) / sqrt(m2) AS crest, m4 / (m2 * m2) AS kurtosis, m3 / pow(m2, 1.5) AS skewness FROM w3)"""
SPEC = f"""{WAVE}, xs AS (SELECT vec_id, label, i - 1 AS i, x[i] * (0.5 - 0.5 * cos(2 * pi() * (i - 1) / 63)) AS v FROM (SELECT vec_id, label, x, unnest(range(1, 65)) AS i FROM wave)),
spec AS (SELECT vec_id, label, k AS pos, (pow(sum(v * cos(2 * pi() * k * i / 64)), 2) + pow(sum(v * sin(2 * pi() * k * i / 64)), 2)) / 64 AS power FROM xs, range(0, 33) AS r(k) GROUP BY 1, 2, 3)"""
BEAR = f"{WAVE}, bt AS (SELECT 1 AS test, vec_id // 4 AS ts, CAST(vec_id // 4 AS DOUBLE) AS hours, vec_id % 4 + 1 AS bearing, rms, peak, kurtosis FROM wave)"
_LR = ", ".join(f"ln(greatest(x.{c}, 1e-9)) - (SELECT median(ln(greatest(o.{c}, 1e-9))) FROM bt o WHERE o.ts = x.ts AND o.bearing <> x.bearing) AS lr_{c}" for c in _HI)
RATIO = f"{BEAR}, cr AS (SELECT x.*, {_LR} FROM bt x)"
_BASE = "FILTER (WHERE hours BETWEEN 1 AND 25)"
_Z = ", ".join(f"(lr_{c} - avg(lr_{c}) {_BASE} OVER w) / CASE WHEN stddev_samp(lr_{c}) {_BASE} OVER w > 1e-9 THEN stddev_samp(lr_{c}) {_BASE} OVER w ELSE 1 END AS z_{c}" for c in _HI)
HEALTH = f"""{RATIO}, base AS (SELECT bearing AS b, median(rms) AS rms0, {", ".join(f"avg(lr_{c}) AS mu_{c}, stddev_samp(lr_{c}) AS sd_{c}" for c in _HI)} FROM cr WHERE hours BETWEEN 1 AND 25 GROUP BY 1),
zz AS (SELECT cr.*, rms / rms0 AS own, {", ".join(f"(lr_{c} - mu_{c}) / CASE WHEN sd_{c} > 1e-9 THEN sd_{c} ELSE 1 END AS z_{c}" for c in _HI)} FROM cr LEFT JOIN base ON b = bearing),
zr AS (SELECT *, CASE WHEN z_rms IS NOT NULL THEN greatest(z_rms, z_peak, z_kurtosis, 0) END AS hi_raw FROM zz),
hh AS (SELECT *, round(median(hi_raw) OVER w, 6) AS hi, median(own) OVER w AS rms_ratio FROM zr WINDOW w AS (PARTITION BY bearing ORDER BY hours ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))"""


def eps(k: str = "1.0", p: str = "2", rows: str = "hh", by: str = "bearing") -> str:
    return f"""e0 AS (SELECT *, coalesce(hi > {k}, false) AS a FROM {rows}),
e1 AS (SELECT *, sum(CASE WHEN a THEN 0 ELSE 1 END) OVER (PARTITION BY {by} ORDER BY hours ROWS UNBOUNDED PRECEDING) AS isl FROM e0),
e2 AS (SELECT *, sum(CASE WHEN a THEN 1 ELSE 0 END) OVER (PARTITION BY {by}, isl ORDER BY hours ROWS UNBOUNDED PRECEDING) AS rn FROM e1),
ep AS (SELECT * FROM e2 WHERE a AND rn = {p})"""


def onset(k: str) -> str:
    """False alarms and value of one limit, as a query of its own."""
    return f"""SELECT {k}::DOUBLE AS k, sum(CASE WHEN kf IS NOT NULL THEN early ELSE len(list_filter(hs, lambda e: first IS NULL OR e < first)) END)::BIGINT AS false_alarms,
      {r6("sum(CASE WHEN kf IS NULL OR onset IS NULL OR life - onset <= 0 THEN 0.0 WHEN life - onset >= 16 THEN 21000.0 ELSE 16000.0 END) - 500 * sum(CASE WHEN kf IS NOT NULL THEN early ELSE len(list_filter(hs, lambda e: first IS NULL OR e < first)) END)", "net_value")}
      FROM (WITH {summary(k)} SELECT *, min(CASE WHEN kf IS NOT NULL THEN onset END) OVER () AS first FROM su)"""


KNOWN = "known(bearing, known_failure) AS (VALUES " + ", ".join(f"({b}, '{m}')" for _, b, m in B.KNOWN) + ")"
def summary(k: str = "1.0") -> str:
    return f"""{KNOWN}, {HEALTH}, {eps(k)}, li AS (SELECT bearing, max(hours) AS life FROM hh GROUP BY 1), al AS (SELECT bearing, list(hours ORDER BY hours) AS hs FROM ep GROUP BY 1),
s0 AS (SELECT li.*, known_failure AS kf, coalesce(hs, []) AS hs FROM li LEFT JOIN al USING (bearing) LEFT JOIN known USING (bearing)),
s1 AS (SELECT *, CASE WHEN kf IS NOT NULL THEN list_filter(hs, lambda e: life - e <= 60) ELSE hs END AS ok FROM s0),
s2 AS (SELECT *, ok[1] AS onset, CASE WHEN kf IS NOT NULL THEN len(hs) - len(ok) ELSE 0 END AS early FROM s1),
dg AS (SELECT bearing, median(round(z_rms, 6)) AS r, median(round(z_peak, 6)) AS p, median(round(z_kurtosis, 6)) AS q FROM hh JOIN s2 USING (bearing) WHERE hours >= onset GROUP BY 1),
su AS (SELECT s2.*, CASE WHEN r IS NULL THEN NULL WHEN r >= p AND r >= q THEN 'outer' WHEN p >= q THEN 'inner' ELSE 'roller' END AS diagnosed FROM s2 LEFT JOIN dg USING (bearing))"""


SUMMARY = summary()
RUL = f"""{KNOWN}, {HEALTH}, g AS (SELECT hh.* FROM hh JOIN known USING (bearing)),
tl AS (SELECT *, row_number() OVER (PARTITION BY bearing ORDER BY hours DESC) AS rn FROM g),
eol AS (SELECT bearing, median(rms_ratio) AS own_eol, max(hours) AS eol FROM tl WHERE rn <= 6 GROUP BY 1),
fl AS (SELECT *, (SELECT median(o.own_eol) FROM eol o WHERE o.bearing <> eol.bearing) AS hi_fail, 20.0 + bearing AS onset FROM eol),
ev_at AS (SELECT *, onset + f * (eol - onset) AS t_eval FROM fl, (VALUES (0.5::DOUBLE), (0.75::DOUBLE), (0.9::DOUBLE)) AS fr(f)),
ft AS (SELECT ev_at.bearing, f, regr_intercept(ln(greatest(rms_ratio, 1e-3)), hours - onset) AS a, regr_slope(ln(greatest(rms_ratio, 1e-3)), hours - onset) AS b, count(rms_ratio) AS n FROM ev_at JOIN g ON g.bearing = ev_at.bearing AND hours >= onset AND hours <= t_eval GROUP BY 1, 2),
ru AS (SELECT ev_at.*, eol - t_eval AS actual, CASE WHEN n >= 12 THEN CASE WHEN b > 0 THEN least(greatest(onset + (ln(hi_fail) - a) / b - t_eval, 0), 2000) ELSE 2000 END END AS pred FROM ev_at LEFT JOIN ft USING (bearing, f))"""
GRID_TH = "(VALUES (46.0::DOUBLE), (48.0::DOUBLE), (50.0::DOUBLE), (52.0::DOUBLE), (54.0::DOUBLE))"
SWEEP = f"""{SC}, sm0 AS ({smoothed()}), sm AS (SELECT * FROM sm0, {GRID_TH} AS g(threshold)), {flags("sm", "threshold", by="asset, threshold")}, {FW},
eve AS (SELECT * FROM ev WHERE "end" >= {HI}), th AS (SELECT * FROM {GRID_TH} AS g(threshold)),
det AS (SELECT th.threshold, fw.*, (SELECT min("start") FROM eve e WHERE e.threshold = th.threshold AND {MATCH} AND "start" <= f_end) AS first_alert FROM th, fw),
fd AS (SELECT *, CASE WHEN first_alert IS NOT NULL THEN CAST(f_start - greatest(first_alert, w_start) AS DOUBLE) END AS lead FROM det),
nf AS (SELECT threshold, count(*) AS n FROM eve e WHERE NOT EXISTS (SELECT 1 FROM fw WHERE {MATCH}) GROUP BY 1),
mo AS (SELECT greatest((max(t) - {HI}) / 24.0 / 30.4375, 1e-9) AS months FROM sc),
sw AS (SELECT threshold, scenario, count(*) FILTER (WHERE lead > 0) AS flagged_early, count(first_alert) AS detected, median(lead) FILTER (WHERE lead > 0) AS median_lead_h, sum({worth("lead", "needed")}) AS v
  FROM fd, (VALUES ('24h', 36.0), ('48h', 60.0), ('168h', 180.0), ('336h', 348.0)) AS p(scenario, needed) GROUP BY 1, 2),
so AS (SELECT sw.*, coalesce(n, 0) AS false_alerts, months, v - coalesce(n, 0) * 500.0 AS net FROM sw LEFT JOIN nf USING (threshold), mo)"""
PERSIST_GRID = f"""{SC}, sm0 AS ({smoothed()}), sm AS (SELECT * FROM sm0, (VALUES (2), (4), (8), (16)) AS g(persistence)), {flags("sm", steps="persistence", by="asset, persistence")}"""
DT = "dt AS (SELECT (us - lag(us) OVER (PARTITION BY asset ORDER BY us, tie)) / 3.6e9 AS h FROM raw)"
MS = f"m AS (SELECT asset, t, a1_sum / n AS x, a2_sum / n AS y, loaded_sum AS z FROM hrs)"
GAPS = f"gaps AS (SELECT asset, lag(us) OVER w AS gap_start, us AS gap_end FROM raw WINDOW w AS (PARTITION BY asset ORDER BY us)), gp AS (SELECT *, (gap_end - gap_start) / 1e6 AS s FROM gaps WHERE gap_end - gap_start > 7200000000)"


def rank_rows(a: str, b: str) -> str:
    rank = lambda c: f"rank() OVER (PARTITION BY asset ORDER BY {c}) + (count(*) OVER (PARTITION BY asset, {c}) - 1) / 2.0"
    return f"SELECT asset, '{a}' AS a, '{b}' AS b, {r6('corr(ra, rb)', 'rho')} FROM (SELECT asset, {rank(a)} AS ra, {rank(b)} AS rb FROM m) GROUP BY asset"


def profile(c: str) -> str:
    stats = {"min": f"min({c})", "p01": f"quantile_cont({c}, 0.01)", "median": f"median({c})", "mean": f"avg({c})", "p99": f"quantile_cont({c}, 0.99)", "max": f"max({c})", "std": f"stddev_samp({c})"}
    return f"SELECT '{c}' AS signal, count(*) - count({c}) AS missing_count, {r6(f'(count(*) - count({c})) * 100.0 / count(*)', 'missing_pct')}, {', '.join(r6(x, chr(34) + n + chr(34)) for n, x in stats.items())} FROM (SELECT {c}::DOUBLE AS {c} FROM raw)"


def runs_of(flag: str, least: int = 2) -> str:
    """Runs of hours with a flag, ended by an empty hour, as a query on hrs."""
    return f"""a AS (SELECT asset, t, {flag} AS f, coalesce(lag({flag}) OVER w AND t - lag(t) OVER w <= 1, false) AS on_ FROM hrs WINDOW w AS (PARTITION BY asset ORDER BY t)),
      b AS (SELECT *, sum(CASE WHEN f AND NOT on_ THEN 1 ELSE 0 END) OVER (PARTITION BY asset ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM a)
      SELECT asset, min(t) AS "start", max(t) AS "end", count(*) AS buckets FROM b WHERE f GROUP BY asset, run HAVING count(*) >= {least}"""


ORACLES: dict[str, str] = {
    "row_signals": f"WITH {SIG} SELECT tie, asset, loaded::BIGINT AS loaded, load_start::BIGINT AS load_start, {r6('run_elapsed')}, {r6('idle_dp')}, {r6('idle_dt')} FROM sig",
    "run_elapsed": f"WITH {SIG} SELECT asset, {r6('max(run_elapsed)', 'longest_run')}, {r6('avg(run_elapsed)', 'mean_run')} FROM sig WHERE loaded = 1 GROUP BY asset",
    "gap_audit": f"WITH {RAW}, {GAPS} SELECT asset, gap_start, gap_end, {r6('s', 'gap_seconds')}, {r6('s / 3600', 'gap_hours')} FROM gp",
    "longest_gaps": f"WITH {RAW}, {GAPS} SELECT asset, gap_start, gap_end, {r6('s', 'gap_seconds')}, {r6('s / 3600', 'gap_hours')} FROM gp ORDER BY gap_seconds DESC, asset, gap_start LIMIT 10",
    "interval_histogram": f"WITH {RAW}, {DT} SELECT CASE WHEN h < 0 THEN 0 WHEN h >= 12 THEN 25 ELSE CAST(floor(h / 0.5) AS BIGINT) + 1 END AS bin, count(*) AS n FROM dt WHERE h IS NOT NULL GROUP BY 1",
    "range_profile": f"WITH {RAW} {' UNION ALL '.join(profile(c) for c in ('a1', 'a2', 'comp', 'lps'))}",
    "state_contingency": f"WITH {RAW} SELECT coalesce(comp::VARCHAR, 'all') AS comp, coalesce(lps::VARCHAR, 'all') AS lps, count(*) AS n FROM raw GROUP BY CUBE (comp, lps)",
    "group_means": f"WITH {RAW} SELECT {shift('((us // 3600000000) % 24)')} AS shift, comp::BIGINT AS comp, count(*) AS n, {r6('avg(a1)', 'mean_a1')}, {r6('avg(a2)', 'mean_a2')} FROM raw GROUP BY 1, 2",
    "predicate_share": f"WITH {RAW} SELECT asset, {r6('avg(CASE WHEN a2 > 50 THEN 1.0 ELSE 0.0 END)', 'share_over_50')} FROM raw GROUP BY 1",
    "interval_value_counts": f"WITH {RAW} SELECT a2::BIGINT AS k, count(*) AS n FROM raw GROUP BY 1 ORDER BY n DESC, k LIMIT 10",
    "hour_buckets": f"WITH {HRS} SELECT asset, t, {', '.join(r6(c) for c in ('n', 'a1_sum', 'a2_sum', 'a2_max', 'a1_min', 'a1_max', 'loaded_sum', 'load_starts', 'run_elapsed_max', 'idle_dp_sum', 'idle_dt_sum', 'current_loaded_sum', 'dp_loaded_sum', 'LPS_sum', 'analog_range_max'))} FROM hrs",
    "frozen_periods": f"WITH {HRS.replace(RAW, COARSE)}, {runs_of('n >= 3 AND analog_range_max = 0')}",
    "sparse_periods": f"WITH {HRS}, {runs_of('n < 3')}",
    "run_lookback": f"WITH {SIG} SELECT tie, asset, load_start::BIGINT AS load_start, {r6('run_elapsed')} FROM sig WHERE us >= {T0 + 400} * 3600000000 AND us < {T0 + 448} * 3600000000",
    "resample_means": f"""WITH {RAW}, b AS (SELECT asset, (us // 3600000000) // 12 AS bin, avg(a1) AS a1, avg(a2) AS a2 FROM raw GROUP BY 1, 2), g AS (SELECT asset, unnest(range(min(bin), max(bin) + 1)) AS bin FROM b GROUP BY asset)
      SELECT g.asset, g.bin, {r6('a1')}, {r6('a2')} FROM g LEFT JOIN b USING (asset, bin)""",
    "densify": f"WITH {HRS} SELECT asset, (max(t) - min(t) + 1)::BIGINT AS hours, count(*) AS filled FROM hrs GROUP BY asset",
    "distinct_counts": "SELECT event_type, count(DISTINCT user_id) AS users, string_agg(DISTINCT (user_id % 8)::VARCHAR, ',' ORDER BY (user_id % 8)::VARCHAR) AS assets FROM events GROUP BY 1",
    "trailing_duty": f"WITH {HRS} SELECT asset, t, {r6(ratio('loaded_sum', 'n', 'w1'), 'duty_6h')}, {r6(ratio('loaded_sum', 'n', 'w2'), 'duty_24h')}, {r6(ratio('loaded_sum', 'n', 'w3'), 'duty_72h')} FROM hrs WINDOW {_WIN}",
    "trailing_std": f"WITH {HRS} SELECT asset, t, {r6('stddev_samp(a1_sum / n) OVER w1', 'std_6h')}, {r6('stddev_samp(a1_sum / n) OVER w2', 'std_24h')} FROM hrs WINDOW {_WIN}",
    "trailing_extrema": f"WITH {HRS} SELECT asset, t, {r6('max(run_elapsed_max) OVER w2', 'max_run')}, {r6('min(a1_min) OVER w2', 'min_a1')} FROM hrs WINDOW {_WIN}",
    "prefix_sums": f"WITH {HRS} SELECT asset, t, round(sum(a1_sum) OVER w4, 4) AS sum_168h FROM hrs WINDOW {_WIN}",
    "idle_decay": f"WITH {HRS} SELECT asset, t, {r6('60 * (' + ratio('idle_dp_sum', 'idle_dt_sum', 'w2') + ')', 'decay')} FROM hrs WINDOW {_WIN}",
    "feature_table": f"WITH {FEATS} SELECT asset, t, {', '.join(r6(c) for c in FEATURES)} FROM feats",
    "lookback_slice": f"WITH {HRS}, s AS (SELECT asset, t, sum(n) OVER w2 AS s FROM hrs WINDOW {_WIN}) SELECT asset, t, {r6('s', 'rows_24h')} FROM s WHERE t >= {T0 + 400} AND t < {T0 + 448}",
    "baseline_drift": f"""WITH {FEATS}, b AS (SELECT {', '.join(f"avg({x}) AS mu{i}, CASE WHEN stddev_samp({x}) > 1e-9 THEN stddev_samp({x}) ELSE 1 END AS sd{i}" for i, x in enumerate(('duty_cycle_w2', 'cur_mean_w2', 'tmp_mean_w2', 'idle_decay_rate_w2')))} FROM feats WHERE t BETWEEN {LO} AND {HI})
      SELECT asset, t, {r6('(duty_cycle_w2 - mu0) / sd0', 'duty_cycle_drift_z')}, {r6('(cur_mean_w2 - mu1) / sd1', 'cur_drift_z')}, {r6('(tmp_mean_w2 - mu2) / sd2', 'tmp_drift_z')}, {r6('(idle_decay_rate_w2 - mu3) / sd3', 'idle_decay_drift_z')} FROM feats, b""",
    "shift_assign": f"WITH {SC} SELECT asset, t, hour, shift FROM sc",
    "calendar_parts": f"WITH {SC}, c AS (SELECT *, make_timestamp(t * 3600000000) AS ts FROM sc) SELECT dayname(ts) AS day_of_week, isodow(ts) >= 6 AS is_weekend, count(*) AS n, {r6('avg(score)', 'mean_score')} FROM c GROUP BY 1, 2",
    "failure_labels": f"""WITH {SC}, l AS (SELECT asset, {"CASE " + " ".join(f"WHEN t BETWEEN {f[1]} AND {f[2]} THEN '{f[0]}'" for f in reversed(B.FAILURES)) + " ELSE 'healthy' END"} AS failure_id FROM sc) SELECT asset, failure_id, failure_id <> 'healthy' AS is_failure, count(*) AS n FROM l GROUP BY 1, 2""",
    "failure_labels_by_bins": f"""WITH {SC}, fl AS (SELECT a AS asset, ord, failure_id, f_start + 6 * a AS lo, f_end + 6 * a AS hi FROM {failure_rows()}, range(8) AS r(a) UNION ALL SELECT 1, 9, 'F9', {T0 + 262}, {T0 + 300}),
      l AS (SELECT sc.asset, t, coalesce(arg_max(failure_id, ord), 'healthy') AS failure_id FROM sc LEFT JOIN fl ON fl.asset = sc.asset AND t BETWEEN lo AND hi GROUP BY 1, 2) SELECT asset, failure_id, count(*) AS n FROM l GROUP BY 1, 2""",
    "event_overlaps": f"""WITH lo AS (SELECT asset, "start" AS low_start, "end" AS low_end FROM (WITH {SC}, sm AS ({smoothed()}), {flags("sm", "48.0", "2")} SELECT * FROM ev)),
      hi AS (SELECT asset, "start" AS high_start, "end" AS high_end FROM (WITH {SC}, sm AS ({smoothed()}), {flags("sm", "52.0", "2")} SELECT * FROM ev))
      SELECT lo.asset, low_start, low_end, high_start, high_end FROM lo LEFT JOIN hi ON lo.asset = hi.asset AND low_start <= high_end AND low_end >= high_start""",
    "training_slice": f"WITH {SC} SELECT asset, count(*) AS n, {r6('avg(score)', 'mean_score')} FROM sc WHERE {TRAIN} GROUP BY 1",
    "control_limit_scores": f"""WITH {FEATS}, b AS (SELECT {', '.join(f"avg({x}) AS mu{i}, CASE WHEN stddev_samp({x}) < 1e-6 THEN 1e-3 ELSE stddev_samp({x}) END AS sd{i}" for i, x in enumerate(('duty_cycle_w2', 'cur_mean_w2', 'tmp_std_w2')))} FROM feats WHERE {TRAIN}),
      s AS (SELECT asset, t, round(1e-9 + greatest({', '.join(f"abs((coalesce({x}, mu{i}) - mu{i}) / sd{i})" for i, x in enumerate(('duty_cycle_w2', 'cur_mean_w2', 'tmp_std_w2')))}), 6) AS score FROM feats, b) SELECT *, score > 3 AS above FROM s""",
    "smoothed_median": f"WITH {SC}, sm AS ({smoothed()}) SELECT asset, t, smoothed_score FROM sm",
    "smoothed_mean": f"WITH {SC}, sm AS ({smoothed(fn='avg')}) SELECT asset, t, smoothed_score FROM sm",
    "rolling_median_rows": f"WITH {SC} SELECT asset, t, {r6('median(score) OVER (PARTITION BY asset ORDER BY t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)', 'median_12')} FROM sc",
    "quantile_thresholds": f"WITH {SC}, tr AS (SELECT * FROM sc WHERE {TRAIN}), sm AS (SELECT *, median(score) OVER (PARTITION BY asset ORDER BY t RANGE BETWEEN {SMOOTH - 1} PRECEDING AND CURRENT ROW) AS s FROM tr) SELECT asset, {', '.join(r6(f'quantile_cont(s, {q})', n) for q, n in ((0.5, 'q50'), (0.9, 'q90'), (0.97, 'q97'), (0.995, 'q995')))} FROM sm GROUP BY asset",
    "persistence_time": f"WITH {EV} SELECT asset, t, above, alert_flag FROM flagged",
    "persistence_count": f"""WITH {SC}, a AS (SELECT asset, t, round(score, 6) > {LIMIT} AS above FROM sc), b AS (SELECT *, sum(CASE WHEN above THEN 0 ELSE 1 END) OVER (PARTITION BY asset ORDER BY t ROWS UNBOUNDED PRECEDING) AS i FROM a)
      SELECT asset, t, above, above AND sum(CASE WHEN above THEN 1 ELSE 0 END) OVER (PARTITION BY asset, i ORDER BY t ROWS UNBOUNDED PRECEDING) >= 3 AS alert_flag FROM b""",
    "alert_events": f'WITH {EV} SELECT asset, event_id, "start", "end", {r6(chr(34) + "end" + chr(34) + " - " + chr(34) + "start" + chr(34), "duration_hours")}, {r6("peak_score")}, shift FROM ev',
    "episodes": f"""WITH {HRS}, a AS (SELECT asset, t, max(run_elapsed_max) OVER w2 > 21600 AS f FROM hrs WINDOW {_WIN}), b AS (SELECT *, coalesce(lag(f) OVER w AND t - lag(t) OVER w <= {GAP}, false) AS on_ FROM a WINDOW w AS (PARTITION BY asset ORDER BY t)),
      c AS (SELECT *, sum(CASE WHEN f AND NOT on_ THEN 1 ELSE 0 END) OVER (PARTITION BY asset ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM b)
      SELECT asset, run::BIGINT AS run, min(t) AS "start", max(t) AS "end", count(*) AS n FROM c WHERE f GROUP BY asset, run HAVING max(t) - min(t) >= 1""",
    "sequence_windows": f"""WITH {SC}, a AS (SELECT asset, t, count(*) OVER w AS n, min(t) OVER w AS lo, avg(score) OVER w AS m FROM sc WINDOW w AS (PARTITION BY asset ORDER BY t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
      SELECT asset, t, t - lo = 11 AS contiguous, {r6('m', 'mean_of_12')} FROM a WHERE n = 12""",
    "incident_match": f'WITH {EV}, {FW} SELECT asset, event_id, failure_id, "start", "end", w_start::BIGINT AS w_start, w_end::BIGINT AS w_end FROM ev JOIN fw ON {MATCH}',
    "event_failure": f"WITH {EV}, {FW} SELECT asset, event_id, arg_max(failure_id, ord) AS failure_id FROM ev JOIN fw ON {MATCH} GROUP BY 1, 2",
    "false_alerts": f'WITH {EV}, {FW} SELECT asset, event_id, "start", "end" FROM ev WHERE NOT EXISTS (SELECT 1 FROM fw WHERE {MATCH})',
    "false_alerts_by_shift": f"""WITH {EV}, {FW}, x AS (SELECT shift, count(*) / 24.0 AS days FROM sc GROUP BY 1), f AS (SELECT shift, count(*) AS n FROM ev WHERE NOT EXISTS (SELECT 1 FROM fw WHERE {MATCH}) GROUP BY 1)
      SELECT x.shift, coalesce(n, 0) AS false_alerts, {r6('coalesce(n, 0) / greatest(days / 30.4375, 1e-9)', 'per_month')} FROM x LEFT JOIN f ON f.shift = x.shift""",
    "lead_times": f"WITH {EV}, {DETAIL} SELECT failure_id, first_alert, first_alert IS NOT NULL AS detected, flagged_early, {r6('greatest(lead, 0)', 'lead_time_hours')}, {r6('greatest(-lead, 0)', 'detection_delay_hours')} FROM (SELECT * REPLACE (lead AS lead) FROM fd)".replace("greatest(lead, 0)", "CASE WHEN lead IS NOT NULL THEN greatest(lead, 0) END").replace("greatest(-lead, 0)", "CASE WHEN lead IS NOT NULL THEN greatest(-lead, 0) END"),
    "median_lead": f"WITH {EV}, {DETAIL} SELECT {r6('median(early)', 'median_lead_h')}, count(first_alert) AS detected FROM fd",
    "net_value": f"WITH {EV}, {DETAIL}, f AS (SELECT count(*) AS n FROM eve WHERE NOT EXISTS (SELECT 1 FROM fw WHERE {MATCH})) SELECT any_value(n) AS n_false, {r6('sum(' + worth('early') + ') - any_value(n) * 500', 'net_value')} FROM fd, f",
    "break_even": f"WITH {EV}, {DETAIL} SELECT {r6('sum(' + worth('early') + ') / 500', 'break_even_false_alerts')} FROM fd",
    "parts_scenarios": f"WITH {EV}, {DETAIL} SELECT scenario, {r6('sum(' + worth('early', 'needed') + ')', chr(34) + 'value' + chr(34))} FROM fd, (VALUES ('24h', 36.0), ('48h', 60.0), ('168h', 180.0), ('336h', 348.0)) AS p(scenario, needed) GROUP BY 1",
    "threshold_sweep": f"WITH {SWEEP} SELECT threshold, scenario, flagged_early, detected, {r6('median_lead_h')}, false_alerts, {r6('false_alerts / months', 'false_alerts_per_month')}, {r6('net', 'net_value')}, {r6('v / 500 / months', 'break_even_per_month')} FROM so",
    "operating_point": f"WITH {SWEEP} SELECT scenario, threshold, {r6('net', 'net_value')} FROM so QUALIFY row_number() OVER (PARTITION BY scenario ORDER BY round(net, 6) DESC, threshold) = 1",
    "anticipation_sensitivity": f"""WITH {EV}, an AS ({" UNION ALL ".join(f"SELECT {a} AS anticipation, * FROM {failure_rows(a)}" for a in (12, 24, 48, 72))}), h AS (SELECT anticipation, failure_id, any_value(f_start) AS f_start, any_value(w_start) AS w_start, min("start") AS first FROM ev JOIN an ON {MATCH} AND "start" <= f_end WHERE "end" >= {HI} GROUP BY 1, 2)
      SELECT anticipation::BIGINT AS anticipation, count(*) AS flagged_early FROM h WHERE f_start > greatest(first, w_start) GROUP BY 1""",
    "persistence_sensitivity": f"WITH {PERSIST_GRID} SELECT persistence::BIGINT AS persistence, count(*) AS events FROM ev GROUP BY 1",
    "persistence_pivot": f"WITH {PERSIST_GRID} SELECT asset, {', '.join(f'count(*) FILTER (WHERE persistence = {k}) AS p{k}' for k in (2, 4, 8, 16))} FROM ev GROUP BY 1",
    "alert_triage": f"""WITH {EV}, x AS (SELECT ev.asset, event_id, max(run_elapsed_max) AS m FROM ev LEFT JOIN hrs ON hrs.asset = ev.asset AND t BETWEEN "start" AND "end" GROUP BY 1, 2) SELECT asset, event_id, {r6('m', 'max_run_elapsed_max')}, m > 21600 AS looks_like_leak FROM x""",
    "score_normalised": f"WITH {SC}, m AS (SELECT median(score) AS m FROM sc WHERE {TRAIN}) SELECT asset, t, {r6('(score - m) / (60 - m)', 'normalised')} FROM sc, m",
    "decimated": f"WITH {SC} SELECT asset, t, {r6('score')} FROM sc QUALIFY (row_number() OVER (PARTITION BY asset ORDER BY t) - 1) % 5 = 0",
    "spearman": f"WITH {HRS}, {MS} {rank_rows('x', 'y')} UNION ALL {rank_rows('x', 'z')} UNION ALL {rank_rows('y', 'z')}",
    "wave_time_domain": f"WITH {WAVE} SELECT vec_id, {', '.join(r6(c) for c in ('rms', 'peak', 'p2p', 'crest', 'kurtosis', 'skewness'))} FROM wave",
    "wave_spectrum_bands": f"WITH {SPEC} SELECT vec_id, {', '.join(r6(f'sum(power) FILTER (WHERE pos BETWEEN {lo} AND {hi}) / sum(power)', f'band_{n}') for n, lo, hi in (('low', 1, 8), ('mid', 9, 20), ('high', 21, 32)))} FROM spec GROUP BY 1",
    "mean_spectrum": f"WITH {SPEC} SELECT label::BIGINT AS label, pos, {r6('avg(power)', 'power')} FROM spec GROUP BY 1, 2",
    "bearing_max": f"WITH {BEAR} SELECT ts // 2 AS snap, bearing, {r6('max(rms)', 'rms')}, {r6('max(peak)', 'peak')} FROM bt GROUP BY 1, 2",
    "cross_entity_ratio": f"WITH {RATIO} SELECT ts AS \"timestamp\", bearing, {', '.join(r6(f'lr_{c}') for c in _HI)} FROM cr",
    "health_indicator": f"WITH {HEALTH} SELECT ts AS \"timestamp\", bearing, {', '.join(r6(f'z_{c}') for c in _HI)}, {r6('hi_raw')}, {r6('hi')}, {r6('rms_ratio')} FROM hh",
    "hi_driver": f"""WITH {HEALTH}, z AS (SELECT ts, bearing, {', '.join(f'CASE WHEN z_{c} IS NOT NULL THEN greatest(round(z_{c}, 6), 0) END AS {c}' for c in _HI)} FROM hh)
      SELECT ts AS "timestamp", bearing, CASE WHEN rms IS NULL THEN NULL WHEN rms >= peak AND rms >= kurtosis THEN 'rms' WHEN peak >= kurtosis THEN 'peak' ELSE 'kurtosis' END AS hi_driver FROM z""",
    "alarm_episodes": f"WITH {HEALTH}, {eps()} SELECT bearing, {r6('hours')} FROM ep",
    "onset_summary": f"""WITH {SUMMARY} SELECT bearing, coalesce(kf, 'none') AS known_failure, {r6('life', 'life_hours')}, {r6('onset', 'onset_hours')}, {r6('CASE WHEN kf IS NOT NULL THEN life - onset END', 'hours_before_failure')}, {r6('100 * onset / life', 'onset_pct_life')},
      len(hs)::BIGINT AS alarm_episodes, early::BIGINT AS early_false_alarms, array_to_string(list_transform(hs, lambda x: x::BIGINT::VARCHAR), ',') AS alarm_hours, diagnosed, CASE WHEN kf IS NOT NULL THEN CAST(diagnosed = kf AS VARCHAR) END AS diagnosis_correct FROM su""",
    "onset_evaluation": f"""WITH {SUMMARY}, f AS (SELECT *, min(CASE WHEN kf IS NOT NULL THEN onset END) OVER () AS first FROM su)
      SELECT count(CASE WHEN kf IS NOT NULL THEN onset END) AS detected, count(kf) AS failed, {r6('median(CASE WHEN kf IS NOT NULL THEN life - onset END)', 'median_lead_h')},
        sum(CASE WHEN kf IS NOT NULL THEN early ELSE len(list_filter(hs, lambda e: first IS NULL OR e < first)) END)::BIGINT AS false_alarms FROM f""",
    "k_sweep": f"""WITH {HEALTH}, gr AS (SELECT * FROM hh, (VALUES (0.5::DOUBLE), (1.0::DOUBLE), (1.5::DOUBLE)) AS a(k), (VALUES (1), (2), (4)) AS b(p)), {eps('k', 'p', 'gr', 'k, p, bearing')} SELECT k, p::BIGINT AS p, count(*) AS n, {r6('min(hours)', 'first_alarm')} FROM ep GROUP BY 1, 2""",
    "onset_economics": " UNION ALL ".join(onset(k) for k in ("0.5", "1.0", "1.5")),
    "summary_report": f"""SELECT s.bearing, s.known_failure, {r6('life', 'life_hours')}, {r6('onset', 'onset_hours')}, {r6('actual', 'rul75_actual')}, rul75_pred FROM (WITH {SUMMARY} SELECT bearing, coalesce(kf, 'none') AS known_failure, life, onset FROM su) s
      LEFT JOIN (WITH {RUL} SELECT bearing, actual, round(pred, 3) AS rul75_pred FROM ru WHERE f = 0.75) r ON r.bearing = s.bearing""",
    "kinematics": f"""SELECT p_partkey, {r6('8 * hz * (1 - q)', 'bpfo')}, {r6('8 * hz * (1 + q)', 'bpfi')}, {r6('0.5 * 2.815 / 0.331 * hz * (1 - q * q)', 'bsf')}, {r6('0.5 * hz * (1 - q)', 'ftf')} FROM (SELECT p_partkey, p_size * 50 / 60.0::DOUBLE AS hz, 0.331 / 2.815::DOUBLE * cos(radians(15.17)) AS q FROM part)""",
    "exp_fit": f"WITH {HEALTH} SELECT bearing, {r6('regr_intercept(ln(greatest(rms_ratio, 1e-3)), hours)', 'a')}, {r6('regr_slope(ln(greatest(rms_ratio, 1e-3)), hours)', 'b')}, count(rms_ratio) AS points FROM hh GROUP BY 1",
    "loo_rul": f"WITH {RUL} SELECT bearing::BIGINT AS bearing, f AS eval_fraction, {r6('hi_fail')}, {r6('own_eol')}, {r6('t_eval')}, {r6('actual', 'actual_rul')}, round(pred, 3) AS pred_rul FROM ru",
    "rul_error": f"WITH {RUL} SELECT f AS eval_fraction, round(median(abs(pred - actual)), 3) AS median_abs_error FROM ru GROUP BY 1",
    "naive_rul": f"""WITH {KNOWN}, {BEAR}, s AS (SELECT bearing, max(hours) - (20.0 + bearing * 3) AS post FROM bt JOIN known USING (bearing) GROUP BY 1), o AS (SELECT *, (SELECT median(q.post) FROM s q WHERE q.bearing <> s.bearing) AS other FROM s)
      SELECT bearing::BIGINT AS bearing, f AS eval_fraction, {r6('post * (1 - f)', 'actual_rul')}, {r6('greatest(other - f * post, 0)', 'naive_rul')}, {r6('abs(greatest(other - f * post, 0) - post * (1 - f))', 'abs_error')} FROM o, (VALUES (0.5::DOUBLE), (0.75::DOUBLE), (0.9::DOUBLE)) AS fr(f)""",
    "stream_replay_features": f"WITH {FEATS} SELECT asset, t, {', '.join(r6(c) for c in FEATURES)} FROM feats",
}

FEATURE_ROWS = f"WITH {FEATS} SELECT asset, t, {', '.join(r6(c) for c in FEATURES)} FROM feats"
ORACLES |= {
    "csv_scan": f"WITH {RAW} SELECT us, {r6('a1::FLOAT', 'TP2')}, {r6('a2::FLOAT', 'TP3')}, comp::BIGINT AS comp, lps::BIGINT AS lps, true AS no_towers FROM raw",
    "clean_parquet": f"WITH {RAW} SELECT asset, count(*) AS n, min(us) AS first, round(sum(a1::FLOAT::DOUBLE), 2) AS tp2, sum(comp)::BIGINT AS comp FROM raw WHERE asset < 3 AND us >= epoch_us(TIMESTAMP '2024-01-05 06:00:00') AND us < epoch_us(TIMESTAMP '2024-01-20 00:00:00') GROUP BY asset",
    "snapshot_files": f"WITH {WAVE} SELECT vec_id // 4 AS hours, vec_id % 4 + 1 AS bearing, vec_id % 4 AS channel, {r6('rms')}, 64::BIGINT AS points FROM wave",
    "model_store": ORACLES["control_limit_scores"],
    "baseline_store": ORACLES["baseline_drift"],
    "score_store": f"WITH {SC} SELECT asset, t, {r6('score')}, shift FROM sc",
    "report_csv": ORACLES["threshold_sweep"],
    "stream_scores": FEATURE_ROWS,
    "stream_event_time": f"{FEATURE_ROWS} WHERE (t + 1) * 3600000000 <= (SELECT (max(epoch_us(ts)) // 1000) * 1000 - {6 * 3600}000000 FROM events)",
}

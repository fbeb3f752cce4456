"""Vibration: kinematics, signal features, health indicator, onset, diagnosis and remaining life."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsewright.cluster import ship
from pulsewright.functions.exprs import array_median, clip, first_argmax, let
from pulsewright.operators.order_stats import median_of_others
from pulsewright.operators.windows import ordered, trailing_median, trailing_rows

FAULTS = ("bpfo", "bpfi", "bsf", "ftf")


def defect_frequencies(shaft_hz: float | Column, n_rollers: int, pitch_d: float, roller_d: float, contact_deg: float) -> dict:
    """Frequencies of outer race, inner race, roller and cage of a rolling-element bearing, for a number or a column of shaft speeds."""
    ratio = roller_d / pitch_d * math.cos(math.radians(contact_deg))
    return {
        "bpfo": 0.5 * n_rollers * shaft_hz * (1 - ratio),
        "bpfi": 0.5 * n_rollers * shaft_hz * (1 + ratio),
        "bsf": 0.5 * pitch_d / roller_d * shaft_hz * (1 - ratio * ratio),
        "ftf": 0.5 * shaft_hz * (1 - ratio),
    }


def lines(freqs: Mapping[str, float]) -> dict[str, float]:
    """Where each fault shows: rollers strike both races, so at twice their frequency."""
    return {k: v * (2 if k == "bsf" else 1) for k, v in freqs.items()}


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _centred(a: str | Column) -> Column:
    """The array as doubles, less its mean."""
    x = F.transform(F.col(a) if isinstance(a, str) else a, lambda v: v.cast("double"))
    return let(_sum(x) / F.size(x).cast("double"), lambda m: F.transform(x, lambda v: v - m))


def time_domain(a: str | Column) -> dict[str, Column]:
    """rms, peak, p2p, crest, kurtosis (normal = 3) and skewness of an array about its mean, by array functions."""
    mean = lambda z, f: _sum(F.transform(z, f)) / F.size(z).cast("double")
    m2 = lambda z: mean(z, lambda v: v * v)
    peak = lambda z: F.greatest(F.array_max(z), -F.array_min(z))
    some = lambda z, c: F.when(m2(z) > 0, c)
    parts = {
        "rms": lambda z: F.sqrt(m2(z)), "peak": peak, "p2p": lambda z: F.array_max(z) - F.array_min(z), "crest": lambda z: some(z, peak(z) / F.sqrt(m2(z))),
        "kurtosis": lambda z: some(z, mean(z, lambda v: v * v * v * v) / F.pow(m2(z), F.lit(2.0))), "skewness": lambda z: some(z, mean(z, lambda v: v * v * v) / F.pow(m2(z), F.lit(1.5))),
    }
    return {k: let(_centred(a), f) for k, f in parts.items()}


def dft_power(a: str, n: int, hann: bool = True) -> Column:
    """Array of |rfft|**2 / n of an array of n values about its mean, by array functions; for short arrays (use SpectralFeatures for long ones)."""
    win = [0.5 - 0.5 * math.cos(2 * math.pi * i / (n - 1)) if hann else 1.0 for i in range(n)]
    windowed = F.zip_with(_centred(a), F.array(*[F.lit(v) for v in win]), lambda v, h: v * h)
    step = 2 * math.pi / n

    def power(w: Column, k: Column) -> Column:
        part = lambda f: _sum(F.transform(w, lambda v, i: v * f(i * k * step)))
        return (F.pow(part(F.cos), F.lit(2.0)) + F.pow(part(F.sin), F.lit(2.0))) / n

    return let(windowed, lambda w: F.transform(F.sequence(F.lit(0), F.lit(n // 2)), lambda k: power(w, k)))


@dataclass(frozen=True)
class SpectralFeatures:
    """Time-domain, band and envelope features of long snapshots, by FFT in Arrow batches."""

    fs: float
    freqs: Mapping[str, float]
    tol: float = 0.05
    harmonics: int = 3
    band: tuple[float, float] = (2000.0, 8000.0)
    order: int = 4
    high: float = 5000.0

    @property
    def names(self) -> list[str]:
        return ["rms", "peak", "p2p", "crest", "kurtosis", "skewness", *[f"band_{f}" for f in FAULTS], "hf_energy", *[f"env_{f}" for f in FAULTS]]

    def gain(self, f: np.ndarray) -> np.ndarray:
        """Squared magnitude of a Butterworth band-pass of the order given, which is what its zero-phase double pass applies."""
        warp = lambda x: np.tan(np.pi * np.clip(x, 0, self.fs / 2 * 0.999999) / self.fs)
        lo, hi = warp(np.array(self.band))
        w = warp(f)
        with np.errstate(divide="ignore"):
            s = np.where(w > 0, (w * w - lo * hi) / (np.maximum(w, 1e-300) * (hi - lo)), np.inf)
            return 1 / (1 + np.minimum(np.abs(s), 1e30) ** (2 * self.order))

    def one(self, x: np.ndarray) -> list[float]:
        x = np.asarray(x, float)
        x = x - x.mean()
        n = len(x)
        f = np.fft.rfftfreq(n, 1 / self.fs)
        window = np.hanning(n)
        m2 = float(np.mean(x**2))
        rms, peak = math.sqrt(m2), float(np.abs(x).max())
        out = [rms, peak, float(x.max() - x.min()), peak / rms if rms > 0 else None, float(np.mean(x**4)) / m2**2 if m2 > 0 else None, float(np.mean(x**3)) / m2**1.5 if m2 > 0 else None]
        spec = np.abs(np.fft.rfft(x * window)) ** 2
        whole = spec.sum()
        at = lines(self.freqs)
        near = lambda f0, h=1: np.abs(f - h * f0) <= self.tol * h * f0
        for k in FAULTS:
            mask = np.zeros(len(f), bool)
            for h in range(1, self.harmonics + 1):
                mask |= near(at[k], h)
            out.append(float(spec[mask].sum() / whole) if whole > 0 else None)
        out.append(float(spec[f >= self.high].sum() / whole) if whole > 0 else None)
        # band-pass and analytic signal in one inverse transform: positive frequencies doubled, negative ones dropped
        full = np.zeros(n, complex)
        full[: len(f)] = np.fft.rfft(x) * self.gain(f) * 2
        full[0] = 0
        env = np.abs(np.fft.ifft(full))
        env = env - env.mean()
        espec = np.abs(np.fft.rfft(env * window)) / n
        inner = espec[(f > 10) & (f < 1000)]
        floor = (float(np.median(inner)) if len(inner) else 0.0) + 1e-12
        for k in FAULTS:
            line = espec[near(at[k])]
            out.append(float(line.max() / floor) if len(line) else None)
        return out

    def add(self, df: DataFrame, samples: str = "samples") -> DataFrame:
        """`df` with one column per feature; each snapshot is one row, so nothing is shuffled."""
        ship(df.sparkSession)
        kind = ", ".join(f"{n} double" for n in self.names)
        names, one = self.names, self.one

        @F.pandas_udf(f"struct<{kind.replace(' double', ':double')}>")
        def run(a: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([one(x) for x in a], columns=names, dtype=float).astype(object).where(lambda d: d.notna(), None)

        return df.withColumn("_f", run(samples)).select(*df.columns, "_f.*")


def bearing_max(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("test", "timestamp", "hours", "bearing")) -> DataFrame:
    """One row per bearing and snapshot: the largest of its channels."""
    return df.groupBy(*keys).agg(*[F.max(c).alias(c) for c in cols])


def cross_log_ratio(bt: DataFrame, cols: Sequence[str], by: Sequence[str] = ("test", "timestamp"), entity: str = "bearing") -> DataFrame:
    """lr_<c>: log of c less the median log of the other entities at the same snapshot."""
    w = Window.partitionBy(*by)
    logs = bt.withColumns({f"_l_{c}": F.log(clip(c, 1e-9)) for c in cols})
    logs = logs.withColumn("_all", F.collect_list(F.struct(F.col(entity).alias("e"), *[F.col(f"_l_{c}").alias(c) for c in cols])).over(w))
    others = F.filter("_all", lambda x: x["e"] != F.col(entity))
    out = logs.withColumn("_others", others)
    out = out.withColumns({f"lr_{c}": F.col(f"_l_{c}") - array_median(F.col(f"_others.{c}")) for c in cols})
    return out.drop("_all", "_others", *[f"_l_{c}" for c in cols])


def health_indicator(bt: DataFrame, features: Sequence[str], level: str = "rms", baseline_hours: float = 24.0, skip_hours: float = 1.0, smoothing: int = 12, z_only: Sequence[str] = (), keys: Sequence[str] = ("test", "bearing"), prefix: str = "lr_") -> DataFrame:
    """z_<c> against each bearing's own healthy window, hi_raw (largest positive z), hi_driver, hi (trailing median) and rms_ratio."""
    cols = list(dict.fromkeys([*features, *z_only]))
    base = (F.col("hours") >= skip_hours) & (F.col("hours") <= skip_hours + baseline_hours)
    stats = [x for c in cols for x in (F.avg(f"{prefix}{c}").alias(f"_mu_{c}"), F.stddev_samp(f"{prefix}{c}").alias(f"_sd_{c}"))]
    own = bt.filter(base).groupBy(*keys).agg(*stats, F.median(level).alias("_level"))
    out = bt.join(own, list(keys), "left")
    z = {f"z_{c}": (F.col(f"{prefix}{c}") - F.col(f"_mu_{c}")) / F.when(F.col(f"_sd_{c}") > 1e-9, F.col(f"_sd_{c}")).otherwise(1.0) for c in cols}
    out = out.withColumns(z | {"_own": F.col(level) / F.col("_level")}).select(*bt.columns, *z, "_own")
    z = [clip(f"z_{c}", 0.0) for c in features]
    out = out.withColumns({"hi_raw": F.greatest(*z) if len(z) > 1 else z[0], "hi_driver": first_argmax(list(features), z)})
    frame = trailing_rows(keys, ["hours"], smoothing)
    return out.withColumns({"hi": trailing_median("hi_raw", frame), "rms_ratio": trailing_median("_own", frame)}).drop("_own")


def alarm_episodes(hi: DataFrame, k: str | Column | float, persistence: str | Column | int, keys: Sequence[str] = ("test", "bearing"), x: str = "hi", order: str = "hours") -> DataFrame:
    """Rows at which an alarm is raised: the persistence-th of consecutive rows above k; re-armed by a row that is not."""
    limit = F.col(k) if isinstance(k, str) else F.lit(k) if not isinstance(k, Column) else k
    need = F.col(persistence) if isinstance(persistence, str) else F.lit(persistence) if not isinstance(persistence, Column) else persistence
    w = ordered(keys, [order])
    rows = hi.withColumn("_a", F.coalesce(F.col(x) > limit, F.lit(False)))
    rows = rows.withColumn("_island", F.sum((~F.col("_a")).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_rn", F.sum(F.col("_a").cast("long")).over(ordered([*keys, "_island"], [order]).rowsBetween(Window.unboundedPreceding, 0)))
    return rows.filter(F.col("_a") & (F.col("_rn") == need)).drop("_a", "_island", "_rn")


def onset_summary(hi: DataFrame, k, persistence, known: DataFrame, envelope: Mapping[str, str], max_lead: float | None = 168.0, keys: Sequence[str] = ("test", "bearing"), by: Sequence[str] = ()) -> DataFrame:
    """One row per bearing (and grid point, if hi has one row for each in the columns `by`): life, alarms, onset, lead, false alarms before the lead window, diagnosis.

    known: keys and known_failure of the bearings that failed (a small
    configuration table). envelope: column of a fault's z, and the fault.
    """
    own, keys = list(keys), [*by, *keys]
    life = hi.groupBy(*keys).agg(F.max("hours").alias("life_hours"))
    eps = alarm_episodes(hi, k, persistence, keys).groupBy(*keys).agg(F.array_sort(F.collect_list("hours")).alias("alarm_hours"))
    out = life.join(eps, list(keys), "left").join(F.broadcast(known), own, "left")
    out = out.withColumn("alarm_hours", F.coalesce("alarm_hours", F.expr("cast(array() as array<double>)")))
    limited = F.col("known_failure").isNotNull() & F.lit(max_lead is not None)
    late = lambda e: F.col("life_hours") - e <= (max_lead or 0.0)
    valid = F.when(limited, F.filter("alarm_hours", late)).otherwise(F.col("alarm_hours"))
    out = out.withColumns({"onset_hours": F.get(valid, F.lit(0)), "early_false_alarms": F.when(limited, F.size(F.filter("alarm_hours", lambda e: ~late(e)))).otherwise(0)})
    after = hi.join(out.select(*keys, "onset_hours"), list(keys)).filter("hours >= onset_hours")
    med = after.groupBy(*keys).agg(*[F.median(c).alias(c) for c in envelope])
    med = med.select(*keys, first_argmax(list(envelope.values()), [F.col(c) for c in envelope]).alias("diagnosed"))
    out = out.join(med, list(keys), "left")
    return out.select(
        *keys, F.coalesce("known_failure", F.lit("none")).alias("known_failure"), "life_hours", "onset_hours",
        F.when(F.col("known_failure").isNotNull(), F.col("life_hours") - F.col("onset_hours")).alias("hours_before_failure"), (100 * F.col("onset_hours") / F.col("life_hours")).alias("onset_pct_life"),
        F.size("alarm_hours").alias("alarm_episodes"), "early_false_alarms", "alarm_hours", "diagnosed", F.when(F.col("known_failure").isNotNull(), F.col("diagnosed") == F.col("known_failure")).alias("diagnosis_correct"),
    )


def evaluate_onsets(summary: DataFrame, test: str = "test", by: Sequence[str] = ()) -> DataFrame:
    """Detected and failed bearings, median lead and false alarms; survivors' alarms count only before their rig's first true detection."""
    failed = F.col("known_failure") != "none"
    w = Window.partitionBy(*by, test)
    rows = summary.withColumn("_first", F.min(F.when(failed, F.col("onset_hours"))).over(w))
    own = F.when(failed, F.col("early_false_alarms")).otherwise(F.size(F.filter("alarm_hours", lambda e: F.coalesce(e < F.col("_first"), F.lit(True)))))
    lead = F.when(failed, F.col("hours_before_failure"))
    return rows.groupBy(*by).agg(F.count(lead).alias("detected"), F.sum(failed.cast("long")).alias("failed"), F.median(lead).alias("median_lead_h"), F.sum(own).alias("false_alarms"))


def exponential_fit(df: DataFrame, keys: Sequence[str], hours: Column, level: str) -> DataFrame:
    """a and b of level = exp(a + b * hours), by least squares on the log; and the number of points."""
    y, x = F.log(clip(level, 1e-3)), hours
    return df.groupBy(*keys).agg(F.regr_intercept(y, x).alias("a"), F.regr_slope(y, x).alias("b"), F.count(y).alias("points"))


def remaining_life(hi: DataFrame, onsets: DataFrame, known: DataFrame, fractions: Sequence[float] = (0.5, 0.75, 0.9), min_points: int = 12, max_rul: float = 2000.0, tail: int = 6, level: str = "rms_ratio", keys: Sequence[str] = ("test", "bearing")) -> DataFrame:
    """Leave-one-bearing-out remaining life of each failed bearing at fractions of the way from onset to failure.

    The level at failure is the median of the other failed bearings' last levels, by
    ranks instead of pairs. known is a configuration table, so it is broadcast.
    """
    keys = list(keys)
    g = hi.join(F.broadcast(known.select(*keys)), keys)
    last = g.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("hours")))).filter(F.col("_r") <= tail)
    eol = last.groupBy(*keys).agg(F.median(level).alias("own_eol"), F.max("hours").alias("eol"))
    fail = median_of_others(eol, [], "own_eol", "hi_fail")
    at = fail.join(onsets.select(*keys, "onset_hours"), keys, "left").withColumn("eval_fraction", F.explode(F.array(*[F.lit(f) for f in fractions])))
    at = at.withColumn("t_eval", F.col("onset_hours") + F.col("eval_fraction") * (F.col("eol") - F.col("onset_hours")))
    pts = g.join(at.select(*keys, "eval_fraction", "onset_hours", "t_eval"), keys).filter("hours >= onset_hours and hours <= t_eval")
    fit = exponential_fit(pts, [*keys, "eval_fraction"], F.col("hours") - F.col("onset_hours"), level)
    out = at.join(fit, [*keys, "eval_fraction"], "left")
    t_fail = F.col("onset_hours") + (F.log("hi_fail") - F.col("a")) / F.when(F.col("b") > 0, F.col("b"))
    pred = F.when(F.col("points") >= min_points, F.when(F.col("b") > 0, clip(t_fail - F.col("t_eval"), 0.0, max_rul)).otherwise(max_rul))
    out = out.withColumns({"actual_rul": F.col("eol") - F.col("t_eval"), "pred_rul": pred})
    return out.select(*keys, "eval_fraction", "hi_fail", "own_eol", "t_eval", "actual_rul", "pred_rul", (F.col("pred_rul") - F.col("actual_rul")).alias("error_h"), F.when(F.col("actual_rul") > 0, 100 * F.abs(F.col("pred_rul") - F.col("actual_rul")) / F.col("actual_rul")).alias("abs_pct_error"))


def naive_life(summary: DataFrame, keys: Sequence[str] = ("test", "bearing"), fractions: Sequence[float] = (0.5, 0.75, 0.9)) -> DataFrame:
    """The baseline: the median time from onset to failure of the other failed bearings, less the time since onset."""
    keys = list(keys)
    f = summary.filter("known_failure <> 'none' and onset_hours is not null").select(*keys, "onset_hours", (F.col("life_hours") - F.col("onset_hours")).alias("post"))
    rows = median_of_others(f, [], "post", "other").filter("other is not null")
    rows = rows.withColumn("eval_fraction", F.explode(F.array(*[F.lit(x) for x in fractions])))
    actual = F.col("post") * (1 - F.col("eval_fraction"))
    pred = F.greatest(F.col("other") - F.col("eval_fraction") * F.col("post"), F.lit(0.0))
    return rows.select(*keys, "eval_fraction", actual.alias("actual_rul"), pred.alias("naive_rul"), F.abs(pred - actual).alias("abs_error"))


def mean_spectrum(df: DataFrame, keys: Sequence[str], power: str) -> DataFrame:
    """Element-wise mean of spectra per key."""
    return df.select(*keys, F.posexplode(power).alias("pos", "p")).groupBy(*keys, "pos").agg(F.avg("p").alias("power"))


def band_peak(spectrum: DataFrame, keys: Sequence[str], rate: float, n: int, low: float, high: float) -> DataFrame:
    """The frequency in Hz and the power of the largest bin of each key's spectrum (pos, power) between low and high; the lowest of equals."""
    hz = F.col("pos") * F.lit(rate / n)
    best = F.max_by(F.struct(hz.alias("hz"), "power"), F.struct("power", (-F.col("pos")).alias("p")))
    return spectrum.filter(hz.between(low, high)).groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.hz").alias("peak_hz"), F.col("b.power").alias("peak_power"))


def likelier_rate(spectrum: DataFrame, keys: Sequence[str], n: int, rates: Sequence[float], expected: float, tolerance: float = 0.05) -> DataFrame:
    """Which of several sampling rates puts the peak near an expected frequency closest to it: peak_hz under each rate, and the rate.

    Each bin meets the few rates once: one pass over the spectra, however many rates.
    """
    rows = spectrum.withColumn("rate", F.explode(F.array(*[F.lit(float(r)) for r in rates]))).withColumn("hz", F.col("pos") * F.col("rate") / n)
    near = rows.filter(F.col("hz").between(expected * (1 - tolerance), expected * (1 + tolerance)))
    peak = near.groupBy(*keys, "rate").agg(F.max_by("hz", F.struct("power", (-F.col("pos")).alias("p"))).alias("peak_hz"))
    best = F.min_by(F.struct("rate", "peak_hz"), F.struct(F.abs(F.col("peak_hz") - expected).alias("d"), "rate"))
    return peak.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")

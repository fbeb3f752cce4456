"""Entry points for spark-submit: features, models, backtest, vibration, health, replay.

The configuration has the sections `telemetry` (train_split, train_exclude, shifts,
alert_logic, backtest), `rig` (shaft_speed_rpm, sampling_frequency_hz and
bearing_geometry or fault_frequencies_hz) and `health` (hi_features, baseline_hours,
skip_hours, smoothing_snapshots, limit, persistence, max_lead_hours, and known, a list of
test, bearing and failure). A file without a section of that name is that section.
"""

from __future__ import annotations

import argparse
import json

from pulsewright import config
from pulsewright.operators import telemetry as T
from pulsewright.operators import vibration as V
from pulsewright.operators.detectors import ControlLimits
from pulsewright.plans import compressor, health
from pulsewright.session import session
from pulsewright.sources import registry, snapshots
from pulsewright.sources import telemetry as S

#: Detectors that score a minute by itself.
STREAMED = ("isolation_forest", "control_limits")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pulsewright")
    p.add_argument("--config", required=True, help="parameters, YAML or JSON")
    p.add_argument("--failures", help="failure reports, YAML or JSON")
    p.add_argument("--costs", help="costs, YAML or JSON")
    p.add_argument("--data", default="data", help="folder of inputs and results")
    sub = p.add_subparsers(dest="command", required=True)
    f = sub.add_parser("features")
    f.add_argument("--refresh", action="store_true")
    m = sub.add_parser("models")
    m.add_argument("--train", action="store_true")
    m.add_argument("--no-lstm", action="store_true")
    sub.add_parser("backtest")
    v = sub.add_parser("vibration")
    v.add_argument("--test", type=int, nargs="+", default=[1, 2, 3])
    v.add_argument("--limit", type=int)
    v.add_argument("--n-jobs", type=int, help="tasks of the extraction; by default as many as the files give")
    sub.add_parser("health")
    r = sub.add_parser("replay")
    for x in ("--start", "--end", "--out"):
        r.add_argument(x)
    r.add_argument("--speed", type=float, default=0, help="seconds of the data a second, a day at a time; 0: as fast as can be")
    r.add_argument("--model", choices=STREAMED, help="all of them by default")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = session()
    raw_params = config.load(a.config)
    own = config.section(raw_params, "telemetry", ("train_split",), a.command in ("features", "models", "backtest", "replay"))
    params = config.Params.from_dict(own) if "train_split" in own else None
    entries = config.load(a.failures) if a.failures else []
    failures = config.failures(entries["failures"] if isinstance(entries, dict) else entries)
    at = lambda name: f"{a.data}/{name}"
    if a.command == "features":
        raw = S.cached(spark, at("clean"), lambda: S.read_csv(spark, at("raw.csv")), a.refresh)
        feats, baseline = compressor.feature_table(spark, raw, params, failures)
        feats.write.mode("overwrite").parquet(at("features"))
        S.write_json(spark, baseline.first().asDict(), at("baseline.json"))
    elif a.command == "models":
        feats = S.read_built(spark, at("features"), "features")
        if a.train:
            models = compressor.train(feats, params, not a.no_lstm)
            registry.save(spark, models, at("models"))
            for name, d in models.items():
                S.log_run(spark, at("runs"), name, {"train": params.train, "exclude": params.exclude, "features": list(d.features)}, {"threshold": d.threshold})
        compressor.score(feats, registry.load(spark, at("models"))).write.mode("overwrite").parquet(at("scores"))
    elif a.command == "backtest":
        scores = S.read_built(spark, at("scores"), "models")
        costs = config.costs(a.costs) if a.costs else None
        report = points = None
        amounts = config.amounts(a.costs) if a.costs else None
        for name, threshold in S.read_json(spark, at("models/thresholds.json")).items():
            b = compressor.run_backtest(scores, name, threshold, failures, params, costs)
            report = b.report if report is None else report.unionByName(b.report)
            S.write_report(b.details, at(f"report_{name}"))
            best = compressor.operating_point(scores, name, failures, params, amounts)
            points = best if points is None else points.unionByName(best)
        S.write_report(report, at("report"))
        S.write_report(points, at("report_operating_points"))
        report.show(truncate=False)
    elif a.command == "vibration":
        rig = config.section(raw_params, "rig", ("bearing_geometry", "fault_frequencies_hz"))
        g = rig.get("bearing_geometry")
        freqs = V.defect_frequencies(rig["shaft_speed_rpm"] / 60, g["n_rollers"], g["pitch_diameter_in"], g["roller_diameter_in"], g["contact_angle_deg"]) if g else rig["fault_frequencies_hz"]
        for t in a.test:
            rows = snapshots.with_bearing(snapshots.load(spark, at(f"test{t}"), a.limit), t)
            rows = rows.repartition(a.n_jobs) if a.n_jobs else rows
            V.SpectralFeatures(rig.get("sampling_frequency_hz", 20480), freqs).add(rows).drop("samples").write.mode("overwrite").parquet(at(f"vibration/test={t}"))
    elif a.command == "health":
        h = config.section(raw_params, "health", ("hi_features", "known", "limit", "persistence", "baseline_hours"), False)
        cols = h.get("hi_features", ["rms", "kurtosis", "env_bpfo", "env_bpfi", "env_bsf"])
        rows = S.read_built(spark, at("vibration"), "vibration")
        bt = V.bearing_max(rows, list(dict.fromkeys([*cols, "rms", "kurtosis", *[f"env_{f}" for f in V.FAULTS]])))
        z = list(dict.fromkeys([*cols, *[f"env_{f}" for f in V.FAULTS]]))
        hi = V.health_indicator(V.cross_log_ratio(bt, z), cols, baseline_hours=h.get("baseline_hours", 24), skip_hours=h.get("skip_hours", 1), smoothing=h.get("smoothing_snapshots", 12), z_only=z)
        hi.write.mode("overwrite").parquet(at("health"))
        for name, report in health.reports(spark.read.parquet(at("health")), h).items():
            S.write_report(report, at(f"report_{name}"))
    elif a.command == "replay":
        from pulsewright.streaming.processor import Scorer, flush_stream, score_stream

        saved = S.read_json(spark, at("models/thresholds.json"))
        models = registry.load(spark, at("models"), [a.model] if a.model else [k for k in STREAMED if k in saved])
        limits = {k: {f: tuple(x) for f, x in d.limits.items()} for k, d in models.items() if isinstance(d, ControlLimits)}
        mu_sd = S.read_json(spark, at("baseline.json"))
        baseline = {z: (x, mu_sd[f"mu_{x}"], mu_sd[f"sd_{x}"]) for x, z in T.drift_targets(T.COMPRESSOR)}
        scorer = Scorer(limits, {k: d.threshold for k, d in models.items()}, params.smoothing, params.persistence, baseline=baseline, models={k: d for k, d in models.items() if k not in limits})
        clean = spark.readStream.schema(S.read_clean(spark, at("clean")).schema).option("maxFilesPerTrigger", 1).parquet(at("clean"))
        rows = S.as_rows(S.replay_slice(clean, a.start, a.end))
        # a folder a batch, so that a batch that runs again replaces its own; what the end leaves open is replaced by a run that goes on
        write = lambda df, batch: df.write.mode("overwrite").json(f"{a.out or at('replay')}/batch={batch}")
        q = score_stream(rows, T.COMPRESSOR, scorer).writeStream.foreachBatch(write).option("checkpointLocation", at("replay_checkpoint"))
        if a.speed:  # a file is a day of an asset
            q = q.trigger(processingTime=f"{max(1, round(86_400 / a.speed))} seconds").start()
            q.processAllAvailable()
            q.stop()
        else:
            q = q.trigger(availableNow=True).start()
            q.awaitTermination()
        last = spark.read.format("state-metadata").load(at("replay_checkpoint")).selectExpr("max(maxBatchId) AS last").first().last
        if last is not None:
            write(flush_stream(spark, at("replay_checkpoint"), T.COMPRESSOR, scorer), last + 1)
        print(json.dumps({"status": q.lastProgress and q.lastProgress.get("numInputRows")}))


if __name__ == "__main__":
    main()

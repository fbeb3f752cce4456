from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from pulsewright import config
from pulsewright.schema import SchemaError
from pulsewright.sources import snapshots
from pulsewright.sources import telemetry as S
from tests.synth import telemetry


def test_csv_and_clean_parquet(spark, tmp_path):
    raw = telemetry(hours=0.2, frozen=None, gap=None)
    raw.loc[3, "TP2"] = np.nan
    raw.to_csv(tmp_path / "raw.csv")  # with an index column that has no name
    df = S.read_csv(spark, str(tmp_path / "raw.csv"))
    assert df.count() == len(raw) and S.read_csv(spark, str(tmp_path / "raw.csv"), 5).count() == 5
    assert dict(df.dtypes)["TP2"] == "float" and dict(df.dtypes)["COMP"] == "tinyint" and df.filter("TP2 is null").count() == 1
    S.write_clean(df, str(tmp_path / "clean"))
    back = S.read_clean(spark, str(tmp_path / "clean"))
    assert back.count() == len(raw) and back.select("asset").distinct().count() == 1
    assert S.as_rows(back).columns[:3] == ["asset", "us", "tie"]
    assert S.replay_slice(back, "2020-03-01 00:01:00", "2020-03-01 00:02:00").count() == 6
    with pytest.raises(SchemaError, match="COMP"):
        S.as_rows(back.drop("COMP"))
    with pytest.raises(FileNotFoundError, match="features"):
        S.read_built(spark, str(tmp_path / "none"), "features")


def test_cache_models_reports_and_runs(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    path = str(tmp_path / "cache")
    assert S.cached(spark, path, build).count() == 3 and S.cached(spark, path, build).count() == 3 and len(calls) == 1
    S.cached(spark, path, build, refresh=True)
    assert len(calls) == 2
    S.write_json(spark, {"a": [1, 2.5]}, str(tmp_path / "m.json"))
    assert S.read_json(spark, str(tmp_path / "m.json")) == {"a": [1, 2.5]}
    S.write_report(spark.range(2), str(tmp_path / "report"))
    assert len(list((tmp_path / "report").glob("*.csv"))) == 1
    for k in range(2):
        S.log_run(spark, str(tmp_path / "runs"), f"r{k}", {"k": k}, {"net": 1.5})
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 2


def test_snapshots(spark, tmp_path):
    rng = np.random.default_rng(0)
    deep = tmp_path / "test2" / "a" / "b"
    shallow = tmp_path / "test2" / "data"
    for folder, n in ((deep, 11), (shallow, 12)):
        folder.mkdir(parents=True)
        for i in range(n):
            np.savetxt(folder / f"2004.02.12.{i + 10:02d}.32.39", rng.normal(size=(50, 4)), fmt="%.3f", delimiter="\t")
    (shallow / "readme.txt").write_text("no")
    inv = snapshots.inventory(spark, str(tmp_path / "test2"))
    assert inv.count() == 12 and sorted(r.hours for r in inv.collect()) == [float(i) for i in range(12)]
    rows = snapshots.with_bearing(snapshots.load(spark, str(tmp_path / "test2"), limit=3), 2)
    assert rows.count() == 12 and {len(r.samples) for r in rows.collect()} == {50}
    assert {(r.channel, r.bearing) for r in rows.collect()} == {(0, 1), (1, 2), (2, 3), (3, 4)}


def test_params():
    p = config.Params.from_dict({"train_split": {"start": "2020-02-01 00:00:00", "end": "2020-04-10 23:59:00"}, "train_exclude": [{"start": "2020-03-12 00:00:00", "end": "2020-03-12 14:00:00"}], "shifts": {"x": {"label": "L", "start_hour": 1, "end_hour": 2}}, "alert_logic": {"persistence_minutes": 90}})
    assert p.train[0] == pd.Timestamp("2020-02-01").timestamp() // 60 and p.exclude[0][1] - p.exclude[0][0] == 840 and p.shifts == (("L", 1, 2),) and p.persistence == 90 and p.quantile == 0.995
    f = config.failures([{"id": "F1", "start": "2020-04-18 00:00:00", "end": "2020-04-18 23:59:00", "maintenance": None}])
    assert f[0][2] - f[0][1] == 1439 and f[0][3] is None

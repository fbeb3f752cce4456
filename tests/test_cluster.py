from __future__ import annotations

from pathlib import Path

from pulsewright import cluster


def test_rows_of_keys_by_either_join(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    keys = cluster.materialise(spark.createDataFrame([(3,), (50,), (200,)], "k long"), "keys")
    for bound in (10, 0):
        assert sorted(r.k for r in cluster.only_rows_of(df, keys, ["k"], bound).collect()) == [3, 50]
    plan = cluster.only_rows_of(df, keys, ["k"], 10)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan


def test_materialised_tables_cut_lineage_and_go(spark):
    t = cluster.materialise(spark.range(5), "t")
    assert t.count() == 5 and "Range" not in t._jdf.queryExecution().toString()
    path = t._pulsewright_path
    assert path.startswith(cluster.shared_dir(spark)) and Path(path.removeprefix("file:")).exists()
    cluster.discard(t)
    assert not Path(path.removeprefix("file:")).exists()


def test_shipping_is_done_once(spark):
    cluster.ship(spark)
    cluster.ship(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= cluster.ARROW_ROWS

"""What every operator needs of the cluster: shared storage, shipped code, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED = "pulsewright.shipped"

#: Rows of a few longs that may be broadcast (some 50 MB as a hash table); beyond it a shuffle join is used.
BROADCAST_ROWS = 500_000
#: Rows of an Arrow batch at most: whole documents of some ten thousand rows would take an executor's memory outside the heap.
ARROW_ROWS = 500


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever they run (once per application), and keep Arrow batches small."""
    sc = spark.sparkContext
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    if sc.getLocalProperty(_SHIPPED):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp()) / "pulsewright_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(str(target))
    sc.setLocalProperty(_SHIPPED, "1")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset in local mode (tests)."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not found:
        jvm_dir = sc._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            found = jvm_dir.get()
        else:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            found = "file://" + tempfile.mkdtemp(prefix="pulsewright-")
            sc.setCheckpointDir(found)
            found = sc._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and survives lost executors."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._pulsewright_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what materialise() wrote; only once nothing lazy reads it any more."""
    for t in tables:
        path = getattr(t, "_pulsewright_path", None)
        if path:
            delete(t.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def only_rows_of(df: DataFrame, keys: DataFrame, on: list[str], bound: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of df whose keys stand in `keys` (a materialised table, distinct keys).

    The keys are broadcast only if they are counted to be few; otherwise both
    sides are shuffled.
    """
    keys = keys.select(*on)
    small = keys.count() <= bound  # of a Parquet table: from the files' footers
    return df.join(F.broadcast(keys) if small else keys, on, "left_semi")


def sized(table: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """A materialised table of narrow rows, to be joined: broadcast if it is counted to have few rows, else left to a shuffle join."""
    return F.broadcast(table) if table.count() <= bound else table


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


__all__ = ["BROADCAST_ROWS", "delete", "discard", "materialise", "new_path", "only_rows_of", "shared_dir", "ship", "shuffle_partitions", "sized"]

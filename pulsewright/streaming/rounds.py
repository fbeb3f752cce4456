"""A table replayed as a stream in bounded micro-batches.

A stream over one large file takes it in one micro-batch, and a state function then gets all rows of an
asset at once. Here the table is written in the order of time, in ranges, and the files are
moved into the stream's folder round by round, each of about ROWS rows; a round is over
before the next one comes. So a micro-batch holds no more, however large the table is, and
the order does not depend on the files' times.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pulsewright.cluster import delete, new_path

#: Rows of a round, of all assets together.
ROWS = 1_000_000


class Rounds:
    """`stream` is the stream over `rows` (a table); `feed` runs a started query of it through all rounds."""

    def __init__(self, rows: DataFrame, order: Sequence[str]):
        spark = self.spark = rows.sparkSession
        self.n = max(1, -(-rows.count() // ROWS))
        self.cut, self.incoming = new_path(spark, "cut"), new_path(spark, "incoming")
        rows.repartitionByRange(self.n, *order).sortWithinPartitions(*order).write.parquet(self.cut)
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        cut = self.path(self.cut)
        self.fs = cut.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self.path(self.incoming))
        # by name is by range
        self.files = sorted((f.getPath().getName(), f.getLen()) for f in self.fs.listStatus(cut) if f.getPath().getName().startswith("part-"))
        self.stream = spark.readStream.schema(rows.schema).parquet(self.incoming)

    def groups(self) -> list[list[str]]:
        """Names of each round's files; rounds are of like size, also where there are more files than rounds."""
        total, done, out = sum(size for _, size in self.files), 0, [[] for _ in range(self.n)]
        for name, size in self.files:
            out[(2 * done + size) * self.n // (2 * total)].append(name)  # by its middle
            done += size
        return [g for g in out if g]

    def feed(self, query: StreamingQuery) -> None:
        try:
            for group in self.groups():
                for name in group:
                    if not self.fs.rename(self.path(f"{self.cut}/{name}"), self.path(f"{self.incoming}/{name}")):
                        raise OSError(f"{self.cut}/{name} cannot be moved")
                query.processAllAvailable()
        finally:
            query.stop()
        delete(self.spark, self.cut)
        delete(self.spark, self.incoming)

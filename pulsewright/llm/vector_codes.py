"""Vector codes: product quantisation in whole numbers, with Exponion search for the nearest entry.

A component x becomes floor(256 x); a vector is cut into PARTS consecutive parts, each
with a codebook of its own, which starts as the parts of the ENTRIES smallest ids. In a
round every part goes to its nearest entry and an entry becomes the floor of its parts' mean.

Exponion: a part at distance u from the entry it had before, a, can only be as near to
an entry within 2u of a (triangle inequality; ties lie on that sphere, so it is closed). Each
entry has the others sorted by distance, so the search runs along a's list until it
leaves the sphere; squares are compared (4 u^2), so nothing is rounded. The first
round has no entry before and starts at entry 0. Of equal distances the lower index wins.

A round is one pass over a table of vectors and codes, written for the next one; the
sums of a task's parts leave it as one row an entry, so what is shuffled and what the driver
gets (PARTS x ENTRIES rows) depend on neither rows nor skew.

Rows with a null vector or with null or non-finite components are dropped. Rows that
repeat, or repeat an id, are rows like others (an id's rows are ordered by their vectors);
rows without an id come last among the smallest. Shorter vectors count as padded with
zeros to the longest; parts of a length that PARTS does not divide differ by one
component, and empty parts have code 00. Fewer rows than ENTRIES make fewer entries. An
empty table gives an empty result. Components of LARGEST and more are an error: squares would leave
64 bits. Only vec_id, embedding and label are read, whatever other columns are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsewright.cluster import discard, materialise, ship, sized

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Components (floor(256 x)) below it have exact squares, sums of squares and sums over 2**35 rows.
LARGEST = 1 << 26
#: Rows worked on at once.
ROWS = 2048


def cuts(d: int, parts: int = PARTS) -> np.ndarray:
    """Where the parts of d components begin, and d."""
    return np.arange(parts + 1) * d // parts


class Codebooks:
    """Entries of all parts (parts x entries x widest part, zeros behind narrower ones), and each entry's neighbours by distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        parts, n, width = entries.shape
        gap = entries[:, :, None] - entries[:, None]
        square = np.einsum("pabw,pabw->pab", gap, gap)
        # by distance, then index; an entry's own place is put first, before others that equal it
        own = square - np.eye(n, dtype=np.int64)
        self.near = np.argsort(own, 2, kind="stable")
        self.square = np.take_along_axis(square, self.near, 2)
        self.flat, self.n = entries.reshape(parts * n, width), n

    def nearest(self, x: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, squared distance) of parts x (rows x parts x width), searched from the entries `before`."""
        rows, parts, width = x.shape
        x = x.reshape(rows * parts, width)
        base = np.tile(np.arange(parts) * self.n, rows)
        start = before.reshape(-1).astype(np.int64)
        list_of = base + start
        best, least = start.copy(), self._square(x, list_of)
        reach = 4 * least
        near, square = self.near.reshape(-1, self.n), self.square.reshape(-1, self.n)
        open_ = np.arange(len(x))
        for k in range(1, self.n):
            open_ = open_[square[list_of[open_], k] <= reach[open_]]  # the lists rise: who leaves the sphere is done
            if not len(open_):
                break
            other = near[list_of[open_], k]
            d = self._square(x[open_], base[open_] + other)
            better = (d < least[open_]) | ((d == least[open_]) & (other < best[open_]))
            won = open_[better]
            best[won], least[won] = other[better], d[better]
        return best.reshape(rows, parts), least.reshape(rows, parts)

    def _square(self, x: np.ndarray, entry: np.ndarray) -> np.ndarray:
        gap = x - self.flat[entry]
        return np.einsum("nw,nw->n", gap, gap)

    def moved(self, sums: np.ndarray, counts: np.ndarray) -> Codebooks:
        """Entries at the floor of the mean of their parts; those without parts stay."""
        return Codebooks(np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], self.entries))

    def listed(self, d: int) -> str:
        """All components by part, entry and position, without the zeros behind narrower parts."""
        at = cuts(d, len(self.entries))
        return ",".join(str(v) for p, w in enumerate(np.diff(at)) for e in self.entries[p, :, :w].tolist() for v in e)


def in_parts(vectors: np.ndarray, parts: int = PARTS) -> np.ndarray:
    """rows x d as rows x parts x widest part, narrower ones with zeros behind."""
    at = cuts(vectors.shape[1], parts)
    width = max(1, int(np.diff(at).max()))
    if vectors.shape[1] == parts * width:
        return vectors.reshape(len(vectors), parts, width)
    out = np.zeros((len(vectors), parts, width), np.int64)
    for p in range(parts):
        out[:, p, : at[p + 1] - at[p]] = vectors[:, at[p] : at[p + 1]]
    return out


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Lists of whole numbers as rows of d, with zeros behind shorter ones."""
    size = column.value_lengths().to_numpy().astype(np.int64)
    flat = column.flatten().to_numpy().astype(np.int64)
    if (size == d).all():
        return flat.reshape(len(size), d)
    out = np.zeros((len(size), d), np.int64)
    out[np.arange(d) < size[:, None]] = flat
    return out


def _rows(b: pa.RecordBatch, d: int, books: Codebooks) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for s in range(0, b.num_rows, ROWS):
        part = b.slice(s, ROWS)
        x = in_parts(_matrix(part.column("whole"), d), len(books.entries))
        code = part.column("code")
        before = np.zeros(x.shape[:2], np.uint8) if code.null_count else np.frombuffer(b"".join(code.to_pylist()), np.uint8).reshape(x.shape[:2])
        yield part, x, *books.nearest(x, before)


def _codes(best: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in best.astype(np.uint8)], pa.binary())


def _assign(books: Codebooks, d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, _, best, least in _rows(b, d, books):
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), part.column("whole"), _codes(best), pa.array(least.sum(1))], ["vec_id", "label", "whole", "code", "error"])

    return run


def _sums(parts: int, n: int, d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for s in range(0, b.num_rows, ROWS):
                part = b.slice(s, ROWS)
                x = in_parts(_matrix(part.column("whole"), d), parts)
                code = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(x.shape[:2])
                if total is None:
                    total = np.zeros((parts * n, x.shape[2] + 1), np.int64)
                x = np.concatenate([x, np.ones((*x.shape[:2], 1), np.int64)], 2).reshape(-1, x.shape[2] + 1)
                np.add.at(total, (code.astype(np.int64) + np.arange(parts) * n).reshape(-1), x)
        if total is not None:
            used = np.flatnonzero(total[:, -1])
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used].tolist(), pa.list_(pa.int64()))], ["entry", "sums"])

    return run


_TABLE = "vec_id long, label {label}, whole array<int>, code binary, error long"


class Compressed:
    """codes: vec_id, label, code (binary) and error of every kept row; books: the final codebooks; d: components of a vector."""

    def __init__(self, codes: DataFrame, books: Codebooks | None, d: int):
        self.codes, self.books, self.d = codes, books, d


def whole_rows(vectors: DataFrame) -> DataFrame:
    """vec_id, label and whole (components floor(256 x)) of the rows that are kept, with no code yet."""
    x = F.col("embedding")
    fine = x.isNotNull() & F.forall(x, lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False)))
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * SCALE))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.when(fine, whole).alias("whole")).filter("whole is not null")
    return out


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Compressed:
    """Codes of all rows of `vectors` (vec_id, embedding, label) and the codebooks that they refer to."""
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte a part: 1 to 256 entries")
    spark = vectors.sparkSession
    ship(spark)
    rows = whole_rows(vectors)
    size = rows.agg(F.max(F.size("whole")).alias("d"), F.max(F.array_max(F.transform("whole", lambda v: F.abs(v)))).alias("m")).first()
    d = size.d or 0
    if (size.m or 0) >= LARGEST:
        raise ValueError(f"components of {LARGEST // SCALE} and more in size are not supported")
    rows = rows.withColumn("whole", F.col("whole").cast("array<int>"))
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "whole").limit(entries).select("whole").collect()
    schema = _TABLE.format(label=rows.schema["label"].dataType.simpleString())
    if not first:
        return Compressed(spark.createDataFrame([], schema), None, d)
    start = in_parts(np.array([r.whole + [0] * (d - len(r.whole)) for r in first], np.int64).reshape(len(first), d), parts)
    books = Codebooks(np.ascontiguousarray(start.transpose(1, 0, 2)))
    table = rows.withColumns({"code": F.lit(None).cast("binary"), "error": F.lit(0).cast("long")})
    for k in range(rounds + 1):
        coded = materialise(table.mapInArrow(_assign(books, d), schema), "codes")
        if k:
            discard(table)
        table = coded
        if k == rounds:
            return Compressed(table, books, d)
        books = _next(table, books, d)


def _next(table: DataFrame, books: Codebooks, d: int) -> Codebooks:
    """The codebooks that the parts of a table of codes give: one row an entry leaves each task, and one reaches the driver."""
    parts, n, width = books.entries.shape
    each = table.mapInArrow(_sums(parts, n, d), "entry long, sums array<long>")
    found = each.groupBy("entry").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width + 1)]).collect()
    total = np.zeros((parts * n, width + 1), np.int64)
    for r in found:
        total[r[0]] = r[1:]
    total = total.reshape(parts, n, width + 1)
    return books.moved(total[:, :, :width], total[:, :, width])


def decode(spark: SparkSession, done: Compressed) -> DataFrame:
    """vec_id, label and whole (the components that the code stands for) of every row."""
    ship(spark)
    books, at = done.books, cuts(done.d, PARTS if done.books is None else len(done.books.entries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(b.num_rows, len(at) - 1)
            out = np.concatenate([books.entries[p][code[:, p]][:, : at[p + 1] - at[p]] for p in range(len(at) - 1)], 1)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(out.tolist(), pa.list_(pa.int64()))], ["vec_id", "label", "whole"])

    label = done.codes.schema["label"].dataType.simpleString()
    return done.codes.select("vec_id", "label", "code").mapInArrow(run, f"vec_id long, label {label}, whole array<long>")


def digest(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept row of `vectors`."""
    done = compress(vectors)
    sha = hashlib.sha256((done.books.listed(done.d) if done.books else "").encode()).hexdigest()
    by_label = sized(materialise(done.codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label"), "codes-labels"))
    out = done.codes.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


ORACLE_SQL_TEMPLATE = r"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, embedding AS e FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
f AS (SELECT r, vec_id, label, list_transform(e, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM kept),
x AS (SELECT r, part, e[4 * part + 1] AS a, e[4 * part + 2] AS b, e[4 * part + 3] AS c, e[4 * part + 4] AS d FROM f CROSS JOIN (SELECT unnest(range(16)) AS part)),
c0 AS (SELECT part, r - 1 AS entry, a, b, c, d FROM x WHERE r <= 64),
{rounds}
fin AS ({nearest_last}),
s AS (SELECT string_agg(a || ',' || b || ',' || c || ',' || d, ',' ORDER BY part, entry) AS listed FROM c2),
v AS (SELECT r, string_agg(printf('%02x', k % 64), '' ORDER BY part) AS code, sum(k // 64)::BIGINT AS error FROM fin GROUP BY r),
j AS (SELECT f.vec_id, f.label, v.code, v.error FROM f JOIN v USING (r))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, sha256((SELECT listed FROM s)) AS codebooks_sha256 FROM j
"""
# the nearest entry of each part, as 64 times the squared distance plus the entry: the least of these has the lower index of equals
_NEAREST = "SELECT x.r, x.part, min(64 * ((x.a - y.a) ** 2 + (x.b - y.b) ** 2 + (x.c - y.c) ** 2 + (x.d - y.d) ** 2)::BIGINT + y.entry)::BIGINT AS k FROM x JOIN c{k} y USING (part) GROUP BY ALL"
_FLOOR = "((sum(x.{c}) - ((sum(x.{c}) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS {c}"
_MOVED = "SELECT o.part, o.entry, coalesce(m.a, o.a) AS a, coalesce(m.b, o.b) AS b, coalesce(m.c, o.c) AS c, coalesce(m.d, o.d) AS d FROM c{k} o LEFT JOIN (SELECT n.part, n.k % 64 AS entry, {floors} FROM n{k} n JOIN x USING (r, part) GROUP BY ALL) m USING (part, entry)"


def _oracle() -> str:
    floors = ", ".join(_FLOOR.format(c=c) for c in "abcd")
    rounds = "".join(f"n{k} AS ({_NEAREST.format(k=k)}),\nc{k + 1} AS ({_MOVED.format(k=k, floors=floors)}),\n" for k in range(2))
    return ORACLE_SQL_TEMPLATE.format(rounds=rounds, nearest_last=_NEAREST.format(k=2))


ORACLE_SQL = _oracle()

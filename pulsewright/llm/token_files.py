"""Token output: Arrow files of equal-length sequences and masks that are read without copying.

The documents are sorted over the cluster by a key; each sorted partition becomes
one shard. A shard is an Arrow IPC file whose batches hold `tokens`, fixed-size
lists of ids, and `mask`, fixed-size lists of booleans (false behind the last
token), so sequence k of a memory-mapped shard is a slice; and a side file of
its documents (doc_id, start within the shard, n_tokens). Tokens of one document
after the other, each closed by the end id, fill the sequences without gaps.

Encoding: a byte-level tokenizer starts a new piece at every single space
between two other characters (and at other places that surely are boundaries),
so texts are cut there, each distinct piece is
encoded once (and kept), and the ids are put together by gathering. The ids are
those of whole texts, added tokens that a text spells out included: each is a piece of
its own, and what stands beside it begins or ends there.

A task writes files under names of its own attempt and returns them; the shards
of the tasks that succeeded make the manifest. So lost and repeated tasks leave
stray files, never wrong ones. Null and empty texts are the end id alone; rows
that repeat an id follow each other in the order of a hash of their texts; rows without
an id come first. An empty table gives no shard and an empty result. Only doc_id and
text are read, whatever other columns are called. A long text is one chunk of its own.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsewright.cluster import new_path, ship
from pulsewright.llm import textkit as K

LENGTH = 2048
BATCH = 512
END = 0
#: Pieces that a Python worker keeps: some 20 bytes each.
CACHE_PIECES = 1_000_000
#: Pieces encoded at once: the tokenizer's results are large.
ENCODE = 2048

_held: dict = {}


class Pieces:
    """Ids of the pieces seen so far, found by their hash: sorted keys, and where each one's ids stand in a pool."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError("added tokens that depend on what stands beside them are not supported")
        names = sorted((t.content.encode() for t in added), key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, names))) if names else None
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.clear()

    def clear(self) -> None:
        self.keys, self.starts, self.lengths, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, self.kind)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the known keys, whether it is known) of each key."""
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        return at, known

    def look_up(self, keys: np.ndarray, text_of) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths in the pool of sorted, distinct keys; text_of(i) gives the texts of those not known."""
        at, known = self.find(keys)
        if not known.all():
            if len(self.keys) + len(keys) > CACHE_PIECES:
                self.clear()
                at, known = self.find(keys)
            new = np.flatnonzero(~known)
            texts = text_of(new)
            encoded = [np.array(e.ids, self.kind) for s in range(0, len(texts), ENCODE) for e in self.tokenizer.encode_batch_fast(texts[s : s + ENCODE], add_special_tokens=False)]
            lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
            starts = len(self.pool) + np.cumsum(lengths) - lengths
            self.pool = np.concatenate([self.pool, *encoded])
            self.keys, self.starts, self.lengths = np.insert(self.keys, at[new], keys[new]), np.insert(self.starts, at[new], starts), np.insert(self.lengths, at[new], lengths)
            at, _ = self.find(keys)
        return self.starts[at].astype(np.int64), self.lengths[at].astype(np.int64)


def pieces_of(path: str) -> Pieces:
    """The tokenizer of a file and its pieces, once per Python worker."""
    if path not in _held:
        _held[path] = Pieces(path)
    return _held[path]


def id_type(path: str) -> type:
    return pieces_of(path).kind


_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK[33:127] = True
_MARK[48:58] = _MARK[65:91] = _MARK[97:123] = False
_MARK[ord("'")] = False


def with_added(data: np.ndarray, offsets: np.ndarray, added: re.Pattern | None) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of rows and of the added tokens that stand in them, from and to; starts of the latter)."""
    if added is None or not (found := [m.span() for m in added.finditer(data.tobytes())]):
        return offsets, np.zeros(0, np.int64)
    at = np.array(found, np.int64)
    row = np.searchsorted(offsets, at[:, 0], "right") - 1
    at = at[at[:, 1] <= offsets[row + 1]]  # not over a row's end
    return np.union1d(offsets, at.reshape(-1)), at[:, 0]


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces start.

    Pieces start with what `offsets` delimits; at a single space or line feed between characters
    that are surely not white space, and behind such a line feed; and at an
    ASCII mark behind a Latin letter. A byte-level tokenizer has a boundary at each.
    """
    n = len(data)
    safe = np.zeros(n + 1, bool)
    at = np.flatnonzero((data == 0x20) | (data == 0x0A))
    at = at[(at > 0) & (at < n - 1)]
    p1, p2, p3, q = data[at - 1], data[at - 2], data[at - 3], data[at + 1]
    before = (p1 > 0x20) & (p1 < 0x7F) | (p1 >= 0x80) & ((p2 >= 0xC3) & (p2 <= 0xDF) | (p2 >= 0x80) & (p2 < 0xC0) & (p3 >= 0xE4))
    after = (q > 0x20) & (q < 0x7F) | (q >= 0xC3) & ((q < 0xE1) | (q > 0xE3))
    at = at[before & after]
    safe[at] = True
    safe[at[data[at] == 0x0A] + 1] = True
    mark = np.flatnonzero(_MARK[data])
    mark = mark[mark > 1]
    p1, p2 = data[mark - 1], data[mark - 2]
    safe[mark[_LETTER[p1] | (p2 == 0xC3) & (p1 >= 0x80) & (p1 != 0x97) & (p1 != 0xB7)]] = True
    ends = offsets[1:-1]
    last = ends[ends > 0] - 1  # white space at a row's end is not between two characters of it
    safe[last[(data[last] == 0x20) | (data[last] == 0x0A)]] = False
    safe[offsets[:-1]] = True
    safe[n] = False
    return np.flatnonzero(safe)


def encode(data: np.ndarray, offsets: np.ndarray, path: str, end: int = END) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows, each closed by the end id, and the rows' offsets into them."""
    held = pieces_of(path)
    if not len(data):
        return np.full(len(offsets) - 1, end, held.kind), np.arange(len(offsets))
    parts, added = with_added(data, offsets, held.added)
    starts = piece_starts(data, parts)
    if len(added):  # an added token is one piece
        first, after = np.searchsorted(starts, added), np.searchsorted(starts, parts[np.searchsorted(parts, added) + 1])
        inside = np.zeros(len(starts) + 1, np.int64)
        np.add.at(inside, first + 1, 1)
        np.add.at(inside, after, -1)
        starts = starts[np.cumsum(inside)[:-1] == 0]
    cut = np.searchsorted(starts, offsets, "left")
    ends = np.append(starts[1:], len(data))
    h = K.span_hash(K.prefix_hash(K.BYTE_VALUE[data]), starts, ends)
    keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)

    def texts(which: np.ndarray) -> list[str]:
        raw, own = data.tobytes(), first[which]
        return [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[own].tolist(), ends[own].tolist(), strict=True)]

    begin, length = held.look_up(keys, texts)
    # each row's end id is one more piece, behind the pool
    begin, length = np.append(begin, len(held.pool)), np.append(length, 1)
    pieces = np.insert(inverse, cut[1:], len(keys))
    n_of = length[pieces]
    stop = np.cumsum(n_of)
    out = np.append(held.pool, held.kind(end))[np.arange(stop[-1]) + np.repeat(begin[pieces] - (stop - n_of), n_of)]
    return out, np.concatenate([[0], stop[cut[1:] + np.arange(len(cut) - 1)]])


class Shard:
    """Writes one shard; tokens are buffered up to a batch of sequences."""

    def __init__(self, base: str, kind: type, length: int):
        self.fs, self.at = pafs.FileSystem.from_uri(base)
        self.length = length
        self.schema = pa.schema([("tokens", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.side = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.fs.create_dir(self.at.rpartition("/")[0], recursive=True)
        self.files = [self.fs.open_output_stream(self.at + x) for x in (".arrow", ".docs.arrow")]
        self.out, self.docs = (pa.ipc.new_file(f, s) for f, s in zip(self.files, (self.schema, self.side), strict=True))
        self.buffer, self.n, self.total, self.n_docs = [], 0, 0, 0

    def add(self, ids: np.ndarray, rows: np.ndarray, doc_ids: pa.Array) -> None:
        self.docs.write_batch(pa.RecordBatch.from_arrays([doc_ids, pa.array(self.total + rows[:-1]), pa.array(np.diff(rows))], schema=self.side))
        self.n_docs += len(doc_ids)
        self.total += len(ids)
        self.buffer.append(ids)
        self.n += len(ids)
        if self.n >= self.length * BATCH:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        x = np.concatenate(self.buffer) if self.buffer else np.zeros(0, np.uint16)
        whole = len(x) if last else len(x) // self.length * self.length
        for s in range(0, whole, self.length * BATCH):
            part = x[s : min(s + self.length * BATCH, whole)]
            pad = -len(part) % self.length
            mask = np.arange(len(part) + pad) < len(part)
            values = pa.array(np.concatenate([part, np.zeros(pad, part.dtype)]) if pad else part)
            self.out.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(values, self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema))
        self.buffer = [x[whole:]]
        self.n = len(x) - whole

    def close(self) -> None:
        self._flush(True)
        for x in (self.out, self.docs, *self.files):
            x.close()


def _write(folder: str, path: str, length: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"{folder}/shard-{context.partitionId():06d}-{context.taskAttemptId()}"
        shard = None
        for b in batches:
            if not b.num_rows:
                continue
            shard = shard or Shard(name, id_type(path), length)
            for i, j, data, offsets in K.chunks(b.column("text"), 4 * K.CHUNK_BYTES):
                ids, rows = encode(data, offsets, path, end)
                shard.add(ids, rows, b.column("doc_id").slice(i, j - i))
        if shard:
            shard.close()
            yield pa.RecordBatch.from_arrays([pa.array([context.partitionId()]), pa.array([name]), pa.array([shard.n_docs]), pa.array([shard.total])], ["shard", "path", "n_docs", "n_tokens"])

    return run


def write_tokens(docs: DataFrame, path: str, folder: str | None = None, order: list[Column] | None = None, length: int = LENGTH, end: int = END) -> list[dict]:
    """Write shards of `docs` (doc_id, text) in ascending order and return their manifest, in order.

    path: the tokenizer's file, at the same place on every machine. The manifest
    (one small entry per shard, like a listing of the files) has path, n_docs,
    n_tokens and start, the number of tokens in all shards before.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = folder or new_path(spark, "tokens")
    keys = [F.col(f"_k{i}") for i in range(len(order or [0, 1]))]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), *[k.alias(f"_k{i}") for i, k in enumerate(order or [F.col("doc_id").cast("long"), F.xxhash64("text")])])
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    shards = sorted((r.asDict() for r in placed.mapInArrow(_write(folder, path, length, end), "shard long, path string, n_docs long, n_tokens long").collect()), key=lambda x: x["shard"])
    start = 0
    for s in shards:
        s["start"] = start
        start += s["n_tokens"]
    return shards


def open_shard(base: str) -> tuple[pa.ipc.RecordBatchFileReader, pa.Table]:
    """A shard's sequences, memory-mapped where the file system is local, and its table of documents."""
    fs, at = pafs.FileSystem.from_uri(base)
    local = isinstance(fs, pafs.LocalFileSystem)
    seq = pa.memory_map(at + ".arrow") if local else fs.open_input_file(at + ".arrow")
    return pa.ipc.open_file(seq), pa.ipc.open_file(fs.open_input_file(at + ".docs.arrow")).read_all()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for base, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
            reader, docs = open_shard(base)
            n = docs.column("n_tokens").to_numpy()
            ends = np.cumsum(n)
            crc, done, d, left = [], 0, 0, 0
            for k in range(reader.num_record_batches):
                batch = reader.get_batch(k)
                ids = batch.column("tokens").flatten().to_numpy()
                ids = ids[batch.column("mask").flatten().to_numpy(zero_copy_only=False)].astype("<u4")
                at = 0
                while d < len(n) and at < len(ids):
                    take = min(len(ids), int(ends[d]) - done)
                    left = zlib.crc32(ids[at:take].data, left)
                    at = take
                    if take == int(ends[d]) - done:
                        crc.append(left)
                        d, left = d + 1, 0
                done += len(ids)
            for s in range(0, len(n), 10_000):
                part = docs.slice(s, 10_000)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").combine_chunks(), pa.array(part.column("start").to_numpy() + start), part.column("n_tokens").combine_chunks(), pa.array(crc[s : s + 10_000], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(spark, shards: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from the shards."""
    ship(spark)
    table = spark.createDataFrame([(s["path"], s["start"]) for s in shards], "path string, start long")
    return table.repartition(max(1, len(shards))).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def digest(docs: DataFrame, path: str, order: list[Column] | None = None) -> DataFrame:
    return read_tokens(docs.sparkSession, write_tokens(docs, path, order=order))

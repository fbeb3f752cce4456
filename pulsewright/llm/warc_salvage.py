"""WARC archives: written a file or more a task, and read back by a reader that salvages what damage leaves.

Written: WARC/1.1, each record a gzip member of its own, with digests of block and
payload. Of pages with equal payloads of at least LEAST bytes, the one with the largest id
is a response; the others are revisits of it (HTTP header without payload). Equal means
equal SHA-1, 64-bit hash and length. Only the keys of repeated payloads are joined to the pages.

Read: at each place the next record must pass its checks: the member inflates to its
end and its CRC holds (or, outside gzip, a version line is there); header lines, lengths and
the blank lines behind the block are right; digests agree. After a failed check the
reader searches on, from the next byte, for a member's magic or a version line that begins a
record which passes all checks, and goes on from there. The bytes between are a gap,
logged with the first reason. So damage costs the records that it touches and no others.

Files are closed at FILE_BYTES, so a reading task has a bounded file; it streams it and
holds one record (one gzip member) at a time. Tasks write names of their own attempt, and the
manifest lists the files of those that succeeded: lost tasks leave stray files, not wrong ones.

Null html is empty; a null or unusable url becomes the record's id; a null page_id is kept
(in a group of copies it is a revisit, or a response where no copy has an id). Rows that
repeat the largest id of a group are all responses. An empty table gives no file and an empty
result. Only page_id, url and html are read, whatever other columns are called.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsewright.cluster import materialise, new_path, ship, sized

LEAST = 1000
FILE_BYTES = 128 << 20
#: Bytes read or fed to the inflater at once.
STEP = 1 << 18
#: A header block longer than this is no header.
HEADER_BYTES = 1 << 20
#: Pages bear no date, and a repeated task must write the same bytes.
DATE = "1970-01-01T00:00:00Z"
LEVEL = 4

# The names that the format defines.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_NAME = re.compile(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+")
_START = re.compile(re.escape(MAGIC) + b"|" + VERSION)
_BITS = {"md5": 16, "sha1": 20, "sha256": 32, "sha512": 64}


# --- writing -------------------------------------------------------------------------


def record_id(page_id: int | None) -> str:
    return f"<urn:pulsewright:page:{'none' if page_id is None else page_id}>"


def _digest(block: bytes) -> str:
    return _labelled(hashlib.sha1(block).digest())


def _labelled(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def record(kind: str, rid: str, uri: str | None, block: bytes, content: str, date: str = DATE, **more: str) -> bytes:
    """One record with its header, uncompressed."""
    lines = {"WARC-Type": kind, "WARC-Record-ID": rid, "WARC-Date": date} | ({"WARC-Target-URI": uri} if uri else {}) | more
    lines |= {"WARC-Block-Digest": _digest(block), "Content-Type": content, "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, sha1: bytes, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    rid = record_id(page_id)
    uri = quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else rid[1:-1]
    more = {"WARC-Payload-Digest": _labelled(sha1)}
    if revisit:
        more |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to)}
    return record("revisit" if revisit else "response", rid, uri, head if revisit else head + payload, "application/http;msgtype=response", date, **more)


def member(data: bytes) -> bytes:
    """A gzip member without a time, so that equal records are equal bytes."""
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _write(folder: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, at = pafs.FileSystem.from_uri(folder)
        fs.create_dir(at, recursive=True)
        n_files, out, name, n, size = 0, None, "", 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n]), pa.array([size])], ["path", "n_records", "bytes"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "sha1", "refers_to", "revisit")), strict=True):
                if out is None:
                    file = f"pages-{context.partitionId():06d}-{context.taskAttemptId()}-{n_files:04d}.warc.gz"
                    name, n, n_files = f"{folder}/{file}", 0, n_files + 1
                    out = fs.open_output_stream(f"{at}/{file}", compression=None)
                    info = member(record("warcinfo", f"<urn:pulsewright:file:{file}>", None, b"format: WARC File Format 1.1\r\n", "application/warc-fields"))
                    out.write(info)
                    size = len(info)
                data = member(page_record(*row))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= limit:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return run


def with_revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, sha1 (binary), revisit and refers_to of every row of `pages` (page_id, url, html)."""
    keys = ["_sha1", "_hash", "_size"]
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"_sha1": F.unhex(F.sha1("payload")), "_hash": F.xxhash64("payload"), "_size": F.octet_length("payload")})
    copies = rows.filter(F.col("_size") >= least).groupBy(*keys).agg(F.max("page_id").alias("_largest"), F.count(F.lit(1)).alias("_n")).filter("_n > 1 and _largest is not null")
    copies = sized(materialise(copies.drop("_n"), "warc-copies"))
    revisit = F.col("_largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_largest"))
    return rows.join(copies, keys, "left").select("page_id", "url", "payload", F.col("_sha1").alias("sha1"), F.when(revisit, F.col("_largest")).alias("refers_to"), revisit.alias("revisit"))


def write_pages(pages: DataFrame, folder: str | None = None, least: int = LEAST, file_bytes: int = FILE_BYTES) -> list[dict]:
    """Write archives of `pages`; returns their manifest, one small entry (path, n_records, bytes) a file."""
    spark = pages.sparkSession
    ship(spark)
    rows = with_revisits(pages, least)
    found = rows.mapInArrow(_write(folder or new_path(spark, "warc"), file_bytes), "path string, n_records long, bytes long").collect()
    return sorted((r.asDict() for r in found), key=lambda x: x["path"])


# --- reading -------------------------------------------------------------------------


class Damaged(Exception):
    """A check failed."""


@dataclass
class Record:
    kind: str
    record_id: str
    uri: str | None
    refers_to: str | None
    digest: str | None  # of the full payload, bare lower-case hex
    n_bytes: int | None  # of the full payload
    payload: bytes


Get = Callable[[int, int], bytes]


def _bare(labelled: str) -> tuple[str, str] | None:
    """(algorithm, lower-case hex) of a digest header; None if it is of an unknown kind."""
    name, _, value = labelled.partition(":")
    name = name.strip().lower().replace("-", "")
    bits, value = _BITS.get(name), value.strip()
    if bits is None:
        return None
    try:
        raw = bytes.fromhex(value) if len(value) == 2 * bits else base64.b32decode(value.upper() + "=" * (-len(value) % 8))
    except (ValueError, binascii.Error):
        raise Damaged("unreadable digest") from None
    return name, raw.hex()


def _agrees(labelled: str | None, data: bytes, what: str) -> None:
    known = _bare(labelled) if labelled else None
    if known and hashlib.new(known[0], data).hexdigest() != known[1]:
        raise Damaged(f"{what} digest differs")


def _fields(lines: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    last = ""
    for line in lines.split(b"\r\n"):
        if line[:1] in (b" ", b"\t") and last:  # folded
            out[last] += " " + line.decode("utf-8", "replace").strip()
            continue
        name, colon, value = line.partition(b":")
        if not colon or not _NAME.fullmatch(name):
            raise Damaged("bad header line")
        last = name.decode("utf-8", "replace").strip().lower()
        out[last] = value.decode("utf-8", "replace").strip()
    return out


def parse(get: Get, p: int, size: int) -> tuple[Record, int]:
    """The record that begins at p, and where it ends; get(place, n) gives bytes. Raises Damaged if a check fails."""
    head, step = get(p, 4096), 4096
    if not _VERSION_LINE.match(head):
        raise Damaged("no version line")
    while (end := head.find(b"\r\n\r\n")) < 0:
        if p + len(head) >= size or len(head) >= HEADER_BYTES:
            raise Damaged("no end of the header")
        step *= 4
        head = get(p, step)
    fields = _fields(head[head.index(b"\r\n") + 2 : end])
    length = fields.get("content-length", "")
    if not (fields.get("warc-type") and fields.get("warc-record-id") and fields.get("warc-date") and length.isascii() and length.isdigit()):
        raise Damaged("a needed header field is missing")
    begin, n = p + end + 4, int(length)
    if begin + n + 4 > size:
        raise Damaged("longer than what is left")
    body = get(begin, n + 4)
    if body[n:] != b"\r\n\r\n":
        raise Damaged("no blank lines behind the block")
    block = body[:n]
    _agrees(fields.get("warc-block-digest"), block, "block")
    kind, http = fields["warc-type"], fields.get("content-type", "").startswith("application/http")
    head_end = block.find(b"\r\n\r\n") if http else -4
    if http and head_end < 0:
        raise Damaged("no end of the HTTP header")
    payload = block[head_end + 4 :]
    labelled = fields.get("warc-payload-digest")
    if kind == "revisit":
        stated = re.search(rb"(?im)^content-length:[ \t]*(\d+)", block[: max(0, head_end)])
        known = _bare(labelled) if labelled else None
        digest, n_bytes = known[1] if known else None, int(stated[1]) if stated else None
    else:
        _agrees(labelled, payload, "payload")
        digest, n_bytes = hashlib.sha1(payload).hexdigest(), len(payload)
    return Record(kind, fields["warc-record-id"], fields.get("warc-target-uri"), fields.get("warc-refers-to"), digest, n_bytes, payload), begin + n + 4


def inflate(get: Get, p: int, size: int) -> tuple[bytes, int]:
    """The content of the gzip member at p and where it ends; its CRC and length hold, and it begins with a version line."""
    z, parts, n, at = zlib.decompressobj(31), [], 0, p
    while not z.eof:
        data = get(at, STEP)
        if not data:
            raise Damaged("member without an end")
        at += len(data)
        try:
            parts.append(z.decompress(data))
        except zlib.error:
            raise Damaged("member does not inflate") from None
        n += len(parts[-1])
        if n >= len(VERSION) and not (parts := [b"".join(parts)] if len(parts[0]) < len(VERSION) else parts)[0].startswith(VERSION):
            raise Damaged("member without a version line")
    return b"".join(parts), at - len(z.unused_data)


Found = tuple[int, int, Record | str]


def salvage(get: Get, size: int, plain: bool = False) -> Iterator[Found]:
    """(start, end, record or reason) of all records and gaps, in order; together they are all of the file.

    plain: look for version lines only (inside of a member).
    """
    p = 0
    broken: tuple[int, str] | None = None
    while p < size:
        try:
            start = get(p, len(MAGIC))
            if start == MAGIC and not plain:
                body, end = inflate(get, p, size)
                inner = list(salvage(lambda at, n, body=body: body[at : at + n], len(body), True))
                whole = [r for _, _, r in inner if isinstance(r, Record)]
                lost = next((r for _, _, r in inner if isinstance(r, str)), None)
                if not whole:
                    raise Damaged(lost or "empty member")
                found = [(p, end, r) for r in whole] + ([(p, end, f"in the member: {lost}")] if lost else [])
            else:
                one, end = parse(get, p, size)
                found = [(p, end, one)]
        except Damaged as e:
            broken = broken or (p, str(e))
            p = _next_start(get, p + 1, size, plain)
            continue
        if broken:
            yield broken[0], p, broken[1]
            broken = None
        yield from found
        p = end
    if broken:
        yield broken[0], size, broken[1]


def _next_start(get: Get, p: int, size: int, plain: bool) -> int:
    """The next place from p on that looks like a member's or a record's start; the file's end if there is none."""
    wanted = re.compile(re.escape(VERSION)) if plain else _START
    keep = max(len(MAGIC), len(VERSION)) - 1
    while p < size:
        data = get(p, STEP)
        if not data:
            break
        if hit := wanted.search(data):
            return p + hit.start()
        p += max(1, len(data) - keep) if p + len(data) < size else len(data)
    return size


class Buffered:
    """Bytes at any place of a file, read ahead by STEP: records follow each other."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.at, self.held = file, 0, b""

    def __call__(self, p: int, n: int) -> bytes:
        if p < self.at or p + n > self.at + len(self.held):
            self.at, self.held = p, self.file.read_at(max(n, 2 * STEP), p)
        return self.held[p - self.at : p - self.at + n]


COLUMNS = "path string, start long, end long, type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, gap string"
_NAMES = [c.split()[0] for c in COLUMNS.split(", ")]
_KINDS = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary(), pa.string()]


def _read(payload: bool, batch_bytes: int = 1 << 23, batch_rows: int = 1000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)

        for b in batches:
            for path in b.column("path").to_pylist():
                fs, at = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(at) as f:
                    for start, end, r in salvage(Buffered(f), f.size()):
                        if isinstance(r, str):
                            rows.append((path, start, end, *[None] * 7, r))
                        else:
                            rows.append((path, start, end, r.kind, r.record_id, r.uri, r.refers_to, r.digest, r.n_bytes, r.payload if payload and r.kind != "revisit" else None, None))
                            held += len(r.payload) if payload else 0
                        if held >= batch_bytes or len(rows) >= batch_rows:
                            yield out()
                            rows, held = [], 0
        if rows:
            yield out()

    return run


def read_archives(spark: SparkSession, paths: list[str], payload: bool = True) -> DataFrame:
    """COLUMNS of every record and every quarantined gap of the files; rows with `gap` (the reason) are gaps."""
    ship(spark)
    table = spark.createDataFrame([(p,) for p in paths], "path string")
    return table.repartition(max(1, len(paths))).mapInArrow(_read(payload), COLUMNS)


def archives_in(folder: str) -> list[str]:
    """The archive files of a folder, as read_archives takes them."""
    fs, at = pafs.FileSystem.from_uri(folder)
    names = [f.path for f in fs.get_file_info(pafs.FileSelector(at, recursive=True)) if f.is_file and re.search(r"\.warc(\.gz)?$", f.path)]
    scheme = folder.split(":", 1)[0] if "://" in folder else ""
    root = folder[: len(folder) - len(at)] if folder.endswith(at) else f"{scheme}://"
    return sorted(root + n for n in names)


def records(found: DataFrame) -> DataFrame:
    return found.filter("gap is null").drop("gap")


def gaps(found: DataFrame) -> DataFrame:
    """path, start, end and gap (the reason) of the bytes that no record could be made of."""
    return found.filter("gap is not null").select("path", "start", "end", "gap")


def digest(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, read back from its archives."""
    files = write_pages(pages)
    found = records(read_archives(pages.sparkSession, [f["path"] for f in files], payload=False)).filter(F.col("type").isin("response", "revisit"))
    number = lambda c: F.nullif(F.regexp_extract(c, r"page:(-?\d+)>", 1), F.lit("")).cast("long")
    return found.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.when(F.col("type") == "revisit", number("refers_to")).alias("refers_to"))


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS largest FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN n >= 1000 AND largest IS NOT NULL AND page_id IS DISTINCT FROM largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM largest THEN largest END AS refers_to
FROM g
"""

"""Archives: round trips, revisits, and what the salvage reader makes of damage."""

from __future__ import annotations

import gzip
import hashlib
import random

import pytest

from pulsewright.llm import warc_salvage as S

SCHEMA = "page_id long, url string, html string, type string, payload string, sha1 string"


def read(data: bytes):
    found = list(S.salvage(lambda p, n: data[p : p + n], len(data)))
    assert found[0][0] == 0 and found[-1][1] == len(data)  # nothing is left out
    for (begin, end, _), (start, after, _) in zip(found, found[1:], strict=False):
        assert start == end or (start, after) == (begin, end)  # records of one member have its bytes
    return [r for *_, r in found if isinstance(r, S.Record)], [(a, b, r) for a, b, r in found if isinstance(r, str)]


def one(k: int, payload: bytes | None = None) -> bytes:
    payload = payload if payload is not None else (f"<p>page {k}</p>" * (k + 3)).encode()
    return S.page_record(k, f"http://x/{k}", payload, hashlib.sha1(payload).digest(), None, False)


def ids(records):
    return [int(r.record_id.split(":")[-1][:-1]) for r in records]


@pytest.mark.parametrize("packed", [True, False])
def test_damage_costs_only_the_records_that_it_touches(packed):
    wrap = S.member if packed else bytes
    units = [wrap(one(k)) for k in range(8)]
    at = [sum(map(len, units[:k])) for k in range(9)]
    whole = b"".join(units)
    assert read(whole)[1] == [] and ids(read(whole)[0]) == list(range(8))
    rng = random.Random(1)
    for k in range(8):
        for _ in range(12):
            spot = rng.randrange(at[k], at[k + 1])
            broken = bytearray(whole)
            broken[spot] ^= 1 << rng.randrange(8)
            data = bytes(broken)
            found = list(S.salvage(lambda p, n, data=data: data[p : p + n], len(data)))
            assert [(x, y) for x, y, _ in found] == list(zip(at, at[1:], strict=False))  # a header's field that is changed but fits in passes: no digest covers it
            assert all(isinstance(r, S.Record) for x, _, r in found if x != at[k])
            if spot >= at[k + 1] - 40 and not packed or packed:  # in a block, or in a member's data
                assert isinstance(found[k][2], str) or packed and spot < at[k] + 10
    for k in (0, 3, 7):  # bytes lost from the middle of a record, put in, or cut off at the end
        records, gaps = read(whole[: at[k] + 20] + whole[at[k] + 45 :])
        assert ids(records) == [r for r in range(8) if r != k] and len(gaps) == 1
        records, gaps = read(whole[: at[k]] + b"junk \x1f\x8b\x08 WARC/1.1\r\n more" + whole[at[k] :])
        assert ids(records) == list(range(8)) and [(a, b - a) for a, b, _ in gaps] == [(at[k], 24)]
        records, gaps = read(whole[: at[k + 1] - 3])
        assert ids(records) == list(range(k)) and [(a, b) for a, b, _ in gaps] == [(at[k], at[k + 1] - 3)]


def test_digests_lengths_and_header_lines_are_checked():
    good = one(1)
    for wrong in (good.replace(b"<p>page 1", b"<p>page 2"), good.replace(b"WARC-Type: ", b"WARC-Kind: "), good.replace(b"WARC-Date: ", b"WARC-Date "), good.replace(b"Content-Length: ", b"Content-Length: 9", 1)):
        assert wrong != good
        for data in (wrong, S.member(wrong)):
            records, gaps = read(data + S.member(one(2)))
            assert ids(records) == [2] and len(gaps) == 1 and gaps[0][:2] == (0, len(data))


def test_members_with_several_records_and_foreign_digests():
    hexed = one(3).replace(S._digest(one(3).split(b"\r\n\r\n", 1)[1][:-4]).encode(), b"sha1:" + hashlib.sha1(one(3).split(b"\r\n\r\n", 1)[1][:-4]).hexdigest().encode())
    odd = one(4).replace(b"WARC-Block-Digest: sha1:", b"WARC-Block-Digest: crc9:")
    broken = one(5).replace(b"page 5", b"page 6")
    records, gaps = read(gzip.compress(hexed + odd + broken + one(6), mtime=0))
    assert ids(records) == [3, 4, 6] and len(gaps) == 1 and "digest" in gaps[0][2]


def test_a_long_record_and_one_that_quotes_an_archive():
    long = random.Random(2).randbytes(3 * S.STEP)
    inner = S.member(one(77)) + one(78)
    for wrap in (bytes, S.member):
        data = wrap(one(1, long)) + wrap(one(2, inner)) + wrap(one(3))
        records, gaps = read(data)
        assert ids(records) == [1, 2, 3] and not gaps and records[0].payload == long and records[1].payload == inner
        records, gaps = read(data[: S.STEP] + b"\x00" + data[S.STEP + 1 :])
        assert ids(records) == [2, 3] and len(gaps) == 1


def rows():
    rng = random.Random(4)
    copy, short = "same é " * 200, "short"
    out = [(k, f"http://h/{k}", "".join(rng.choice("ab é<") for _ in range(rng.randint(0, 3000)))) for k in range(30)]
    out += [(100 + k, "http://copy", copy) for k in range(40)] + [(200 + k, None, short) for k in range(5)]
    out += [(300, None, None), (301, "", ""), (302, "http://bad\r\nX: y ü", "z"), (None, "u", "no id" * 300), (None, "u", copy), (139, "http://copy", copy), (7, "http://h/7", out[7][2]), (400, "u", "x" * 999), (401, "u", "x" * 999), (402, "u", "y" * 1000), (403, "u", "y" * 1000)]
    out += [(None, "u", "w" * 2000), (None, "u", "w" * 2000), (404, "u", "\x1f\x8b\x08 WARC/1.1\r\n" * 80)]
    return [(*r, "t", "p", "s") for r in out]


def expected(rows):
    out = []
    for i, _, html, *_ in rows:
        data = (html or "").encode()
        group = [r[0] for r in rows if (r[2] or "") == (html or "") and r[0] is not None]
        revisit = len(data) >= 1000 and group and i != max(group)
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", max(group) if revisit else None))
    return sorted(out, key=repr)


def test_digest(spark):
    got = S.digest(spark.createDataFrame(rows(), SCHEMA).repartition(3))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows())
    assert S.digest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_archives_roll_over_and_are_salvaged_by_spark(spark, tmp_path):
    folder = f"file://{tmp_path}/warc"
    files = S.write_pages(spark.createDataFrame(rows(), SCHEMA).repartition(2), folder, file_bytes=4000)
    paths = [f["path"] for f in files]
    assert len(paths) > 4 and sum(f["n_records"] for f in files) == len(rows()) and S.archives_in(folder) == sorted(paths)
    found = S.read_archives(spark, paths).cache()
    assert S.gaps(found).count() == 0
    back = {r.payload.decode() for r in S.records(found).filter("type = 'response'").collect()}
    assert back == {r[2] or "" for r in rows()}
    uri = S.records(found).filter("record_id like '%:302>'").first().target_uri
    assert uri == "http://bad%0D%0AX:%20y%20%C3%BC"
    hurt = paths[2].removeprefix("file://")
    data = open(hurt, "rb").read()
    open(hurt, "wb").write(data[:-30] + b"\x00" * 30)
    again = S.read_archives(spark, paths)
    lost = S.gaps(again).collect()
    assert len(lost) == 1 and lost[0].path == paths[2] and lost[0].end == len(data)
    assert S.records(again).count() == S.records(found).count() - 1

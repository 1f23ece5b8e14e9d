"""WARC archives: round trips, ranges and damage."""

import base64
import gzip
import hashlib
import io
import random
from collections import Counter

import pytest

from palisade.llm import warc

PAGES = "page_id long, url string, html string, payload string, digest string, salt string, record_type string, refers_to string, n string"


def awkward_pages():
    rows = [(i, f"http://a.example/{i}", f"<p>{i % 7}</p>") for i in range(60)]
    rows += [(100, None, None), (101, "", ""), (102, "http://b/\r\nWARC-Type: request\r\n\r\n x", "é" * 5), (103, "http://c/ü?q=\t", "é" * 5),
             (104, "x", "word " * 200_000), (105, "x", "word " * 200_000), (None, "n", "alone"), (None, None, "<p>3</p>"), (None, "m", "two"), (None, "m", "two"),
             (106, "r", "again"), (106, "r", "again"), (7, "r", "again"), (-9, "neg", "\x1f\x00\r\n\r\nWARC/1.1\r\n"), (110, "z", "\r\n\r\n")]
    return [(*r, "x", "x", "x", "x", "x", "x") for r in rows]


def plain(rows, min_bytes=0):
    payloads = [(i, (h or "").encode()) for i, _, h, *_ in rows]
    last = {}
    for i, p in payloads:
        last[p] = max(-1 << 63 if i is None else i, last.get(p, -1 << 63))
    out = Counter()
    for i, p in payloads:
        again = len(p) >= min_bytes and last[p] != -1 << 63 and i != last[p]
        digest = base64.b32encode(hashlib.sha1(p).digest()).decode()
        out[(i, len(p), digest, "revisit" if again else "response", last[p] if again else None)] += 1
    return out


@pytest.mark.parametrize("min_bytes, groups", [(0, 1000), (0, 0), (9, 0), (10 ** 9, 10)])
def test_marks(spark, min_bytes, groups):
    df = spark.createDataFrame(awkward_pages(), PAGES).repartition(3)
    got = warc.mark_revisits(df, min_bytes, broadcast_groups=groups).collect()
    found = Counter((r.page_id, len(r.payload), warc.digest_of(bytes(r.payload)), r.record_type, r.refers_to) for r in got)
    assert found == plain(awkward_pages(), min_bytes)


@pytest.mark.parametrize("split", [1 << 25, 997])
def test_round_trip(spark, tmp_path, split):
    df = spark.createDataFrame(awkward_pages(), PAGES).repartition(3)
    warc.write_archive(df, f"file://{tmp_path}/w")
    warc.write_archive(df, f"file:{tmp_path}/w")  # replaces what is there
    got = warc.read_archive(spark, f"file://{tmp_path}/w", split).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == plain(awkward_pages())
    assert all(r.intact and r.date == "1970-01-01T00:00:00Z" for r in got)
    assert Counter(bytes(r.payload) for r in got if r.record_type == "response") <= Counter((p[2] or "").encode() for p in awkward_pages())
    urls = {r.page_id: r.target_uri for r in got}
    assert urls[100] is None and urls[101] == "" and urls[102] == "http://b/%0D%0AWARC-Type:%20request%0D%0A%0D%0A%20x" and urls[103] == "http://c/ü?q=%09"
    assert {r.payload for r in warc.read_archive(spark, f"{tmp_path}/w", split, payload=False).collect()} == {None}
    assert not [p for p in (tmp_path / "w").iterdir() if p.name.startswith("_")]
    for path in (tmp_path / "w").glob("*.warc.gz"):
        assert gzip.decompress(path.read_bytes()).startswith(b"WARC/1.1\r\n")


def test_empty_table(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([], PAGES), str(tmp_path / "none"))
    assert warc.read_archive(spark, str(tmp_path / "none")).count() == 0


def records(rng, n):
    for i in range(n):
        inner = warc.compress(warc.write_record(i, b"in", b"inner", None, False, "d")) * 3
        payload = rng.choice([b"", b"x" * 5000, rng.randbytes(3000), inner, inner + rng.randbytes(100), warc.MAGIC * 50])
        yield i, payload, warc.compress(warc.write_record(i, b"u", payload, None, False, "d"), level=rng.choice([0, 1, 6]))


def in_ranges(data, step):
    found = []
    for lo in range(0, len(data), step):
        found += warc.Members(io.BytesIO(data), len(data)).between(lo, min(lo + step, len(data)))
    return found


def test_every_split_finds_every_record_once():
    rng = random.Random(4)
    for _ in range(6):
        some = list(records(rng, 12))
        data = b"".join(m for _, _, m in some)
        for step in (1, 7, 100, 2048, len(data)) if len(data) < 60_000 else (333, 5000, len(data)):
            got = [warc.parse_record(r) for _, r in in_ranges(data, step)]
            assert [(r[4], r[9], r[8]) for r in got] == [(i, p, True) for i, p, _ in some]


def test_damage_costs_only_the_damaged_records():
    rng = random.Random(9)
    some = list(records(rng, 20))
    bad = {3: lambda m: m[:len(m) // 2], 8: lambda m: m[:-8] + b"\0" * 8, 12: lambda m: b"junk" + m, 15: lambda m: b"\0" + m[1:], 19: lambda m: m[:-1]}
    data = b"".join(bad.get(i, bytes)(m) for i, _, m in some)
    for step in (50, 3000, len(data)):
        assert [warc.parse_record(r)[4] for _, r in in_ranges(data, step)] == [i for i in range(20) if i not in (3, 8, 15, 19)]


def test_other_records_are_read():
    def record(kind, block, *fields, length=None):
        head = b"\r\n".join([b"WARC/1.0", b"WARC-Type: " + kind, *fields, b"content-length: %d" % (len(block) if length is None else length)])
        return gzip.compress(head + b"\r\n\r\n" + block + b"\r\n\r\n", mtime=5)
    data = (record(b"warcinfo", b"software: x\r\n") + record(b"response", b"HTTP/1.0 200\r\n\r\nbody", b"Content-Type: application/http", b"Page-ID: x")
            + record(b"resource", b"a\r\n\r\nb", b"WARC-Payload-Digest: sha1:" + warc.digest_of(b"no").encode()) + record(b"metadata", b"short", length=99)
            + record(b"revisit", b"") + gzip.compress(b"no record") + record(b"request", b"", length=0))
    got = [warc.parse_record(r) for _, r in in_ranges(data, 40)]
    assert [(r[0], r[9], r[7], r[8]) for r in got] == [
        ("warcinfo", b"software: x\r\n", 13, True), ("response", b"body", 4, True), ("resource", b"a\r\n\r\nb", 6, False),
        ("metadata", b"short\r\n\r\n", 9, False), ("revisit", None, None, True), ("request", b"", 0, True)]
    assert [r[4] for r in got] == [None] * 6

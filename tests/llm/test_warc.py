"""WARC archives: written and read back in ranges of any size, against a plain version."""

from __future__ import annotations

import gzip
import hashlib
import random
import zlib

import pytest

from tidemark.llm import warc

SCHEMA = "page_id long, url string, html string, type string, offset long, payload string"


def member(head: str, block: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(f"WARC/1.1\r\nWARC-Type: {head}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n") + c.flush()


@pytest.fixture(scope="module")
def page_rows():
    rng = random.Random(3)
    same, short = "<p>é " + "same " * 40, "<p>short</p>"
    rows = [(1, "http://a/1", same), (2, None, same), (2, "http://a/2", same), (3, "u\r\nWARC-Type: metadata", None), (4, "", ""), (5, "x", short), (6, "y", short), (None, "n", same), (None, "m", "z" * 99), (None, "m", "z" * 99)]
    rows += [(i, f"http://b/{i}", rng.choice([same, "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9, "".join(rng.choice("abc\r\n<>\x1f\x00漢") for _ in range(rng.randrange(3000)))])) for i in range(10, 90)]
    return [*rows, (99, "large", "wörd " * 3_000_000), (100, "large", "wörd " * 3_000_000)]


def plain(rows):
    first: dict[bytes, int] = {}
    out = []
    for page, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2] or "")):
        body = (html or "").encode()
        digest = hashlib.sha256(body).hexdigest()
        again = len(body) >= 100 and body in first
        out.append((page, len(body), digest, "revisit" if again else "response", first[body] if again else None))
        if len(body) >= 100:
            first.setdefault(body, page)
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def archive(spark, page_rows):
    return warc.write(spark.createDataFrame([(*r, "t", 7, "p") for r in page_rows], SCHEMA).repartition(3))


def test_round_trip_equals_plain(spark, page_rows):
    pages = spark.createDataFrame([(*r, "t", 7, "p") for r in page_rows], SCHEMA).repartition(3)
    out = warc.report(pages)
    assert got(out) == plain(page_rows)
    assert out.where("not intact").count() == 0


@pytest.mark.parametrize("size", [997, 20_000, 1 << 30])
def test_ranges_of_any_size_own_each_record_once(spark, archive, page_rows, size):
    assert got(warc.index(spark, archive, size)) == plain(page_rows)


def test_files_are_members_and_nothing_else(spark, archive):
    names = [r["path"] for r in spark.read.format("binaryFile").load(archive).select("path").collect()]
    contents = [gzip.open(n.removeprefix("file:")).read() for n in names]
    assert all(c.startswith(b"WARC/1.1\r\n") for c in contents if c)
    assert sum(c.count(b"WARC-Record-ID: <urn:x-record:") for c in contents) == 92


def test_payloads_come_back(spark, archive, page_rows):
    rows = warc.records(spark, archive, 5000).collect()
    html = {i: h for i, _, h in page_rows if i is not None}
    assert len(rows) == len(page_rows)
    for r in rows:
        if r["record_type"] == "revisit":
            assert r["payload"] is None
        elif r["page_id"] is not None:
            assert bytes(r["payload"]) == (html[r["page_id"]] or "").encode()
    assert {r["uri"] for r in rows} >= {"http://a/1", None, "", "u%0D%0AWARC-Type:%20metadata"}


def test_an_archive_inside_a_record_and_a_damaged_record(spark, tmp_path):
    inner = b"".join(member("response", b"inner %d" % i) for i in range(30))
    parts = [member("response", b"first"), member("resource", inner, 0), member("response", b"last"), member("response", bytes(random.Random(1).choices(range(256), k=2000)))[:-30]]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(parts))
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    for size in (100, 700, 1 << 20):
        rows = sorted(warc.index(spark, str(tmp_path), size).collect(), key=lambda r: r["offset"])
        assert [(r["record_type"], r["intact"]) for r in rows] == [("response", True), ("resource", True), ("response", True), ("response", False)]
        assert [r["offset"] for r in rows] == [0, len(parts[0]), len(parts[0]) + len(parts[1]), sum(map(len, parts[:3]))]
        payloads = {r["offset"]: bytes(r["payload"]) for r in warc.records(spark, str(tmp_path), size).collect()}
        assert payloads[rows[1]["offset"]] == inner
        assert len(payloads) == 4


def test_empty_table(spark):
    assert warc.report(spark.createDataFrame([], SCHEMA)).count() == 0

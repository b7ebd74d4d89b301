"""WARC archives of pages: one gzip member a record, written by Spark's own writer and read back in byte ranges.

Writing. Pages of equal payload are found by digest and length; the smallest id
of each group is a response, the others are revisits of it and carry no payload.
Each record is a gzip member of its own. Members go through Spark's text writer
with the byte 0 as line separator: a member ends with the high byte of its
length, which is 0 (a record of 16 MiB or more is followed by an empty member,
so that this holds for it too), and the writer puts that last byte. So the files
hold members and nothing else, any store that Spark writes to will do, and a
lost executor's files are never committed.

Reading. A file is cut into byte ranges, whatever its records. The task of a
range looks for the gzip magic in it, inflates what follows each find, and takes
it for a record where that decodes to a WARC header. It owns the records that
start inside its range and reads them to their ends, beyond the range if need
be; after a record it goes on at that record's end. An archive stored within a
record (a page that is itself a WARC file) can look like records to a task whose
range starts there: what lies within another record's extent is left out by
`index`, and by `records`, which leaves out what the index does.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import shared_folder, with_row_id

MAGIC = b"\x1f\x8b\x08"
#: Payloads shorter than this are never revisits.
LEAST_REVISIT = 100
#: A group of equal payloads is joined to its first page in so many parts.
SALTS = 32
RANGE_BYTES, TASK_BYTES = 16 << 20, 64 << 20
READ_BYTES, HEAD_MOST = 1 << 18, 1 << 20
OUT_ROWS, OUT_BYTES = 500, 4 << 20

INDEX_SCHEMA = "path string, offset long, `end` long, record_type string, record_id string, page_id long, uri string, refers_id string, refers_to long, payload_bytes long, payload_digest string, intact boolean"


def decided(pages: DataFrame, id_column: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(k, page_id, uri, payload, n, digest, first, first_page) of each page; `first` is the k of the record it revisits, or null.

    k is unique to the row and sorts as (page_id, nulls last, then payload): of repeated ids the first in that order counts as smaller.
    """
    rows = with_row_id(pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url).cast("string").alias("uri"), F.col(html).cast("string").alias("text")), "page_id")
    payload = F.coalesce(F.col("text").cast("binary"), F.lit(b"").cast("binary"))
    k = F.when(F.col("page_id").isNull(), F.col("rid").bitwiseOR(F.lit(1 << 62))).otherwise(F.col("rid"))
    rows = rows.select(k.alias("k"), "page_id", "uri", payload.alias("payload")).withColumns({"n": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    groups = rows.where(F.col("n") >= LEAST_REVISIT).groupBy("digest", "n").agg(F.min("k").alias("first"), F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
    dealt = groups.select("digest", "n", "first", "first_page", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return rows.withColumn("salt", F.pmod(F.xxhash64("k"), F.lit(SALTS)).cast("int")).join(dealt, ["digest", "n", "salt"], "left")


def _member(head: list[str], block: bytes) -> bytes:
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    raw = packed.compress("\r\n".join(head).encode() + b"\r\n\r\n") + packed.compress(block) + packed.compress(b"\r\n\r\n") + packed.flush()
    return raw if raw[-1] == 0 else raw + zlib.compressobj(6, zlib.DEFLATED, 31).flush()


def _uri(uri: str) -> str:
    """Without white space or control characters, which would end the header's line."""
    return re.sub(r"[\x00-\x20\x7f\x85  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), uri)


def write(pages: DataFrame, folder: str | None = None, id_column: str = "page_id", url: str = "url", html: str = "html", date: str = "2024-01-01T00:00:00Z") -> str:
    """Writes an archive of one record a page, in `folder` (a new one of the shared folder where None), and returns the folder.

    Null payloads are empty; an empty table gives a folder without records. A null id has a record without an id, and comes last in
    its group. Of rows of one id and payload one is the response and the others revisit it. Null urls give no target. Other
    columns are left out, whatever their names.
    """
    path = folder or f"{shared_folder(pages.sparkSession)}/tidemark/warc-{uuid.uuid4().hex}"

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for r in zip(*(batch.column(i) for i in range(batch.num_columns)), strict=True):
                k, page, uri, payload, n, digest, first, first_page = (x.as_py() for x in r)
                again = first is not None and first != k
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n + (b"" if again else payload or b"")
                head = ["WARC/1.1", f"WARC-Type: {'revisit' if again else 'response'}", f"WARC-Record-ID: <urn:x-record:{k}>", f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {n}"]
                head += [f"WARC-Target-URI: {_uri(uri)}"] if uri is not None else []
                head += [f"X-Page-Id: {page}"] if page is not None else []
                if again:
                    head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-record:{first}>"]
                    head += [f"X-Refers-To-Page: {first_page}"] if first_page is not None else []
                out.append(_member(head, block)[:-1])
                held += len(out[-1])
                if held >= OUT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    again = F.col("first").isNotNull() & (F.col("first") != F.col("k"))
    rows = decided(pages, id_column, url, html).select("k", "page_id", "uri", F.when(~again, F.col("payload")).alias("payload"), "n", "digest", "first", "first_page")
    rows.mapInArrow(members, "member binary").select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").option("compression", "none").text(path)
    return path


class _NoRecordError(Exception):
    """What starts here is no record, or does not reach its end."""


class _File:
    """The bytes of a file of the shared store by their place; the last block read is kept."""

    def __init__(self, path: str, size: int) -> None:
        from pyarrow import fs

        local = re.fullmatch(r"(?:file:(?://)?)?(/.*)", path)
        store, name = (fs.LocalFileSystem(), local[1]) if local else fs.FileSystem.from_uri(path)
        self.file, self.size = store.open_input_file(name), size
        self.at, self.block = 0, b""

    def read(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        if n <= 0:
            return b""
        if at < self.at or at + n > self.at + len(self.block):
            self.at, self.block = at, self.file.read_at(min(max(n, 1 << 20), self.size - at), at)
        return self.block[at - self.at : at - self.at + n]


class _Stream:
    """A member's content, inflated as it is taken; never more than a piece is held."""

    def __init__(self, file: _File, at: int) -> None:
        self.file, self.at, self.held, self.raw = file, at, b"", b""
        self.inflate = zlib.decompressobj(31)

    def more(self) -> bool:
        """Adds a piece to what is held; False at the member's end."""
        while not self.inflate.eof:
            if not self.raw:
                self.raw = self.file.read(self.at, READ_BYTES)
                self.at += len(self.raw)
                if not self.raw:
                    raise _NoRecordError
            try:
                piece = self.inflate.decompress(self.raw, READ_BYTES)
            except zlib.error:
                raise _NoRecordError from None
            self.raw = self.inflate.unconsumed_tail
            if piece:
                self.held += piece
                return True
        return False

    def until(self, mark: bytes, most: int) -> bytes:
        """What stands before the mark, of at most `most` bytes; the mark is taken too."""
        while (k := self.held.find(mark)) < 0:
            if len(self.held) > most or not self.more():
                raise _NoRecordError
        out, self.held = self.held[:k], self.held[k + len(mark) :]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in pieces."""
        while n:
            if not self.held and not self.more():
                raise _NoRecordError
            piece, self.held = self.held[:n], self.held[n:]
            n -= len(piece)
            yield piece

    def end(self) -> int:
        """Where the member ends in the file, once nothing of it is left."""
        while self.more():
            pass
        return self.at - len(self.inflate.unused_data)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?\d{1,18}|-?[1-8]\d{18}|-?9[01]\d{17}|-?92[01]\d{16}", text) else None


def _record(file: _File, at: int, payload: bool) -> tuple:
    """One record by INDEX_SCHEMA from `offset` on, and its payload; raises where there is none."""
    stream = _Stream(file, at)
    while len(stream.held) < 7 and stream.more():
        pass
    if not stream.held.startswith(b"WARC/1."):
        raise _NoRecordError
    fields = _fields(stream.until(b"\r\n\r\n", HEAD_MOST))
    left = _number(fields.get("content-length"))
    if left is None or left < 0 or "warc-type" not in fields:
        raise _NoRecordError
    intact, n, sha, kept, end = True, 0, hashlib.sha256(), [], at + 1
    try:
        if fields.get("content-type", "").startswith("application/http") and left:
            before = stream.until(b"\r\n\r\n", HEAD_MOST)
            left -= len(before) + 4
        if left < 0:
            raise _NoRecordError
        for piece in stream.take(left):
            sha.update(piece)
            n += len(piece)
            if payload:
                kept.append(piece)
        end = stream.end()
    except _NoRecordError:
        intact = False
    kind, said = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
    if kind == "revisit":
        n, digest = _number(fields.get("x-payload-length")), said
    else:
        digest = sha.hexdigest()
        intact = intact and (said is None or said == digest or ":" in said)
    row = (at, end, kind, fields.get("warc-record-id"), _number(fields.get("x-page-id")), fields.get("warc-target-uri"), fields.get("warc-refers-to"), _number(fields.get("x-refers-to-page")), n, digest, intact)
    return row, b"".join(kept) if payload and kind != "revisit" else None


def _owned(file: _File, start: int, to: int, payload: bool) -> Iterator[tuple]:
    """The records that start in [start, to)."""
    at = start
    while at < to:
        block = file.read(at, min(READ_BYTES, to - at + 2))
        k = block.find(MAGIC)
        if k < 0:
            at += max(len(block) - 2, 1)
            continue
        at += k
        if at >= to:
            return
        try:
            row, content = _record(file, at, payload)
        except _NoRecordError:
            at += 1
            continue
        yield row, content
        at = row[1]


def scan(spark: SparkSession, path: str, payload: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All that decodes as a record, by the ranges' own tasks; see `index` and `records`."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    total = files.agg(F.sum("length")).first()[0] or 0
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    ranges = ranges.repartition(max(1, min(total // range_bytes + 1, max(total // TASK_BYTES + 1, spark.sparkContext.defaultParallelism))))
    schema = INDEX_SCHEMA + ", payload binary" * payload

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
        names = "path offset end record_type record_id page_id uri refers_id refers_to payload_bytes payload_digest intact payload".split()
        width = 12 + payload

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names[:width])

        for batch in batches:
            for name, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                file, rows, held = _File(name, size), [], 0
                for row, content in _owned(file, start, min(start + range_bytes, size), payload):
                    rows.append((name, *row, content)[:width])
                    held += len(content or b"")
                    if len(rows) >= OUT_ROWS or held >= OUT_BYTES:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return ranges.mapInArrow(read, schema)


def _nested(rows: DataFrame) -> DataFrame:
    """Adds `within`: the record lies inside another one's extent."""
    before = Window.partitionBy("path").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("within", F.coalesce(F.max("end").over(before) > F.col("offset"), F.lit(False)))


def index(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row a record without its payload: path, offset, end, record_type, record_id, page_id, uri, refers_id, refers_to (the page),
    payload_bytes, payload_digest (of the full payload: a response's is computed anew, a revisit's is what its header says), intact
    (inflates to its end with the length and the digest that it states)."""
    return _nested(scan(spark, path, False, range_bytes)).where(~F.col("within")).drop("within")


def records(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """As `index`, with `payload`: null for revisits. The few offsets that lie within other records are left out by a join."""
    inside = _nested(scan(spark, path, False, range_bytes)).where("within").select("path", "offset")
    return scan(spark, path, True, range_bytes).join(inside, ["path", "offset"], "left_anti")


def report(pages: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Writes the archive, reads it back, and returns page_id, payload_bytes, payload_digest, record_type, refers_to of each page.

    Null html counts as empty. Rows of a null id keep it; repeated rows give a record each; an empty table gives no rows.
    """
    found = index(pages.sparkSession, write(pages), range_bytes)
    return found.where(F.col("record_type").isin("response", "revisit")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri", "intact")

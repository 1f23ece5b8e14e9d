"""WARC archives as a Spark data source, ``spark.read.format("warc")``.

An archive file is a row of gzip members with one record each, so it can be
read from any place: a task gets a range of bytes, looks for the magic number
of gzip in it, takes a place for a member only if it decodes to a WARC header,
and owns the records whose member starts in its range; the last of them may
end beyond it.  Writing is one file per task under a temporary name; the
commit gives the files of the successful attempts their names.

Archive folders are paths or URIs that pyarrow's file systems open (local and
mounted folders, hdfs, s3, gs).
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from palisade.llm.common import cut

MAGIC = b"\x1f\x8b\x08"
#: Bytes of a range, and of a read.
SPLIT_BYTES = 32 << 20
READ_BYTES = 1 << 20
#: A header block that has not ended by then belongs to no record.
HEADER_BYTES = 1 << 20
#: Rows and bytes of payload in a batch.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: Groups of equal payloads that are broadcast, each a digest and two numbers; more are joined by digest.
BROADCAST_GROUPS = 200_000
SALTS = 64

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = ("file string, offset long, record_type string, record_id string, target_uri string, date string, page_id long, refers_to long, "
           "payload_digest string, payload_bytes long, intact boolean, payload binary")
ARROW = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()),
                   ("target_uri", pa.string()), ("date", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()),
                   ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("intact", pa.bool_()), ("payload", pa.binary())])


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's path in it; ``file:/x`` is written as Hadoop does."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", uri))


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def compress(record: bytes, level: int = 6) -> bytes:
    """One gzip member.

    A payload that holds gzip itself may be stored as it is; a flush behind
    the first byte of every magic number in it keeps readers from taking the
    copy for a member.
    """
    packer, out, at = zlib.compressobj(level, zlib.DEFLATED, 31), [], 0
    while (found := record.find(MAGIC, at)) >= 0:
        out += [packer.compress(record[at:found + 1]), packer.flush(zlib.Z_FULL_FLUSH)]
        at = found + 1
    return b"".join([*out, packer.compress(record[at:]), packer.flush()])


def write_record(page_id: int | None, url: bytes | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """A response with its payload, or a revisit with the HTTP header only; both name the whole payload's digest and length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], url)))
    if page_id is not None:
        fields.append(("Page-ID", str(page_id)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("Refers-To-Page-ID", str(refers_to))]
    fields += [("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"), ("Content-Type", "application/http; msgtype=response"),
               ("Content-Length", str(len(block)))]
    lines = [b"WARC/1.1", *(f"{k}: ".encode() + (v if isinstance(v, bytes) else v.encode()) for k, v in fields)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[bytes, bytes]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}


def header_of(record: bytes) -> dict[bytes, bytes] | None:
    """The fields of a WARC header, if the bytes begin with a whole one."""
    head, end, _ = record.partition(b"\r\n\r\n")
    if not end or not head.startswith(b"WARC/"):
        return None
    fields = _fields(head)
    return fields if fields.get(b"warc-type") and fields.get(b"content-length", b"").isdigit() else None


def _text(value: bytes | None) -> str | None:
    return None if value is None else value.decode("utf-8", "replace")


def _number(value: bytes | None) -> int | None:
    return int(value) if value is not None and re.fullmatch(rb"-?[0-9]{1,18}|-?[0-9]{19}", value) and abs(int(value)) < 2 ** 63 else None


def parse_record(record: bytes) -> tuple:
    """The columns behind ``file, offset`` of a whole record.

    The payload of an HTTP response is what follows the HTTP header, else the
    block; a revisit has none.  Digest and length are those of the bytes read,
    of a revisit those that it states.  ``intact``: the block is as long as
    stated, and the payload has the stated digest, if any.
    """
    fields = header_of(record)
    start = record.index(b"\r\n\r\n") + 4
    length = int(fields[b"content-length"])
    block = record[start:start + length]
    kind = fields[b"warc-type"].lower()
    head, end, body = block.partition(b"\r\n\r\n")
    http = fields.get(b"content-type", b"").startswith(b"application/http") and end
    stated = fields.get(b"warc-payload-digest", b"").rpartition(b":")[2].decode("latin-1").upper() or None
    intact = len(block) == length
    if kind == b"revisit":
        payload, digest = None, stated
        size = _number(_fields(head).get(b"content-length")) if http else None
    else:
        payload = body if http else block
        digest, size = digest_of(payload), len(payload)
        intact &= stated is None or len(stated) != 32 or stated == digest
    return (_text(kind), _text(fields.get(b"warc-record-id")), _text(fields.get(b"warc-target-uri")), _text(fields.get(b"warc-date")),
            _number(fields.get(b"page-id")), _number(fields.get(b"refers-to-page-id")), digest, size, intact, payload)


class Members:
    """The gzip members of an open file that begin in a range of it."""

    def __init__(self, stream, size: int):
        self.stream, self.size = stream, size
        self.low, self.held = 0, b""

    def _read(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        if n > 0 and not self.low <= at <= at + n <= self.low + len(self.held):
            self.stream.seek(at)
            self.low, self.held = at, self.stream.read(max(n, READ_BYTES))
        return self.held[at - self.low:at - self.low + n] if n > 0 else b""

    def decode(self, at: int) -> tuple[bytes, int] | None:
        """The record of the member at a place and where the member ends; None if none is there.

        A member that doesn't hold a WARC header, breaks off or fails its
        checksum is none.
        """
        unpack, out, header = zlib.decompressobj(31), b"", False
        pieces = []
        while not unpack.eof:
            data = self._read(at, 65536 if header else 2048)
            if not data:
                return None
            at += len(data)
            try:
                if header:
                    pieces.append(unpack.decompress(data))
                    continue
                out += unpack.decompress(data, HEADER_BYTES)
                header = header_of(out) is not None
                if not header and (not out.startswith(b"WARC/"[:len(out)]) or len(out) >= HEADER_BYTES):
                    return None
                if header:
                    pieces = [out, unpack.decompress(unpack.unconsumed_tail)]
            except zlib.error:
                return None
        return (b"".join(pieces), at - len(unpack.unused_data)) if header else None

    def _magic(self, at: int, end: int) -> int | None:
        """The first magic number from ``at`` on that begins before ``end``."""
        while at < end:
            found = self._read(at, 65536 + len(MAGIC) - 1).find(MAGIC)
            if found >= 0:
                return at + found if at + found < end else None
            at += 65536
        return None

    def between(self, start: int, end: int) -> Iterator[tuple[int, bytes]]:
        """Place and record of every whole member that begins in the range."""
        at = self._magic(start, end)
        while at is not None:
            whole = self.decode(at)
            if whole:
                yield at, whole[0]
            at = self._magic(whole[1] if whole else at + 1, end)


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int
    size: int


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))
        self.payload = str(options.get("payload", "true")).lower() == "true"

    def partitions(self) -> list[Range]:
        system, folder = place(self.path)
        found = system.get_file_info(fs.FileSelector(folder, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and f.size and f.path.endswith(".warc.gz") and "/_" not in f.path[len(folder):])
        ranges = [Range(path, lo, min(lo + self.split, size), size) for path, size in files for lo in range(0, size, self.split)]
        return ranges or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.size:
            return
        held, size = [], 0
        with place(self.path)[0].open_input_file(partition.file) as stream:
            for at, record in Members(stream, partition.size).between(partition.start, partition.end):
                row = parse_record(record)
                held.append((partition.file, at, *row) if self.payload else (partition.file, at, *row[:-1], None))
                size += len(record) if self.payload else 0
                if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield self._batch(held)
                    held, size = [], 0
        if held:
            yield self._batch(held)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)


@dataclass
class Written(WriterCommitMessage):
    temporary: str | None
    name: str


class WarcWriter(DataSourceArrowWriter):
    """Rows of ``page_id, url (binary), payload (binary), refers_to, record_type`` as records."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.date = options.get("date", "1970-01-01T00:00:00Z")
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{self.job}.warc.gz"
        system, folder = place(self.path)
        temporary, out = f"{folder}/_{self.job}/{task.taskAttemptId()}-{name}", None
        try:
            for batch in iterator:
                for k in range(0, batch.num_rows, 100):
                    some = batch.slice(k, 100)
                    columns = (some.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to", "record_type"))
                    for page_id, url, payload, refers_to, kind in zip(*columns, strict=True):
                        if out is None:
                            system.create_dir(f"{folder}/_{self.job}", recursive=True)
                            out = system.open_output_stream(temporary, compression=None)
                        out.write(compress(write_record(page_id, url, payload or b"", refers_to, kind == "revisit", self.date)))
        finally:
            if out is not None:
                out.close()
        return Written(temporary if out is not None else None, name)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = place(self.path)
        system.create_dir(folder, recursive=True)
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(folder)):
                if old.is_file and old.path.endswith(".warc.gz"):
                    system.delete_file(old.path)
        for message in messages:
            if message is not None and message.temporary:
                system.move(message.temporary, f"{folder}/{message.name}")
        self._clean(system, folder)

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*place(self.path))

    def _clean(self, system: fs.FileSystem, folder: str) -> None:
        if system.get_file_info(f"{folder}/_{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{folder}/_{self.job}")


class WarcSource(DataSource):
    """Options: ``path``; for reading ``splitBytes`` and ``payload`` (false leaves the payloads out); for writing ``date``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def mark_revisits(pages: DataFrame, min_bytes: int = 0, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """``page_id, url, payload, record_type, refers_to`` of ``pages`` (``page_id, url, html``; other columns are ignored).

    Of rows with equal payloads of at least ``min_bytes`` bytes the one with
    the largest ``page_id`` is the response, others revisit it; smaller ones
    are all responses.  A null html is an empty payload.  Null ids are below
    all others and revisit them; a group of null ids only, and repeated rows
    with a group's largest id, are responses all.

    Equal payloads are known by length and SHA-256.  Only groups of several
    rows go back to the pages: broadcast while they are few, else joined by
    digest and a salt, as one payload may be on a third of all pages.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").cast("binary").alias("url"),
        F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).withColumn(
        "digest", F.when(F.length("payload") >= min_bytes, F.concat_ws(":", F.length("payload"), F.sha2("payload", 256))))
    parts = cut(rows.where("digest IS NOT NULL").groupBy("digest", "salt").agg(F.max("page_id").alias("last"), F.count("*").alias("n")))
    groups = parts.groupBy("digest").agg(F.max("last").alias("response"), F.sum("n").alias("n")).where("n > 1 AND response IS NOT NULL").drop("n")
    groups = cut(groups)
    if groups.count() <= broadcast_groups:
        marked = rows.join(F.broadcast(groups), "digest", "left")
    else:
        salted = parts.join(groups, "digest").select("digest", "salt", "response")
        marked = rows.join(salted, ["digest", "salt"], "left")
    again = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    return marked.select("page_id", "url", "payload", F.when(again, "revisit").otherwise("response").alias("record_type"),
                         F.when(again, F.col("response")).alias("refers_to"))


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record per row of ``pages`` to a folder of WARC files, replacing those that are there.

    A null url gives a record without a target; white space and control
    characters in a url are percent-encoded.  An empty table gives no file.
    """
    marked = mark_revisits(pages, min_bytes)
    pages.sparkSession.dataSource.register(WarcSource)
    marked.write.format("warc").option("date", date).mode("overwrite").save(path)


def read_archive(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, payload: bool = True) -> DataFrame:
    """Every record of the ``.warc.gz`` files below a folder, as ``RECORDS``.

    A member that doesn't decode whole is no record.  An archive inside a
    payload that another writer stored uncompressed can't be told from records
    if a range starts inside it.
    """
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("splitBytes", split_bytes).option("payload", str(payload).lower()).load(path)

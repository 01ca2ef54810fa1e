"""WARC archives as a Spark data source.

Reading plans one partition for each file. Of every record only the headers are decoded first; predicates
on the record type and the other header columns are pushed into the reader, and what they refuse is
skipped, as is the payload of all records if it is not asked for: archives written here tell the length
of each compressed record in its gzip header ("sl" field), so skipping is a seek. Other gzip archives
are inflated but not decoded, plain ones are skipped by Content-Length.

Writing rolls over files at a size, under names unique to the attempt. Only files named in the list that
the commit writes are read, so what failed or lost tasks leave behind is never seen.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from .common import staged

READ_SCHEMA = (
    "type string, record_id string, target_uri string, date string, payload_digest string, "
    "headers map<string,string>, payload binary"
)
WRITE_SCHEMA = "page_id long, url string, payload binary, refers_to long"
HEADER_OF = {
    "type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "payload_digest": "warc-payload-digest",
}
LIST = "_files.json"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
ROLL_BYTES = 32 << 20
PIECE = 4096


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}').urn}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit without its payload if ``refers_to`` names another page."""
    digest = base32_sha1(payload)
    revisit = refers_to is not None
    block = HTTP if revisit else HTTP + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if revisit:
        fields += [
            ("WARC-Profile", PROFILE),
            ("WARC-Refers-To", record_id(refers_to, digest)),
            ("X-Refers-To-Page-ID", str(refers_to)),
        ]
    fields.append(("Content-Length", str(len(block))))
    head = "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass")
    return b"WARC/1.1\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 4) -> bytes:
    """One gzip member, with its compressed length in an "sl" extra field where that fits."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    total = 10 + 2 + 12 + len(body) + len(tail)
    extra = b""
    if total < 1 << 32 and len(data) < 1 << 32:
        extra = struct.pack("<H2sHII", 12, b"sl", 8, total, len(data))
    flags = 4 if extra else 0
    return b"\x1f\x8b\x08" + bytes([flags]) + b"\0\0\0\0\0\xff" + extra + body + tail


class Record:
    """Headers of a record; its block is read only on demand."""

    def __init__(self, headers: dict[str, str], block: Callable[[], bytes]):
        self.headers, self.block = headers, block

    def payload(self) -> bytes | None:
        kind = self.headers.get("warc-type")
        if kind == "revisit":
            return None
        data = self.block()
        if kind == "response" and "application/http" in self.headers.get("content-type", ""):
            data = data.partition(b"\r\n\r\n")[2]
        return data


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    pairs = (line.partition(":") for line in lines[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


class _Inflater:
    """One gzip member of a file, inflated piece by piece."""

    def __init__(self, file: io.BufferedReader, start: int):
        self.file, self.start = file, start
        self.zip = zlib.decompressobj(31)
        self.data = bytearray()

    def more(self) -> bool:
        if self.zip.eof:
            return False
        piece = self.file.read(PIECE if len(self.data) < 4 * PIECE else 1 << 18)
        if not piece:
            raise EOFError(f"the record at byte {self.start} is cut off")
        self.data += self.zip.decompress(piece)
        return True

    def finish(self, keep: bool) -> None:
        while not self.zip.eof:
            if not keep:
                self.data.clear()
            self.more()
        self.file.seek(-len(self.zip.unused_data), io.SEEK_CUR)


def records(file: io.BufferedReader) -> Iterator[Record]:
    """The records of an open archive, plain or with a gzip member each."""
    while magic := file.peek(2)[:2]:
        yield from (_gzip_record if magic == b"\x1f\x8b" else _plain_record)(file)


def _gzip_record(file: io.BufferedReader) -> Iterator[Record]:
    start = file.tell()
    fixed = file.read(24)
    known = len(fixed) == 24 and fixed[3] & 4 and fixed[12:14] == b"sl"
    end = start + struct.unpack_from("<I", fixed, 16)[0] if known else None
    file.seek(start)
    member = _Inflater(file, start)
    while (at := member.data.find(b"\r\n\r\n")) < 0:
        if not member.more():
            raise ValueError(f"the record at byte {start} has no headers")
    headers = _headers(bytes(member.data[:at]))
    length = int(headers.get("content-length", 0))
    read = False

    def block() -> bytes:
        nonlocal read
        if not read:
            member.finish(keep=True)
            read = True
        found = bytes(member.data[at + 4 : at + 4 + length])
        if len(found) < length:
            raise EOFError(f"the record at byte {start} is cut off")
        return found

    yield Record(headers, block)
    if end is not None:
        file.seek(end)
    elif not read:
        member.finish(keep=False)


def _plain_record(file: io.BufferedReader) -> Iterator[Record]:
    start, head = file.tell(), bytearray()
    while not head.endswith(b"\r\n\r\n"):
        line = file.readline()
        if not line:
            if head.strip():
                raise EOFError(f"the record at byte {start} is cut off")
            return
        if head or line.strip():
            head += line
    headers = _headers(bytes(head[:-4]))
    begin, length = file.tell(), int(headers.get("content-length", 0))

    def block() -> bytes:
        file.seek(begin)
        found = file.read(length)
        if len(found) < length:
            raise EOFError(f"the record at byte {start} is cut off")
        return found

    yield Record(headers, block)
    file.seek(begin + length)


def _predicate(filter: Filter) -> Callable[[dict], bool] | None:
    """The test of a pushed filter over header columns, or None if Spark has to do it."""
    name = getattr(filter, "attribute", ("",))[0]
    if name not in HEADER_OF:
        return None
    key = HEADER_OF[name]
    tests = {
        EqualTo: lambda v: v is not None and v == filter.value,
        EqualNullSafe: lambda v: v == filter.value,
        In: lambda v: v is not None and v in filter.value,
        IsNull: lambda v: v is None,
        IsNotNull: lambda v: v is not None,
        StringStartsWith: lambda v: v is not None and v.startswith(filter.value),
        StringEndsWith: lambda v: v is not None and v.endswith(filter.value),
        StringContains: lambda v: v is not None and filter.value in v,
    }
    test = tests.get(type(filter))
    return None if test is None else lambda headers: test(headers.get(key))


@dataclass
class WarcFile(InputPartition):
    path: str

    def __init__(self, path: str):
        self.path = path


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, verify: bool):
        self.path, self.payload, self.verify = path, payload, verify
        self.filters: list[Filter] = []

    def pushFilters(self, filters):
        for filter in filters:
            if _predicate(filter) is None:
                yield filter
            else:
                self.filters.append(filter)

    def partitions(self):
        files, path = pafs.FileSystem.from_uri(self.path)
        info = files.get_file_info(path)
        if info.type == pafs.FileType.File:
            return [WarcFile(self.path)]
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if files.get_file_info(f"{path}/{LIST}").type == pafs.FileType.File:
            with files.open_input_stream(f"{path}/{LIST}") as f:
                names = json.loads(f.read())["files"]
        else:
            below = files.get_file_info(pafs.FileSelector(path))
            names = [x.base_name for x in below if x.base_name.endswith((".warc", ".warc.gz"))]
        return [WarcFile(f"{self.path.rstrip('/')}/{n}") for n in sorted(names)]

    def read(self, partition):
        if partition is None:
            return
        tests = [_predicate(f) for f in self.filters]
        files, path = pafs.FileSystem.from_uri(partition.path)
        kind = pa.schema(
            [(c, pa.string()) for c in HEADER_OF]
            + [("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())]
        )
        rows: list[tuple] = []
        held = 0
        with files.open_input_file(path) as raw, io.BufferedReader(raw, 1 << 18) as file:
            for found in records(file):
                if not all(test(found.headers) for test in tests):
                    continue
                payload = found.payload() if self.payload else None
                digest = found.headers.get("warc-payload-digest", "")
                if self.verify and payload is not None and digest.startswith("sha1:"):
                    if base32_sha1(payload) != digest[5:]:
                        raise ValueError(f"{partition.path}: wrong digest of {found.headers.get('warc-record-id')}")
                head = [found.headers.get(h) for h in HEADER_OF.values()]
                rows.append((*head, list(found.headers.items()), payload))
                held += len(payload or b"") + 500
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kind.types)], schema=kind)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kind.types)], schema=kind)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, roll_bytes: int):
        self.path, self.roll_bytes = path, roll_bytes

    def write(self, iterator):
        files, folder = pafs.FileSystem.from_uri(self.path)
        files.create_dir(folder, recursive=True)
        names: list[str] = []
        out, size = None, 0
        for batch in iterator:
            for page_id, url, payload, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if out is None or size >= self.roll_bytes:
                    if out is not None:
                        out.close()
                    names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = files.open_output_stream(f"{folder}/{names[-1]}", compression=None), 0
                data = gzip_member(record(page_id, url, payload or b"", refers_to))
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages):
        files, folder = pafs.FileSystem.from_uri(self.path)
        files.create_dir(folder, recursive=True)
        names = sorted(n for m in messages if m is not None for n in m.files)
        made = datetime.datetime.now(datetime.timezone.utc).isoformat()
        with files.open_output_stream(f"{folder}/{LIST}") as f:
            f.write(json.dumps({"written": made, "files": names}).encode())

    def abort(self, messages):
        files, folder = pafs.FileSystem.from_uri(self.path)
        for message in messages:
            for name in message.files if message is not None else []:
                files.delete_file(f"{folder}/{name}")


class WarcSource(DataSource):
    """``spark.read.format("warc").option("payload", "false").load(folder)`` and the writer's counterpart."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return READ_SCHEMA

    def _flag(self, name: str) -> bool:
        return self.options.get(name, "true").lower() == "true"

    def reader(self, schema):
        return WarcReader(self.options["path"], self._flag("payload"), self._flag("verify"))

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"], int(self.options.get("rollBytes", ROLL_BYTES)))


def register(spark: SparkSession) -> None:
    """Make the format known. Spark refuses readers with pushdown unless this setting is on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write_pages(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write a record for every row of ``page_id, url, html``, the payload being the html in UTF-8.

    Of rows with equal payloads of at least ``least_bytes``, those with the smallest ``page_id`` are
    responses and the others revisits of it (a null id counts as the largest; if all are null, all
    are responses). Repeated rows make repeated records. A null html is an empty payload, a null url or
    id leaves its header out. Other columns are ignored; an empty table makes an empty archive.

    Copies are found on digests alone; pages are joined only with the revisits.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    digests = staged(
        rows.where(F.octet_length("payload") >= least_bytes).select(
            "page_id", F.unhex(F.sha1("payload")).alias("digest")
        ),
        "digests",
    )
    first = staged(
        digests.groupBy("digest")
        .agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND refers_to IS NOT NULL")
        .drop("n"),
        "first-pages",
    )
    revisits = staged(
        digests.join(first, "digest")
        .where("page_id IS NULL OR page_id > refers_to")
        .select(F.col("page_id").alias("own"), F.col("digest").alias("own_digest"), "refers_to")
        .distinct(),
        "revisits",
    )
    same = F.col("page_id").eqNullSafe(F.col("own")) & (
        F.unhex(F.sha1("payload")) == F.col("own_digest")
    )
    marked = rows.join(revisits, same, "left").select("page_id", "url", "payload", "refers_to")
    register(pages.sparkSession)
    marked.write.format("warc").mode("append").save(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """The pages of archives written here: ``page_id, url, type, payload_digest, payload_bytes,
    refers_to, payload`` (null for revisits). Payloads are checked against their digests."""
    register(spark)
    found = spark.read.format("warc").load(path).where(F.col("type").isin("response", "revisit"))
    header = lambda name: F.col("headers")[name]
    return found.select(
        header("x-page-id").cast("long").alias("page_id"),
        F.col("target_uri").alias("url"),
        "type",
        F.substring("payload_digest", 6, 32).alias("payload_digest"),
        F.coalesce(F.octet_length("payload").cast("long"), header("x-payload-length").cast("long")).alias(
            "payload_bytes"
        ),
        header("x-refers-to-page-id").cast("long").alias("refers_to"),
        "payload",
    )

"""WARC archives as a Python data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Reading plans one partition per archive file, takes record-type and header predicates from Spark,
parses each record's headers first, and inflates a payload only for a record that passed and whose
payload is asked for. Writing compresses every record as a gzip member of its own; an extra field
holds the member's length, so that the reader can step over a payload without inflating it.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)

from epispark.session import materialise

SCHEMA = (
    "record_type string, record_id string, target_uri string, warc_date string, "
    "payload_digest string, refers_to string, payload_length long, payload binary"
)
#: Column to WARC header, fixed values of the format.
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "warc_date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:x-record:"
FILE_BYTES = 256 << 20
WINDOW = 1 << 20
BATCH_BYTES = 8 << 20


def _open(path: str):
    fs, root = pafs.FileSystem.from_uri(path if re.match(r"\w+:", path) else "file://" + path)
    return fs, root.rstrip("/")


# ------------------------------------------------------------------------------------- writing


def _member(data: bytes, level: int = 6) -> bytes:
    """One gzip member with its own length in the extra field ``SL``."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    total = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHQ", 12, b"SL", 8, total)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _clean(value: str) -> str:
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def _record(row: dict) -> bytes:
    kind, payload = row["record_type"], row["payload"] or b""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if kind == "revisit" else http + payload
    lines = ["WARC/1.1"]
    for col, name in HEADERS.items():
        v = row.get(col)
        if v is None:
            continue
        if col in ("record_id", "refers_to"):
            v = f"<{v}>"
        elif col == "payload_digest":
            v = f"sha1:{v}"
        lines.append(f"{name}: {_clean(v)}")
    if kind == "revisit":
        lines.append(f"WARC-Profile: {PROFILE}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    """Files have names of their own per attempt; the manifest lists those of committed attempts."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _open(self.path)
        fs.create_dir(root)
        files, out = [], None
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None:
                        files.append({"name": f"{uuid.uuid4().hex}.warc.gz", "bytes": 0, "records": 0})
                        out = fs.open_output_stream(f"{root}/{files[-1]['name']}", compression=None)
                    data = _member(_record(row))
                    out.write(data)
                    files[-1]["bytes"] += len(data)
                    files[-1]["records"] += 1
                    if files[-1]["bytes"] >= FILE_BYTES:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        fs, root = _open(self.path)
        fs.create_dir(root)
        files = [f for m in messages if m for f in m.files]
        with fs.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps(files).encode())

    def abort(self, messages: list) -> None:
        fs, root = _open(self.path)
        for f in [f for m in messages if m for f in m.files]:
            fs.delete_file(f"{root}/{f['name']}")


# ------------------------------------------------------------------------------------- reading


class _Bytes:
    """Positioned reads through one window, so that stepping over a record reads nothing."""

    def __init__(self, file):
        self.file, self.size = file, file.size()
        self.at, self.data = 0, b""

    def get(self, pos: int, n: int) -> bytes:
        n = min(n, self.size - pos)
        if pos < self.at or pos + n > self.at + len(self.data):
            self.at, self.data = pos, self.file.read_at(max(n, min(WINDOW, self.size - pos)), pos)
        return self.data[pos - self.at : pos - self.at + n]


def _gzip_header(head: bytes) -> tuple[int, int | None]:
    """Where the deflated data begins, and the member's length if the extra field tells it."""
    flags, at, total = head[3], 10, None
    if flags & 4:
        size = struct.unpack_from("<H", head, at)[0]
        extra, at = head[at + 2 : at + 2 + size], at + 2 + size
        k = 0
        while k + 4 <= len(extra):
            n = struct.unpack_from("<H", extra, k + 2)[0]
            if extra[k : k + 2] == b"SL" and n == 8:
                total = struct.unpack_from("<Q", extra, k + 4)[0]
            k += 4 + n
    for flag in (8, 16):
        if flags & flag:
            at = head.index(b"\0", at) + 1
    return at + (2 if flags & 2 else 0), total


def _fields(block: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in block.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs if k.strip()}


class _Member:
    """A gzip member inflated as far as asked for."""

    def __init__(self, source: _Bytes, pos: int):
        self.source, self.pos = source, pos
        start, self.total = _gzip_header(source.get(pos, 1 << 12))
        self.next, self.inflate, self.data = pos + start, zlib.decompressobj(-15), b""

    def upto(self, mark: bytes | None, start: int = 0) -> int:
        """Inflates until ``mark`` follows ``start``, or to the end; the mark's end or -1."""
        step = 2048 if mark else 1 << 18
        while True:
            at = self.data.find(mark, start) if mark else -1
            if at >= 0:
                return at + len(mark)
            if self.inflate.eof:
                return -1
            pending = self.inflate.unconsumed_tail
            if not pending:
                pending = self.source.get(self.next, step)
                if not pending:
                    raise ValueError("truncated gzip member")
                self.next += len(pending)
            self.data += self.inflate.decompress(pending, 4096 if mark else 0)

    def end(self) -> int:
        if self.total:
            return self.pos + self.total
        self.upto(None)
        return self.next - len(self.inflate.unused_data) + 8


class _Plain:
    """An uncompressed record behind the same calls."""

    def __init__(self, source: _Bytes, pos: int):
        self.source, self.pos, self.data, self.stop = source, pos, b"", None

    def upto(self, mark: bytes | None, start: int = 0) -> int:
        left = (self.stop or self.source.size) - self.pos
        while True:
            at = self.data.find(mark, start) if mark else -1
            if at >= 0:
                return at + len(mark)
            if len(self.data) >= left:
                return -1
            size = min(max(4096, 2 * len(self.data)) if mark else left, left)
            self.data = self.source.get(self.pos, size)

    def end(self) -> int:
        return self.stop


def records(source: _Bytes, wanted, payload: bool, verify: bool) -> Iterator[dict]:
    """Rows of one archive; ``wanted(row)`` sees the headers before any payload is inflated."""
    pos = 0
    while pos < source.size:
        magic = source.get(pos, 2)
        if magic == b"\r\n":
            pos += 2
            continue
        rec = (_Member if magic == b"\x1f\x8b" else _Plain)(source, pos)
        head = rec.upto(b"\r\n\r\n")
        if head < 0:
            raise ValueError(f"no WARC header at byte {pos}")
        fields = _fields(rec.data[:head])
        length = int(fields["content-length"])
        if isinstance(rec, _Plain):
            rec.stop = pos + head + length + 4
        row = {c: fields.get(h.lower()) for c, h in HEADERS.items()}
        for c in ("record_id", "refers_to"):
            row[c] = row[c].strip("<>") if row[c] else None
        row["payload_digest"] = row["payload_digest"].partition(":")[2] if row["payload_digest"] else None
        if wanted(row):
            body, size = head, length
            if fields.get("content-type", "").startswith("application/http"):
                body = rec.upto(b"\r\n\r\n", head)
                body = head + length if body < 0 else body
                http = _fields(rec.data[head:body]).get("content-length", "")
                size = int(http) if http.isdigit() else head + length - body
            row["payload_length"], row["payload"] = size, None
            if payload and row["record_type"] != "revisit":
                rec.upto(None)
                row["payload"] = rec.data[body : head + length]
                if verify and row["payload_digest"]:
                    digest = base64.b32encode(hashlib.sha1(row["payload"]).digest()).decode()
                    if digest != row["payload_digest"]:
                        raise ValueError(f"payload of {row['record_id']} doesn't match its digest")
            yield row
        pos = rec.end()


class Archive(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, verify: bool):
        self.path, self.payload, self.verify, self.tests = path, payload, verify, []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if name in HEADERS and isinstance(f, (EqualTo, In, StringStartsWith, IsNotNull)):
                self.tests.append((type(f).__name__, name, getattr(f, "value", None)))
            else:
                yield f

    def wanted(self, row: dict) -> bool:
        for kind, name, value in self.tests:
            v = row[name]
            if v is None or not (
                kind == "IsNotNull"
                or (kind == "EqualTo" and v == value)
                or (kind == "In" and v in value)
                or (kind == "StringStartsWith" and v.startswith(value))
            ):
                return False
        return True

    def partitions(self) -> Sequence[InputPartition]:
        """A partition per committed file; folders without a manifest give all their archives."""
        fs, root = _open(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=False))
        manifests = [i.path for i in found if i.base_name.startswith("_manifest-")]
        names = [i.path for i in found if re.search(r"\.warc(\.gz)?$", i.base_name)]
        if manifests:
            names = []
            for m in manifests:
                with fs.open_input_stream(m) as f:
                    names += [f"{root}/{x['name']}" for x in json.loads(f.read())]
        return [Archive(n) for n in sorted(names)] or [Archive("")]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        if not partition.value:
            return
        fs, _ = _open(self.path)
        schema = pa.schema(
            [(c, pa.string()) for c in HEADERS] + [("payload_length", pa.int64()), ("payload", pa.binary())]
        )
        rows, held = [], 0
        with fs.open_input_file(partition.value) as f:
            for row in records(_Bytes(f), self.wanted, self.payload, self.verify):
                rows.append(row)
                held += 300 + len(row["payload"] or b"")
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcDataSource(DataSource):
    """Options: ``path``; ``payload`` (default true) and ``verify`` (default false) for reads."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def _flag(self, name: str, default: str) -> bool:
        return self.options.get(name, default).lower() == "true"

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self._flag("payload", "true"), self._flag("verify", "false"))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


# ------------------------------------------------------------------------------------ operators


def _register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def write_archive(
    pages: DataFrame,
    path: str,
    key: str = "page_id",
    url: str = "url",
    payload: str = "html",
    min_bytes: int = 0,
) -> None:
    """Writes a record per row below ``path``: response, or revisit of an equal payload.

    Of equal payloads of at least ``min_bytes`` bytes the smallest key is the response, the others
    refer to it. Only digests are grouped, with map-side partial minima, and only digests that occur
    more than once are joined back.

    Null payload counts as empty; a null url leaves its header out; null keys come after all others
    and have no record id (if all keys of a payload are null, all are responses). Rows that repeat
    the smallest key are responses too. An empty table writes an empty manifest.
    """
    _register(pages.sparkSession)
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    k = F.col(key).cast("long")
    rows = pages.select(k.alias("k"), F.col(url).cast("string").alias("u"), body.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    groups = (
        pages.select(k.alias("k"), body.alias("p"))
        .where(F.octet_length("p") >= min_bytes)
        .groupBy(F.unhex(F.sha1("p")).alias("g"))
        .agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > 1) & F.col("first").isNotNull())
    )
    groups = materialise(groups, "warc-copies")  # adaptive execution can then split a hot payload's join
    rows = rows.join(groups, F.col("digest") == F.col("g"), "left")
    again = F.col("first").isNotNull() & (F.col("k").isNull() | (F.col("k") > F.col("first")))
    urn = lambda c: F.concat(F.lit(URN), F.col(c).cast("string"))
    out = rows.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        urn("k").alias("record_id"),
        F.col("u").alias("target_uri"),
        F.lit("1970-01-01T00:00:00Z").alias("warc_date"),
        _base32(F.col("digest")).alias("payload_digest"),
        F.when(again, urn("first")).alias("refers_to"),
        F.octet_length("payload").cast("long").alias("payload_length"),
        "payload",
    )
    out.write.format("warc").mode("append").option("path", path).save()


def _base32(digest):
    """Upper-case base32 of 20 bytes: eight groups of 40 bits, five bits a letter."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    parts = []
    for g in range(4):
        bits = F.conv(F.hex(F.substring(digest, 5 * g + 1, 5)), 16, 10).cast("long")
        for i in range(7, -1, -1):
            at = F.shiftright(bits, 5 * i).bitwiseAND(F.lit(31))
            parts.append(F.substring(F.lit(letters), at.cast("int") + 1, F.lit(1)))
    return F.concat(*parts)


def read_archive(spark: SparkSession, path: str, payload: bool = True, verify: bool = False) -> DataFrame:
    """Rows of all committed archives below ``path``, see ``SCHEMA``; filters are pushed down."""
    _register(spark)
    reader = spark.read.format("warc").option("payload", str(payload)).option("verify", str(verify))
    return reader.load(path)


def archive_digest(spark: SparkSession, path: str) -> DataFrame:
    """Per record: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Responses are read with their payloads, which are measured and verified against the digest; of
    revisits only the headers are read.
    """
    number = lambda c: F.substring(F.col(c), len(URN) + 1, 30).cast("long")
    shape = lambda df, size: df.select(
        number("record_id").alias("page_id"), size.cast("long").alias("payload_bytes"),
        "payload_digest", "record_type", number("refers_to").alias("refers_to"),
    )
    full = read_archive(spark, path, verify=True).where("record_type = 'response'")
    heads = read_archive(spark, path, payload=False).where("record_type = 'revisit'")
    return shape(full, F.octet_length("payload")).unionByName(shape(heads, F.col("payload_length")))

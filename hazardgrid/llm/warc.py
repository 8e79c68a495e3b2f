"""WARC archives as a PySpark Python data source.

Writing: each task writes one gzip member per record, with the member's length in the
gzip header's extra field, to a file named by its attempt; the commit lists the files
that count in a manifest, so files of lost or repeated attempts are never read.
Reading: files are packed into partitions by size; predicates on the record type and
on headers are pushed down; a record's headers are decompressed first, and where the
payload is not wanted the reader jumps to the next member by that length.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import StructType

from hazardgrid.session import stage, work_folder

#: Column -> WARC header.
HEADERS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "content_type": "Content-Type",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", content_length bigint, payload_bytes bigint, digest_ok boolean, payload binary"
#: Columns that need no more than the headers of record and HTTP message.
PAYLOAD_COLUMNS = ("payload", "digest_ok")
MANIFEST = "_warc_files.json"
PACK_BYTES = 64 << 20
ROWS_PER_BATCH = 256
_HEAD = 4096


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path inside it, for any store pyarrow knows, so nothing needs a local file."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)


def member(record: bytes) -> bytes:
    """One gzip member with its skip lengths (packed, unpacked) in an ``sl`` extra field."""
    body = zlib.compressobj(1, zlib.DEFLATED, -15)
    packed = body.compress(record) + body.flush()
    size = 10 + 2 + 12 + len(packed) + 8
    extra = struct.pack("<2sHII", b"sl", 8, size & 0xFFFFFFFF, len(record) & 0xFFFFFFFF)
    return (b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + packed
            + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF))


def record(row: dict) -> bytes:
    """A response, or a revisit that repeats only the HTTP headers."""
    payload = row["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http + (payload if row["record_type"] == "response" else b"")
    lines = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", row["date"]),
             ("WARC-Target-URI", row["target_uri"]), ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}")]
    if row["record_type"] == "revisit":
        lines += [("WARC-Refers-To", row["refers_to"]),
                  ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    lines += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in lines if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    bytes: int
    records: int


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = filesystem(self.path)
        name, total, records, out = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0, None
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                data = member(record(row))
                out.write(data)
                total += len(data)
                records += 1
        if out is None:
            return Written(None, 0, 0)
        out.close()
        return Written(name, total, records)

    def commit(self, messages: list) -> None:
        fs, root = filesystem(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{MANIFEST}", compression=None) as f:
            f.write(json.dumps({m.file: m.bytes for m in messages if m and m.file}).encode())

    def abort(self, messages: list) -> None:
        """Files without a manifest are never read; nothing to undo."""


@dataclass
class Files(InputPartition):
    names: list


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.columns = path, schema.names
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters):
        for f in filters:
            column = getattr(f, "attribute", (None,))[0]
            if column in HEADERS and isinstance(f, EqualTo):
                self.wanted[column] = self.wanted.get(column, {f.value}) & {f.value}
            elif column in HEADERS and isinstance(f, In):
                self.wanted[column] = self.wanted.get(column, set(f.value)) & set(f.value)
            elif column in HEADERS and isinstance(f, IsNotNull):
                yield f
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, root = filesystem(self.path)
        if fs.get_file_info(f"{root}/{MANIFEST}").type == pafs.FileType.File:
            with fs.open_input_stream(f"{root}/{MANIFEST}", compression=None) as f:
                files = sorted(json.loads(f.read()).items())
        else:
            files = sorted((i.base_name, i.size) for i in fs.get_file_info(pafs.FileSelector(root)) if i.base_name.endswith((".warc.gz", ".warc")))
        packs, size = [], PACK_BYTES
        for name, n in files:
            if size + n > PACK_BYTES:
                packs.append([])
                size = 0
            packs[-1].append(name)
            size += n
        return [Files(p) for p in packs] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(self.path)
        deep = any(c in self.columns for c in PAYLOAD_COLUMNS)
        schema = pa.schema([(c, pa.binary() if c == "payload" else pa.bool_() if c == "digest_ok" else pa.int64() if c in ("content_length", "payload_bytes") else pa.string())
                            for c in self.columns])
        rows: list[dict] = []
        for name in partition.names:
            with fs.open_input_file(f"{root}/{name}") as f:
                for row in self.records(f, deep):
                    rows.append(row)
                    if len(rows) == ROWS_PER_BATCH:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def records(self, f, deep: bool) -> Iterator[dict]:
        at, size = 0, f.size()
        while at < size:
            f.seek(at)
            item = Member(f, at) if f.read(2) == b"\x1f\x8b" else Plain(f, at)
            head = item.until(b"\r\n\r\n")
            fields = {}
            for line in head.split(b"\r\n")[1:]:
                k, _, v = line.partition(b":")
                fields[k.strip().decode().lower()] = v.strip().decode("utf-8", "replace")
            row = {c: fields.get(h.lower()) for c, h in HEADERS.items()}
            if row["payload_digest"]:
                row["payload_digest"] = row["payload_digest"].removeprefix("sha1:")
            length = int(fields.get("content-length") or 0)
            if all(row[c] in values for c, values in self.wanted.items()):
                row["content_length"] = row["payload_bytes"] = length
                left = length
                if (row["content_type"] or "").startswith("application/http") and length:
                    http = item.until(b"\r\n\r\n")
                    left -= len(http) + 4
                    for line in http.split(b"\r\n")[1:]:
                        if line.lower().startswith(b"content-length:"):
                            row["payload_bytes"] = int(line.split(b":")[1])
                if deep and row["record_type"] != "revisit":
                    payload = item.take(left)
                    row["payload"] = payload
                    row["digest_ok"] = row["payload_digest"] == base32_sha1(payload) if row["payload_digest"] else None
                yield {c: row.get(c) for c in self.columns}
            at = item.end(length + len(head) + 4 + 4)


class Member:
    """A gzip member that is unpacked only as far as it is asked for."""

    def __init__(self, f, at: int):
        self.f, self.at, self.data, self.used = f, at, b"", 0
        self.unzip = zlib.decompressobj(31)
        f.seek(at)
        self.raw = f.read(_HEAD)
        self.skip = None
        if self.raw[3] & 4 and self.raw[12:14] == b"sl":
            self.skip = struct.unpack("<I", self.raw[16:20])[0]
        self.position = at + len(self.raw)

    def more(self) -> bool:
        if self.unzip.eof:
            return False
        if not self.raw:
            self.f.seek(self.position)
            self.raw = self.f.read(1 << 16)
            self.position += len(self.raw)
            if not self.raw:
                return False
        self.data += self.unzip.decompress(self.raw)
        self.raw = b""
        return True

    def until(self, mark: bytes) -> bytes:
        while (i := self.data.find(mark, self.used)) < 0:
            if not self.more():
                raise ValueError("a record ends inside its headers")
        out, self.used = self.data[self.used:i], i + len(mark)
        return out

    def take(self, n: int) -> bytes:
        parts, have = [self.data[self.used:]], len(self.data) - self.used
        while have < n:
            self.data = b""
            if not self.more():
                raise ValueError("a record ends inside its payload")
            parts.append(self.data)
            have += len(self.data)
        self.data, self.used = b"".join(parts), n
        return self.data[:n]

    def end(self, unpacked: int) -> int:
        if self.skip:
            return self.at + self.skip
        while not self.unzip.eof and self.more():       # a foreign archive: find the member's end
            self.data, self.used = b"", 0
        return self.position - len(self.unzip.unused_data)


class Plain:
    """A record of an uncompressed archive."""

    def __init__(self, f, at: int):
        self.f, self.at, self.used, self.data = f, at, 0, b""

    def until(self, mark: bytes) -> bytes:
        while (i := self.data.find(mark, self.used)) < 0:
            self.f.seek(self.at + len(self.data))
            more = self.f.read(_HEAD)
            if not more:
                raise ValueError("a record ends inside its headers")
            self.data += more
        out, self.used = self.data[self.used:i], i + len(mark)
        return out

    def take(self, n: int) -> bytes:
        self.f.seek(self.at + self.used)
        return self.f.read(n)

    def end(self, unpacked: int) -> int:
        return self.at + unpacked


class WarcSource(DataSource):
    """``spark.read.format("warc")``; columns not in the given schema are not decoded."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def plan_records(df: DataFrame, id_col: str, uri_col: str, payload_col: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Columns of :func:`record` for each row; of records with equal payloads of ``min_bytes`` or more, the one with the
    largest id is the response and the others revisit it.

    A null payload is empty.  Rows that share the largest id are all responses; a row without an id is a response and
    is referred to by none.  Payloads are compared by SHA-1 and length.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(uri_col).alias("target_uri"),
                     F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("bigint"))
    shared = rows.filter(F.col("payload_bytes") >= min_bytes).groupBy("sha1", "payload_bytes").agg(
        F.count(F.lit(1)).alias("n"), F.max("id").alias("first")).filter("n > 1 AND first IS NOT NULL")
    shared = stage(shared.drop("n"), "warc-shared")
    joined = rows.join(shared, ["sha1", "payload_bytes"], "left")
    revisit = F.col("first").isNotNull() & F.col("id").isNotNull() & (F.col("id") < F.col("first"))
    uri = lambda c: F.concat(F.lit("<urn:record:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), uri(F.col("id")).alias("record_id"), F.lit(date).alias("date"),
        "target_uri", to_base32(F.col("sha1")).alias("payload_digest"), F.when(revisit, uri(F.col("first"))).alias("refers_to"),
        "payload_bytes", F.when(~revisit, F.col("payload")).alias("payload"))


def to_base32(hex_digest):
    """Upper-case base32 of a 40-digit hexadecimal text: eight groups of five digits, four letters each."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")

    def letters(i):
        value = F.conv(F.substring(hex_digest, 5 * i + 1, 5), 16, 10).cast("int")
        return [F.substring(alphabet, F.shiftright(value, 15 - 5 * k).bitwiseAND(31) + 1, F.lit(1)) for k in range(4)]

    return F.concat(*[x for i in range(8) for x in letters(i)])


def write_archives(records: DataFrame, path: str) -> None:
    register(records.sparkSession)
    records.write.format("warc").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, columns: str = SCHEMA) -> DataFrame:
    """Records below ``path``; give a shorter ``columns`` to leave payloads packed."""
    register(spark)
    return spark.read.format("warc").schema(columns).load(path)


def new_folder(spark: SparkSession) -> str:
    return f"{work_folder(spark)}/warc-{uuid.uuid4().hex}"

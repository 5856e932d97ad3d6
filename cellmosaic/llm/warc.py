"""WARC archives as a PySpark data source.

Writing makes one file per task, each record a gzip member whose extra field "sl" tells its compressed length. Reading plans
partitions by file, inflates a record's headers first, tests pushed-down predicates on them and steps over a record that fails,
or whose payload isn't asked for, without inflating the rest. Files without "sl", and plain .warc files, are read too.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from cellmosaic.llm.common import join_unique, scratch_dir

#: Payloads of fewer bytes are never replaced by a revisit.
LEAST_BYTES = 0
READ_SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to string, payload binary, truncated boolean"
WRITE_SCHEMA = "record_id string, target_uri string, payload binary, refers_to string"
_HEADER_OF = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
#: A revisit has no payload; this header keeps the length of the one it stands for.
_LENGTH = "WARC-Revisited-Payload-Length"
#: Tells a payload's length without decoding the block.
_HTTP = "WARC-HTTP-Header-Length"
_DATE = "2024-01-01T00:00:00Z"
#: Bytes that are read at a time: at first and behind a skip, and at most.
_LEAST_BLOCK, _BLOCK = 8 << 10, 4 << 20


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    """A record as one gzip member with its length in the extra field."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {_DATE}", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    plain = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    deflate = zlib.compressobj(4, zlib.DEFLATED, -15)
    body = deflate.compress(plain) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(plain)) + body + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


def page_record(record_id: str, uri: str, payload: bytes, refers_to: str | None) -> bytes:
    headers = {"WARC-Record-ID": f"<{record_id}>", "WARC-Target-URI": uri, "WARC-Payload-Digest": f"sha1:{digest(payload)}", "Content-Type": "application/http;msgtype=response"}
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers[_HTTP] = str(len(http))
    if refers_to is None:
        return record("response", headers, http + payload)
    headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<{refers_to}>", _LENGTH: str(len(payload))}
    return record("revisit", headers, http)


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"file://{path}")


class WarcWriter(DataSourceArrowWriter):
    """Each task's file has a name of its own; only files of the attempts that Spark commits are listed in the manifest."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, folder = _filesystem(self.path)
        store.create_dir(folder, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        with store.open_output_stream(f"{folder}/{name}", compression=None) as out:
            out.write(record("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))
            for batch in iterator:
                for key, uri, payload, refers_to in zip(*(batch.column(k) for k in range(4)), strict=True):
                    out.write(page_record(key.as_py(), uri.as_py() or "", payload.as_py() or b"", refers_to.as_py()))
        message = WriterCommitMessage()
        message.file = name
        return message

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = _filesystem(self.path)
        with store.open_output_stream(f"{folder}/_manifest") as out:
            out.write("".join(f"{m.file}\n" for m in messages if m).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = _filesystem(self.path)
        for m in messages:
            if m:
                store.delete_file(f"{folder}/{m.file}")


class _Bytes:
    """A file read in blocks, with skips. Blocks grow while it is read on and are small again behind a skip over unread bytes."""

    def __init__(self, stream):
        self.stream, self.size = stream, stream.size()
        self.held, self.at, self.block, self.fetched = b"", 0, _LEAST_BLOCK, 0

    def tell(self) -> int:
        return self.stream.tell() - len(self.held) + self.at

    def peek(self, n: int) -> bytes:
        """The next n bytes, fewer at the end of the file."""
        while len(self.held) - self.at < n and (more := self.stream.read(max(self.block, n - len(self.held) + self.at))):
            self.held, self.at = self.held[self.at :] + more, 0
            self.fetched += len(more)
            self.block = min(2 * self.block, _BLOCK)
        return self.held[self.at : self.at + n]

    def skip(self, n: int) -> None:
        if n <= len(self.held) - self.at:
            self.at += n
        else:
            self.stream.seek(min(self.tell() + n, self.size))
            self.held, self.at, self.block = b"", 0, _LEAST_BLOCK


def parse_headers(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}


def _length(headers: dict[str, str], name: str = "content-length", default: int = 0) -> int:
    value = headers.get(name, "")
    return int(value) if value.isdecimal() else default


class _Member:
    """A gzip member inflated a bounded piece at a time; `cut` tells that the file ends before it does."""

    def __init__(self, data: _Bytes, end: int | None):
        self.data, self.end, self.inflate, self.cut = data, end, zlib.decompressobj(31), False

    def more(self) -> bytes:
        """Some plain bytes; none at the member's end."""
        while not self.inflate.eof:
            left = _LEAST_BLOCK if self.end is None else min(_LEAST_BLOCK, self.end - self.data.tell())
            piece = self.data.peek(left)
            out = self.inflate.decompress(piece, 8 * _LEAST_BLOCK)
            # at the member's end zlib reports what is left as unused, and if it met the bound then, as unconsumed once more
            used = len(piece) - len(self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail)
            self.data.skip(used)
            if out:
                return out
            if not used and not self.inflate.eof:
                self.cut = True
                break
        return b""


def records(data: _Bytes, wanted, payloads: bool) -> Iterator[tuple[dict[str, str], bytes | None, bool]]:
    """Headers, if asked for the block, and whether the file is cut off within it, of records whose headers are wanted.

    A record that is cut off within its headers has none; a damaged member is an error.
    """
    while start := data.peek(20):
        place = data.tell()
        if start[:2] == b"\x1f\x8b":
            size = struct.unpack("<I", start[16:20])[0] if len(start) == 20 and start[3] & 4 and start[12:14] == b"sl" else 0
            member, plain = _Member(data, place + size if size else None), bytearray()
            try:
                while (end := plain.find(b"\r\n\r\n", max(0, len(plain) - 8 * _LEAST_BLOCK - 3))) < 0 and (more := member.more()):
                    plain += more
                headers = parse_headers(bytes(plain[:end])) if end >= 0 else {}
                keep, length = wanted(headers), _length(headers)
                rest, cut = plain[end + 4 :] if end >= 0 else b"", end < 0
                if size and not (keep and payloads):
                    cut |= place + size > data.size
                    data.skip(max(0, place + size - data.tell()))
                else:
                    while more := member.more():
                        if keep and payloads and len(rest) < length:
                            rest += more
                    cut |= member.cut
            except zlib.error as e:
                raise ValueError(f"damaged gzip member at byte {place}: {e}") from e
            if data.tell() <= place or (cut and size and place + size <= data.size):
                raise ValueError(f"damaged gzip member at byte {place}")
            block = bytes(rest[:length]) if payloads else None
        else:
            n = 4096
            while (end := data.peek(n).find(b"\r\n\r\n")) < 0 and len(data.peek(n)) == n:
                n *= 2
            if end < 0:
                headers, length, cut = {}, 0, True
                data.skip(data.size - data.tell())
            else:
                headers = parse_headers(data.peek(end))
                data.skip(end + 4)
                length = _length(headers)
                cut = data.tell() + length > data.size
            keep = wanted(headers)
            block = data.peek(length) if keep and payloads else None
            data.skip(length)
            while (two := data.peek(2)) in (b"\r\n", b"\r"):  # the latter at the end of a cut file
                data.skip(len(two))
        if keep:
            yield headers, block, cut


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payloads: bool):
        self.path, self.payloads, self.tests = path, payloads, []

    def pushFilters(self, filters):
        for f in filters:
            name = _HEADER_OF.get(f.attribute[0]) if len(f.attribute) == 1 else None
            if name and isinstance(f, (EqualTo, In, StringStartsWith, IsNotNull)):
                self.tests.append((name, type(f).__name__, list(f.value) if isinstance(f, In) else getattr(f, "value", None)))
            else:
                yield f

    def partitions(self):
        store, folder = _filesystem(self.path)
        manifest = store.get_file_info(f"{folder}/_manifest")
        if manifest.type == fs.FileType.File:
            with store.open_input_stream(f"{folder}/_manifest", compression=None) as f:
                names = [f"{folder}/{x}" for x in f.read().decode().split()]
        elif store.get_file_info(folder).type == fs.FileType.File:
            names = [folder]
        else:
            names = sorted(x.path for x in store.get_file_info(fs.FileSelector(folder)) if x.path.endswith((".warc", ".warc.gz")))
        return [InputPartition(x) for x in names]

    def _wanted(self, headers: dict[str, str]) -> bool:
        for name, kind, value in self.tests:
            got = _plain(headers.get(name))
            if got is None or not {"EqualTo": lambda: got == value, "In": lambda: got in value, "StringStartsWith": lambda: got.startswith(value), "IsNotNull": lambda: True}[kind]():
                return False
        return True

    def read(self, partition):
        store, _ = _filesystem(self.path)
        rows, held = [], 0
        with store.open_input_file(partition.value) as stream:
            for headers, block, cut in records(_Bytes(stream), self._wanted, self.payloads):
                rows.append((*self._row(headers, block), cut))
                held += len(block or b"")
                if len(rows) >= 5000 or held > _BLOCK:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _row(self, headers: dict[str, str], block: bytes | None) -> tuple:
        kind, length = headers.get("warc-type"), _length(headers)
        payload = None
        if kind in ("response", "revisit"):
            http = _length(headers, _HTTP.lower(), -1)
            if block is not None:
                head, _, payload = block.partition(b"\r\n\r\n")
                length = len(payload)
            elif http >= 0:
                length -= http
        if kind == "revisit":
            payload, length = None, _length(headers, _LENGTH.lower(), length)
        return (*(_plain(headers.get(_HEADER_OF[c])) for c in ("record_id", "record_type", "target_uri", "payload_digest")), length, _plain(headers.get("warc-refers-to")), payload)


def _plain(value: str | None) -> str | None:
    """A header's value without angle brackets or the name of the digest's algorithm."""
    return None if value is None else value.strip("<>").removeprefix("sha1:")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.bool_()]
    names = ["record_id", "record_type", "target_uri", "payload_digest", "payload_bytes", "refers_to", "payload", "truncated"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


class WarcSource(DataSource):
    """format("warc"): path; option payload=false leaves payloads undecoded and null.

    A file that ends within a record gives a last row with truncated true and what there is of its payload; one that ends within
    a record's headers gives a last row whose other columns are null but for payload_bytes, which is 0. Damaged bytes are an error.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def archive_pages(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> None:
    """Write a record per page (page_id, url, html) under path.

    Of pages with equal payloads of at least least_bytes the one with the largest page_id is written whole and the others as
    revisits of it; rows that share that page_id are all written whole. Null html is an empty payload, a null url an empty
    one, and a null page_id has a record id without number. Payloads are compared by SHA-256 and length.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("payload_key", F.sha2("html", 256))
    groups = rows.groupBy("payload_key", "bytes").agg(F.max("page_id").alias("whole"), F.count("*").alias("copies"))
    joined = join_unique(rows, groups, ["payload_key", "bytes"], "copies", pages.count())
    revisit = (F.col("bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("whole"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    joined.select(urn(F.col("page_id")).alias("record_id"), F.regexp_replace("url", r"[\r\n]", "").alias("target_uri"), F.col("html").cast("binary").alias("payload"), F.when(revisit, urn(F.col("whole"))).alias("refers_to")).write.format("warc").mode("append").save(path)


def read_pages(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """Page records of an archive: page_id, url, payload_bytes, payload_digest, record_type, refers_to (a page_id), payload, truncated."""
    rows = spark.read.format("warc").option("payload", str(payload).lower()).load(path).filter(F.col("record_type").isin("response", "revisit"))
    number = lambda c: F.expr(f"try_cast(substring({c}, 10) AS bigint)")
    return rows.select(number("record_id").alias("page_id"), F.col("target_uri").alias("url"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "payload", "truncated")


def op8(spark, sf_dir: str) -> DataFrame:
    register(spark)
    path = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_pages(spark, path).drop("payload", "url")

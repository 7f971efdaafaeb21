"""WARC records in ZIP-packaged web archives: a writer with revisit records and a range reader.

An archive is a ZIP file of two stored (uncompressed) members: ``archive/data.warc.gz``, one gzip member per record,
and ``indexes/index.cdxj``, one JSON line per record with its offset and length inside the first. The reader finds the
end-of-central-directory record (and the ZIP64 one where it is used), lists the central directory, locates the data of
the stored members behind their local headers, and reads index and records as byte ranges of the stored file; nothing is
extracted and no archive is loaded, so one may be of any size. One stage reads directories and indexes, and deals spans of
records over tasks, which read each record's range.

Writing shuffles each page once, to join it by digest with the smallest page_id of repeated payloads. That side is
pre-aggregated and holds repeated digests only; a hot digest is split by Spark's skew join. Archives hold at most about
``FILE_BYTES`` (or one record), which bounds the memory of a task on either side.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import io
import json
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FILE_BYTES, arrow_rows, byte_slices, shared_dir, write_blobs

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PIECE = 1 << 20  #: bytes of an index that are read at once
SPAN = 4 << 20  #: bytes of records that one row deals to a task
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header of the full payload and leaves the payload out."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}"] if url else []),
        f"WARC-Payload-Digest: sha1:{digest32(payload)}",
        *([f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return headers, rest[: int(headers["content-length"])]


def pack_archive(records: list[tuple[int | None, bytes]], zip64: bool = False) -> bytes:
    """The ZIP file of ``(page_id, gzip member)`` less its last byte: a comment of one 0x0A, which the sink appends."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.comment = b"\n"
        lines, at = [], 0
        for page_id, member in records:
            lines.append(json.dumps({"page_id": page_id, "offset": at, "length": len(member)}))
            at += len(member)
        for name, parts in ((DATA, [m for _, m in records]), (INDEX, ["\n".join(lines).encode()])):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=zip64) as f:
                for p in parts:
                    f.write(p)
    return out.getvalue()[:-1]


class ZipRanges:
    """The members of a ZIP file that is only read by ``read_at(offset, length)``."""

    def __init__(self, read_at: Callable[[int, int], bytes], size: int):
        self.read_at = read_at
        tail_at = max(0, size - 65_557)  # the record and the longest comment
        tail = read_at(tail_at, size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        while end >= 0 and end + 22 + int.from_bytes(tail[end + 20 : end + 22], "little") != len(tail):
            end = tail.rfind(b"PK\x05\x06", 0, end)
        if end < 0:
            raise ValueError("no end of central directory")
        n, length, at = struct.unpack_from("<HII", tail, end + 10)
        if end + tail_at >= 20:
            locator = read_at(tail_at + end - 20, 20)
            if locator[:4] == b"PK\x06\x07":
                where = struct.unpack_from("<Q", locator, 8)[0]
                n, length, at = struct.unpack_from("<QQQ", read_at(where, 56), 32)
        self.members: dict[str, tuple[int, int, int]] = {}  # name -> method, size, offset of the local header
        directory, i = read_at(at, length), 0
        for _ in range(n):
            if directory[i : i + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            flags, method = struct.unpack_from("<HH", directory, i + 8)
            packed, full, name_n, extra_n, comment_n = struct.unpack_from("<IIHHH", directory, i + 20)
            offset = struct.unpack_from("<I", directory, i + 42)[0]
            name = directory[i + 46 : i + 46 + name_n].decode("utf-8" if flags & 0x800 else "cp437")
            extra = directory[i + 46 + name_n : i + 46 + name_n + extra_n]
            while len(extra) >= 4:  # ZIP64 sizes, in this order, for the fields that are full
                tag, m = struct.unpack_from("<HH", extra)
                if tag == 1:
                    wide = iter(struct.unpack_from(f"<{m // 8}Q", extra, 4))
                    full = next(wide) if full == 0xFFFFFFFF else full
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    offset = next(wide) if offset == 0xFFFFFFFF else offset
                extra = extra[4 + m :]
            self.members[name] = (method, packed, offset)
            i += 46 + name_n + extra_n + comment_n

    def locate(self, name: str) -> tuple[int, int]:
        """Offset and length of a stored member's data."""
        method, size, offset = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed")
        local = self.read_at(offset, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError("broken local header")
        return offset + 30 + sum(struct.unpack_from("<HH", local, 26)), size


def indexed(read_at: Callable[[int, int], bytes], size: int) -> Iterator[tuple[int | None, int, int]]:
    """``(page_id, offset in the archive, length)`` of every indexed record. The index is read in pieces."""
    ranges = ZipRanges(read_at, size)
    data, _ = ranges.locate(DATA)
    at, left = ranges.locate(INDEX)
    rest = b""
    while left or rest:
        piece = read_at(at, min(left, PIECE))
        at, left = at + len(piece), left - len(piece)
        *lines, rest = (rest + piece).split(b"\n")
        if not left:
            lines, rest = [*lines, rest], b""
        for line in lines:
            if line.strip():
                entry = json.loads(line)
                yield entry["page_id"], data + entry["offset"], entry["length"]


def read_record(read_at: Callable[[int, int], bytes], offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Headers and block of the record in one range."""
    return parse_record(zlib.decompress(read_at(offset, length), 31))


@contextlib.contextmanager
def opened(uri: str):
    """``read_at(offset, length)`` of a stored file: local, or in any store that Arrow opens (hdfs, s3, gs, ...)."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        yield lambda at, n: f.read_at(n, at)


def _gzip(raw: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def write_archives(pages: DataFrame, path: str, revisit_from: int = 0, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> None:
    """Write a record for each row of ``pages(page_id, url, html, ...)`` to archives under ``path``.

    Of payloads that are equal and at least ``revisit_from`` bytes long, the rows with the smallest page_id are
    responses and the others revisits of it. Null html is an empty payload; null urls are left out. Rows without
    page_id revisit a payload that some page_id has, and are responses otherwise. Repeated rows give repeated records.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn(
        "digest", F.unhex(F.sha1("payload"))
    )
    long = F.length("payload") >= revisit_from
    first = rows.where(long).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.select(F.col("digest").alias("first_digest"), "first")
    joined = rows.join(first, (F.col("digest") == F.col("first_digest")) & long, "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))

    def run(batches):
        held, n = [], 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array([pack_archive(held)], pa.binary())], names=["blob"])
        for columns in byte_slices(batches, "page_id", "url", "refers", "payload", rows=64):
            for page_id, url, to, body in zip(*columns):
                member = _gzip(record(page_id, url, body, to, date))
                if held and n + len(member) > file_bytes:
                    yield flush()
                    held, n = [], 0
                held.append((page_id, member))
                n += len(member)
        if held:
            yield flush()

    write_blobs(joined.select("page_id", "url", "payload", refers.alias("refers")).mapInArrow(run, "blob binary"), "blob", path)


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Every record of the archives under ``path``: ``page_id, url, payload_bytes, payload_digest, record_type,
    refers_to`` (and ``payload``, null for revisits). Digest and length of responses are those of the bytes read.

    ``path`` is in a store that tasks can open by ranges (``opened``); no archives, or empty ones, give no rows."""
    columns = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if with_payload else "")
    names = [c.split()[0] for c in columns.split(", ")]

    def number(urn: str) -> int | None:
        text = urn.strip("<>").rpartition(":")[2]
        return int(text) if text else None

    def spans(batches):
        for paths, lengths in arrow_rows(batches, "path", "length", step=1):
            with opened(paths[0]) as read_at:
                held, size = [], 0
                for entry in indexed(read_at, lengths[0]):
                    if held and size + entry[2] > SPAN:
                        yield span(paths[0], held)
                        held, size = [], 0
                    held.append(entry)
                    size += entry[2]
                if held:
                    yield span(paths[0], held)

    def span(path, held):
        ids, at, n = (pa.array([list(x)], pa.list_(pa.int64())) for x in zip(*held))
        return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([held[0][1]], pa.int64()), ids, at, n], names=["path", "first", "ids", "at", "n"])

    def run(batches):
        for paths, ids, ats, ns in arrow_rows(batches, "path", "ids", "at", "n", step=1):
            out = []
            with opened(paths[0]) as read_at:
                for page_id, at, n in zip(ids[0], ats[0], ns[0]):
                    head, block = read_record(read_at, at, n)
                    http, _, body = block.partition(b"\r\n\r\n")
                    kind = head["warc-type"]
                    if kind == "revisit":
                        n = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        out.append((page_id, head.get("warc-target-uri"), n, head["warc-payload-digest"].removeprefix("sha1:"), kind, number(head["warc-refers-to"]), None))
                    else:
                        out.append((page_id, head.get("warc-target-uri"), len(body), digest32(body), kind, None, body if with_payload else None))
                    if len(out) == 500:
                        yield batch(out)
                        out = []
            if out:
                yield batch(out)

    def batch(rows):
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)][: len(names)], names=names)

    files = spark.read.format("binaryFile").load(path).where("length > 1").select("path", "length")  # no content is read
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = files.mapInArrow(spans, "path string, first long, ids array<long>, at array<long>, n array<long>").repartition(parts, "path", "first")
    return dealt.select("path", "ids", "at", "n").mapInArrow(run, columns)


def archive_pages(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and return the records read back."""
    path = shared_dir(pages.sparkSession, "archives")
    write_archives(pages, path, revisit_from)
    return read_archives(pages.sparkSession, path)

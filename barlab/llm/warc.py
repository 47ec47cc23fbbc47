"""WARC records in ZIP packages: writing, and range reads without extraction.

Each page is a record: a response with its payload, or, where an earlier page (smaller page_id) has an
equal payload of at least ``least`` bytes, a revisit that names that page and carries no payload. Records
are compressed one by one and laid end to end in a member of a ZIP archive; another member is an index of
page, offset and length. Members are stored, not compressed, so a record is a range of the archive.

Reading takes only ranges of an archive: the end of central directory (with its ZIP64 form), the central
directory, the members' local headers, the index, and then records by their ranges: one by one where some pages are
wanted, neighbours together up to ``SPAN`` bytes where all are; a ``catalogue`` of many archives says which hold the
wanted pages. Digests and lengths of payloads are checked
against the records' headers.

Pages with equal payloads are found by a shuffle on the payload's SHA-1: the smallest page_id of each is
a partial aggregate, joined back; a payload that a third of the pages share is an ordinary skewed join,
which Spark splits. A task streams its records into archive files of about ``ARCHIVE`` bytes in the shared folder
(any that pyarrow can open: a path or the address of a file, S3, GCS or HDFS folder), under names of its own, and
returns their list, which is kept; files of lost attempts are in no list. So any executor can read any archive.

Null html is an empty payload. Pages of a null page_id revisit others but are never revisited; all pages
that carry the smallest page_id of a payload are responses, so repeated rows are. An empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.llm.common import durable, kept, scratch

#: Bytes of records in an archive, about; of neighbouring records that are read at once.
ARCHIVE, SPAN = 256 << 20, 1 << 20
LEAST = 0
DATE = "2024-01-01T00:00:00Z"
RECORDS, INDEX = "archive/records.warc.gz", "indexes/index.cdx"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

Range = Callable[[int, int], bytes]  # (offset, length) -> bytes

# ---------------------------------------------------------------- records


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _page_uri(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def _headers(lines: list[tuple[str, str]]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in lines).encode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit if it refers to another page."""
    http = b"HTTP/1.1 200 OK\r\n" + _headers([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]) + b"\r\n"
    block = http + (payload if refers_to is None else b"")
    target = "".join(c if c > " " else f"%{ord(c):02X}" for c in url) if url else _page_uri(page_id)
    lines = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{_page_uri(page_id)}>"), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}")]
    if refers_to is not None:
        lines += [("WARC-Refers-To", f"<{_page_uri(refers_to)}>"), ("WARC-Profile", _PROFILE)]
    lines += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + _headers(lines) + b"\r\n" + block + b"\r\n\r\n"


@dataclass(frozen=True)
class Record:
    page_id: int | None
    kind: str
    payload_bytes: int
    payload_digest: str
    refers_to: int | None
    payload: bytes | None  # none in a revisit


def _fields(head: bytes) -> dict[str, str]:
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in head.decode().split("\r\n")[1:])}


def _page(uri: str) -> int | None:
    number = uri.strip("<>").rpartition(":")[2]
    return int(number) if number else None


def parse(raw: bytes) -> Record:
    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    warc = _fields(head)
    n = int(warc["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("a WARC record of another length than it says")
    http_head, _, payload = rest[:n].partition(b"\r\n\r\n")
    size, digest = int(_fields(http_head)["content-length"]), warc["warc-payload-digest"].removeprefix("sha1:")
    if warc["warc-type"] == "response" and (len(payload) != size or sha1_base32(payload) != digest):
        raise ValueError("a payload that does not match its record")
    refers = warc.get("warc-refers-to")
    return Record(_page(warc["warc-record-id"]), warc["warc-type"], size, digest, None if refers is None else _page(refers), payload if refers is None else None)


# ---------------------------------------------------------------- ZIP packages


class Package:
    """An archive written to ``stream``: records as they come, then their index (page_id, offset, length)."""

    def __init__(self, stream: BinaryIO):
        self.size, self.index = 0, io.BytesIO()
        self.zip = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED)
        self.records = self.zip.open(zipfile.ZipInfo(RECORDS), "w", force_zip64=True)

    def add(self, page_id: int | None, raw: bytes) -> None:
        self.records.write(raw)
        self.index.write(f"{'-' if page_id is None else page_id} {self.size} {len(raw)}\n".encode())
        self.size += len(raw)

    def close(self) -> None:
        self.records.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), self.index.getvalue())
        self.zip.close()


@dataclass(frozen=True)
class Member:
    name: str
    start: int  # of its local header
    size: int
    method: int


def directory(read: Range, size: int) -> list[Member]:
    """Members of the archive of ``size`` bytes, by its central directory, in ZIP64 form where it is so."""
    at = max(0, size - 22)
    tail = read(at, size - at)
    if not (tail.startswith(b"PK\x05\x06") and tail.endswith(b"\0\0")):
        at = max(0, size - 22 - 0xFFFF)  # there may be a comment behind
        tail = read(at, size - at)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(b"PK\x05\x06", 0, end)
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if at + end >= 20 and (locator := read(at + end - 20, 20)).startswith(b"PK\x06\x07"):
        (end64,) = struct.unpack_from("<Q", locator, 8)
        record64 = read(end64, 56)
        if not record64.startswith(b"PK\x06\x06"):
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<QQQ", record64, 32)
    data, members, i = read(start, length), [], 0
    for _ in range(count):
        if data[i : i + 4] != b"PK\x01\x02":
            raise ValueError("a damaged central directory")
        method = struct.unpack_from("<H", data, i + 10)[0]
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", data, i + 20)
        offset = struct.unpack_from("<I", data, i + 42)[0]
        name = data[i + 46 : i + 46 + n_name].decode()
        # ZIP64 extra field: only those of the three values that are at their limit, in this order.
        k, stop = i + 46 + n_name, i + 46 + n_name + n_extra
        while k + 4 <= stop:
            tag, n = struct.unpack_from("<HH", data, k)
            if tag == 1:
                wide = iter(struct.unpack_from(f"<{n // 8}Q", data, k + 4))
                plain, packed, offset = (next(wide) if v == 0xFFFFFFFF else v for v in (plain, packed, offset))
            k += 4 + n
        members.append(Member(name, offset, packed, method))
        i = stop + n_comment
    return members


def locate(read: Range, member: Member) -> int:
    """Offset of a stored member's data."""
    if member.method != zipfile.ZIP_STORED:
        raise ValueError(f"{member.name} is not stored")
    head = read(member.start, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no local header")
    return member.start + 30 + sum(struct.unpack_from("<HH", head, 26))


def read_records(read: Range, size: int, pages: set[int | None] | None = None, span: int = 0) -> Iterator[Record]:
    """Records of an archive by their ranges: all, or those of ``pages``; neighbours of up to ``span`` bytes together."""
    members = {m.name: m for m in directory(read, size)}
    base = locate(read, members[RECORDS])
    held: list[tuple[int, int]] = []

    def taken() -> Iterator[Record]:
        if held:
            first, last = held[0][0], sum(held[-1])
            data = read(base + first, last - first)
            for offset, length in held:
                yield parse(zlib.decompress(data[offset - first : offset - first + length], wbits=31))
            held.clear()

    for line in read(locate(read, members[INDEX]), members[INDEX].size).decode().splitlines():
        page, *where = line.split(" ")
        offset, length = map(int, where)
        if pages is not None and (None if page == "-" else int(page)) not in pages:
            continue
        if held and (sum(held[-1]) != offset or offset + length - held[0][0] > span):
            yield from taken()
        held.append((offset, length))
    yield from taken()


def gzipped(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


# ---------------------------------------------------------------- tables


def roles(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """``pages`` as (page_id, url, html, refers_to): the page that each revisits, or null."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha1", F.sha1("html"))
    first = rows.where((F.octet_length("html") >= least) & F.col("page_id").isNotNull()).groupBy("sha1").agg(F.min("page_id").alias("first"))
    refers = F.when((F.octet_length("html") >= least) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(first, "sha1", "left").select("page_id", "url", "html", refers.alias("refers_to"))


def _storage(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's address, and its path there."""
    return fs.FileSystem.from_uri(re.sub("^s3a:", "s3:", folder) if "://" in folder else f"file://{os.path.abspath(folder.removeprefix('file:'))}")


def archives(rows: DataFrame, folder: str, size: int | None = None) -> DataFrame:
    """Writes ZIP packages of the records of ``rows`` to ``folder`` and lists them: (archive, n_records, bytes)."""
    limit = ARCHIVE if size is None else size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        storage, path = _storage(folder)
        storage.create_dir(path, recursive=True)
        name, stream, package, n = "", None, None, 0

        def close() -> pa.RecordBatch:
            package.close()
            written = stream.tell()
            stream.close()
            return pa.RecordBatch.from_pydict({"archive": [name], "n_records": [n], "bytes": [written]})

        for batch in batches:
            for page, url, html, refers in zip(*(batch.column(k) for k in range(4)), strict=True):
                if package is None:
                    name, n = f"{uuid.uuid4().hex}.zip", 0
                    stream = storage.open_output_stream(f"{path}/{name}")
                    package = Package(stream)
                package.add(page.as_py(), gzipped(record(page.as_py(), url.as_py(), html.as_py().encode(), refers.as_py())))
                n += 1
                if package.size >= limit:
                    yield close()
                    package = None
        if package is not None:
            yield close()

    return durable(rows.mapInArrow(run, "archive string, n_records long, bytes long"))


READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_archives(listed: DataFrame, folder: str, pages: list[int | None] | None = None) -> DataFrame:
    """Per record of the archives ``listed`` (archive, bytes) in ``folder``, or those of a short list of pages: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    wanted = None if pages is None else set(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        storage, path = _storage(folder)
        for batch in batches:
            for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with storage.open_input_file(f"{path}/{name}") as file:
                    found = read_records(lambda offset, length, f=file: f.read_at(length, offset), size, wanted, 0 if wanted else SPAN)
                    while some := [(r.page_id, r.payload_bytes, r.payload_digest, r.kind, r.refers_to) for r in islice(found, 4096)]:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), READ, strict=True)], schema=READ)

    return listed.select("archive", "bytes").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def catalogue(listed: DataFrame, folder: str) -> DataFrame:
    """Where each page's record is, from the indexes of the archives ``listed``: (page_id, archive, at, length), kept in ranges of page_id.

    A list of pages is then looked up in a few row groups, and only the archives that hold them are opened.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        storage, path = _storage(folder)
        for batch in batches:
            for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with storage.open_input_file(f"{path}/{name}") as file:
                    read = lambda offset, length, f=file: f.read_at(length, offset)
                    members = {m.name: m for m in directory(read, size)}
                    base = locate(read, members[RECORDS])
                    rows = [line.split(" ") for line in read(locate(read, members[INDEX]), members[INDEX].size).decode().splitlines()]
                columns = [pa.array([None if page == "-" else int(page) for page, _, _ in rows], pa.int64()), pa.array([name] * len(rows), pa.string()), pa.array([base + int(at) for _, at, _ in rows], pa.int64()), pa.array([int(n) for _, _, n in rows], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "archive", "at", "length"])

    found = listed.select("archive", "bytes").mapInArrow(run, "page_id long, archive string, at long, length long")
    return kept(found.repartitionByRange("page_id").sortWithinPartitions("page_id"), "catalogue")


def _neighbours(ranges: list[tuple[int, int]], span: int) -> Iterator[list[tuple[int, int]]]:
    """``ranges`` (offset, length) in order, those that touch together, up to ``span`` bytes."""
    held: list[tuple[int, int]] = []
    for at, n in ranges:
        if held and (sum(held[-1]) != at or at + n - held[0][0] > span):
            yield held
            held = []
        held.append((at, n))
    if held:
        yield held


def read_pages(catalogued: DataFrame, folder: str, pages: DataFrame | list[int], span: int = SPAN) -> DataFrame:
    """The records of ``pages`` (ids, or a table with page_id of any size) by a ``catalogue``: as ``read_archives``, and the payload (null in a revisit).

    An archive's wanted records are read in the order of their places, neighbours together.
    """
    chosen = catalogued.where(F.col("page_id").isin(pages)) if isinstance(pages, list) else catalogued.join(pages.select(F.col("page_id").cast("long").alias("page_id")).distinct(), "page_id", "left_semi")
    schema = READ.append(pa.field("payload", pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        storage, path = _storage(folder)
        for batch in batches:
            names, at, length = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for name in dict.fromkeys(names):
                own = [(a, n) for x, a, n in zip(names, at, length, strict=True) if x == name]
                with storage.open_input_file(f"{path}/{name}") as file:
                    for together in _neighbours(own, span):
                        first, last = together[0][0], sum(together[-1])
                        data = file.read_at(last - first, first)
                        found = [parse(zlib.decompress(data[a - first : a - first + n], wbits=31)) for a, n in together]
                        rows = zip(*[(r.page_id, r.payload_bytes, r.payload_digest, r.kind, r.refers_to, r.payload) for r in found], strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    spread = chosen.select("archive", "at", "length").repartition("archive").sortWithinPartitions("archive", "at")
    return spread.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def through_archives(pages: DataFrame, least: int = LEAST, folder: str | None = None) -> DataFrame:
    """Writes archives of ``pages`` to ``folder`` (a new one in the shared folder by default) and reads them back."""
    folder = folder or f"{scratch(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_archives(archives(roles(pages, least), folder), folder)


_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {5 * k + 1}, 5))::int >> {s}) & 31), 1)" for k in range(8) for s in (15, 10, 5, 0))
#: ``through_archives`` over the table pages.
SQL = f"""
with p as (select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as h from pages),
f as (select h, min(page_id) as first from p group by h)
select p.page_id, cast(strlen(payload) as bigint) as payload_bytes, {_BASE32} as payload_digest,
  case when first is null or page_id is not distinct from first then 'response' else 'revisit' end as record_type,
  case when page_id is distinct from first then first end as refers_to
from p join f using (h)
"""

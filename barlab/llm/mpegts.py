"""Media columns as MPEG transport streams: multiplexing, and reading back.

A payload becomes elementary-stream packets (PES) of at most ``FRAME`` bytes on one PID. Each has a
presentation time on the 90 kHz clock and a header that says its length; the adaptation field of its first
packet carries the program clock, and every ``GROUP``-th starts a random-access point, marked there. Packets of 188 bytes carry continuity counters; a
program association table and a program map table, with their CRCs, come first. The last packet of a
frame is filled up by adaptation-field stuffing, so the payload comes back to the byte.

Reading parses the tables to find the stream's PID, checks sync bytes, table CRCs and continuity
counters, reassembles elementary packets and collects clocks, times and random-access points, which
``describe`` stores in the columns ``times`` and ``access``; what is damaged raises ``ValueError``. Both directions work on arrays of packets, not packet by packet.

Spark deals the rows over tasks and nothing is shuffled; streams are kept as binary rows of a Parquet
table in the shared folder. Null and empty texts are payloads of 64 zero
bytes; equal texts give equal values; repeated rows are stored each; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.llm.common import scratch

PACKET, UNIT = 188, 64
#: Payload bytes of an elementary packet, elementary packets from one random-access point to the next, ticks between them.
FRAME, GROUP, TICKS = 32_768, 8, 3600
PAT_PID, PMT_PID, STREAM_PID, PROGRAM = 0x0000, 0x1000, 0x0101, 1
# Fixed values of the format: sync byte, private data as stream type and id.
SYNC, STREAM_TYPE, STREAM_ID = 0x47, 0x06, 0xBD
_PES_HEADER = 14


def _crc_table() -> list[int]:
    table = []
    for n in range(256):
        c = n << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c >> 31 else c << 1) & 0xFFFFFFFF
        table.append(c)
    return table


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255, number >> 8, number & 255, 0xC1, 0, 0])
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0])
    return (head + section).ljust(PACKET, b"\xff")


_TABLES = _table_packet(PAT_PID, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(
    PMT_PID, _section(2, PROGRAM, (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00")
)


def _stamp(ticks: int) -> bytes:
    return bytes([0x21 | (ticks >> 29 & 0x0E), ticks >> 22 & 255, (ticks >> 14 & 254) | 1, ticks >> 7 & 255, (ticks << 1 & 254) | 1])


def _clock(ticks: int) -> bytes:
    """A program clock reference: the 90 kHz clock, six reserved bits, an extension of 0."""
    return (ticks << 15 | 0x7E00).to_bytes(6, "big")


def mux(payload: bytes) -> bytes:
    """The transport stream of ``payload``."""
    out = [_TABLES]
    counter = 0
    for k in range(-(-len(payload) // FRAME)):
        data = payload[k * FRAME : (k + 1) * FRAME]
        length, ticks = len(data) + _PES_HEADER - 6, k * TICKS & (1 << 33) - 1
        pes = b"\0\0\1" + bytes([STREAM_ID]) + length.to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(ticks) + data
        field = bytes([0x10 | 0x40 * (k % GROUP == 0)]) + _clock(ticks)  # of the first packet, without its length
        n = -(-(len(pes) + 1 + len(field)) // (PACKET - 4))
        stuffing = n * (PACKET - 4) - len(pes) - 1 - len(field)  # all in the last packet
        rows = np.empty((n, PACKET), np.uint8)
        rows[:, 0], rows[:, 1], rows[:, 2] = SYNC, STREAM_PID >> 8, STREAM_PID & 255
        rows[:, 3] = 0x10 | (counter + np.arange(n) & 15)
        rows[0, 1] |= 0x40
        rows[0, 3] |= 0x20
        counter += n
        body = np.frombuffer(pes, np.uint8)
        last = b""
        if n == 1:
            field += b"\xff" * stuffing
        elif stuffing:
            last = bytes([stuffing - 1]) + (b"\x00" + b"\xff" * (stuffing - 2) if stuffing > 1 else b"")
            rows[-1, 3] |= 0x20
        first = bytes([len(field)]) + field
        flat = np.concatenate([np.frombuffer(first, np.uint8), body])
        if last:
            at = (n - 1) * (PACKET - 4)
            flat = np.concatenate([flat[:at], np.frombuffer(last, np.uint8), flat[at:]])
        rows[:, 4:] = flat.reshape(n, PACKET - 4)
        out.append(rows.tobytes())
    return b"".join(out)


@dataclass(frozen=True)
class Stream:
    payload: bytes
    pid: int
    times: list[int]  # of each elementary packet
    access: list[int]  # numbers of the elementary packets that start random-access points
    clocks: list[int]  # the program clock's references, in 27 MHz

    def feature(self) -> str:
        """What describes the stream: its PID, elementary packets, random-access points, last time and sum of bytes."""
        return f"pid={self.pid};frames={len(self.times)};access={len(self.access)};last={self.times[-1] if self.times else -1};sum={int(np.frombuffer(self.payload, np.uint8).sum(dtype=np.int64))}"


def _sections(rows: np.ndarray, pid: np.ndarray, wanted: int) -> bytes:
    """The body of the table section on PID ``wanted``."""
    at = np.flatnonzero((pid == wanted) & (rows[:, 1] & 0x40 > 0))
    if not len(at):
        raise ValueError(f"no table on PID {wanted}")
    row = rows[at[0]].tobytes()
    start = 5 + row[4]
    length = (row[start + 1] & 15) << 8 | row[start + 2]
    section = row[start : start + 3 + length]
    if len(section) < 12 or crc32_mpeg(section):
        raise ValueError(f"the table on PID {wanted} is damaged")
    return section[8:-4]


def demux(stream: bytes) -> Stream:
    """Reads the stream of the first program's first elementary stream."""
    if len(stream) % PACKET or not stream:
        raise ValueError("not whole packets")
    rows = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (rows[:, 0] != SYNC).any():
        raise ValueError("a packet without sync byte")
    pid = (rows[:, 1].astype(np.int32) & 0x1F) << 8 | rows[:, 2]
    programs = _sections(rows, pid, PAT_PID)
    entries = [(int.from_bytes(programs[i : i + 2], "big"), int.from_bytes(programs[i + 2 : i + 4], "big") & 0x1FFF) for i in range(0, len(programs), 4)]
    mapping = _sections(rows, pid, next(p for n, p in entries if n))
    clock_pid = int.from_bytes(mapping[:2], "big") & 0x1FFF
    skip = 4 + (int.from_bytes(mapping[2:4], "big") & 0xFFF)
    wanted = int.from_bytes(mapping[skip + 1 : skip + 3], "big") & 0x1FFF

    own = rows[pid == wanted]
    if (np.diff(own[:, 3] & 15) % 16 != 1).any():
        raise ValueError("a gap in the continuity counters")
    begins = own[:, 1] & 0x40 > 0
    adapted = own[:, 3] & 0x20 > 0
    skipped = np.where(adapted, 5 + own[:, 4].astype(np.int32), 4)
    if (skipped > PACKET).any() or (len(own) and not begins[0]):
        raise ValueError("a damaged packet")
    points = adapted & (own[:, 4] > 0) & (own[:, 5] & 0x40 > 0)
    held = np.arange(PACKET) >= skipped[:, None]
    data = own[held].tobytes()
    ends = np.cumsum(PACKET - skipped)
    bounds = [*(ends - (PACKET - skipped))[begins].tolist(), len(data)]
    parts, times = [], []
    for a, b in zip(bounds, bounds[1:], strict=False):
        pes = data[a:b]
        if pes[:3] != b"\0\0\1" or int.from_bytes(pes[4:6], "big") != len(pes) - 6 or pes[7] >> 6 != 2:
            raise ValueError("a damaged elementary packet")
        t = pes[9:14]
        times.append((t[0] & 0x0E) << 29 | t[1] << 22 | (t[2] & 0xFE) << 14 | t[3] << 7 | t[4] >> 1)
        parts.append(pes[9 + pes[8] :])
    number = np.cumsum(begins) - 1
    clocked = rows[(pid == clock_pid) & (rows[:, 3] & 0x20 > 0) & (rows[:, 4] > 6) & (rows[:, 5] & 0x10 > 0)]
    clocks = [(v >> 15) * 300 + (v & 0x1FF) for v in (int.from_bytes(r[6:12].tobytes(), "big") for r in clocked)]
    return Stream(b"".join(parts), wanted, times, number[points].tolist(), clocks)


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, times array<long>, access array<int>"


def pad(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of ``UNIT``."""
    return data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b"\0")


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` as (doc_id, n_bytes, media): each whole text, padded, as a transport stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t.as_buffer().to_pybytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array([mux(pad(r)) for r in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def describe(stored: DataFrame) -> DataFrame:
    """What is read back from each transport stream of ``stored`` (doc_id, n_bytes, media)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for m in batch.column(2):
                raw = m.as_buffer().to_pybytes()
                s = demux(raw)
                rows.append((len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-UNIT:]), len(raw), hashlib.sha256(raw).hexdigest(), s.feature(), s.times, s.access))
            if rows:
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "times", "access"])

    return stored.mapInArrow(run, SCHEMA)


def through_table(docs: DataFrame, folder: str | None = None, **columns: str) -> DataFrame:
    """Stores the streams of ``docs`` as a table in ``folder`` (a new one in the shared folder by default) and describes what is read back."""
    spark = docs.sparkSession
    folder = folder or f"{scratch(spark)}/media-{uuid.uuid4().hex}"
    media(docs, **columns).write.option("compression", "zstd").parquet(folder)
    return describe(spark.read.parquet(folder))

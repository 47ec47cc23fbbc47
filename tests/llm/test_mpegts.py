import hashlib
import zlib

import numpy as np
import pytest

from barlab.llm import mpegts


@pytest.mark.parametrize("n", [0, 1, 64, 128, 150, 167, 168, 169, 170, 171, 184, 350, 352, 353, 354, 355, 32_704, 32_768, 32_769, 32_832, 300_000, 1_000_000])
def test_round_trip(n):
    payload = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    stream = mpegts.mux(payload)
    assert len(stream) % 188 == 0
    read = mpegts.demux(stream)
    frames = -(-n // mpegts.FRAME)
    assert read.payload == payload and read.pid == mpegts.STREAM_PID
    assert read.times == [k * mpegts.TICKS for k in range(frames)] and read.access == list(range(0, frames, mpegts.GROUP))
    assert read.clocks == [300 * t for t in read.times]


def test_every_padded_length_comes_back():
    for n in range(64, 64 * 60, 64):
        assert mpegts.demux(mpegts.mux(b"\x47" * n)).payload == b"\x47" * n


def test_the_headers_by_the_book():
    """Byte for byte, as ISO/IEC 13818-1 lays them out."""
    s = mpegts.mux(b"A" * 64)
    assert s[:13].hex() == "4740001000" + "00b00d0001c10000" and s[13:17].hex() == "0001f000"
    assert mpegts.crc32_mpeg(b"123456789") == 0x0376E6E7
    assert s[188:193].hex() == "4750001000"
    p = s[376:]
    assert len(p) == 188 and p[:4].hex() == "47410130" and p[5] == 0x50 and p[6:12].hex() == "000000007e00"
    assert mpegts._clock((1 << 33) - 1).hex() == "ffffffff" + "fe00"
    pes = p[5 + p[4] :]
    assert pes[:9].hex() == "000001bd" + "0048" + "848005" and pes[9:14].hex() == "2100010001" and pes[14:] == b"A" * 64


def test_times_wrap_to_33_bits():
    for t in (0, 1, 90_000, (1 << 33) - 1, 1 << 32):
        b = mpegts._stamp(t)
        assert (b[0] & 0x0E) << 29 | b[1] << 22 | (b[2] & 0xFE) << 14 | b[3] << 7 | b[4] >> 1 == t and b[0] & 1 and b[2] & 1 and b[4] & 1


def test_damage_is_seen():
    s = bytearray(mpegts.mux(bytes(5000)))
    for change in (lambda b: b.__setitem__(0, 0), lambda b: b.__setitem__(15, 9), lambda b: b.__delitem__(slice(188 * 4, 188 * 5)), lambda b: b.pop(), lambda b: b.__setitem__(slice(376, 564), b"")):
        bad = bytearray(s)
        change(bad)
        with pytest.raises(ValueError):
            mpegts.demux(bytes(bad))


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in mpegts.through_table(docs).collect()}
    for d in docs.collect():
        raw = d.text.encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(m := mpegts.mux(payload)), hashlib.sha256(m).hexdigest())
        frames = -(-len(payload) // mpegts.FRAME)
        assert r.times == [k * mpegts.TICKS for k in range(frames)] and r.access == list(range(0, frames, mpegts.GROUP))


def test_nulls_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, b"x"), (2, "", b"x"), (None, "a" * 64, b"x"), (3, "é" * 2_000_000, b"x"), (3, "é" * 2_000_000, b"x")], "doc_id long, text string, media binary")
    got = sorted(((r.n_bytes, r.payload_bytes) for r in mpegts.through_table(docs).collect()))
    assert got == [(0, 64), (0, 64), (64, 64), (4_000_000, 4_000_000), (4_000_000, 4_000_000)]
    assert mpegts.through_table(docs.limit(0)).count() == 0

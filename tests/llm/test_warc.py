import base64
import hashlib
import io
import zipfile

import duckdb
import numpy as np
import pytest

from barlab.llm import warc


def reader(data, log=None):
    def read(offset, length):
        assert 0 <= offset and offset + length <= len(data)
        if log is not None:
            log.append(length)
        return data[offset : offset + length]

    return read


def archive(pages):
    out = io.BytesIO()
    package = warc.Package(out)
    for page, url, payload, refers in pages:
        package.add(page, warc.gzipped(warc.record(page, url, payload, refers)))
    package.close()
    return out.getvalue()


PAGES = [(1, "http://a.example/x y\n", b"\r\n\r\nWARC/1.1\r\n\r\n", None), (None, None, b"", None), (2, "http://b.example", b"x" * 100_000, None), (3, "http://c.example", b"x" * 100_000, 2)]


def check(data):
    got = list(warc.read_records(reader(data), len(data)))
    assert [(r.page_id, r.refers_to, r.payload) for r in got] == [(p, t, None if t is not None else b) for p, _, b, t in PAGES]
    assert [(r.payload_bytes, r.payload_digest) for r in got] == [(len(b), base64.b32encode(hashlib.sha1(b).digest()).decode()) for _, _, b, _ in PAGES]


def test_records_come_back_by_range():
    data = archive(PAGES)
    check(data)
    log = []
    next(warc.read_records(reader(data, log), len(data)))
    assert log[-1] < 400  # the first record alone
    assert zipfile.ZipFile(io.BytesIO(data)).testzip() is None


def test_only_ranges_are_read():
    pages = [(k, "u", bytes(np.random.default_rng(k).integers(0, 256, 5000, dtype=np.uint8)), None) for k in range(500)]
    data, log = archive(pages), []
    got = list(warc.read_records(reader(data, log), len(data), {7, 300}))
    assert [r.page_id for r in got] == [7, 300] and got[1].payload == pages[300][2]
    index = warc.directory(reader(data), len(data))[1].size
    assert sum(log) < index + 2 * 6000 + 1000 < len(data) / 50
    log.clear()
    assert len(list(warc.read_records(reader(data, log), len(data), span=100_000))) == 500
    assert len(log) < 40 and max(log) <= 100_000 and sum(log) < len(data) + 1000


def test_files_are_read_by_range(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE", 20_000)
    folder = f"file://{tmp_path}/packages"
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    listed = warc.archives(warc.roles(pages), folder)
    files = {f.name: f.stat().st_size for f in (tmp_path / "packages").iterdir()}
    assert files == {r.archive: r.bytes for r in listed.collect()} and len(files) > 1
    assert sum(len(zipfile.ZipFile(tmp_path / "packages" / f).namelist()) for f in files) == 2 * len(files)
    some = [r.page_id for r in pages.limit(5).collect()]
    got, whole = warc.read_archives(listed, folder, some).collect(), warc.read_archives(listed, folder)
    assert sorted(got) == sorted(r for r in whole.collect() if r.page_id in some) and whole.count() == pages.count()


def test_zip64(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    data = archive(PAGES)
    assert b"PK\x06\x06" in data and b"PK\x06\x07" in data
    check(data)


def test_a_comment_that_looks_like_an_end():
    out = io.BytesIO(archive(PAGES))
    with zipfile.ZipFile(out, "a") as z:
        z.comment = b"PK\x05\x06 and more of it than a record has"
    check(out.getvalue())


def test_damage_is_seen():
    data = archive(PAGES)
    for bad in (data[:-3], b"", data.replace(b"PK\x01\x02", b"PK\x01\x09"), data.replace(b"PK\x03\x04", b"PK\x03\x09")):
        with pytest.raises(ValueError):
            list(warc.read_records(reader(bad), len(bad)))
    raw = warc.record(1, "u", b"abc", None)
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"abc", b"abd"))


def test_pages_and_sql(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE", 20_000)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    pages = pages.union(pages.selectExpr("page_id + 1000", "url", "html").limit(20))
    local = pages.toPandas()
    con = duckdb.connect()
    con.register("pages", local)
    got = sorted(map(tuple, warc.through_archives(pages).collect()))
    assert got == sorted(con.sql(warc.SQL).fetchall())
    assert len(got) == len(local) and sum(r[3] == "revisit" for r in got) >= 20


def test_the_shortest_payload_to_be_revisited(spark):
    pages = spark.createDataFrame([(k, "u", "é" * (k // 2)) for k in range(8)], "page_id long, url string, html string")
    got = {r.page_id: r.refers_to for r in warc.through_archives(pages, least=4).collect()}
    assert got == {0: None, 1: None, 2: None, 3: None, 4: None, 5: 4, 6: None, 7: 6}


def test_nulls_repeats_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, None, None, 0), (2, "u", "", 0), (None, "u", "", 0), (3, "u", "x" * 3_000_000, 0), (3, "u", "x" * 3_000_000, 0), (None, None, "only", 0)], "page_id long, url string, html string, sha1 int")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.through_archives(pages).collect()), key=str)
    assert got == [(1, 0, "response", None), (2, 0, "revisit", 1), (3, 3_000_000, "response", None), (3, 3_000_000, "response", None), (None, 0, "revisit", 1), (None, 4, "response", None)]
    assert warc.through_archives(pages.limit(0)).count() == 0


def test_a_catalogue_opens_only_the_archives_of_the_wanted_pages(spark, tmp_path, monkeypatch):
    r = np.random.default_rng(3)
    rows = [(k, f"http://x/{k}", "same" if k % 50 == 7 else r.bytes(1500).hex(), 1) for k in range(400)] + [(None, None, "no id", 1), (5, "http://x/5", "again", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, archive int")
    folder = str(tmp_path / "archives")
    listed = warc.archives(warc.roles(pages).repartition(8), folder, size=40_000)
    n = listed.count()
    assert n > 10
    where = warc.catalogue(listed, folder)
    assert where.count() == 402 and where.select("archive").distinct().count() == n
    whole = {}
    for x in warc.read_archives(listed, folder).collect():
        whole.setdefault(x.page_id, []).append(tuple(x))
    html = {}
    for page, _, text, _ in rows:
        html.setdefault(page, []).append(text.encode())
    for wanted in ([3], [5, 7, 57, 399, 12345], spark.createDataFrame([(k,) for k in range(0, 400, 3)], "page_id int")):
        ids = wanted if isinstance(wanted, list) else [x.page_id for x in wanted.collect()]
        got = warc.read_pages(where, folder, wanted).collect()
        assert sorted(map(str, (tuple(g)[:5] for g in got))) == sorted(str(x) for k in ids for x in whole.get(k, []))
        assert all(g.payload is None if g.record_type == "revisit" else bytes(g.payload) in html[g.page_id] for g in got)
    # Archives that hold none of the wanted pages may be gone.
    needed = {x.archive for x in where.where("page_id in (3, 8)").collect()}
    for f in (tmp_path / "archives").iterdir():
        if f.name not in needed:
            f.unlink()
    assert sorted(x.page_id for x in warc.read_pages(where, folder, [3, 8]).collect()) == [3, 8]


def test_an_empty_catalogue(spark, tmp_path):
    listed = warc.archives(warc.roles(spark.createDataFrame([], "page_id long, url string, html string")), str(tmp_path))
    assert warc.read_pages(warc.catalogue(listed, str(tmp_path)), str(tmp_path), [1]).count() == 0


def test_neighbours():
    assert list(warc._neighbours([(0, 5), (5, 5), (10, 90), (100, 1), (200, 1)], 50)) == [[(0, 5), (5, 5)], [(10, 90)], [(100, 1)], [(200, 1)]]

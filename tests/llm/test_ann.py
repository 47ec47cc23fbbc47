import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlab.llm import ann


def brute(ids, x, k=10, every=100):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        near = [j for j in np.lexsort((ids, d)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(d[j])) for j in near]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r.rank
    return out


@pytest.mark.parametrize("path", ["/root/testdata/sf0.1/embeddings.parquet", "/root/testdata/sf0.001/embeddings.parquet"])
def test_recall_and_exact_scores(spark, path):
    rows = spark.read.parquet(path)
    local = rows.toPandas()
    want = brute(local.vec_id.to_numpy(), np.stack(local.embedding.to_numpy()).astype("f8"))
    got = found(ann.search(rows))
    assert set(got) == set(want)
    hits = [len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / len(want[q]) for q in want]
    print(f"recall {np.mean(hits):.4f} of {len(hits)} queries")
    assert np.mean(hits) >= 0.9
    for q, near in got.items():
        assert len(near) == 10 and near == sorted(near, key=lambda x: (x[1], x[0]))
        exact = dict(zip(local.vec_id, np.sqrt(((np.stack(local.embedding.to_numpy()).astype("f8") - np.array(local.embedding[local.vec_id == q].iloc[0], "f8")) ** 2).sum(axis=1)), strict=True))
        assert all(s == pytest.approx(exact[v], rel=1e-12) for v, s in near)


def test_probes_come_by_falling_success_and_sum_to_enough():
    place, sigma = np.array([0.2, 3.9, -1.5]), 0.6
    cdf = lambda x: 0.5 * math.erfc(-x / math.sqrt(2))
    prob = lambda slots: math.prod(cdf((s + 1 - p) / sigma) - cdf((s - p) / sigma) for s, p in zip(slots, place, strict=True))
    got = ann.probes(place, sigma, 0.9)
    p = [prob(s) for s in got.tolist()]
    assert len({tuple(s) for s in got.tolist()}) == len(got) and p == sorted(p, reverse=True)
    assert sum(p) >= 0.9 > sum(p[:-1]) and got[0].tolist() == [0, 3, -2]


def test_a_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(ann, "GROUP_BYTES", 32 * 8 * 8)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 8))
    x[200:450] = x[0]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got, want = found(ann.search(rows)), brute(np.arange(600), x)
    assert [v for v, _ in got[0]] == list(range(200, 210)) == [v for v, _ in want[0]]
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 10 for q in want]) >= 0.9


def test_nulls_repeats_and_empty_tables(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 2.0]), (1, [1.0, 2.5]), (1, [1.0, 2.5]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0]), (8, []), (None, [1.0, 1.0]), (100, None), (200, [0.0, 1.0])]
    rows = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("bucket", F.lit("x")).withColumn("score", F.lit(1))
    got = found(ann.search(rows))
    assert {q: [v for v, _ in near] for q, near in got.items()} == {0: [1, 200], 200: [0, 1]}
    assert ann.search(rows.limit(0)).count() == 0 and ann.search(rows.where("vec_id = 0")).count() == 0


@pytest.mark.parametrize("times", [2, 40])
def test_repeated_rows_do_not_take_the_place_of_ids(spark, times):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((700, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got, want = found(ann.search(rows.crossJoin(spark.range(times).select()))), brute(np.arange(700), x)
    assert set(got) == set(want) and all(len({v for v, _ in near}) == 10 for near in got.values())
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 10 for q in want]) >= 0.9


def test_an_id_counts_once_among_the_nearest(monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 50)
    ids = np.append(np.repeat(np.arange(5), 60), np.arange(5, 20))
    x = np.append(np.repeat(np.arange(5.0), 60) + np.tile(np.arange(60) / 100, 5), np.arange(5.0, 20))[:, None]
    near, score = ann.nearest(ids, x, np.zeros(1), 10)
    assert near.tolist() == list(range(10)) and score.tolist() == list(map(float, range(10)))


def clusters(rng):
    """Crowds of four densities, far apart."""
    centres = rng.standard_normal((4, 8)) * 300
    return np.concatenate([c + rng.standard_normal((300, 8)) * spread for c, spread in zip(centres, (0.01, 0.3, 4, 50), strict=True)])


def outliers(rng):
    x = rng.standard_normal((1200, 8))
    x[0] += 40
    x[100] += 400
    return x


def crowd(rng):
    """92 % of the rows are one vector, two queries are outside of it."""
    x = rng.standard_normal((1200, 8))
    crowd = rng.random(1200) < 0.92
    crowd[[100, 700]] = False
    x[crowd] = x[crowd.argmax()]
    return x


MADE = {"clusters": (clusters, 1), "outliers": (outliers, 1), "crowd": (crowd, 1), "each row 40 times": (lambda rng: rng.standard_normal((400, 8)), 40)}


def complete(got, ids, x):
    """Every query has ten ids, and nearly all of them the right ones; of equal distances, any."""
    want = brute(ids, x)
    assert set(got) == set(want)
    hits = []
    for q, near in got.items():
        assert len({v for v, _ in near}) == len(near) == 10
        last = want[q][-1][1]
        hits.append(np.mean([s <= last * (1 + 1e-12) for _, s in near]))
    assert np.mean(hits) >= 0.9
    return np.mean(hits)


@pytest.mark.parametrize("name", MADE)
@pytest.mark.parametrize("exact", [1024, 0])
def test_every_query_gets_its_neighbours(spark, monkeypatch, name, exact):
    # Without queries that are held against all rows, those left are asked again until all answers hold.
    monkeypatch.setattr(ann, "EXACT", exact)
    make, times = MADE[name]
    x = make(np.random.default_rng(5))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = found(ann.search(rows.crossJoin(spark.range(times).select())))
    assert complete(got, np.arange(len(x)), x) >= 0.9
    if name == "outliers":
        want = brute(np.arange(len(x)), x)
        assert [v for v, _ in got[0]] == [v for v, _ in want[0]] and [v for v, _ in got[100]] == [v for v, _ in want[100]]


def test_an_id_often_beside_a_query(spark):
    x = np.random.default_rng(6).standard_normal((1000, 8))
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, (x[0] + 1e-3 * k).tolist()) for k in range(60)]
    got = found(ann.search(spark.createDataFrame(data, "vec_id long, embedding array<double>")))
    assert len(got) == 11 and all(len({v for v, _ in near}) == 10 for near in got.values())
    assert got[0][0][0] == 5000 and [v for v, _ in got[0][1:]] == [v for v, _ in brute(np.arange(1000), x)[0][:9]]


def test_slices_of_queries_meet_all_of_a_group(spark, monkeypatch):
    x = np.random.default_rng(7).standard_normal((900, 6))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    hashes = ann.Hashes.draw(6, 1.0, 3)
    whole = found(ann.search(rows, every=3, hashes=hashes))
    monkeypatch.setattr(ann, "ASKED", 20)
    assert found(ann.search(rows, every=3, hashes=hashes)) == whole and len(whole) == 300


def test_fewer_ids_than_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "EXACT", 0)
    x = np.random.default_rng(8).standard_normal((400, 4))
    rows = spark.createDataFrame([(100 * (i % 3), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert {q: {v for v, _ in near} for q, near in found(ann.search(rows)).items()} == {0: {100, 200}, 100: {0, 200}, 200: {0, 100}}


def test_vectors_of_one_query_share_its_neighbours():
    parts = [(np.full(3, 7), np.array([1, 2, 3]), np.array([0.1, 0.5, 0.6])), (np.full(3, 7), np.array([2, 4, 5]), np.array([0.2, 0.5, 0.5])), (np.full(1, 0), np.array([9]), np.array([3.0]))]
    got = ann._found(parts, 3)
    assert list(zip(*(got[c].tolist() for c in ("query_id", "vec_id", "score")), strict=True)) == [(0, 9, 3.0), (7, 1, 0.1), (7, 2, 0.2), (7, 4, 0.5)]
    assert ann._found([], 3)["score"].tolist() == [] and ann._found(parts[:1], 3)["vec_id"].tolist() == [1, 2, 3]

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlab.llm import toxicity


def test_features_are_the_ngrams_of_each_text():
    texts = ["Ab  cd", None, "", "ab cd", "x" * 7, "ñandú\0b"] * 3
    found = {i: set() for i in range(len(texts))}
    for doc, bucket in toxicity.features(texts):
        for d, b in zip(doc.tolist(), bucket.tolist(), strict=True):
            assert b not in found[d]
            found[d].add(b)
    assert found[0] == found[3] and found[0] and not found[1] and not found[2]
    assert len(found[0]) == 5 + 4 + 3 and len(found[4]) == 3 * 3
    alone = {int(b) for _, bucket in toxicity.features(["ñandú b"]) for b in bucket}
    assert found[5] == alone == found[11]


@pytest.mark.parametrize("chunk", [7, 50, 10**9])
def test_chunks_do_not_matter(monkeypatch, chunk):
    monkeypatch.setattr(toxicity, "CHUNK", chunk)
    texts = [f"text number {i} of some" for i in range(40)]
    model = toxicity.Model(np.arange(0, toxicity.BUCKETS, 3), np.sin(np.arange(0, toxicity.BUCKETS, 3)), 0.1)
    assert np.allclose(toxicity.score_texts(texts, model), [toxicity.score_texts([t], model)[0] for t in texts])


def plain_features(text):
    """The buckets of a text's n-grams, one n-gram after the other."""
    words = (text or "").replace("\0", " ").lower().split()
    padded, found = f" {' '.join(words)} " if words else "", set()
    for n in toxicity.ORDERS:
        for at in range(len(padded) - n + 1):
            h = 0
            for k, c in enumerate(padded[at : at + n]):
                h = (h * 0x01000193 & 0xFFFFFFFF) ^ ord(c) if k else ord(c)
            found.add(((h ^ h >> 15) * 0x9E3779B1 & 0xFFFFFFFF) >> 12)
    return found


def plain_model(rows):
    """Selected buckets with their ratios from (label, text) pairs, by definition."""
    held = [(y, plain_features(t)) for y, t in rows]
    n1 = sum(y for y, _ in held)
    n0 = len(held) - n1
    p, q = (Counter(b for y, own in held if y == k for b in own) for k in (1, 0))
    z = {}
    for b in set(p) | set(q):
        rate = (p[b] + q[b]) / (n1 + n0)
        z[b] = abs(p[b] / n1 - q[b] / n0) / math.sqrt(max(rate * (1 - rate), 1e-9) * (1 / n1 + 1 / n0))
    best = sorted(sorted(b for b in z if z[b] > toxicity.Z_MIN), key=lambda b: -z[b])[: toxicity.MAX_FEATURES]
    sums = [sum(c.values()) + toxicity.BUCKETS for c in (p, q)]
    return {b: math.log((p[b] + 1) / sums[0]) - math.log((q[b] + 1) / sums[1]) for b in best}, n1, n0


def test_features_counts_selection_and_ratios_by_brute_force(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    for text in ("Ab  cd", "", "ñandú\0b", "x" * 9, "\U0001f600 ok"):
        assert {int(b) for _, own in toxicity.features([text]) for b in own} == plain_features(text)
    label = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    rows = [(label[r.doc_id], r.text) for r in docs.collect() if r.doc_id in label]
    assert sorted(map(tuple, toxicity.sample(docs, labels).collect())) == sorted(rows)
    want, n1, n0 = plain_model(rows)
    buckets, ratio, *numbers = toxicity.select_buckets(toxicity.sample(docs, labels))
    assert numbers == [n1, n0] and buckets.tolist() == sorted(want) and len(want) > 20
    assert np.allclose(ratio, [want[b] for b in sorted(want)])
    model = toxicity.fit(docs, labels)
    assert model.buckets.tolist() == sorted(want)
    weight = dict(zip(model.buckets.tolist(), model.weights.tolist(), strict=True))
    got = {r.doc_id: r.score for r in toxicity.scores(docs, model).collect()}
    for r in docs.collect():
        z = model.bias + sum(weight.get(b, 0.0) for b in plain_features(r.text))
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_descent_finds_the_minimum():
    rng = np.random.default_rng(2)
    x = (rng.random((300, 12)) < 0.3) * rng.normal(size=12)
    y = (rng.random(300) < 1 / (1 + np.exp(-2 * x.sum(axis=1)))).astype(float)
    indptr, feature = np.append(0, np.cumsum((x != 0).sum(axis=1))), np.concatenate([np.flatnonzero(r) for r in x])
    scale = np.abs(x).max(axis=0) * np.sign(x.sum(axis=0))
    full = np.column_stack([x, np.ones(300)])
    ridge = 1e-2 * np.append(np.ones(12), 0)

    def loss(theta):
        z = full @ theta
        return np.mean(np.logaddexp(0, z) - y * z) + 0.5 * (ridge * theta**2).sum()

    best = np.zeros(13)
    for _ in range(50):  # Newton's method
        mean = 1 / (1 + np.exp(-full @ best))
        best -= np.linalg.solve(full.T @ (full * (mean * (1 - mean))[:, None]) / 300 + np.diag(ridge), full.T @ (mean - y) / 300 + ridge * best)
    weights, bias = toxicity._descend(indptr, feature, scale, y, 1e-2, 2000)
    assert np.allclose(np.append(weights, bias), best, atol=1e-3)
    usual = np.append(*toxicity._descend(indptr, feature, scale, y, 1e-2, 120))
    assert loss(usual) < 1.01 * loss(best)


def test_an_id_of_many_rows_counts_once_and_the_scan_keeps_its_tasks(spark):
    docs = spark.range(4000, numPartitions=40).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(4000)], "doc_id long, toxic int")
    rows = toxicity.sample(docs, labels)
    ids = [7, *range(3000, 4000)]
    assert rows.count() == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in ids)
    assert "Coalesce" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert [r.text for r in rows.where("text < 'text 3000'").collect()] in ([], ["text 0"])


def test_without_a_classifier_nothing_is_rejected(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    for few in (labels.limit(0), labels.where("toxic = 1"), labels.where("toxic = 0"), labels.withColumn("doc_id", F.col("doc_id") + 10**9)):
        assert toxicity.reject(docs, toxicity.fit(docs, few)).count() == docs.count()


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = {r.doc_id: r for r in toxicity.scores(docs, toxicity.fit(docs, labels)).collect()}
    known = [(scored[r.doc_id], r.toxic) for r in labels.collect()]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r, _ in known)
    test = [(r.score, r.predicted, y) for r, y in known if r.held_out]
    pos, neg = [s for s, _, y in test if y], [s for s, _, y in test if not y]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    caught, wrong = np.mean([p for _, p, y in test if y]), np.mean([p for _, p, y in test if not y])
    print(f"area under the curve {auc:.4f}, caught {caught:.3f}, clean rejected {wrong:.4f}, of {len(pos)} and {len(neg)}")
    assert auc > 0.9 and wrong < 0.05


def test_nulls_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, f"you are a scumbag {i}" if i % 2 else f"have a fine day {i}", i) for i in range(80)] + [(None, None, 0), (3, "", 0), (3, "", 0)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(1, None), (None, 1), (900, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.scores(docs, model).collect()
    assert len(got) == 83 and all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id != 3)
    empty = [r.score for r in got if r.doc_id in (None,)]
    assert all(0 <= s <= 1 for s in empty)
    assert toxicity.reject(docs, model).columns == docs.columns
    for few in (labels.limit(0), labels.where("toxic = 1")):
        assert len({r.score for r in toxicity.scores(docs, toxicity.fit(docs, few)).collect()}) == 1
    assert toxicity.scores(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0

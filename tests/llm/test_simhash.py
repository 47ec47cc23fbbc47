import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barlab.llm import simhash


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius=4):
    """[(id, fp)] -> id -> least id reachable."""
    fps = np.array([fp for _, fp in prints], np.int64).view(np.uint64)
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[:i]) <= radius):
            a, b = root(i), root(int(j))
            parent[a] = b
    least = {}
    for i, (d, _) in enumerate(prints):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: least[root(i)] for i, (d, _) in enumerate(prints)}


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aAbÉé \t\n\x0b\x1c\xa0"), max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_print(text)


def test_long_text():
    text = "one two three four five six " * 30_000
    assert simhash.fingerprint(text) == brute_print(text)


def near(n, seed):
    """Random fingerprints, some with near ones, chains and a crowd about one centre."""
    rng = np.random.default_rng(seed)
    fps = [int(x) for x in rng.integers(0, 1 << 64, n, dtype=np.uint64)]
    for k in range(n // 2):
        x = fps[int(rng.integers(len(fps)))]
        for b in rng.choice(64, int(rng.integers(1, 6)), replace=False):
            x ^= 1 << int(b)
        fps.append(x)
    centre = fps[0]
    for _ in range(n // 2):
        x = centre
        for b in rng.choice(64, int(rng.integers(1, 4)), replace=False):
            x ^= 1 << int(b)
        fps.append(x)
    fps += [0, 0, (1 << 64) - 1]
    return [(i, simhash._signed(x)) for i, x in enumerate(fps)]


def test_components(spark):
    for seed, kwargs in ((1, {}), (2, {"tree": 40}), (3, {"blocks": 6, "tree": 64, "shard": 50}), (4, {"blocks": 8, "shard": 4}), (5, {"shard": 1})):
        prints = near(400, seed)
        got = simhash.components(spark.createDataFrame(prints, "doc_id long, fp long"), **kwargs)
        assert {r.doc_id: r.component_id for r in got.collect()} == brute_components(prints)


def test_tree_finds_all_within_the_radius():
    rng = np.random.default_rng(5)
    items = np.unique(np.concatenate([rng.integers(0, 1 << 10, 500, dtype=np.uint64), rng.integers(0, 1 << 64, 500, dtype=np.uint64)]))
    found = {(i, int(q)) for i, at in simhash.BKTree(items).search(items, 3) for q in at}
    assert found == {(i, j) for i in range(len(items)) for j in np.flatnonzero(np.bitwise_count(items[i] ^ items) <= 3)}


def test_shards_lose_no_link():
    rng = np.random.default_rng(8)
    for n in (10, 3000, 10**5, 10**7, 10**9, 10**13):
        shards = simhash._shards(n, 4)
        assert len(shards) <= 1820 and (n > 10**9 or len(shards) <= 35)
        assert n >> min(mask.bit_count() for _, mask in shards) <= simhash.SHARD
        for _ in range(300):
            flips = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(flips & mask == 0 for _, mask in shards)


def test_trees_have_nodes_and_prune_edges(spark):
    """Of sf0.1, shard by shard as ``links`` deals them: trees have inner nodes, and queries meet a part of them."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect()]
    fps = np.unique(np.array([simhash.fingerprint(t) for t in texts], np.uint64))
    stats, pairs, whole, inner = {}, 0, 0, 0
    for _, mask in simhash._shards(len(fps), 4)[:2]:
        agreed = fps & np.uint64(mask)
        for value in np.unique(agreed):
            items = fps[agreed == value]
            tree = simhash.BKTree(items)
            whole, pairs, inner = whole + len(items), pairs + len(items) ** 2, inner + len(items) * isinstance(tree.root, tuple)
            found = sum(len(near) for _, near in tree.search(items, 4, stats))
            assert found == sum((np.bitwise_count(x ^ items) <= 4).sum() for x in items)
    assert inner > 0.99 * whole and pairs / whole > 500
    assert stats["inner"] > 0.2 * stats["leaf"] and stats["pruned"] > 0.1 * pairs
    assert stats["inner"] + stats["leaf"] < 0.3 * pairs


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.collect()
    prints = [(r.doc_id, simhash._signed(brute_print(r.text))) for r in rows]
    want = brute_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {d: (f"{fp & (1 << 64) - 1:016x}", want[d]) for d, fp in prints}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(5, None, 1), (4, "", 2), (None, "one two three four five", 3), (7, "one two three four five", 3), (7, "one two three four five", 3), (None, "other words of a text here", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int").withColumn("row_key", F.lit(9))
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == [(4, 4), (5, 4), (7, 7), (7, 7), (None, 7), (None, None)]
    assert sorted(((r.doc_id, r.fp, r.row_key) for r in simhash.keep_one(docs).collect()), key=str) == [(4, 2, 9), (7, 3, 9), (None, 4, 9)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


def test_rows_that_differ_in_where_a_null_is(spark):
    """A row is not its hash: each component keeps one, whatever its nulls and the names and types of its columns."""
    text = "one two three four five six"
    rows = [(None, None, "en", 1, {"a": 1}), (None, "en", None, 1, {"a": 1}), (3, text, None, 1, None), (3, text, "en", 1, {"b": 2}), (3, None, text, 1, None), (4, text + " seven", None, 2, {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, `a.b` int, `row_key` map<string, int>")
    component = brute_components([(k, simhash._signed(brute_print(r[1]))) for k, r in enumerate(rows)])
    kept = simhash.keep_one(docs)
    assert kept.schema.names == docs.schema.names
    got = [tuple(r) for r in kept.collect()]
    assert len(got) == len(set(component.values())) == 4
    assert sorted(str(g[1]) for g in got) == ["None", "en", text, text + " seven"]
    assert all(g in [tuple(r) for r in rows] for g in got)
    assert sorted(map(str, got)) == sorted(str(tuple(r)) for r in simhash.keep_one(docs.repartition(5)).collect())

"""The pipeline's stages one by one, each against a brute-force version on what the stage before kept."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_mixing import size
from test_packing import check, ids
from test_pii import brute
from test_simhash import brute_components, brute_print

import __spark_entry__
import corpus_pipeline
from barlab.llm import mixing, simhash, toxicity


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # Also copies under other ids, a repeated row, a null text and an empty one.
    more = [docs.limit(5).withColumn("doc_id", F.col("doc_id") + 10_000), docs.limit(1), docs.limit(1).withColumns({"doc_id": F.lit(20_000).cast("long"), "text": F.lit(None).cast("string")}), docs.limit(1).withColumns({"doc_id": F.lit(20_001).cast("long"), "text": F.lit("")})]
    for m in more:
        docs = docs.unionByName(m)
    kept = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], sf_dir).write.parquet(f"{folder}/{k}")
        kept.append(spark.read.parquet(f"{folder}/{k}"))
    return kept


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_all_but_the_last_keep_the_columns(stages):
    assert all(sorted(df.columns) == sorted(stages[0].columns) for df in stages[:-1])


def test_toxic_documents_go(spark, sf_dir, stages):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(stages[0], labels)
    before = stages[0].collect()
    keep = toxicity.score_texts([r.text for r in before], model) < 0.3
    assert rows(stages[1]) == Counter(tuple(r) for r, k in zip(before, keep, strict=True) if k) and not keep.all()


def test_one_of_each_group_stays(stages):
    before = stages[1].collect()
    component = brute_components([(r.doc_id, simhash._signed(brute_print(r.text))) for r in before])
    after = stages[2].collect()
    assert sorted(r.doc_id for r in after) == sorted(set(component.values()))
    assert set(map(tuple, after)) <= set(map(tuple, before))


def test_personal_data_is_replaced(stages):
    before, after = ({r.doc_id: r for r in df.collect()} for df in stages[2:4])
    assert set(before) == set(after)
    for d, r in after.items():
        found = brute(before[d].text or "")
        assert (r.text == before[d].text) == (not found)
        assert not found or brute(r.text) == [] or len(brute(r.text)) < len(found)
        assert r.n_chars == (None if r.text is None else len(r.text))


def test_sources_are_mixed_to_their_targets(stages):
    want = {r.doc_id: r for r in mixing.mixture(stages[3]).collect()}
    got = defaultdict(int)
    for r in stages[4].collect():
        got[r.doc_id] += size(r.text)
    assert got == {d: r.taken for d, r in want.items() if r.taken}


def test_all_tokens_are_packed(stages):
    want = defaultdict(list)
    for r in stages[4].collect():
        want[r.doc_id].append(np.append(ids(r.text), 0).astype("<u4"))
    check(stages[5].collect(), want)


def test_registered_and_whole(spark, sf_dir):
    assert __spark_entry__.queries()["pipeline"] and corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def through(spark, docs, labels, folder):
    """The tables after each stage, as ``run`` makes them of tables in a folder."""
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    kept = [spark.read.parquet(f"{folder}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], str(folder)).write.parquet(f"{folder}/{k}")
        kept.append(spark.read.parquet(f"{folder}/{k}"))
    return kept


def test_empty_tables(spark, sf_dir, tmp_path):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0) for t in ("documents", "labels"))
    kept = through(spark, docs, labels, tmp_path)
    assert [df.count() for df in kept] == [0] * 6 and all(sorted(df.columns) == sorted(docs.columns) for df in kept[:-1])


@pytest.mark.parametrize("case", ["no labels", "null ids", "clashing names"])
def test_nothing_is_lost_in_silence(spark, sf_dir, tmp_path, case):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    more = ("row_key", "part", "at", "toxic", "label", "doc", "size", "fp", "copy", "taken", "h", "length")
    if case == "no labels":
        labels = labels.limit(0)
    elif case == "null ids":
        docs = docs.withColumn("doc_id", F.lit(None).cast("long"))
    else:
        docs = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in more})
    kept = through(spark, docs, labels, tmp_path)
    n = [df.count() for df in kept]
    if case != "clashing names":
        # No label matches, so no document is rejected.
        assert n[1] == n[0]
    assert n[0] >= n[1] > 0 and 0 < n[2] <= n[1] and n[3] == n[2] and n[4] > 0 and n[5] >= n[4]
    texts = lambda df: {r.text for r in df.select("text").collect()}
    assert texts(kept[2]) <= texts(kept[1]) and sorted(kept[4].columns) == sorted(docs.columns)
    components = brute_components([(k, simhash._signed(brute_print(r.text))) for k, r in enumerate(kept[1].collect())])
    assert n[2] == len(set(components.values()))
    if case == "clashing names":
        assert all(r[c] == f"{c}{r.doc_id}" for r in kept[4].collect() for c in more)


def test_rows_with_nulls_in_different_columns_all_count(spark, sf_dir):
    rows = [(None, None, "en", "a", 1), (None, "en", None, "a", 1), (None, "en", "a", None, 1), (None, None, None, "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()
    assert sorted(str(r.text) for r in got) == ["None", "en"] and all(tuple(r) in rows for r in got)

"""A training corpus from documents, in stages; each is written as Parquet and read again by the next.

Toxic documents go, one document of each group of near-duplicates stays, personal data is replaced by
tags, sources are mixed to their target weights along the curriculum, and token sequences are packed.

All stages but the last keep the columns of documents, further ones too, whatever their names. An empty table
gives an empty result at every stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from barlab.llm import mixing, packing, pii, simhash, toxicity
from barlab.llm.common import scratch, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects; trained on the labels, all but those held out.

    Null and empty texts score like texts without features. Rows that repeat a document are kept or rejected alike.
    Without labels of both classes, or with labels of other documents, there is no classifier and all rows stay.
    """
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked fingerprints: that of the least doc_id, nulls last.

    Null and empty texts are one group, as their fingerprint is the same. Of repeated rows one stays.
    """
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by tags; n_chars follows the text, and is null where it is null. All rows stay."""
    return pii.redact_pii(docs, length_col="n_chars")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order; n_chars follows the text.

    Null and empty texts have no words and are never taken; a null source is a source. Rows that share an id are
    dealt each.
    """
    return mixing.curriculum(docs, length_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens with their sequences and offsets; a null or empty text is its closing id alone."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxic),
    ("simhash near-dedup", near_duplicates),
    ("pii", personal_data),
    ("mixing", mix),
    ("best-fit packing", pack),
]

#: The classifier and the packing plan have no form in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{scratch(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}

"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the n-grams of ``ORDERS`` characters that occur in a text (lower case, white space as one
space), hashed to ``BUCKETS``; presence counts, not frequency. Over labelled texts the log-count ratio

    r = log((p + 1) / sum(p + 1)) - log((q + 1) / sum(q + 1))

of each bucket compares its document counts among toxic (p) and other (q) texts. Buckets whose rates
differ by over ``Z_MIN`` standard errors enter, scaled by r, a logistic regression with an L2 penalty.

Training reads a bounded sample: at most about ``MAX_LABELLED`` labelled rows, chosen by a hash of the
id, each id once (with the least of its texts); only ids and labels of that sample are broadcast. Documents
are scanned by as many tasks as they have partitions; only the sample is shuffled. Counts, tests and the choice of features are Spark
aggregates; the sample's rows come to the driver as the few selected features that they hold. Scoring
covers every whole text, in tasks, without a shuffle.

Null and empty texts score like a text without features. Labels of a repeated id count as toxic if any
does; null labels and labels without a text are ignored. Without both classes among the labels, the
score is the smoothed share of toxic labels for every text; likewise where no bucket differs enough. Such a
model tells no texts apart, so ``reject`` rejects nothing by it. An empty table gives an empty result; repeated rows are scored alike; further columns are ignored by ``scores`` and kept by ``reject``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlab.llm.common import durable

ORDERS = (3, 4, 5)
BUCKETS = 1 << 20
MAX_LABELLED = 20_000
MAX_FEATURES = 1 << 12
Z_MIN = 4.0
#: Partitions of the sample.
TASKS = 16
#: Characters hashed at once.
CHUNK = 200_000


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learned: crc32 of the id as text has remainder 2 by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, normalized texts) in runs of about ``CHUNK`` characters; a longer text comes alone."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        plain = " ".join((text or "").replace("\0", " ").lower().split())
        if held and size + len(plain) > CHUNK:
            yield first, held
            first, held, size = i, [], 0
        held.append(f" {plain} " if plain else "")
        size += len(plain)
    if held:
        yield first, held


def _ngrams(held: list[str], keep: np.ndarray | None) -> np.ndarray:
    """index * BUCKETS + bucket of the n-grams of each text, each once, sorted."""
    gap = "\0" * max(ORDERS)
    codes = np.frombuffer((gap.join(held) + gap).encode("utf-32-le"), "<u4")
    starts = np.cumsum([0] + [len(t) + len(gap) for t in held[:-1]])
    inside = codes != 0
    rolled, found = codes, []
    for n in range(2, max(ORDERS) + 1):
        rolled = rolled[:-1] * np.uint32(0x01000193) ^ codes[n - 1 :]
        if n not in ORDERS:
            continue
        mixed = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x9E3779B1)
        bucket = mixed >> np.uint32(32 - BUCKETS.bit_length() + 1)
        # Gaps are as long as the longest n-gram, so one that touches a gap starts or ends in it.
        at = inside[: len(bucket)] & inside[n - 1 :]
        at = np.flatnonzero(at & keep[bucket] if keep is not None else at)
        found.append((np.searchsorted(starts, at, "right") - 1) * np.int64(BUCKETS) + bucket[at])
    return np.unique(np.concatenate(found))


def features(texts: list[str | None], keep: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (index of the text, bucket), each once; only buckets that ``keep`` marks, if it is given."""
    for first, held in _chunks(texts):
        if len(held) == 1:
            # Pieces of a long text overlap by what an n-gram may need of the next.
            text = held[0]
            pairs = np.unique(np.concatenate([_ngrams([text[k : k + CHUNK + max(ORDERS) - 1]], keep) for k in range(0, max(1, len(text)), CHUNK)]))
        else:
            pairs = _ngrams(held, keep)
        yield first + (pairs >> (BUCKETS.bit_length() - 1)), pairs & (BUCKETS - 1)


@dataclass(frozen=True)
class Model:
    """Weights of the selected buckets, sorted by bucket, with the log-count ratios multiplied in."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float


@lru_cache(maxsize=2)
def _dense(buckets: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    b = np.frombuffer(buckets, np.int64)
    w, keep = np.zeros(BUCKETS), np.zeros(BUCKETS, bool)
    w[b], keep[b] = np.frombuffer(weights), True
    return w, keep


def score_texts(texts: list[str | None], model: Model) -> np.ndarray:
    weights, keep = _dense(model.buckets.tobytes(), model.weights.tobytes())
    z = np.full(len(texts), model.bias)
    for doc, bucket in features(texts, keep):
        z += np.bincount(doc, weights[bucket], len(texts))
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def sample(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(label, text) of at most about ``bound`` labelled documents that are not held out."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
    share = min(1.0, bound / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < int(share * (1 << 30)))
    # Broadcast: some `bound` rows of an id and a label, whatever the input's size.
    rows = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), id_col)
    # An id that many rows carry comes once, so the bound holds for rows; within a task first, so it is not shuffled.
    return rows.groupBy(id_col).agg(F.first("label").alias("label"), F.min("text").alias("text")).select("label", "text")


def select_buckets(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """The buckets whose rates differ most, sorted, with their log-count ratios; numbers of toxic and other rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            label = batch.column(0).to_numpy(zero_copy_only=False)
            for doc, bucket in features(batch.column(1).to_pylist()):
                for k in (0, 1):
                    counts[k] += np.bincount(bucket[label[doc] == k], minlength=BUCKETS)
        held = np.flatnonzero(counts.any(axis=0))
        for at in np.array_split(held, 16):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[1][at]), pa.array(counts[0][at])], ["bucket", "p", "q"])

    by_label = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n1, n0 = by_label.get(1, 0), by_label.get(0, 0)
    if not (n0 and n1):
        return np.zeros(0, np.int64), np.zeros(0), n1, n0
    counts = durable(rows.mapInArrow(run, "bucket long, p long, q long").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("q").alias("q")))
    total = counts.agg(F.sum("p"), F.sum("q")).first()
    rate = (F.col("p") + F.col("q")) / (n1 + n0)
    z = F.abs(F.col("p") / n1 - F.col("q") / n0) / F.sqrt(F.greatest(rate * (1 - rate), F.lit(1e-9)) * (1 / n1 + 1 / n0))
    best = sorted(counts.withColumn("z", z).where(F.col("z") > Z_MIN).orderBy(F.desc("z"), "bucket").limit(MAX_FEATURES).collect())
    p, q = (np.array([r[c] for r in best], float) for c in ("p", "q"))
    ratio = np.log((p + 1) / ((total[0] or 0) + BUCKETS)) - np.log((q + 1) / ((total[1] or 0) + BUCKETS))
    return np.array([r["bucket"] for r in best], np.int64), ratio, n1, n0


def _descend(indptr: np.ndarray, feature: np.ndarray, scale: np.ndarray, y: np.ndarray, l2: float, steps: int) -> tuple[np.ndarray, float]:
    """Logistic regression on rows that hold ``scale`` at their features, by Adam on all rows."""
    row = np.repeat(np.arange(len(y)), np.diff(indptr))
    value = scale[feature]
    theta = np.zeros(len(scale) + 1)
    theta[-1] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        z = np.bincount(row, value * theta[feature], len(y)) + theta[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / len(y)
        g = np.append(np.bincount(feature, value * error[row], len(scale)) + l2 * theta[:-1], error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= 0.05 * (0.5 + 0.5 * np.cos(np.pi * t / steps)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return theta[:-1], float(theta[-1])


def fit(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED, l2: float = 1e-3, steps: int = 120, **columns: str) -> Model:
    """The classifier, from a bounded sample of the labelled documents that are not held out."""
    rows = durable(sample(docs, labels, bound, **columns).repartition(TASKS))
    chosen, ratio, n1, n0 = select_buckets(rows)
    if not len(chosen):
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log((n1 + 1) / (n0 + 1))))

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.zeros(BUCKETS, bool)
        keep[chosen] = True
        for batch in batches:
            texts, held = batch.column(1).to_pylist(), []
            for doc, bucket in features(texts, keep):
                held.append(np.stack([doc, np.searchsorted(chosen, bucket)]))
            doc, bucket = np.concatenate(held, axis=1) if held else np.zeros((2, 0), np.int64)
            ends = np.searchsorted(doc, np.arange(1, len(texts) + 1)).tolist()
            own = [bucket[a:b].astype("<u2").tobytes() for a, b in zip([0, *ends], ends, strict=False)]
            yield pa.RecordBatch.from_pydict({"label": batch.column(0), "held": pa.array(own, pa.binary())})

    found = rows.mapInArrow(select, "label int, held binary").collect()
    y, held = zip(*((x.label, np.frombuffer(x.held, "<u2")) for x in found), strict=True)
    indptr = np.cumsum([0, *map(len, held)])
    weights, bias = _descend(indptr, np.concatenate(held).astype(np.int64), ratio, np.array(y, float), l2, steps)
    return Model(chosen, weights * ratio, bias)


def scores(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score and predicted (1 if the score is at least ``threshold``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = score_texts(batch.column(2).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def reject(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose score is at least ``threshold``; all of them where the model has no features."""
    if not len(model.buckets):
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = score_texts(batch.column(batch.schema.get_field_index(text_col)).to_pylist(), model)
            yield batch.filter(pa.array(s < threshold))

    return docs.mapInArrow(run, docs.schema)

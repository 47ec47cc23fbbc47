"""Approximate nearest neighbours by multiprobe p-stable hashing, with exact reranking.

A table has ``width`` hash functions floor((a . v + b) / w), a Gaussian; a vector lies in the bucket that
all of them name. A query visits perturbed buckets in the order of estimated success: for a neighbour at
distance r, a coordinate's projection differs by a normal deviate of standard deviation r, so each slot of
each coordinate has a probability and a bucket the product of its slots'. Buckets are visited, most
probable first, until their sum over all tables makes a miss at distance r as unlikely as ``miss``. There
is no cap on buckets. Candidates of all tables are merged and ranked by the exact distance in double
precision, ties by the smaller id.

The distance r and the width come from a bounded, documented sample (about ``SAMPLE`` distinct vectors and
queries): r is the ``QUANTILE`` of the k-th nearest distance, carried on from the sample's ranks to the
table's by a fit of distance to rank; the width is the one whose visits and distances cost least, among those
with at most ``MOST_VISITS`` visits a query. Every row is indexed. A query's answer holds if it has k ids, the last within ``SURE`` times r; the other queries, such
as outliers or those in thinner clusters, are asked again with an r fitted to themselves, at least twice
the last. When at most ``EXACT`` are left, they are held against all rows in one pass. So every query gets
k ids, or all there are.

Of equal vectors only the k + 1 smallest ids can be an answer; the others are left out before the index is
made, so copies cost nothing however many they are. Buckets fall into groups by a hash, entries of a bucket of
over half a group are split over several by a hash of the id, and a query goes to the groups that its
buckets lie in, where it ranks its candidates; only the best k of a group go on. A group of more than ``ASKED``
queries is met in slices of them. So a task holds about ``GROUP_BYTES`` of vectors and ``ASKED`` queries with
their buckets. The driver sees the sample, a row for each bucket of over half a group and one for each
group: some bytes for megabytes of vectors.

Vectors that are null, zero or hold null or non-finite components take no part, nor do those whose length
differs from the most common (ties: the longer). Fewer than k candidates give fewer rows. Rows of a
query's own id are no candidates; of rows that share an id, the nearest counts, and a query whose id
repeats takes the nearest to any of its vectors. An empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barlab.llm.common import durable, kept

TABLES, MISS = 3, 0.02
#: Slot width as a multiple of r.
SLOT = 1.6
SAMPLE, QUANTILE = 2000, 0.9
#: Queries of the sample that widths are tried with; what a visit costs, in components of distances; visits of a query, over
#: all tables, beyond which tables get no wider; most functions of a table.
TRIED, VISIT, MOST_VISITS, WIDEST = 24, 10_000, 4096, 16
#: An answer holds up to this multiple of r. As many queries are held against all rows at once.
SURE, EXACT = 1.25, 1024
#: Bytes of vectors in one group, about; half as much of one bucket. Vectors of a group below which groups
#: are not made smaller for the sake of more tasks; queries of a slice; distances computed at once.
GROUP_BYTES, FEW, ASKED, BLOCK = 32 << 20, 4096, 4096, 1 << 15


@dataclass(frozen=True)
class Hashes:
    """Hash functions of all tables: ``axes`` (tables, width, dimension), ``shifts`` (tables, width)."""

    axes: np.ndarray
    shifts: np.ndarray
    slot: float
    reach: float  # r

    @classmethod
    def draw(cls, dimension: int, reach: float, width: int, tables: int = TABLES, seed: int = 7) -> Hashes:
        rng = np.random.default_rng(seed)
        return cls(rng.standard_normal((tables, width, dimension)), rng.random((tables, width)), SLOT * reach, reach)

    def places(self, vectors: np.ndarray) -> np.ndarray:
        """(rows, tables, width): positions in units of slots; the integer part names the slot."""
        tables, width, dimension = self.axes.shape
        return (vectors @ self.axes.reshape(-1, dimension).T).reshape(-1, tables, width) / self.slot + self.shifts

    def buckets(self, vectors: np.ndarray) -> np.ndarray:
        """(rows, tables): the bucket of each vector in each table."""
        slots = np.floor(self.places(vectors)).astype(np.int64)
        return np.stack([bucket_ids(t, slots[:, t]) for t in range(len(self.axes))], axis=1)

    def visits(self, vectors: np.ndarray, miss: float) -> Iterator[np.ndarray]:
        """The buckets of all tables that each query visits."""
        tables = len(self.axes)
        for place in self.places(vectors):
            yield np.concatenate([bucket_ids(t, probes(place[t], self.reach / self.slot, 1 - miss ** (1 / tables))) for t in range(tables)])


_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def bucket_ids(table: int, slots: np.ndarray) -> np.ndarray:
    """A 64-bit name for each row of ``slots`` in a table."""
    h = np.full(len(slots), table + 1, np.uint64)
    for k in range(slots.shape[1]):
        h = (h ^ slots[:, k].astype(np.int64).view(np.uint64) * _MULTIPLIERS[k % 4]) * _MULTIPLIERS[(k + 1) % 4]
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _mix(keys: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
    """A hash of 63 bits of each key."""
    h = (keys.astype(np.int64).view(np.uint64) + np.asarray(salt).astype(np.uint64) * _MULTIPLIERS[1]) * _MULTIPLIERS[0]
    h = (h ^ (h >> np.uint64(31))) * _MULTIPLIERS[2]
    return ((h ^ (h >> np.uint64(29))) >> np.uint64(1)).astype(np.int64)


def _normal_cdf(x: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in x.ravel()]).reshape(x.shape)


def probes(place: np.ndarray, sigma: float, enough: float) -> np.ndarray:
    """Slots of the buckets to visit in one table for a query at ``place``, most probable first.

    ``sigma``: standard deviation of a neighbour's projection in slots. Ends when the buckets' probabilities
    sum to ``enough``.
    """
    reach = int(math.ceil(6 * sigma)) + 1
    offsets = np.arange(-reach, reach + 1)
    home = np.floor(place)
    edges = home[:, None] + np.append(offsets, reach + 1)[None, :] - place[:, None]
    mass = np.diff(_normal_cdf(edges / sigma), axis=1)
    order = np.argsort(-mass, axis=1, kind="stable")
    cost = -np.log(np.maximum(np.take_along_axis(mass, order, axis=1), 1e-300))
    slots = (home[:, None] + offsets[order]).astype(np.int64)
    # Best first over ranks by coordinate: each set of ranks is reached once, from the set with its last raised rank lowered.
    n = len(place)
    heap = [(float(cost[:, 0].sum()), (0,) * n, 0)]
    found, total = [], 0.0
    while heap and total < enough:
        c, ranks, last = heapq.heappop(heap)
        found.append(ranks)
        total += math.exp(-c)
        for k in range(last, n):
            if ranks[k] + 1 < len(offsets):
                heapq.heappush(heap, (c + float(cost[k, ranks[k] + 1] - cost[k, ranks[k]]), (*ranks[:k], ranks[k] + 1, *ranks[k + 1 :]), k))
    return slots[np.arange(n)[None, :], np.array(found)]


def squared_distances(vectors: np.ndarray, norms: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Squared distances up to rounding, by the product; ``norms``: the vectors' squared lengths."""
    return norms - 2 * (vectors @ query) + query @ query


def nearest(ids: np.ndarray, vectors: np.ndarray, query: np.ndarray, k: int, at: np.ndarray | None = None, squared: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of the k nearest ids, by exact distance in double precision, then id; an id counts once.

    ``at``: the rows that are candidates, all by default; ``squared``: their squared distances up to rounding.
    Those that may be among the nearest by these are measured exactly.
    """
    at = np.arange(len(ids)) if at is None else at
    if squared is None:
        squared = np.concatenate([np.zeros(0), *(((vectors[at[a : a + BLOCK]] - query) ** 2).sum(axis=1) for a in range(0, len(at), BLOCK))])
    slack = 1e-11 * (float(query @ query) + float(squared.max(initial=0.0)))
    some = 4 * k
    while True:
        few = np.argpartition(squared, some)[:some] if some < len(at) else np.arange(len(at))
        score = np.sqrt(((vectors[at[few]] - query) ** 2).sum(axis=1))
        own = ids[at[few]]
        order = np.lexsort((own, score))
        order = order[np.sort(np.unique(own[order], return_index=True)[1])[:k]]
        if len(few) == len(at) or (len(order) == k and score[order[-1]] ** 2 + slack < squared[few].max()):
            return own[order], score[order]
        some *= 4


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part, in the table's precision, at least single."""
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    v = F.transform(vector_col, lambda x: x.cast(kind))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite & F.exists("v", lambda x: x != 0))


def _lists(column: pa.Array, kind: str) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1).astype(kind) if len(column) else np.zeros((0, 1), kind)


def _matrix(column: pa.ChunkedArray | pa.Array, kind: str) -> np.ndarray:
    """Vectors in double precision from their bytes."""
    raw = np.frombuffer(b"".join(column.to_pylist()), kind)
    return raw.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 1))


def distinct_vectors(rows: DataFrame, k: int, kind: str) -> DataFrame:
    """(vec_id, v as bytes): each pair once, of equal vectors those of the k + 1 smallest ids."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What a batch alone can tell, so that copies do not cross the shuffle.
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column(0).to_numpy(), np.ascontiguousarray(_lists(batch.column(1), kind) + 0.0)  # no negative zeros
            raw = x.view(f"V{x.shape[1] * x.itemsize}").ravel()
            _, code = np.unique(raw, return_inverse=True)
            order = np.lexsort((ids, code))
            new = np.append(True, (np.diff(code[order]) != 0) | (np.diff(ids[order]) != 0))
            order = order[new]
            starts = np.flatnonzero(np.append(True, np.diff(code[order]) != 0))
            rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
            at = np.sort(order[rank <= k])
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array([x[i].tobytes() for i in at], pa.binary())], ["vec_id", "v"])

    bare = rows.mapInArrow(combine, "vec_id long, v binary").withColumn("h", F.xxhash64("v"))
    rank = F.dense_rank().over(W.partitionBy("h", "v").orderBy("vec_id"))
    return bare.withColumn("rank", rank).where(F.col("rank") <= k + 1).select("h", "v", "vec_id").distinct().select("vec_id", "v")


def _some(rows: DataFrame, column: str, n: int, kind: str, most: int = SAMPLE) -> tuple[np.ndarray, float]:
    """About ``most`` of the ``n`` distinct vectors in double precision, and their share."""
    share = min(1.0, most / max(1, n))
    few = rows.where(F.pmod(F.xxhash64(column), F.lit(1 << 30)) < int(share * (1 << 30))).select(column).distinct().limit(2 * most).toArrow()
    return _matrix(few[column], kind), share


def fit_reach(asked: np.ndarray, stored: np.ndarray, share: float, k: int) -> float:
    """Estimated distance within which ``QUANTILE`` of the queries ``asked`` have their k nearest.

    ``stored`` holds ``share`` of all distinct vectors; a query's own is none of its neighbours.
    """
    norms = (stored**2).sum(axis=1)
    distances = []
    for a in range(0, len(asked), 256):
        q = asked[a : a + 256]
        own = (q**2).sum(axis=1)[:, None]
        d = np.maximum(own + norms[None] - 2 * q @ stored.T, 0)
        d[d <= 1e-12 * (own + norms[None])] = np.inf
        distances.append(np.sort(np.sqrt(d), axis=1)[:, : max(k, 64)])
    if not distances:
        return 1.0
    d = np.concatenate(distances)
    good = np.isfinite(d).any(axis=0)
    if not good.any():
        return float(np.sqrt(max(norms.max(initial=0.0), 1e-18)))
    d = d[:, good]
    # A query with fewer neighbours in the sample counts at its farthest.
    d = np.where(np.isfinite(d), d, np.where(np.isfinite(d), d, 0).max(axis=1, keepdims=True))
    typical = np.quantile(d, QUANTILE, axis=0)
    # The sample's neighbour of rank j is about the whole table's of rank j / share: carry the trend of
    # log distance over log rank on to rank k of the whole.
    if len(typical) >= 8 and share < 1 and (typical > 0).all():
        slope, level = np.polyfit(np.log(np.arange(1, len(typical) + 1)), np.log(typical), 1)
        return float(np.exp(level + slope * math.log(k * share)))
    return float(max(typical[min(k, len(typical)) - 1], 1e-9))


def fit_width(asked: np.ndarray, stored: np.ndarray, n: int, reach: float, miss: float = MISS) -> int:
    """The number of hash functions of a table at which the visits of a query and its distances to candidates cost least."""
    best, least, dimension = 1, math.inf, stored.shape[1]
    tried = asked[:: max(1, len(asked) // TRIED)][:TRIED]
    for width in range(1, WIDEST + 1):
        h = Hashes.draw(dimension, reach, width)
        own = h.buckets(stored)
        visited, met = 0, 1
        for buckets in h.visits(tried, miss):
            visited += len(buckets)
            met += int(np.isin(own, buckets).sum())
        if width > 1 and visited > MOST_VISITS * len(tried):
            break
        cost = visited * VISIT + met * dimension * n / max(1, len(stored))
        if cost < least:
            best, least = width, cost
        if visited * VISIT > least:
            break
    return best


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k nearest ids of each query, an id at its least score, with their rank: one shuffle, on the query."""
    once = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    nearest_first = W.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


FOUND = "query_id long, vec_id long, score double"


def _found(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> dict[str, np.ndarray]:
    """The k nearest ids of each query among ``parts`` (query, ids, distances); a query id may have several vectors."""
    query, ids, score = map(np.concatenate, zip((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), *parts, strict=True))
    if len(parts) > len(np.unique(query)):
        order = np.lexsort((score, ids, query))
        query, ids, score = query[order], ids[order], score[order]
        least = np.append(True, (np.diff(query) != 0) | (np.diff(ids) != 0))[: len(query)]
        query, ids, score = query[least], ids[least], score[least]
        order = np.lexsort((ids, score, query))
        query, ids, score = query[order], ids[order], score[order]
        near = np.arange(len(query)) - np.searchsorted(query, query) < k
        query, ids, score = query[near], ids[near], score[near]
    return {"query_id": query, "vec_id": ids, "score": score}


def probe(stored: DataFrame, asked: DataFrame, n: int, k: int, h: Hashes, kind: str, miss: float = MISS) -> DataFrame:
    """(query_id, vec_id, score): the nearest k of each group's candidates, for ``asked`` (query_id, q) among ``stored`` (vec_id, v)."""
    tables, _, dimension = h.axes.shape
    size = np.dtype(kind).itemsize
    parallel = asked.sparkSession.sparkContext.defaultParallelism
    # A query brings k rows from each group that it visits, so groups are as large as memory allows.
    groups = max(1, -(-n * tables * 2 * size * dimension // GROUP_BYTES), min(4 * parallel, -(-n * tables // FEW)))
    part = max(1, -(-n * tables // groups) // 2)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets = h.buckets(_matrix(batch.column(1), kind)) if batch.num_rows else np.zeros((0, tables), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.FixedSizeListArray.from_arrays(pa.array(buckets.ravel()), tables).cast(pa.list_(pa.int64()))], ["vec_id", "v", "buckets"])

    indexed = kept(stored.mapInArrow(index, "vec_id long, v binary, buckets array<long>"), "index")
    # At most two for each group: those that must be split.
    heavy = indexed.select(F.explode("buckets").alias("bucket")).groupBy("bucket").count().where(F.col("count") > part)
    heavy = sorted((r["bucket"], -(-r["count"] // part)) for r in heavy.collect())
    names, parts = np.array([b for b, _ in heavy], np.int64), np.array([p for _, p in heavy], np.int64)

    def parts_of(buckets: np.ndarray) -> np.ndarray:
        if not len(names):
            return np.ones(len(buckets), np.int64)
        at = np.minimum(np.searchsorted(names, buckets), len(names) - 1)
        return np.where(names[at] == buckets, parts[at], 1)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, group_of, held, own = [], [], [], []
            for query, v, buckets in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), h.visits(_matrix(batch.column(1), kind), miss), strict=True):
                p = parts_of(buckets)
                every = np.repeat(buckets, p)
                salt = np.arange(len(every)) - np.repeat(np.cumsum(p) - p, p)
                group = _mix(every, salt) % groups
                order = np.argsort(group, kind="stable")
                some, first = np.unique(group[order], return_index=True)
                held += np.split(every[order], first[1:])
                group_of += some.tolist()
                ids += [query] * len(some)
                own += [v] * len(some)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(own, pa.binary()), pa.array(group_of, pa.int32()), pa.array(held, pa.list_(pa.int64()))], ["query_id", "q", "group", "buckets"])

    visits = kept(asked.mapInArrow(visit, "query_id long, q binary, group int, buckets array<long>"), "visits")
    # A row for each group that more queries visit than a task should hold.
    busy = {r["group"]: -(-r["count"] // ASKED) for r in visits.groupBy("group").count().where(F.col("count") > ASKED).collect()}
    slices = np.ones(groups, np.int64)
    for g, s in busy.items():
        slices[g] = s

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, own = batch.column(0).to_numpy(), batch.column(2).flatten().to_numpy().reshape(-1, tables)
            for t in range(tables):
                group = _mix(own[:, t], _mix(ids) % parts_of(own[:, t])) % groups
                at = np.repeat(np.arange(len(ids)), slices[group])
                first = np.cumsum(slices[group]) - slices[group]
                turn = np.arange(len(at)) - first[at]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at)) for c in (0, 1)), pa.array(own[at, t]), pa.array(group[at].astype(np.int32)), pa.array(turn.astype(np.int32))], ["vec_id", "v", "bucket", "group", "turn"])

    def rank(key: tuple, stored: pa.Table, asked: pa.Table) -> pa.Table:
        bucket = stored["bucket"].to_numpy()
        order = np.argsort(bucket, kind="stable")
        ids, bucket, x = stored["vec_id"].to_numpy()[order], bucket[order], _matrix(stored["v"], kind)[order]
        norms = (x**2).sum(axis=1)
        found, first = np.unique(bucket, return_index=True)
        last = np.append(first[1:], len(bucket))
        parts = []
        for q, buckets, query in zip(asked["query_id"].to_pylist(), asked["buckets"], _matrix(asked["q"], kind), strict=True):
            own = buckets.values.to_numpy()
            at = np.searchsorted(found, own)
            at = at[(at < len(found)) & (found[np.minimum(at, len(found) - 1)] == own)] if len(found) else at[:0]
            rows = np.concatenate([np.arange(a, b) for a, b in zip(first[at].tolist(), last[at].tolist(), strict=True)]) if len(at) else at
            rows = rows[ids[rows] != q]
            if len(rows):
                # Many candidates: one product with all is faster than gathering them.
                squared = squared_distances(x, norms, query)[rows] if 3 * len(rows) > len(x) else squared_distances(x[rows], norms[rows], query)
                near, score = nearest(ids, x, query, k, rows, squared)
                parts.append((np.full(len(near), q, np.int64), near, score))
        return pa.table(_found(parts, k))

    def slice_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, salt = batch.column(2).to_numpy(), np.array([zlib.crc32(q) for q in batch.column(1).to_pylist()], np.int64)
            turn = _mix(batch.column(0).to_numpy(), salt) % slices[group]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(turn.astype(np.int32))], [*batch.schema.names, "turn"])

    tasks = min(int(slices.sum()), max(16 * parallel, groups))
    left = indexed.mapInArrow(deal, "vec_id long, v binary, bucket long, group int, turn int")
    right = visits.mapInArrow(slice_of, "query_id long, q binary, group int, buckets array<long>, turn int")
    left, right = left.repartition(tasks, "group", "turn"), right.repartition(tasks, "group", "turn")
    return left.groupBy("group", "turn").cogroup(right.groupBy("group", "turn")).applyInArrow(rank, FOUND)


def compare_all(stored: DataFrame, asked: DataFrame, k: int, kind: str) -> DataFrame:
    """(query_id, vec_id, score): the nearest k of each partition of ``stored``, for at most ``EXACT`` queries ``asked``."""
    local = asked.limit(EXACT).toArrow()
    owner, queries = local["query_id"].to_numpy(), _matrix(local["q"], kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0))] * len(owner)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1), kind)
            norms = (x**2).sum(axis=1)
            for i, query in enumerate(queries):
                rows = np.flatnonzero(ids != owner[i])
                near, score = nearest(ids, x, query, k, rows, squared_distances(x, norms, query)[rows])
                near, score = np.append(best[i][0], near), np.append(best[i][1], score)
                order = np.lexsort((near, score))
                best[i] = near[order := order[np.sort(np.unique(near[order], return_index=True)[1])[:k]]], score[order]
        yield pa.RecordBatch.from_pydict(_found([(np.full(len(near), q, np.int64), near, score) for q, (near, score) in zip(owner, best, strict=True)], k))

    return stored.mapInArrow(run, FOUND)


def search(vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", miss: float = MISS, hashes: Hashes | None = None) -> DataFrame:
    """The k nearest found of each query (ids divisible by ``every``): query_id, rank, vec_id, score."""
    rows = usable(vectors, id_col, vector_col)
    kind = "<f4" if rows.schema["v"].dataType.simpleString() == "array<float>" else "<f8"
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    dimension = common["d"]
    rows = rows.where(F.size("v") == dimension)
    stored = kept(distinct_vectors(rows, k, kind), "vectors")
    n, ids, different = stored.agg(F.count("*"), F.approx_count_distinct("vec_id", 0.01), F.approx_count_distinct("v", 0.01)).first()
    if ids < 2 * k + 10:
        ids = stored.select("vec_id").distinct().count()
    wanted = min(k, ids - 1)

    def as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _lists(batch.column(1), kind) + 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in x], pa.binary())], ["query_id", "q"])

    asked = kept(rows.where(F.col("vec_id") % every == 0).mapInArrow(as_bytes, "query_id long, q binary").distinct(), "queries")
    left = asked.count() if wanted > 0 else 0
    found = asked.sparkSession.createDataFrame([], FOUND + ", rank int").select("query_id", "rank", "vec_id", "score")
    if not left:
        return found
    few, share = _some(stored, "v", different, kind)
    reach, first = 0.0, True
    while left and (first or left > EXACT):
        own, _ = _some(asked, "q", left, kind)
        reach = max(2 * reach, fit_reach(own, few, share, k))
        h = hashes if first and hashes else Hashes.draw(dimension, reach, fit_width(own, few, n, reach, miss))
        reach, first = h.reach, False
        found = durable(_best(probe(stored, asked, n, k, h, kind, miss).unionByName(found.drop("rank")), k))
        sure = found.groupBy("query_id").agg(F.count("*").alias("count"), F.max("score").alias("last")).where((F.col("count") >= wanted) & (F.col("last") <= SURE * reach))
        asked = kept(asked.join(sure, "query_id", "left_anti"), "queries")
        left = asked.count()
    if left:
        found = durable(_best(compare_all(stored, asked, k, kind).unionByName(found.drop("rank")), k))
    return found

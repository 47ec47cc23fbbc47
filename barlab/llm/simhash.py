"""Near-duplicates by SimHash fingerprints and BK-trees.

A text's fingerprint has 64 bits: A-Z in lower case, words split at ASCII white space, all shingles of
four words (the whole sequence where there are fewer) hashed by XXH64 with seed 42; a bit is 1 if over
half of the hashes have it. Fingerprints that differ in at most ``radius`` bits are linked; a document's
component holds all that links reach.

Only distinct fingerprints are compared, so copies cost one row. They are dealt to shards of about ``SHARD``: 64 bits fall
into blocks of which two fingerprints within the radius share at least ``blocks - radius``, so they share some bits of each of
those too; a shard holds the fingerprints that agree in the low bits of such a choice of blocks, as many bits as
the number of fingerprints asks for, and no link is lost. A shard has a BK-tree
(children keyed by their Hamming distance to the parent); each fingerprint follows only the edges within
the radius of its own distance. A shard of over ``TREE`` fingerprints is split into several trees, each
met by all fingerprints of the shard as a stream, so memory is bounded and the work spreads over tasks.
Trees reach their queries by a shuffle on the shard: a broadcast would pass the fingerprints of all documents through
the driver. A tree returns a spanning set of its links, never all pairs within a group.

Components are found by large-star and small-star rounds on the links, each cut by a checkpoint.

Null and empty texts have fingerprint 0 and are linked like any other. Null ids never name a component
unless it has no other; repeated rows share a component; an empty table gives an empty result; further
columns are ignored by ``near_duplicates`` and kept by ``keep_one``, of any type and name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlab.llm.common import durable

RADIUS = 4
SHINGLE = 4
#: Fingerprints in one tree at most, and in a leaf, which is scanned at once.
TREE, LEAF = 8192, 4
#: Mean number of fingerprints of a shard beyond which shards are cut finer, by a bit.
SHARD = 1024
_SLICE = 1 << 16


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of ``text``."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - SHINGLE + 1)
    hashed = xxhash.xxh64_intdigest
    if n == 1:
        return hashed(joined, 42)
    starts, ends, ones = starts[:n], ends[SHINGLE - 1 :], np.zeros(64, np.int64)
    for k in range(0, n, _SLICE):
        h = np.array([hashed(joined[a:b], 42) for a, b in zip(starts[k : k + _SLICE].tolist(), ends[k : k + _SLICE].tolist(), strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_key: Column | None = None) -> DataFrame:
    """Per row: doc_id, fp (the fingerprint as a signed long) and, if asked for, row_key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py()) for t in batch.column(0)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fp)], [*batch.schema.names[1:], "fp"])

    kept = [F.col(id_col).cast("long").alias("doc_id"), *([row_key.alias("row_key")] if row_key is not None else [])]
    return docs.select(F.col(text_col).alias("text"), *kept).mapInArrow(run, "doc_id long, " + "row_key binary, " * (row_key is not None) + "fp long")


class BKTree:
    """Distinct fingerprints; a node's children are keyed by their distance to it, small sets are leaves."""

    def __init__(self, items: np.ndarray):
        self.items = items
        self.root = self._build(np.arange(len(items)))

    def _build(self, own: np.ndarray):
        if len(own) <= LEAF:
            return own
        distance = np.bitwise_count(self.items[own[1:]] ^ self.items[own[0]])
        order = np.argsort(distance, kind="stable")
        keys, first = np.unique(distance[order], return_index=True)
        parts = np.split(own[1:][order], first[1:])
        return int(own[0]), [(int(k), self._build(part)) for k, part in zip(keys, parts, strict=True)]

    def search(self, queries: np.ndarray, radius: int, stats: dict[str, int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(item, indices of the queries within the radius of it), for all queries at once.

        ``stats`` counts, over all queries, what is compared with items of inner nodes and of leaves, and edges that are not followed.
        """
        stats = {} if stats is None else stats

        def add(name: str, n: int) -> None:
            stats[name] = stats.get(name, 0) + n

        stack = [(self.root, np.arange(len(queries)))]
        while stack:
            node, at = stack.pop()
            if isinstance(node, np.ndarray):
                add("leaf", len(node) * len(at))
                for i, near in zip(node.tolist(), np.bitwise_count(self.items[node][:, None] ^ queries[at][None, :]) <= radius, strict=True):
                    if near.any():
                        yield i, at[near]
                continue
            i, children = node
            add("inner", len(at))
            distance = np.bitwise_count(queries[at] ^ self.items[i]).astype(np.int16)
            if (near := distance <= radius).any():
                yield i, at[near]
            for key, child in children:
                follow = np.flatnonzero(np.abs(distance - key) <= radius)
                add("pruned", len(at) - len(follow))
                if len(follow):
                    stack.append((child, at[follow]))


class _Links:
    """Spanning links among a tree's items and the queries that it meets."""

    def __init__(self, tree: BKTree):
        self.tree, self.parent = tree, list(range(len(tree.items)))

    def _root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def meet(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        seen = np.full(len(queries), -1)  # the first item that the query is linked to
        for i, near in self.tree.search(queries, radius):
            new = near[seen[near] < 0]
            if len(near) > len(new):
                for j in np.unique(seen[near]).tolist():
                    if j >= 0 and (a := self._root(i)) != (b := self._root(j)):
                        self.parent[a] = b
                        yield self.tree.items[[i]], self.tree.items[[j]]
            if len(new):
                seen[new] = i
                new = queries[new]
                new = new[new != self.tree.items[i]]
                yield np.full(len(new), self.tree.items[i]), new


def _shards(n: int, radius: int, blocks: int | None = None, shard: int = SHARD) -> list[tuple[int, int]]:
    """(number, mask) of each choice of bits that fingerprints of a shard agree in, for ``n`` fingerprints.

    Of a choice of ``blocks - radius`` blocks the low bits count, as many as make shards of up to ``shard`` on average;
    there are as few blocks as have so many bits.
    """
    bits = max(0, -(-n // shard) - 1).bit_length()
    if bits == 0:
        return [(0, 0)]
    if blocks is None:
        blocks = next(b for b in range(radius + 1, 17) if b == 16 or (64 // b) * (b - radius) >= bits)
    width = min(64 // blocks, -(-bits // (blocks - radius)))
    part = [((1 << width) - 1) << (64 * k // blocks) for k in range(blocks)]
    return list(enumerate(sum(part[k] for k in chosen) for chosen in combinations(range(blocks), blocks - radius)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(nodes: DataFrame, radius: int = RADIUS, blocks: int | None = None, tree: int = TREE, shard: int = SHARD) -> DataFrame:
    """(a, b) of linked fingerprints: what connects all that are within ``radius`` of each other.

    ``nodes`` has distinct fingerprints ``fp``; ``blocks``: into how many parts 64 bits fall (by default
    as few as can make shards of ``shard``), over ``radius``.
    """
    shards = _shards(nodes.count(), radius, blocks, shard)
    keyed = nodes.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("agreed")) for k, mask in shards])).alias("shard")).select("fp", "shard.*")
    # Fingerprints that are alone in their shard have no link there; large shards are met tree by tree.
    trees = durable(keyed.groupBy("choice", "agreed").count().where("count > 1").withColumn("trees", F.ceil(F.col("count") / tree).cast("int")))
    met = keyed.join(trees, ["choice", "agreed"])
    met = met.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int"))
    met = met.select("choice", "agreed", "fp", "own", F.explode(F.sequence("own", F.col("trees") - 1)).alias("tree"))
    # Each tree's own items, then as guests those of the trees before it.
    met = met.select("choice", "agreed", "tree", (F.col("own") != F.col("tree")).alias("guest"), "fp")
    spread = met.repartition("choice", "agreed", "tree").sortWithinPartitions("choice", "agreed", "tree", "guest", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # what the current tree will hold
        key, active = None, None

        def out(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            pairs = list(found)
            if pairs:
                a, b = (np.concatenate(x).view(np.int64) for x in zip(*pairs, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        def plant() -> Iterator[pa.RecordBatch]:
            """The tree of what is held, met by its own items."""
            nonlocal active, held
            if held and active is None:
                items = np.concatenate(held)
                active, held = _Links(BKTree(items)), []
                yield from out(active.meet(items, radius))

        for batch in batches:
            choice, agreed, tree_no, guest = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            fp = batch.column(4).to_numpy().view(np.uint64)
            change = (choice[1:] != choice[:-1]) | (agreed[1:] != agreed[:-1]) | (tree_no[1:] != tree_no[:-1]) | (guest[1:] != guest[:-1])
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(fp)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if key != (k := (choice[a], agreed[a], tree_no[a])):
                    yield from plant()
                    key, active, held = k, None, []
                if guest[a]:
                    yield from plant()
                    if active is not None:
                        yield from out(active.meet(fp[a:b], radius))
                else:
                    held.append(fp[a:b])
        yield from plant()

    return spread.mapInArrow(run, "a long, b long").distinct()


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. Edges (u, v) have v < u; so have the results."""
    both = durable(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges)
    least = durable(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
    joined = both.join(least, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("v < u").distinct()
    moved = joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("v < u").distinct()


def stars(edges: DataFrame) -> DataFrame:
    """(u, v): each node u of the edges (a, b) that is not the least of its component, and that least v."""
    now = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    sign = lambda e: tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first())
    before = sign(now)
    while before[0]:
        now = durable(_step(durable(_step(now, True)), False))
        if (after := sign(now)) == before:
            break
        before = after
    return now


def components(prints: DataFrame, radius: int = RADIUS, **options: int) -> DataFrame:
    """``prints`` (doc_id, fp, ...) with component_id, the least doc_id of the component, and ``label``, its least fp."""
    nodes = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    star = stars(links(nodes, radius, **options))
    labelled = durable(nodes.join(star.withColumnsRenamed({"u": "fp", "v": "label"}), "fp", "left").withColumn("label", F.coalesce("label", "fp")))
    named = durable(labelled.groupBy("label").agg(F.min("least_id").alias("component_id")))
    return prints.join(durable(labelled.join(named, "label").select("fp", "label", "component_id")), "fp")


def near_duplicates(docs: DataFrame, **columns: str) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits) and component_id."""
    found = components(durable(fingerprints(docs, **columns)))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the least id (nulls last), then of the least checksum of the text, then of all columns.

    Rows are named by a checksum of id and text, in which a null differs from any value. Rows of one name have one text and so
    are in one component, so no other component loses its row.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    marked = lambda c: F.coalesce(F.concat(F.lit("+"), F.col(f"`{c}`").cast("string")), F.lit("-"))
    key = F.unhex(F.sha2(F.concat(F.sha2(marked(id_col), 256), F.sha2(marked(text_col), 256)), 256))
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), key.alias("row_key"))
    found = components(durable(fingerprints(slim, row_key=F.col("row_key"))))
    kept = durable(found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("least")).select(F.col("least.row_key").alias("row_key")))
    # Rows of a name differ in their other columns only; of maps too, which have no order, by their JSON.
    rows = docs.select(key.alias("row_key"), F.struct(*columns).alias("doc")).join(kept, "row_key", "left_semi")
    one = rows.groupBy("row_key").agg(F.min_by("doc", F.sha2(F.to_json("doc", {"ignoreNullFields": "false"}), 256)).alias("doc"))
    return one.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])

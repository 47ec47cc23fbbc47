"""Periodic runs in the words of texts: stretches that repeat with a smallest period, and texts without the repeats.

A run is a maximal stretch of words in which words ``period`` apart are equal, at least ``times`` periods and ``least`` words
long. Runs are found by the branching-tandem test on an enhanced suffix array: where the suffix array has an LCP interval of depth l, the
suffixes of all child intervals but the largest are tried: for such a suffix i, ISA[i + l] or ISA[i - l] inside the interval shows a
square of period l, and the word after tells whether it is the last of its run. Such squares are rotated to the left as
far as words agree, and squares of one stretch are merged into a run of their least period. As runs are ``times`` periods long, intervals
of fewer suffixes cannot show one, and i - l, i - 2 l, ... must lie in the interval too.

No tree is built: suffixes of many documents are sorted together by doubling, in numpy, each document for itself; groups of
fewer than ``times`` suffixes are not sorted further. LCP values come from the ranks of the doubling rounds, intervals from a table of
minima, child intervals from sorted boundaries.

In Spark it is one pass without a shuffle. A task holds the words of ``GROUP`` words' worth of documents, or of one longer document
whole, some 100 bytes a word and 4 more for each doubling of its longest repeat.

Null and empty texts have no words and no runs. Repeated rows are treated alike, each for itself; an empty table gives an empty result;
``find_runs`` keeps the columns it is asked for. White space is that of ASCII.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlab.llm.common import WORD

TIMES, LEAST = 4, 6
#: Words of documents that are sorted together, about.
GROUP = 1 << 19

Run = tuple[int, int, int]  # (start, length, period)

# ---------------------------------------------------------------- suffix arrays of many sequences


class Suffixes:
    """Suffix array of sequences laid end to end; ``bounds``: where each begins, and the end of the last.

    Suffixes that share a prefix with fewer than ``few`` others stand together in any order.
    """

    def __init__(self, items: np.ndarray, bounds: np.ndarray, few: int):
        n = len(items)
        self.items, self.few = items, few
        sizes = np.diff(bounds)
        self.begin = np.repeat(bounds[:-1], sizes)
        self.end = np.repeat(bounds[1:], sizes)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        first = owner * (int(items.max(initial=0)) + 1) + items
        self.sa = np.argsort(first, kind="stable")
        #: Ranks by prefixes of 1, 2, 4, ... items, and the slots of a group that follow another of it.
        self.ranks: list[np.ndarray] = []
        self.inner: list[np.ndarray] = []
        rank = np.zeros(n, np.int32)
        active = self._split(np.arange(n), first[self.sa], rank)
        size = 1
        while len(active):
            at = self.sa[active]
            after = at + size
            follows = np.where(after < self.end[at], rank[np.minimum(after, n - 1)], -1).astype(np.int64)
            key = rank[at].astype(np.int64) * (n + 1) + follows + 1
            order = np.argsort(key, kind="stable")
            self.sa[active] = at[order]
            rank = rank.copy()
            active = self._split(active, key[order], rank)
            size *= 2
        self.isa = np.empty(n, np.int64)
        self.isa[self.sa] = np.arange(n)

    def _split(self, slots: np.ndarray, key: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Ranks ``slots`` by their ascending ``key``; returns those in groups that are not small."""
        if not len(slots):
            return slots
        head = np.concatenate(([True], key[1:] != key[:-1]))
        heads = np.flatnonzero(head)
        sizes = np.diff(np.append(heads, len(slots)))
        large = np.repeat(sizes >= self.few, sizes)
        # Members of small groups get ranks of their own, so that equal ranks always mean equal prefixes.
        rank[self.sa[slots]] = np.where(large, np.repeat(slots[heads], sizes), slots)
        self.ranks.append(rank)
        self.inner.append(slots[large & ~head])
        return slots[large]

    def lcp(self) -> np.ndarray:
        """By slot, items in common with the suffix before; exact up to depths that ``few`` suffixes share, 0 where fewer share any."""
        out, n = np.zeros(len(self.sa), np.int64), len(self.sa)
        for k in reversed(range(len(self.ranks))):
            at, rank = self.inner[k], self.ranks[k]
            a, b = self.sa[at - 1] + out[at], self.sa[at] + out[at]
            inside = np.maximum(a, b) < self.end[self.sa[at]]
            same = rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)]
            out[at] += (inside & same).astype(np.int64) << k
        return out


def _reach(lcp: np.ndarray, at: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The LCP interval (first and last slot) of depth lcp[at] around each boundary ``at``; none is longer than ``most``."""
    minima = [lcp]
    while 2 << len(minima) <= 2 * most:
        last, step = minima[-1], 1 << (len(minima) - 1)
        minima.append(np.minimum(last, np.concatenate([last[step:], np.zeros(min(step, len(last)), lcp.dtype)])))
    depth, left, right, n = lcp[at], at.copy(), at.copy(), len(lcp)
    for k in reversed(range(len(minima))):
        to = left - (1 << k)
        left = np.where((to >= 0) & (minima[k][np.maximum(to, 0)] >= depth), to, left)
        to = right + 1
        right = np.where((to + (1 << k) <= n) & (minima[k][np.minimum(to, n - 1)] >= depth), right + (1 << k), right)
    return left - 1, right


def squares(s: Suffixes, times: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of the last square of each run of at least ``times`` periods, for its period and multiples of it."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not s.inner or not len(s.inner[0]):
        return none
    lcp, at = s.lcp(), s.inner[0]
    edges = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    left, right = _reach(lcp, at, int(np.diff(np.append(edges, len(at))).max()) + 1)
    large = right - left + 1 >= times
    at, left, right = at[large], left[large], right[large]
    if not len(at):
        return none
    # Boundaries of one interval together, in their order: children begin at its first slot and at each boundary.
    order = np.lexsort((at, lcp[at], left))
    at, left, right, depth = at[order], left[order], right[order], lcp[at][order]
    new = np.concatenate(([True], (left[1:] != left[:-1]) | (depth[1:] != depth[:-1])))
    number = np.cumsum(new) - 1
    opening = np.flatnonzero(new)
    begins = np.insert(at, opening, left[opening])
    interval = np.insert(number, opening, number[opening])
    closes = np.append(interval[1:] != interval[:-1], True)
    sizes = np.where(closes, right[opening][interval] + 1, np.append(begins[1:], 0)) - begins
    # All children but one that is largest.
    ranked = np.lexsort((-sizes, interval))
    tried = np.ones(len(begins), bool)
    tried[ranked[np.concatenate(([True], interval[ranked][1:] != interval[ranked][:-1]))]] = False
    begins, sizes, interval = begins[tried], sizes[tried], interval[tried]
    slots = np.arange(sizes.sum()) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)
    i, which = s.sa[slots], np.repeat(interval, sizes)
    low, high, period = left[opening][which], right[opening][which], depth[opening][which]

    def inside(j: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether position j lies in the sequence of position ``at`` and its suffix in the interval."""
        ok = (j >= s.begin[at]) & (j < s.end[at])
        slot = s.isa[np.clip(j, 0, len(s.isa) - 1)]
        return ok & (slot >= low) & (slot <= high)

    forth, back = inside(i + period, i, low, high), inside(i - period, i, low, high)
    start = np.concatenate([i[forth], (i - period)[back]])
    low, high, period = (np.concatenate([x[forth], x[back]]) for x in (low, high, period))
    after = start + 2 * period
    last = (after >= s.end[start]) | (s.items[np.minimum(after, len(s.items) - 1)] != s.items[start + period])
    for k in range(1, times - 1):
        last[last] = inside(start[last] - k * period[last], start[last], low[last], high[last])
    found = np.unique(np.stack([start[last], period[last]], axis=1), axis=0)
    return found[:, 0], found[:, 1]


def _rotate(items: np.ndarray, begin: int, start: int, period: int) -> int:
    """How far to the left of ``start``, down to ``begin``, items equal those a period later."""
    step = 64
    while start > begin:
        a = max(begin, start - step)
        other = np.flatnonzero(items[a:start] != items[a + period : start + period])
        if len(other):
            return a + int(other[-1]) + 1
        start, step = a, 2 * step
    return start


def runs(items: np.ndarray, bounds: np.ndarray, times: int = TIMES, least: int = LEAST) -> dict[int, list[Run]]:
    """Runs of each sequence that has any, by start, then period. ``times``: periods that a run has, at least; 2 or more."""
    found: dict[int, dict[tuple[int, int], int]] = {}
    s = Suffixes(items, bounds, times)
    start, period = squares(s, times)
    ends: dict[int, list[tuple[int, int]]] = {}  # by where runs end: (period, start)
    for p, i in sorted(zip(period.tolist(), start.tolist(), strict=True)):
        known = ends.setdefault(i + 2 * p, [])
        if any(p % q == 0 and begin <= i - (times - 2) * p for q, begin in known):
            continue  # a multiple of the period of a run that is found
        begin = int(s.begin[i])
        first = _rotate(items, begin, i - (times - 2) * p, p)
        known.append((p, first))
        length = i + 2 * p - first
        if length >= max(least, times * p):
            found.setdefault(begin, {}).setdefault((first - begin, length), p)
    number = {int(b): k for k, b in reversed(list(enumerate(bounds[:-1].tolist()))) if bounds[k] < bounds[k + 1]}
    return {number[begin]: sorted((a, n, p) for (a, n), p in own.items()) for begin, own in found.items()}


# ---------------------------------------------------------------- texts


def best(found: list[Run]) -> Run:
    """The run of most periods; ties by start, then period."""
    return max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, end to end, and where each text's begin."""
    split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    flat = split.flatten()
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    return flat.filter(pa.array(real)), np.concatenate(([0], np.cumsum(real)))[split.offsets.to_numpy()]


def text_runs(texts: pa.Array, times: int = TIMES, least: int = LEAST) -> tuple[np.ndarray, dict[int, list[Run]], pa.Array]:
    """Of ``texts``, which have no nulls: numbers of words, the runs of those that have any, and the texts without the repeats."""
    words, bounds = _words(texts)
    found = runs(words.dictionary_encode().indices.to_numpy().astype(np.int64), bounds, times, least) if len(words) else {}
    keep = np.ones(len(words), bool)
    for k, own in found.items():
        for start, length, period in own:
            keep[bounds[k] + start + period : bounds[k] + start + length] = False
    kept = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(keep)))[bounds], pa.int32()), words.filter(pa.array(keep)))
    return np.diff(bounds), found, pc.binary_join(kept, pa.scalar(" ", pa.large_string()))


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = TIMES, least: int = LEAST) -> DataFrame:
    """Per row: doc_id, n_words, ``runs`` (start, length, period of each, in words), ``best`` of them, and ``collapsed``, the text without what a run repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            weight = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64)) // (6 * GROUP)
            cuts = [0, *(np.flatnonzero(np.diff(weight)) + 1).tolist(), len(texts)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                n_words, found, collapsed = text_runs(texts.slice(a, b - a), times, least)
                named = lambda r: dict(zip(("start", "length", "period"), r, strict=True))
                each = [list(map(named, found.get(k, ()))) for k in range(b - a)]
                top = [named(best(found[k])) if k in found else None for k in range(b - a)]
                columns = [batch.column(0).slice(a, b - a), pa.array(n_words, pa.int64()), pa.array(each, pa.list_(_RUN)), pa.array(top, _RUN), collapsed.cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "best", "collapsed"])

    shape = "struct<start: long, length: long, period: long>"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, runs array<{shape}>, best {shape}, collapsed string")


def digest(found: DataFrame) -> DataFrame:
    """Per row of ``find_runs``: number of runs, the best, and checksums of all runs and of the collapsed text."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    at = F.col("best").getField
    milli = (at("length") * 1000 - F.pmod(at("length") * 1000, at("period"))) / at("period")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[at(c).alias(c) for c in ("start", "length", "period")],
        milli.cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def planted(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text, in which for a tenth of the ids (by their checksum) words from some place on repeat; a null id counts as an empty one."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    h = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)

    def repeat(state: Column) -> Column:
        w, n = state["words"], F.size(state["words"])
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, a + F.pmod(i - a, p)))), " ")

    # Through an array of one, so that a text is split once.
    made = F.get(F.transform(F.array(F.struct(words.alias("words"))), repeat), F.lit(0))
    return F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), made).otherwise(text)

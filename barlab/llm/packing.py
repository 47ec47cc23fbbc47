"""Best-fit packing of token sequences by a configuration linear program.

Documents become pieces of at most ``CAPACITY`` tokens. How many pieces have each length is a histogram
of at most ``CAPACITY`` numbers, whatever the number of documents, so the plan is made on it alone:

1. The configuration program (as few patterns of lengths as cover the histogram, used in any fractions) is
   solved by multiplicative weights: prices start in proportion to length and fall by a factor as a length is
   covered; a knapsack dynamic program over the capacity prices patterns, for all lengths at once (the best
   pattern that holds each length), and those near the best price are used, each step for a share of a length's
   pieces. Where a step places little, the next admits patterns further from the best price and larger shares.
2. The solution is rounded: each pattern is used its whole number of times, then once more where its fraction is
   large and all its pieces are left. What is left is a smaller histogram, and goes through the program again,
   ``ROUNDS`` times in all.
3. The rest, fewer pieces than the capacity has lengths on all histograms tried, whatever the number of
   documents, is packed best-fit decreasing by runs of equal pieces in equal sequences. ``plan`` logs the share of
   the pieces that the program placed.

The plan (patterns and how often they are used) is broadcast; it has some thousands of patterns, which do
not grow with the documents. Pieces of one length are numbered across tasks without gathering them: range partitions count
their own, and prefix sums of these counts say where each partition's numbers start. A piece's number and
length give its sequence and offset.

Null and empty texts are one piece, the closing id alone. Repeated rows are packed each. An empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
import logging
import math
import os
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.llm.common import durable, unused

CAPACITY = 2048
CLOSING = 0
#: Cuts of text whose ids a task remembers, the longest of them, and texts encoded together, in characters.
MEMO, MEMO_CHARS, GROUP = 250_000, 24, 1_000_000
#: Prices within this share of the best are used at first, for this share of a length's pieces in a step; both grow
#: to 1, by a factor after each step that places less than a share of all pieces. A covered length's price falls by exp(-RATE).
NEAR, SHARE, WIDER, LITTLE, RATE = 0.01, 1 / 12, 1.3, 0.005, 0.5
#: Steps end when less than this share of the pieces is uncovered, after this many at most; solutions that are rounded in turn.
UNCOVERED, STEPS, ROUNDS = 1e-3, 300, 4

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

# ---------------------------------------------------------------- documents to pieces

#: White space of which the pre-tokenizer's rules and these agree; texts with other such characters are encoded whole.
_CUT = re.compile(r" ?[^ \t-\r]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]")
_ODD = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]|<\|")


#: Cuts and texts of which both libraries' rules agree: words of Latin letters, digits and signs, and common white space; no long runs of either.
_PLAIN = re.compile(r" ?[!-~\xa1-\u024f]{1,200}")
_PLAIN_TEXT = re.compile(r"[ \t\n\r]{0,200}+(?:[!-~\xa1-\u024f]{1,200}+[ \t\n\r]{1,200}+)*+[!-~\xa1-\u024f]{0,200}+")


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level tokenizer file; characters stand for bytes by the usual rule."""
    from tokenizers import Tokenizer

    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    vocabulary = Tokenizer.from_file(path).get_vocab()
    table = [b""] * (max(vocabulary.values()) + 1)
    for token, k in vocabulary.items():
        table[k] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    return table


def _merger(path: str):
    """A faster library with the same vocabulary, and the bytes of each id; None where ids are not in the order of merges."""
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    table = token_bytes(path)
    special = {t["id"] for t in model.get("added_tokens", ())}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
    vocabulary = model["model"]["vocab"]
    usual = model.get("normalizer") is None and model["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    if not usual or any(vocabulary[a + b] != 256 + k for k, (a, b) in enumerate(merges)):
        return None, None
    ranks = {b: k for k, b in enumerate(table) if k not in special}
    return tiktoken.Encoding("same", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), np.array([len(b) for b in table])


class Encoder:
    """Texts -> ids of a tokenizer file as little-endian unsigned 32-bit bytes: byte-level, words cut at white space.

    Plain texts are encoded by a faster library with the same merges. Others are cut: rules of the pre-tokenizer never join
    a character to white space after it, so cuts encode alone; those not met before are encoded together, plain ones by the faster
    library. ``specials``: whether strings of special tokens in a text become their ids (the library's default).
    """

    def __init__(self, path: str, specials: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not specials
        self.memo: dict[str, bytes | None] = {}
        self.merger, self.width = _merger(path)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_cuts(self, cuts: list[str]) -> Iterator[tuple[str, bytes | None]]:
        """Cuts with their ids, or None where the whole text is needed; in any order."""
        other, plain = [], []
        for c in cuts:
            if not _PLAIN.fullmatch(c) or _ODD.search(c) or self.merger is None:
                other.append(c)
            else:
                plain.append(c)
        if plain:
            # One call for all: cuts start with their space, or are put on a line of their own.
            bare = np.array([c[0] != " " for c in plain])
            ids = self.merger.encode_to_numpy("".join(c if c[0] == " " else "\n" + c for c in plain), disallowed_special=()).astype("<u4")
            ends = np.cumsum(np.array([len(c.encode()) for c in plain]) + bare)
            last = np.searchsorted(np.cumsum(self.width[ids]), ends) + 1
            first = np.append(0, last[:-1]) + bare
            raw = ids.tobytes()
            for c, i, j in zip(plain, (4 * first).tolist(), (4 * last).tolist(), strict=True):
                yield c, raw[i:j]
        for c, i in zip(other, self._encode(other), strict=True):
            yield c, None if _ODD.search(c) else i

    def _plain(self, text: str) -> bytes | None:
        if self.merger is None or "<|" in text or not _PLAIN_TEXT.fullmatch(text):
            return None
        return self.merger.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        known = [self._plain(t) for t in texts]
        other = self._cut([t for t, ids in zip(texts, known, strict=True) if ids is None])
        for ids in known:
            yield next(other) if ids is None else ids

    def _cut(self, texts: list[str]) -> Iterator[bytes]:
        cuts = [_CUT.findall(t) for t in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        new = list(set().union(*cuts).difference(self.memo))
        self.memo.update(self._encode_cuts(new))
        for text, own in zip(texts, cuts, strict=True):
            ids = list(map(self.memo.__getitem__, own))
            yield self._encode([text])[0] if None in ids else b"".join(ids)
        for c in new:
            if len(c) > MEMO_CHARS:
                del self.memo[c]

    def __call__(self, texts: Iterable[str]) -> Iterator[bytes]:
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= GROUP:
                yield from self._group(held)
                held, size = [], 0
        if held:
            yield from self._group(held)


@lru_cache(maxsize=2)
def encoder(path: str, specials: bool = True) -> Encoder:
    return Encoder(path, specials)


def cut_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document of ``n`` ids; only the first may be shorter than the capacity."""
    if n <= capacity:
        return [n]
    return ([n % capacity] if n % capacity else []) + [capacity] * (n // capacity)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length and ids_crc32."""
    closing = np.array([CLOSING], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), encode(t.as_py() for t in batch.column(1)), strict=True):
                ids += closing
                start = 0
                for k, n in enumerate(cut_lengths(len(ids) // 4, capacity)):
                    rows.append((doc, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])))
                    start += n
            if not rows:
                continue
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, PIECES)


# ---------------------------------------------------------------- the plan, on the histogram

Pattern = tuple[tuple[int, int], ...]  # (length, how many of it), longest first


def price(prices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack: for each capacity the best sum of prices, and the length to put in first (0: leave one free).

    ``prices`` has a price for each length from 0; lengths that are out of use have -inf.
    """
    best, first = np.zeros(len(prices)), np.zeros(len(prices), np.int64)
    for c in range(1, len(prices)):
        value = best[c - 1 :: -1] + prices[1 : c + 1]
        k = int(value.argmax())
        best[c], first[c] = (value[k], k + 1) if value[k] > best[c - 1] else (best[c - 1], 0)
    return best, first


def _patterns(lengths: np.ndarray, first: np.ndarray, capacity: int) -> np.ndarray:
    """For each length, the best pattern that holds it: a row of lengths, zeros after the last."""
    rows, room = [lengths], capacity - lengths
    while room.any():
        rows.append(first[room])
        room = np.maximum(0, np.where(first[room] > 0, room - first[room], room - 1))
    return np.stack(rows, axis=1)


def solve(counts: np.ndarray, seed: int = 0) -> dict[Pattern, float]:
    """How often each pattern is used in a fractional cover of ``counts``, by multiplicative weights."""
    capacity, total = len(counts) - 1, int(counts.sum())
    rng = np.random.default_rng(seed)
    left, near = counts.astype(float), NEAR
    used: dict[Pattern, float] = {}
    for _ in range(STEPS):
        lengths = np.flatnonzero(left > 1e-6 * counts)
        if left.sum() < UNCOVERED * total or not len(lengths):
            break
        covered = 1 - left[lengths] / counts[lengths]
        prices = np.full(capacity + 1, -np.inf)
        # Jitter chooses among patterns of nearly equal price, so that steps differ; less of it where pieces are short keeps these for later.
        jitter = 1 + 1e-4 * lengths / capacity * rng.random(len(lengths))
        prices[lengths] = lengths * np.exp(-RATE * (covered - covered.mean())) * jitter
        best, first = price(prices)
        value = prices[lengths] + best[capacity - lengths]
        share = SHARE ** (math.log(near) / math.log(NEAR))
        budget = np.minimum(left, share * counts)
        placed = 0.0
        for own in _patterns(lengths[value >= (1 - near) * value.max()], first, capacity)[::-1]:
            held = Counter(own[own > 0].tolist())
            times = min(budget[n] / a for n, a in held.items())
            if times > 1e-9:
                pattern = tuple(sorted(held.items(), reverse=True))
                used[pattern] = used.get(pattern, 0.0) + times
                for n, a in held.items():
                    left[n] -= times * a
                    budget[n] -= times * a
                    placed += times * a
        if placed < LITTLE * total:
            if near >= 1 and placed < 1e-9 * total:
                break
            near = min(1.0, near * WIDER)
    return used


def rounded(fractional: dict[Pattern, float], counts: np.ndarray) -> tuple[Counter[Pattern], np.ndarray]:
    """Whole numbers of uses of the patterns, and the histogram of what they leave of ``counts``."""
    left, used, fractions = counts.copy(), Counter(), []

    def use(pattern: Pattern, times: int) -> None:
        used[pattern] += times
        for n, a in pattern:
            left[n] -= a * times

    for pattern, times in fractional.items():
        # Rounding errors of the sums must not take more than there is.
        whole = min(int(times + 1e-9), *(int(left[n]) // a for n, a in pattern))
        use(pattern, whole)
        fractions.append((times - whole, pattern))
    for _, pattern in sorted(fractions, reverse=True):
        if all(left[n] >= a for n, a in pattern):
            use(pattern, 1)
    return +used, left


def program(counts: np.ndarray) -> tuple[Counter[Pattern], np.ndarray]:
    """Patterns of rounded solutions, how often each is used, and the histogram of what they leave."""
    used, left = Counter(), counts.copy()
    for k in range(ROUNDS):
        more, left = rounded(solve(left, k), left)
        used += more
    return used, left


def best_fit(counts: np.ndarray) -> Counter[Pattern]:
    """Best-fit decreasing over the histogram, by runs: the sequences of a run are equal and take equal pieces at once.

    A sequence that takes a piece has the least room that fits, and so takes the next until none fits. A length
    splits at most one run and opens at most two, so there are a few runs for each length, whatever the counts.
    """
    capacity = len(counts) - 1
    rooms: list[int] = []  # of the runs, sorted
    runs: dict[int, list[tuple[Pattern, int]]] = {}
    for k in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[k])
        while n:
            at = bisect_left(rooms, k)
            if at < len(rooms):
                room = rooms[at]
                pattern, times = runs[room].pop()
                if not runs[room]:
                    del runs[room], rooms[at]
            else:
                room, pattern, times = capacity, (), n
            each = min(room // k, n)
            filled = min(times, n // each)
            n -= filled * each
            for after, m, free in (((*pattern, (k, each)), filled, room - k * each), (pattern, times - filled, room)):
                if after and m:
                    if free not in runs:
                        insort(rooms, free)
                    runs.setdefault(free, []).append((after, m))
    used: Counter[Pattern] = Counter()
    for pattern, times in (x for own in runs.values() for x in own):
        used[pattern] += times
    return used


def plan(counts: np.ndarray) -> Counter[Pattern]:
    """Patterns, and how often each is used, that hold exactly the pieces of the histogram ``counts``."""
    capacity = len(counts) - 1
    left = counts.astype(np.int64).copy()
    full = Counter({((capacity, 1),): int(left[capacity])})
    left[capacity] = 0
    used, rest = program(left)
    logging.getLogger(__name__).info("the program placed %.4f of %d pieces", 1 - int(rest.sum()) / max(1, int(left.sum())), left.sum())
    return +(full + used + best_fit(rest))


# ---------------------------------------------------------------- the plan applied

@dataclass(frozen=True)
class Slots:
    """Where the pieces of each length go: runs of slots, in the order of their numbers."""

    start: dict[int, np.ndarray]  # number of the first piece of each run
    sequence: dict[int, np.ndarray]  # the run's first sequence
    each: dict[int, np.ndarray]  # pieces of this length in one sequence
    offset: dict[int, np.ndarray]  # of the first of them

    @classmethod
    def of(cls, used: Counter[Pattern]) -> Slots:
        runs: dict[int, list[tuple[int, int, int, int]]] = {}
        sequence = 0
        for pattern, times in sorted(used.items()):
            offset = 0
            for length, a in pattern:
                runs.setdefault(length, []).append((times * a, sequence, a, offset))
                offset += length * a
            sequence += times
        table = {k: np.array(v, np.int64) for k, v in runs.items()}
        return cls({k: np.cumsum(np.append(0, v[:-1, 0])) for k, v in table.items()}, *({k: v[:, c] for k, v in table.items()} for c in (1, 2, 3)))

    def place(self, length: int, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence_id, offset) of pieces of ``length``, by their numbers from 0."""
        run = np.searchsorted(self.start[length], numbers, "right") - 1
        turn, k = np.divmod(numbers - self.start[length][run], self.each[length][run])
        return self.sequence[length][run] + turn, self.offset[length][run] + k * length


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``rows``, pieces with a ``length`` of at most ``capacity``, with sequence_id and offset."""
    number = unused(rows, "part")
    spread = durable(rows.repartitionByRange("length", F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])).withColumn(number, F.spark_partition_id()))
    histogram = spread.groupBy(F.col(number).alias("part"), "length").agg(F.count("*").alias("n"))
    # A range partition holds few lengths: this has at most a row for each partition and each length.
    counted = [(r["part"], r["length"], r["n"]) for r in histogram.collect()]
    counts = np.zeros(capacity + 1, np.int64)
    first: dict[tuple[int, int], int] = {}
    for part, length, n in sorted(counted):
        first[part, length] = int(counts[length])
        counts[length] += n
    slots = Slots.of(plan(counts))
    shared = rows.sparkSession.sparkContext.broadcast((slots, first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, first = shared.value
        done: Counter[tuple[int, int]] = Counter()
        for batch in batches:
            length, part = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", number))
            sequence, offset = np.empty((2, len(length)), np.int64)
            for key in np.unique(np.stack([part, length], axis=1), axis=0).tolist():
                key = tuple(key)
                at = np.flatnonzero((part == key[0]) & (length == key[1]))
                sequence[at], offset[at] = slots.place(key[1], first[key] + done[key] + np.arange(len(at)))
                done[key] += len(at)
            kept = [name for name in batch.schema.names if name != number]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    schema = ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes)
    return spread.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, **columns: str) -> DataFrame:
    """Per piece of each document: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(durable(pieces(docs, path, capacity, **columns)), capacity)

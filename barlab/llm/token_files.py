"""Token ids in files of compressed blocks: adaptive context mixing and a range coder.

Documents are encoded with a tokenizer file, each closed by an end id, and written in ascending order of doc_id.
A file holds whole documents: blocks of up to ``BLOCK`` ids, an index of its documents, and a footer. Each block
carries its own model, and checksums of its ids and of its code, so any block is read alone.

The model of a block:

- order 0: its distinct ids and how often each occurs, in a table before the code, the gaps between ids and the counts in bits;
- order 2 and order 1: the id that last followed the same two, or the same one, with how often in a row it did, from what the block has
  shown so far.

First comes a decision whether the next id is the candidate of the highest order that has one. Its probability mixes
the three orders' estimates by weights that follow how well each did (Bayes with forgetting). If not, order 0 codes the id by its
count. Both narrow one range of up to 48 bits, of which 16 bits leave at a time; carries are passed on at the end. Estimates use
only sums, products and quotients of floats, so every machine computes the same.

Blocks are coded side by side, step by step, in numpy: a step codes one id of each of up to ``LANES`` blocks, all by the same operations
on whole arrays. Encoding and decoding run the same model. Tables are packed and read for all blocks at once.

In Spark: rows are range-sorted by (doc_id, hash of text, row), so a doc_id or a row that repeats any number of times is
dealt over tasks; a task writes files of about ``FILE_IDS`` ids under names of its own and returns their list, which is kept. Files of
lost attempts are in no list. The list, a row for each file, gives where each file's ids start. Reading deals files to tasks.

Null and empty texts are the end id alone. Null doc_ids come first. Rows that share a doc_id follow in the order of a
hash of their texts. A long text is encoded whole, its words in groups. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barlab.llm.common import durable, scratch, unused

END_ID = 2
#: Ids of a block, blocks that are coded side by side, and ids of a file (about).
BLOCK, LANES, FILE_IDS = 1024, 4096, 1 << 22
#: Blocks whose tables are made together, few enough for a core's cache.
TOGETHER = 256
#: Bytes of text that are split together.
GROUP = 16 << 20
#: Words of letters that are one character each in lower case, with signs after them; a character that they do not have marks ends.
_SIGNS, _SIGN = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"), r"!-&(-/:-@\[-`{-~"
_PLAIN, _LETTERS, _MARK = f"\\A[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+[{_SIGN}]*\\z", f"\\A[^{_SIGN}]+", "\x01"

# ---------------------------------------------------------------- texts to ids


def _merger(path: str):
    """A faster library with the same merges, for words whose end is marked by ``_MARK``; None where ids are not in the order of merges."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
    vocabulary, special = model["model"]["vocab"], {t["id"] for t in model.get("added_tokens", ())}
    if model["model"].get("end_of_word_suffix") != "</w>" or any(vocabulary[a + b] != 512 + k for k, (a, b) in enumerate(merges)):
        return None
    ranks = {bytes(byte[c] for c in t.removesuffix("</w>")) + _MARK.encode() * t.endswith("</w>"): k for t, k in vocabulary.items() if k not in special}
    # Without a special token the library stops at every character to look for one.
    return tiktoken.Encoding("marked", pat_str=f"[^{_MARK}]+{_MARK}", mergeable_ranks=ranks, special_tokens={"\x02": 1 + max(vocabulary.values())})


def _arrays(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Stretches of ids, as bytes, so that Arrow can pick and join them."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(4 * np.concatenate(([0], ends)).astype(np.int64)), pa.py_buffer(values.astype(np.uint32))])


def _values(arrays: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the stretches, end to end, and where each begins and the last one ends."""
    offsets = np.frombuffer(arrays.buffers()[1], np.int64)[: len(arrays) + 1] // 4
    return np.frombuffer(arrays.buffers()[2] or b"", np.uint32)[: offsets[-1]], offsets


class WordEncoder:
    """Texts -> ids, for tokenizer files that drop white space: words cut at it encode alone, and each distinct one of a group of texts once.

    Words of Latin letters with signs after them, of which the pre-tokenizer makes a piece each, are encoded by a faster library with the same merges:
    each distinct word in lower case once, and the signs apart.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if len(self._library(["a \n b"])[0]) != sum(map(len, self._library(["a", "b"]))):
            raise ValueError("a tokenizer that keeps white space; its words do not encode alone")
        self.merger = _merger(path)
        self.ends = np.array([t.endswith("</w>") for t, _ in sorted(self.tokenizer.get_vocab().items(), key=lambda x: x[1])])

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, words: pa.Array) -> pa.Array:
        """The ids of words, by the library."""
        found = self._library(words.to_pylist())
        return _arrays(np.array(list(chain.from_iterable(found)), np.uint32), np.cumsum(list(map(len, found)), dtype=np.int64))

    def _merged(self, words: pa.Array) -> pa.Array:
        """The ids of words in lower case, by the faster library."""
        marked = pc.binary_join_element_wise(words, pa.scalar(_MARK, words.type), pa.scalar("", words.type))
        ids = self.merger.encode_to_numpy(str(marked.buffers()[2], "utf-8"), disallowed_special=())
        return _arrays(ids, np.flatnonzero(self.ends[ids]) + 1)

    def _plain(self, words: pa.Array) -> pa.Array:
        """The ids of words of letters with signs after them."""
        words = pc.utf8_lower(words)
        letters = pc.ascii_rtrim(words, characters=_SIGNS)
        coded = letters.dictionary_encode()
        own = self._merged(coded.dictionary).take(coded.indices)
        if pc.sum(pc.binary_length(words)) == pc.sum(pc.binary_length(letters)):
            return own
        signs = pc.replace_substring_regex(words, _LETTERS, "").dictionary_encode()
        return pc.binary_join_element_wise(own, self._each(signs.dictionary).take(signs.indices), pa.scalar(b"", own.type))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``texts`` (without nulls), end to end, and how many each has."""
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        plain = pc.match_substring_regex(words, _PLAIN).to_numpy(zero_copy_only=False).astype(bool) & (self.merger is not None)
        known = pa.concat_arrays([self._plain(words.filter(pa.array(plain))), self._each(words.filter(pa.array(~plain)))]) if plain.any() else self._each(words)
        place = np.where(plain, np.cumsum(plain), plain.sum() + np.cumsum(~plain)) - 1
        ids, bounds = _values(known.take(pa.array(place[coded.indices.to_numpy()])))
        return ids, np.diff(bounds[split.offsets.to_numpy()])


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


# ---------------------------------------------------------------- range coder

_DIGIT, _LEAST, _ODDS = 16, 1 << 32, 12  # bits of a digit, least range after a step, bits of a flag's chances


def _mask(flags: np.ndarray, kind: type = np.int64) -> np.ndarray:
    """All bits where a flag is set: choosing by bits takes a third of the time of choosing by flags that follow no pattern."""
    return np.negative(flags.astype(kind))


class Encoder:
    """Ranges of 32 to 48 bits, one for each lane. Digits leave with their carries, which are passed on in the end."""

    def __init__(self, lanes: int):
        self.low, self.range = np.zeros(lanes, np.int64), np.full(lanes, 1 << 48, np.int64)
        self.digits: list[np.ndarray] = []
        self.given: list[np.ndarray] = []

    def step(self, m: int, odds: np.ndarray, lead: np.ndarray, true: np.ndarray, at: np.ndarray, table: _Counts) -> tuple[np.ndarray, np.ndarray]:
        """Codes the numbers ``true`` of the first ``m`` lanes: with chances ``odds`` ``lead``, else by their counts."""
        low, size = self.low[:m], self.range[:m]
        part = (size >> _ODDS) * odds
        hit = true == lead
        unit = (size - part) >> table.bits[:m]
        span = table.spans.take(at + true).astype(np.int64)
        chosen = _mask(hit)
        low += (part + unit * (span >> 16)) & ~chosen
        np.multiply(unit, span & 0xFFFF, out=size)
        size ^= (size ^ part) & chosen
        while size.min() < _LEAST:
            self._digit(size < _LEAST)
        return hit, true

    def _digit(self, short: np.ndarray) -> None:
        m = len(short)
        low, size, one = self.low[:m], self.range[:m], short.astype(np.int64)
        digits, given = (low >> 32).astype(np.uint32), short
        if m < len(self.low):
            digits, given = (np.concatenate([x, np.zeros(len(self.low) - m, x.dtype)]) for x in (digits, given))
        shift = one * _DIGIT
        one -= 1
        one |= _LEAST - 1
        low &= one
        low <<= shift
        size <<= shift
        self.digits.append(digits)
        self.given.append(given)

    def finish(self) -> list[bytes]:
        for _ in range(3):
            self._digit(np.ones(len(self.low), bool))
        given = np.ascontiguousarray(np.stack(self.given).T)
        digits = np.ascontiguousarray(np.stack(self.digits).T)[given]
        while (over := digits >> 16).any():
            digits &= 0xFFFF
            digits[:-1] += over[1:]
        data, ends = digits.astype("<u2").tobytes(), (2 * np.cumsum(given.sum(axis=1))).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class Decoder:
    """The encoder's ranges, and where in them the code lies."""

    def __init__(self, codes: list[bytes]):
        sizes = np.array([len(c) // 2 for c in codes])
        self.data = np.concatenate([np.frombuffer(b"".join(codes), "<u2"), np.zeros(8, np.uint16)]).astype(np.uint16)
        first = np.cumsum(sizes) - sizes
        self.code = sum(self.data.take(np.minimum(first + k, len(self.data) - 1)).astype(np.int64) << (32 - 16 * k) for k in range(3))
        self.at, self.range = first + 3, np.full(len(codes), 1 << 48, np.int64)

    def step(self, m: int, odds: np.ndarray, lead: np.ndarray, true: None, at: np.ndarray, table: _Counts) -> tuple[np.ndarray, np.ndarray]:
        code, size = self.code[:m], self.range[:m]
        part = (size >> _ODDS) * odds
        hit = code < part
        unit = (size - part) >> table.bits[:m]
        chosen = _mask(hit)
        other = ~chosen
        # Both are below 2^53, so the quotient of doubles is exact when it is cut.
        place = np.minimum((((code - part) & other) / unit).astype(np.int64), table.most[:m])
        found = table.numbers.take(at + place)
        found ^= (found ^ lead) & _mask(hit, np.uint16)
        span = table.spans.take(at + found).astype(np.int64)
        code -= (part + unit * (span >> 16)) & other
        np.multiply(unit, span & 0xFFFF, out=size)
        size ^= (size ^ part) & chosen
        while size.min() < _LEAST:
            one, where = (size < _LEAST).astype(np.int64), self.at[:m]
            shift = one * _DIGIT
            code <<= shift
            size <<= shift
            code += self.data.take(where, mode="clip") * one
            where += one
        return hit, found


# ---------------------------------------------------------------- counts of a block


class _Counts:
    """What order 0 knows of each block: its distinct ids, ascending, and how often each occurs. Flat, a stretch of ``block`` for each lane."""

    def __init__(self, lengths: np.ndarray, distinct: np.ndarray, counts: np.ndarray):
        """``counts``: of the ``distinct`` ids of each block, end to end."""
        lanes, block = len(lengths), int(lengths[0])
        begin = np.cumsum(distinct) - distinct
        lane = np.repeat(np.arange(lanes), distinct)
        number = np.arange(len(counts)) - begin[lane]
        first = np.cumsum(counts) - counts
        first -= first[begin][lane]
        self.spans = np.zeros(lanes * block, np.uint32)  # the first of its places in the high bits, their number in the low ones
        self.spans[lane * block + number] = first << 16 | counts
        self.numbers = np.zeros(lanes * block, np.uint16)  # by place
        places = np.repeat(number.astype(np.uint16), counts)
        if len(places) == len(self.numbers):
            self.numbers = places
        else:
            self.numbers[np.repeat(lane * block + first, counts) + np.arange(len(places)) - np.repeat(np.cumsum(counts) - counts, counts)] = places
        self.bits, self.most = np.frexp(lengths - 0.5)[1].astype(np.int64), lengths - 1
        self.best = (self.spans.reshape(lanes, block) & 0xFFFF).argmax(axis=1).astype(np.uint16)


_TABLE = struct.Struct("<HBHH")  # distinct ids, low bits of gaps, bytes of their high parts, bytes of counts in unary (none: two bytes a count)


def _before(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _unary(values: np.ndarray, per: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Numbers from 1, each as a bit after as many others as it is above 1: bytes of stretches of ``per`` numbers, and how many each has."""
    ends = np.cumsum(values)
    bits = np.diff(ends[np.cumsum(per) - 1], prepend=0)
    size = -(-bits // 8)
    out = np.zeros(8 * int(size.sum()), np.uint8)
    out[ends + np.repeat(8 * _before(size) - _before(bits) - 1, per)] = 1
    return np.packbits(out).tobytes(), size


def _from_unary(data: bytes, per: np.ndarray, size: np.ndarray) -> np.ndarray:
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8)))
    values, begin = np.diff(ones, prepend=-1), _before(per)
    values[begin] = ones[begin] - 8 * _before(size) + 1
    return values


def pack_tables(distinct: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The tables of blocks: high parts of gaps in unary, their low bits, and counts, in unary where these are small."""
    begin = _before(distinct)
    gaps = np.diff(ids, prepend=-1) - 1
    gaps[begin] = ids[begin]
    low = np.maximum(np.frexp(0.7 * np.add.reduceat(gaps, begin) / distinct + 0.01)[1] - 1, 0).astype(np.int64)
    high, high_size = _unary((gaps >> np.repeat(low, distinct)) + 1, distinct)
    small = np.add.reduceat(counts, begin) < 16 * distinct
    unary, unary_size = np.zeros(0, np.uint8), np.zeros(len(distinct), np.int64)
    if small.any():
        unary, unary_size[small] = _unary(counts[np.repeat(small, distinct)], distinct[small])
    below: list[bytes] = [b""] * len(distinct)
    for width in np.unique(low[low > 0]).tolist():
        kind = np.dtype("<u2" if width <= 16 else "<u4")
        blocks = np.flatnonzero(low == width)
        own = gaps[np.repeat(low == width, distinct)].astype(kind)
        bits = np.unpackbits(own.view(np.uint8), bitorder="little").reshape(-1, 8 * kind.itemsize)[:, :width].reshape(-1)
        ends = (width * np.cumsum(distinct[blocks])).tolist()
        for k, a, b in zip(blocks.tolist(), [0, *ends], ends, strict=False):
            below[k] = np.packbits(bits[a:b]).tobytes()
    plain = counts.astype("<u2").tobytes()
    out, at, to = [], 0, 0
    for k, (n, w, h, u, first) in enumerate(zip(distinct.tolist(), low.tolist(), high_size.tolist(), unary_size.tolist(), begin.tolist(), strict=True)):
        out.append(_TABLE.pack(n, w, h, u) + high[at : at + h] + below[k] + (unary[to : to + u] if u else plain[2 * first : 2 * (first + n)]))
        at, to = at + h, to + u
    return out


def unpack_tables(codes: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """(distinct ids of each block, these ids, their counts, where each table ends)."""
    distinct, low, high_size, unary_size = np.array([_TABLE.unpack_from(c) for c in codes], np.int64).T
    at_low = _TABLE.size + high_size
    at_counts = at_low - (-low * distinct // 8)
    small = unary_size > 0
    ends = at_counts + np.where(small, unary_size, 2 * distinct)
    parts = lambda which, first, last: [codes[k][a:b] for k, a, b in zip(np.flatnonzero(which).tolist(), first[which].tolist(), last[which].tolist(), strict=True)]
    everyone = np.ones(len(codes), bool)
    gaps = (_from_unary(b"".join(parts(everyone, np.full(len(codes), _TABLE.size), at_low)), distinct, high_size) - 1) << np.repeat(low, distinct)
    for width in np.unique(low[low > 0]).tolist():
        kind = np.dtype("<u2" if width <= 16 else "<u4")
        which = low == width
        own = parts(which, at_low, at_counts)
        bits = [np.unpackbits(np.frombuffer(c, np.uint8), count=width * n) for c, n in zip(own, distinct[which].tolist(), strict=True)]
        wide = np.zeros((int(distinct[which].sum()), 8 * kind.itemsize), np.uint8)
        wide[:, :width] = np.concatenate(bits).reshape(-1, width)
        gaps[np.repeat(which, distinct)] |= np.packbits(wide.reshape(-1), bitorder="little").view(kind)
    counts = np.zeros(len(gaps), np.int64)
    if small.any():
        counts[np.repeat(small, distinct)] = _from_unary(b"".join(parts(small, at_counts, ends)), distinct[small], unary_size[small])
    if not small.all():
        counts[np.repeat(~small, distinct)] = np.frombuffer(b"".join(parts(~small, at_counts, ends)), "<u2")
    before = np.cumsum(gaps + 1)
    return distinct, before - 1 - np.repeat(before[_before(distinct)] - 1 - gaps[_before(distinct)], distinct), counts, ends.tolist()


# ---------------------------------------------------------------- model

def _chances() -> tuple[np.ndarray, np.ndarray]:
    """Estimates of orders 1 and 2 for the candidate that leads, by 32 * n2 + 16 * (order 1 has another) + n1; n: how often in a row one followed.

    From 1/32 to 63/64, so that with all weights above 1/200 no chance gets to 0 or 1.
    """
    one = np.array([1 / 32, 1 / 16, 1 / 4, 5 / 8, 3 / 4, 13 / 16] + [7 / 8] * 10)
    two = np.array([0, 1 / 8, 3 / 4, 15 / 16, 31 / 32, 31 / 32] + [63 / 64] * 10)
    first = np.tile(np.concatenate([one, np.full(16, 1 / 32)]), 16)
    second = np.where(np.arange(512) < 32, first, np.repeat(two, 32))
    return first.astype(np.float32), second.astype(np.float32)


_ONE, _TWO = _chances()


def _walk(lengths: np.ndarray, table: _Counts, coder: Encoder | Decoder, numbers: np.ndarray | None = None) -> np.ndarray:
    """Codes the ``numbers`` (steps x lanes) that ids have in their blocks; without them, reads and returns them."""
    lanes, block = len(lengths), int(lengths[0])
    hash_bits = max(4, (block - 1).bit_length())
    # By context: the number that followed last, and in the low four bits how often in a row.
    last1, last2 = np.repeat(table.best << 4, block + 1), np.zeros(lanes << hash_bits, np.uint16)  # order 0 has the most frequent id
    done = np.zeros((block, lanes), np.uint16) if numbers is None else numbers
    active = np.searchsorted(-lengths, -np.arange(block), side="left").tolist()  # lanes longer than each step
    everyone, shift, keep = np.arange(lanes), 32 - hash_bits, (1 << hash_bits) - 1
    base0, base1, base2 = everyone * block, everyone * (block + 1), everyone << hash_bits
    weight = np.full((3, lanes), 1 / 3, np.float32)
    part = (1 / lengths).astype(np.float32)
    prev, older = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    guess, four, one = np.empty((3, lanes), np.float32), np.uint16(4), np.uint16(1)
    for t, m in enumerate(active):
        if m < len(prev):
            prev, older, weight, guess = prev[:m], older[:m], weight[:, :m], guess[:, :m]
            base0, base1, base2, part = base0[:m], base1[:m], base2[:m], part[:m]
        at1 = base1 + prev
        at2 = base2 + ((prev * 0x9E3779B1 ^ older) >> shift & keep)
        old1, old2 = last1.take(at1), last2.take(at2)
        n1, n2, c1, c2 = old1 & np.uint16(15), old2 & np.uint16(15), old1 >> four, old2 >> four
        # Is it the candidate of the highest order that has one?
        lead = c1 ^ ((c1 ^ c2) & _mask(n2 > 0, np.uint16))
        state = ((n2 << np.uint16(5)) + n1 + ((c1 != lead).astype(np.uint16) << four)).astype(np.int64)
        np.multiply((table.spans.take(base0 + lead) & 0xFFFF).astype(np.float32), part, out=guess[0])
        _ONE.take(state, out=guess[1], mode="clip")
        _TWO.take(state, out=guess[2], mode="clip")
        mixed = weight * guess
        odds = ((mixed[0] + mixed[1] + mixed[2]) * np.float32(1 << _ODDS)).astype(np.int32).astype(np.int64)
        hit, found = coder.step(m, odds, lead, None if numbers is None else numbers[t, :m], base0, table)
        # What was shown.
        guess -= (~hit).astype(np.float32)
        weight *= np.abs(guess, out=guess)
        weight *= np.float32(0.98) / (weight[0] + weight[1] + weight[2])
        weight += np.float32(0.02 / 3)
        shown = (found << four) + one
        last1[at1] = shown + np.minimum(n1, 14) * (c1 == found)
        last2[at2] = shown + np.minimum(n2, 14) * (c2 == found)
        if numbers is None:
            done[t, :m] = found
        older = prev * 0x85EBCA6B
        prev = found + np.int64(1)
    return done


def _numbers(ids: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The number of each id among the distinct ones of its block, a row for each block; of each block how many these are; they themselves, and their counts."""
    n, bits = len(ids), max(1, (block - 1).bit_length())
    narrow = int(ids.max()) >> (32 - bits) == 0
    kind = np.uint32 if narrow else np.uint64
    key = np.full(-(-n // block) * block, np.iinfo(kind).max, kind)
    key[:n] = ids
    key = key.reshape(-1, block)
    if n % block:  # what fills up the last block comes after its ids
        key[-1, n % block :] >>= kind(bits)
    key = np.sort((key << kind(bits)) | np.arange(block, dtype=kind), axis=1)
    place, sorted_ids = (key & kind((1 << bits) - 1)).astype(np.int64), key >> kind(bits)
    head = np.ones(key.shape, bool)
    np.not_equal(sorted_ids[:, 1:], sorted_ids[:, :-1], out=head[:, 1:])
    made = np.empty(key.shape, np.uint16)
    made.reshape(-1)[place + np.arange(0, key.size, block)[:, None]] = np.cumsum(head, axis=1, dtype=np.uint16) - np.uint16(1)
    at = np.flatnonzero(head.reshape(-1)[:n])
    return made, np.bincount(at // block), sorted_ids.reshape(-1)[at].astype(np.int64), np.diff(at, append=n)


def encode_blocks(ids: np.ndarray, block: int = BLOCK) -> Iterator[tuple[int, int, bytes]]:
    """(number of ids, their checksum, code) of each block of ``ids``."""
    if block > 4096:
        raise ValueError("a block of over 4096 ids")
    for a in range(0, len(ids), block * LANES):
        part = np.ascontiguousarray(ids[a : a + block * LANES], "<u4")
        lengths = np.full(-(-len(part) // block), block, np.int64)
        lengths[-1] = len(part) - block * (len(lengths) - 1)
        # Steps by lanes; a short block is the last, as lanes come by descending length.
        numbers = np.empty((lengths[0], len(lengths)), np.uint16)
        heads: list[bytes] = []
        tables: list[tuple[np.ndarray, np.ndarray]] = []
        for b in range(0, len(lengths), TOGETHER):
            own, distinct, known, counts = _numbers(part[b * block : (b + TOGETHER) * block], block)
            numbers[:, b : b + TOGETHER] = own.T[: lengths[0]]
            heads += pack_tables(distinct, known, counts)
            tables.append((distinct, counts))
        coder = Encoder(len(lengths))
        _walk(lengths, _Counts(lengths, *map(np.concatenate, zip(*tables, strict=True))), coder, numbers)
        for k, (head, code) in enumerate(zip(heads, coder.finish(), strict=True)):
            yield int(lengths[k]), zlib.crc32(part[k * block : k * block + lengths[k]].tobytes()), head + code


def decode_blocks(blocks: list[tuple[int, int, bytes]]) -> list[np.ndarray]:
    """The ids of blocks, checked."""
    out: list[np.ndarray] = [None] * len(blocks)
    for a in range(0, len(blocks), LANES):
        order = sorted(range(a, min(a + LANES, len(blocks))), key=lambda k: -blocks[k][0])
        lengths = np.array([blocks[k][0] for k in order], np.int64)
        codes = [blocks[k][2] for k in order]
        tables = [unpack_tables(codes[b : b + TOGETHER]) for b in range(0, len(codes), TOGETHER)]
        distinct, counts = (np.concatenate([t[k] for t in tables]) for k in (0, 2))
        ends = chain.from_iterable(t[3] for t in tables)
        numbers = _walk(lengths, _Counts(lengths, distinct, counts), Decoder([c[e:] for c, e in zip(codes, ends, strict=True)]))
        for b, (distinct, known, _, _) in zip(range(0, len(codes), TOGETHER), tables, strict=True):
            ids = known.astype("<u4")[numbers[:, b : b + TOGETHER].T + _before(distinct)[:, None]]
            for row, k in zip(ids, order[b : b + TOGETHER], strict=True):
                own = row[: blocks[k][0]]
                if zlib.crc32(own.tobytes()) != blocks[k][1]:
                    raise ValueError("a block's ids do not match their checksum")
                out[k] = own
    return out


# ---------------------------------------------------------------- files

MAGIC = b"IDBLOCK3"
_BLOCK, _DOC, _FOOT = struct.Struct("<IIII"), struct.Struct("<?qQ"), struct.Struct("<QQQQI8s")

Range = Callable[[int, int], bytes]  # (offset, length) -> bytes


def file_bytes(docs: list[tuple[int | None, int]], ids: np.ndarray, block: int = BLOCK) -> Iterator[bytes]:
    """A file of documents (doc_id, number of ids) and their ids end to end."""
    yield MAGIC
    at, table = len(MAGIC), []
    for n, crc, code in encode_blocks(ids, block):
        yield _BLOCK.pack(n, len(code), crc, zlib.crc32(code)) + code
        table.append((at, n))
        at += _BLOCK.size + len(code)
    index = b"".join(struct.pack("<QI", *b) for b in table) + b"".join(_DOC.pack(d is None, d or 0, n) for d, n in docs)
    yield index
    yield _FOOT.pack(at, len(table), len(docs), len(ids), zlib.crc32(index), MAGIC)


@dataclass(frozen=True)
class TokenFile:
    """A file's index: where its blocks are and how many ids they hold, and its documents."""

    read: Range
    blocks: list[tuple[int, int]]  # (offset, ids)
    docs: list[tuple[int | None, int]]  # (doc_id, ids)
    end: int  # of the last block

    @staticmethod
    def open(read: Range, size: int) -> TokenFile:
        at, n_blocks, n_docs, n_ids, crc, magic = _FOOT.unpack(read(size - _FOOT.size, _FOOT.size))
        index = read(at, size - _FOOT.size - at)
        if magic != MAGIC or zlib.crc32(index) != crc:
            raise ValueError("not a file of token ids, or a damaged one")
        blocks = list(struct.iter_unpack("<QI", index[: 12 * n_blocks]))
        docs = [(None if none else d, n) for none, d, n in _DOC.iter_unpack(index[12 * n_blocks :])]
        if len(docs) != n_docs or sum(n for _, n in docs) != n_ids or sum(n for _, n in blocks) != n_ids:
            raise ValueError("a file of token ids whose index does not add up")
        return TokenFile(read, blocks, docs, at)

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids of blocks from ``first`` to before ``last``, read as one range."""
        if first >= last:
            return np.zeros(0, "<u4")
        start = self.blocks[first][0]
        data = self.read(start, (self.blocks[last][0] if last < len(self.blocks) else self.end) - start)
        found = []
        for offset, n in self.blocks[first:last]:
            at = offset - start
            count, size, crc, code_crc = _BLOCK.unpack_from(data, at)
            code = data[at + _BLOCK.size : at + _BLOCK.size + size]
            if count != n or zlib.crc32(code) != code_crc:
                raise ValueError("a damaged block")
            found.append((count, crc, code))
        return np.concatenate(decode_blocks(found))

    def document(self, number: int) -> np.ndarray:
        """Ids of one document by its number in the file, from the blocks that hold it alone."""
        start = sum(n for _, n in self.docs[:number])
        ends = np.cumsum([n for _, n in self.blocks])
        first, last = (int(np.searchsorted(ends, x, side="right")) for x in (start, start + self.docs[number][1] - 1))
        base = int(ends[first]) - self.blocks[first][1]
        return self.ids(first, last + 1)[start - base : start - base + self.docs[number][1]]

    def all(self, step: int = LANES) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) of every document in order; ``step`` blocks are decoded together."""
        groups = (self.ids(k, min(k + step, len(self.blocks))) for k in range(0, len(self.blocks), step))
        held = np.zeros(0, "<u4")
        for doc, n in self.docs:
            parts = [held]
            while sum(map(len, parts)) < n:
                parts.append(next(groups))
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield doc, held[:n]
            held = held[n:]


# ---------------------------------------------------------------- tables

FILES = "part int, seq int, file string, bytes long, n_docs long, n_ids long"


def _storage(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's address, and its path there."""
    return fs.FileSystem.from_uri(re.sub("^s3a:", "s3:", folder) if "://" in folder else f"file://{os.path.abspath(folder.removeprefix('file:'))}")


def write_files(docs: DataFrame, path: str, folder: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS, block: int = BLOCK) -> DataFrame:
    """Writes files of ``docs``' ids to ``folder`` and lists them in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, seq = word_encoder(path), TaskContext.get().partitionId(), 0
        storage, place = _storage(folder)
        storage.create_dir(place, recursive=True)
        listed: list[tuple[int | None, int]] = []
        held: list[np.ndarray] = []
        size = 0

        def write() -> pa.RecordBatch:
            nonlocal listed, held, size, seq
            name, ids = f"{part:06d}-{seq:06d}-{uuid.uuid4().hex}.ids", np.concatenate(held)
            with storage.open_output_stream(f"{place}/{name}") as out:
                for piece in file_bytes(listed, ids, block):
                    out.write(piece)
                written = out.tell()
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "file": [name], "bytes": [written], "n_docs": [len(listed)], "n_ids": [len(ids)]})
            listed, held, size, seq = [], [], 0, seq + 1
            return row

        for batch in batches:
            texts, names = batch.column(1), batch.column(0).to_pylist()
            width = pc.binary_length(texts).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(width) // GROUP)) + 1).tolist(), len(texts)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                ids, counts = encode(texts.slice(a, b - a))
                ids = np.insert(ids, np.cumsum(counts), end_id).astype(np.uint32)
                ends = np.cumsum(counts + 1)
                first = 0
                while first < b - a:
                    # As many documents as reach the size of a file, or all that there are.
                    done = int(ends[first - 1]) if first else 0
                    last = min(b - a, int(np.searchsorted(ends, done + file_ids - size)) + 1)
                    held.append(ids[done : ends[last - 1]])
                    listed += zip(names[a + first : a + last], (counts[first:last] + 1).tolist(), strict=True)
                    size += len(held[-1])
                    first = last
                    if size >= file_ids:
                        yield write()
        if listed:
            yield write()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # Equal rows are told apart by their place in the input, so that any number of them is dealt over tasks.
    rows = rows.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_first(), "tie", "row"]
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return durable(spread.mapInArrow(run, FILES))


def read_files(listed: DataFrame, folder: str) -> DataFrame:
    """Per document of the files ``listed`` in ``folder``, read back: doc_id, start, n_tokens and ids_crc32."""
    before = W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)
    # A row for each file; their ids stay where they are.
    placed = listed.select("file", "bytes", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    parts = max(1, listed.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        storage, place = _storage(folder)
        for batch in batches:
            for name, size, start in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                rows = []
                with storage.open_input_file(f"{place}/{name}") as file:
                    for doc, ids in TokenFile.open(lambda offset, length, f=file: f.read_at(length, offset), size).all():
                        rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = placed.repartition(min(parts, 4 * listed.sparkSession.sparkContext.defaultParallelism + parts // 8), "file")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def through_files(docs: DataFrame, path: str, folder: str | None = None, **options) -> DataFrame:
    """Writes files of ``docs`` to ``folder`` (a new one in the shared folder by default) and reads them back."""
    folder = folder or f"{scratch(docs.sparkSession)}/ids-{uuid.uuid4().hex}"
    return read_files(write_files(docs, path, folder, **options), folder)

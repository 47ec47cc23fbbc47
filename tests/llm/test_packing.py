import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from barlab.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids(text):
    return np.array(LIBRARY.encode(text, add_special_tokens=False).ids, "<u4")


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([*" \n\t\r\'sta.1é\x85\xa0 　\x1f", "<|endoftext|>"]), st.characters(exclude_categories=["Cs"])), max_size=40).map("".join))
def test_ids(text):
    assert list(packing.encoder(PATH)([text, "", text])) == [ids(text).tobytes(), b"", ids(text).tobytes()]


def test_ids_of_long_and_special_texts():
    for text in ("", "  a <|endoftext|>  b", "x" * 20_000, " " * 20_000, "a\n\n b" * 5000, "<|endoftext|>"):
        assert list(packing.encoder(PATH)([text])) == [ids(text).tobytes()]


def test_plain_texts_and_others_give_the_same_ids_in_order():
    texts = [r["text"] or "" for r in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).to_pylist()]
    texts += ["it's 12  x\n\n y", "a\u00a0b", "é" * 201, " " * 201 + "a", "x" * 200 + " " * 200, "\ttab\r\n", "<|endoftext|> a", "Ȁ ɏ ɐ", "soft\xadhyphen", "日本 語", ""]
    assert sum(packing.encoder(PATH)._plain(t) is not None for t in texts) > len(texts) / 2
    assert list(packing.encoder(PATH)(texts)) == [ids(t).tobytes() for t in texts]


def test_forgetting_does_not_matter(monkeypatch):
    monkeypatch.setattr(packing, "MEMO", 3)
    monkeypatch.setattr(packing, "GROUP", 10)
    texts = ["one two three", "four five", "two <|endoftext|> six", "seven\x1c eight", "one two three"] * 3
    assert list(packing.Encoder(PATH)(texts)) == [ids(t).tobytes() for t in texts]


def test_price_is_the_best_knapsack():
    rng = np.random.default_rng(1)
    prices = np.where(rng.random(31) < 0.4, rng.random(31), -np.inf)
    best, _ = packing.price(prices)
    want = [0.0] * 31
    for c in range(1, 31):
        want[c] = max([want[c - 1], *(want[c - n] + prices[n] for n in range(1, c + 1))])
    assert np.allclose(best, want)


@pytest.mark.parametrize("seed", range(6))
def test_plan_holds_all_pieces_in_few_sequences(seed):
    rng = np.random.default_rng(seed)
    capacity = (256, 2048)[seed % 2]
    sizes = np.concatenate([rng.integers(1, capacity + 1, 3000), rng.integers(1, capacity // 4, 20_000), rng.integers(capacity // 2 - 50, capacity // 2 + 80, 2000 * (seed > 2))])
    counts = np.bincount(sizes, minlength=capacity + 1)
    used = packing.plan(counts)
    held = np.zeros_like(counts)
    for pattern, times in used.items():
        assert sum(n * a for n, a in pattern) <= capacity
        for n, a in pattern:
            held[n] += a * times
    assert (held == counts).all()
    least = max(-(-int(sizes.sum()) // capacity), int((sizes > capacity / 2).sum()))
    assert sum(used.values()) <= 1.01 * least + 2


RNG = np.random.default_rng(0)
SIZES = {
    "dense": RNG.integers(1, 2049, 2_000_000),
    "long": RNG.integers(1025, 2048, 500_000),
    "thirds": RNG.integers(600, 1100, 500_000),
    "short": np.minimum(2047, RNG.lognormal(5, 1, 500_000).astype(int) + 1),
}


def histogram(name):
    counts = np.bincount(SIZES[name], minlength=2049)
    counts[2048] = 0
    return counts


@pytest.fixture(scope="session")
def corpus():
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist()
    lengths = [n for raw in packing.encoder(PATH)(t or "" for t in texts) for n in packing.cut_lengths(len(raw) // 4 + 1)]
    counts = np.bincount(lengths, minlength=2049)
    counts[2048] = 0
    return counts


@pytest.mark.parametrize("times", [1, 10, 100])
@pytest.mark.parametrize("name", ["corpus", *SIZES])
def test_the_program_packs_all_but_a_bounded_rest(name, times, request):
    counts = times * (request.getfixturevalue("corpus") if name == "corpus" else histogram(name))
    used, left = packing.program(counts)
    share = 1 - left.sum() / counts.sum()
    print(f"{name} times {times}: {share:.4f} of {counts.sum()} pieces, {left.sum()} left")
    assert share >= 0.98 and left.sum() <= 2048 and (left >= 0).all()
    held = left.copy()
    for pattern, n in used.items():
        for k, a in pattern:
            held[k] += a * n
    assert (held == counts).all()
    sequences = sum(used.values()) + sum(packing.best_fit(left).values())
    # Where more than two of a length never share a sequence with room to spare, volume alone is no bound.
    least = max(-(-int((counts * np.arange(2049)).sum()) // 2048), int(counts[1025:].sum()))
    assert sequences <= (1.01 * least + 1 if name != "thirds" else 1.002 * sum(packing.best_fit(counts).values()))


def test_rounding_uses_whole_numbers_and_fills_up():
    counts = np.array([0, 3, 2, 0, 0])
    used, left = packing.rounded({((2, 1), (1, 2)): 1.6, ((2, 2),): 0.2}, counts)
    assert used == Counter({((2, 1), (1, 2)): 1}) and left.tolist() == [0, 1, 1, 0, 0]


def best_fit_by_piece(counts):
    capacity, rooms = len(counts) - 1, []
    for k in np.flatnonzero(counts)[::-1].tolist():
        for _ in range(int(counts[k])):
            fits = [r for r in rooms if r >= k]
            room = min(fits, default=capacity)
            if fits:
                rooms.remove(room)
            rooms.append(room - k)
    return Counter(rooms)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 12), min_size=20, max_size=40))
def test_best_fit_by_runs_is_best_fit_by_piece(counts):
    counts = np.array([0, *counts])
    used, capacity = packing.best_fit(counts), len(counts) - 1
    held = np.zeros_like(counts)
    rooms = Counter()
    for pattern, times in used.items():
        rooms[capacity - sum(n * a for n, a in pattern)] += times
        for n, a in pattern:
            held[n] += a * times
    assert (held == counts).all() and rooms == best_fit_by_piece(counts)


def test_a_plan_does_not_grow_with_the_pieces():
    for sizes in (SIZES["dense"], SIZES["short"]):
        counts = np.bincount(sizes, minlength=2049)
        # So many pieces that nothing can go over them one by one.
        used = packing.plan(counts * 10_000_000)
        assert len(used) < 20_000
        assert sum(n * a * t for pattern, t in used.items() for n, a in pattern) == int(sizes.sum()) * 10_000_000


def check(rows, want):
    """``want``: {doc: [ids, ...]} of the documents with that doc_id."""
    places, got = defaultdict(list), Counter()
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    expected = Counter()
    for doc, texts in want.items():
        for t in texts:
            start = 0
            for k, n in enumerate(packing.cut_lengths(len(t))):
                expected[doc, k, start, n, zlib.crc32(t[start : start + n].tobytes())] += 1
                start += n
    assert got == expected
    return len(places)


def test_columns_of_any_name(spark):
    rows = spark.createDataFrame([(k % 40 + 1, k, "x", k) for k in range(300)], "length long, part long, `a b` string, part_ int")
    got = packing.pack(rows).collect()
    assert sorted((r.length, r.part, r["a b"], r.part_) for r in got) == sorted((k % 40 + 1, k, "x", k) for k in range(300))
    assert len({(r.sequence_id, r.offset) for r in got}) == 300


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: [np.append(ids(r.text), 0).astype("<u4")] for r in docs.collect()}
    n = check(packing.pack_documents(docs, PATH).collect(), want)
    assert n <= -(-sum(len(t[0]) for t in want.values()) // 2048) * 1.01 + 1


def test_nulls_repeats_and_empty_tables(spark):
    texts = [(1, None), (2, ""), (None, "a b c"), (3, "word " * 5000), (3, "word " * 5000), (4, "x" * 9000)]
    docs = spark.createDataFrame([(d, t, 1, "n") for d, t in texts], "doc_id long, text string, length int, _part string")
    want = defaultdict(list)
    for d, t in texts:
        want[d].append(np.append(ids(t or ""), 0).astype("<u4"))
    check(packing.pack_documents(docs, PATH).collect(), want)
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0

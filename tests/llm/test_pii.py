import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from barlab.llm import pii

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        odd, even = digits[::-1][::2], digits[::-1][1::2]
        return 14 <= len(digits) <= 19 and (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0
    return kind != "phone" or 10 <= len(digits) <= 15


def brute(text):
    found = [(m.start(), k, m.end()) for k, (kind, rule) in enumerate(RULES.items()) for m in re.finditer(rule, text) if passes(kind, m[0])]
    return sorted(found)


def base(text):
    return [(s.start, s.kind, s.end) for s in pii.find_spans(text) if pii.KINDS[s.kind] in pii.BASE]


PIECES = ["a", "é", "@", ".", "-", " ", "+", "(", ")", "1", "4111111111111111", "4242 4242-4242 4242", "10.0.0.1", "256.1.1.1", "0007.1.2.3", "+1 (555) 010-0100", "x@y.zz", "a.b@c.d@e.f", "\n", "%_", "12345678901234567890"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25))
def test_base_spans(pieces):
    text = "".join(pieces)
    assert base(text) == brute(text)


def test_validators_and_context():
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")
    kinds = lambda t: [pii.KINDS[s.kind] for s in pii.find_spans(t)]
    assert "iban" in kinds("iban GB82 WEST 1234 5698 7654 32.")
    assert kinds("the ssn 123-45-6789") == ["ssn"] and kinds("the no. 123-45-6789") == [] and kinds("ssn 666-45-6789") == []


def test_words_nearby_raise_and_lower_scores():
    scores = lambda t: [s.score for s in pii.find_spans(t)]
    assert scores("host 10.0.0.1") == [1.0] and scores("at 10.0.0.1") == [0.7] and scores("version 10.0.0.1") == [0.4] and scores("host version 10.0.0.1") == [0.7]
    assert scores("my visa 4111111111111111") == [1.0] and scores("order number 4111111111111111") == [0.5] and scores("in order 4111111111111111") == [0.8] and scores("subversions 10.0.0.1") == [0.7]
    assert scores("ssn 123-45-6789") == [0.6] and scores("ssn or part number 123-45-6789") == [] and scores("ssn, in part 123-45-6789") == [0.6]
    assert scores("version" + " " * pii.NEAR + "10.0.0.1") == [0.7]


def test_long_texts_take_linear_time():
    for text in ("a" * 3_000_000, "1" * 2_000_000, "1." * 1_000_000, "+1" + "(" * 2_000_000, "a@" * 500_000, "1 " * 1_000_000):
        pii.find_spans(text)


def test_query_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in pii.digest(pii.find_pii(docs)).collect()}
    for d in docs.collect():
        want = [(pii.KINDS[k], s, e) for s, k, e in brute(d.text)]
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        r = got[d.doc_id]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, *_ in want) for x in pii.BASE)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))
        assert r.scores == [s.score for s in pii.find_spans(d.text)]


def test_redaction_nulls_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "to a@b.cc or +1 555 010 0100.", "x"), (3, "to a@b.cc or +1 555 010 0100.", "x")], "doc_id long, text string, found string")
    assert sorted(((r.doc_id, r.text) for r in pii.redact_pii(docs).collect()), key=str) == [(1, None), (2, ""), (3, "to [EMAIL] or [PHONE]."), (3, "to [EMAIL] or [PHONE].")]
    assert [len(r.found) for r in sorted(pii.find_pii(docs).collect())] == [0, 0, 2, 2]
    assert pii.digest(pii.find_pii(docs.limit(0))).count() == 0


def test_an_iban_ends_before_capitals_and_numbers():
    ibans = lambda t: [t[s.start : s.end] for s in pii.find_spans(t) if pii.KINDS[s.kind] == "iban"]
    for iban in ("DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO9386011117947", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"):
        for before in ("", "IBAN ", "AB12 ", "REF 2024 XY99 "):
            for after in ("", " BIC COBADEFFXXX", " 12.50 EUR", " OK", " A B C 1 2 3", ".", " and more", " DE", " 1", "\nBIC"):
                assert ibans(before + iban + after) == [iban]
    assert ibans("DE89370400440532013000 GB82 WEST 1234 5698 7654 32 OK") == ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"]
    assert ibans("DE89370400440532013001 BIC COBADEFFXXX") == ibans("DE89370400440532013000x") == ibans("xDE89370400440532013000") == []
    assert pii.redact("IBAN DE89370400440532013000 BIC X", pii.find_spans("IBAN DE89370400440532013000 BIC X")) == "IBAN [IBAN] BIC X"
    pii.find_spans("AB12 " * 200_000)

"""Personal data: regular expressions propose spans, validators confirm them, context adjusts a score.

Four base kinds are found by fixed rules; each is leftmost, non-overlapping per kind, and a match that
fails its validator is dropped without retries:

- ``email``, ``ip`` (four parts of at most 255), ``card`` (14 to 19 digits that pass Luhn) and ``phone``
  (a plus sign and 10 to 15 digits).

Two further kinds are added beside them and never remove a base span:

- ``iban``: country letters, two check digits and 11 to 30 letters or digits whose remainder mod 97 is 1.
  Capitals or digits may follow, so each end of a word is tried; of those that pass, the one of the country's
  length counts, or else the last that overlaps no such span;
- ``ssn``: nine digits as 3-2-4 with valid groups. Alone they score below the threshold; a word such as
  "ssn" or "social security" within ``NEAR`` characters lifts them over it.

Every span has a score: its kind's certainty once confirmed, raised by a word nearby that goes with the kind and lowered
by one that goes with other numbers ("version" beside an IP address). The added kinds are kept from ``THRESHOLD``
on; scores never remove base spans, but whoever reads the result can.

The proposals run in linear time on any text: an address is grown from its "@", an IP address is made of
whole runs of digits. Spark deals the documents over tasks; nothing is shuffled. Null and empty texts
have no spans. Repeated rows give repeated rows, an empty table an empty result; further columns are
ignored by ``find_pii`` and kept by ``redact_pii``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: In the order that breaks ties of start.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
NEAR = 40
THRESHOLD = 0.5

# Certainty of a confirmed span, and words nearby that raise it.
CERTAINTY = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.3}
CONTEXT = {
    "email": ("mail", "contact", "@"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "konto"),
    "ssn": ("ssn", "social security", "tax id"),
}
AGAINST = {
    "email": (),
    "ip": ("version", "release", "section", "chapter"),
    "card": ("order number", "tracking number", "serial number", "invoice", "isbn"),
    "phone": ("order number", "serial number"),
    "iban": ("order number", "serial number"),
    "ssn": ("order number", "serial number", "part number", "model number"),
}


#: Characters of an account number by country.
IBAN_LENGTH = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
        30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}


class Span(NamedTuple):
    start: int
    kind: int
    end: int
    score: float


_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = re.compile("[0-9]+")
_CARD = re.compile("[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}))")
_WORD = re.compile("[A-Z0-9]+")
_ALNUM = re.compile("[A-Za-z0-9]")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_ANY = re.compile("[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free = 0  # end of the last match
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, end)):
            yield start, (end := m.end())
            free = end
        else:
            # No later match starts before this "@", so a run of characters is not looked at twice.
            free = max(free, at + 1)
        at = text.find("@", end)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    if text.count(".") < 3:
        return
    runs: list[tuple[int, int]] = []
    for m in _DIGITS.finditer(text):
        start, end = m.span()
        if runs and (start != runs[-1][1] + 1 or text[start - 1] != "."):
            runs = []
        runs.append((start, end))
        if len(runs) == 4:
            if all(len(text[a:b].lstrip("0")) <= 3 and int(text[a:b].lstrip("0") or 0) <= 255 for a, b in runs):
                yield runs[0][0], end
            runs = []


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        # Between 14 and 19 digits, each but the first with at most one separator.
        if 14 <= m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 10 <= sum(map(m[0].count, "0123456789")) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    found: list[tuple[int, int]] = []
    other: list[tuple[int, list[int]]] = []
    for m in _IBAN.finditer(text):
        ends, held = {}, ""
        for word in _WORD.finditer(text, *m.span(1)):
            held += word[0]
            if len(held) >= 15 and not _ALNUM.match(text, word.end()) and mod97(held):
                ends[len(held)] = word.end()
        if end := ends.get(IBAN_LENGTH.get(held[:2], 0)):
            if not found or m.start() >= found[-1][1]:
                found.append((m.start(), end))
        elif ends:
            other.append((m.start(), sorted(ends.values(), reverse=True)))
    # Other lengths pass by chance, too, and take only what is left.
    done, k = 0, 0
    for start, all_ends in other:
        while k < len(found) and found[k][1] <= start:
            done, k = found[k][1], k + 1
        limit = found[k][0] if k < len(found) else len(text)
        if start >= done and (end := next((e for e in all_ends if e <= limit), 0)):
            yield start, end
            done = end
    yield from found


def _ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        area = m[1]
        if area not in ("000", "666") and area < "900" and m[2] != "00" and m[3] != "0000":
            yield m.span()


_FINDERS = (_emails, _ips, _cards, _phones, _ibans, _ssns)


def _nearby(words: tuple[str, ...]) -> re.Pattern | None:
    return re.compile(rf"(?<![a-z])(?:{'|'.join(map(re.escape, words))})(?![a-z])") if words else None


_RAISING, _LOWERING = ({kind: _nearby(words) for kind, words in table.items()} for table in (CONTEXT, AGAINST))


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = f"{text[max(0, start - NEAR) : start]} {text[end : end + NEAR]}".lower()
    hit = lambda pattern: pattern is not None and pattern.search(near) is not None
    return round(min(1.0, CERTAINTY[kind] + 0.3 * hit(_RAISING[kind]) - 0.3 * hit(_LOWERING[kind])), 2)


def find_spans(text: str) -> list[Span]:
    """Spans of ``text`` by start, then kind; code points, ends exclusive."""
    if not _ANY.search(text):
        return []
    spans = []
    for k, (kind, find) in enumerate(zip(KINDS, _FINDERS, strict=True)):
        for start, end in find(text):
            score = _score(text, kind, start, end)
            if kind in BASE or score >= THRESHOLD:
                spans.append(Span(start, k, end, score))
    return sorted(spans)


def redact(text: str, spans: list[Span]) -> str:
    """``text`` with each group of overlapping spans replaced by the tag of its first span."""
    out, done = [], 0
    for s in spans:
        if s.start >= done:
            out += [text[done : s.start], f"[{KINDS[s.kind].upper()}]"]
        done = max(done, s.end)
    return "".join(out) + text[done:] if out else text


FOUND = "array<struct<kind:string,start:long,end:long,score:double>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and ``found``, its spans in order with kind and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": KINDS[s.kind], "start": s.start, "end": s.end, "score": s.score} for s in find_spans(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _SPANS)], ["doc_id", "found"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, found {FOUND}")


def redact_pii(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with the personal data of each text replaced by tags; null texts stay null.

    ``length_col``: a column that holds the texts' numbers of characters, to be kept right.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index(text_col)
            texts = [None if (t := x.as_py()) is None else redact(t, find_spans(t)) for x in batch.column(k)]
            yield batch.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type))

    out = docs.mapInArrow(run, docs.schema)
    return out if length_col is None else out.withColumn(length_col, F.char_length(text_col).cast(docs.schema[length_col].dataType))


def digest(found: DataFrame) -> DataFrame:
    """Per row of ``find_pii``: counts of the base kinds, the hash of the base spans, all spans as text, and their scores in the same order."""
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[of(k).alias(f"n_{k}") for k in BASE], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("found")).alias("spans"), F.transform("found", lambda s: s["score"]).alias("scores"))

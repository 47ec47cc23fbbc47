"""Cheapest repair of the structure of conversations, by iterative-deepening A*.

A conversation's rows are taken by turn (nulls first; ties by role, then text). A row's first fault counts: *blank* (no character but white
space of ASCII), *duplicate* (role and text seen earlier in the conversation), *truncated* (its last other character is none of ``.!?``).
Edits make the initials of the roles read ``(s?(ua)+)?``: Keep a row (0), Rerole it to user or assistant (2), Delete it (3), Insert a row
without text (2). Blank and duplicate rows must be deleted, truncated rows that stay add 1. An empty role has no initial and cannot be kept.

The search goes depth first through edits in ASCII order (D, I, K, R) under a bound on cost, which starts at a lower bound of the
rows' own costs and grows by one; a table holds, for each row and state of the pattern, the largest remainder of the
bound that has failed there, also from earlier bounds. So the first accepting path is the cheapest, and of those the ASCII-least. Which
role an edit gives follows from the state.

Rows of a conversation meet in one task, sorted by the shuffle, as its audit and checksum are one sequence each. There a
conversation of up to ``BLOCK`` rows is searched whole. A longer one is searched block by block: a pass from its end gives the least cost
to go at the block's end for each state, which the search of the block then adds; inserts at a border belong to the next
row, so blocks give the same path as the whole. A task holds a conversation's texts up to ``HELD`` bytes, and beyond that in a temporary
file of its own; besides that some 150 bytes a row of one conversation (a set of checksums).

Null roles and texts are one space. A null conv_id is a conversation. A conversation of no rows has zeros, an empty audit and the checksum
of an empty string. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: Rows that are searched together, and bytes of a conversation's texts in memory.
BLOCK, HELD = 128, 16 << 20

# States of the pattern: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
_KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_GIVE = (2, 2, 3, 2)  # the state after a row whose role is chosen
_ROLE = {2: "user", 3: "assistant"}  # by that state
_END = (0, 2 * INSERT, INSERT, 0)  # least cost to go after the last row
_SPACE = " \t\n\x0b\x0c\r"

# A row as the search sees it: its role's initial, whether it must go, and what staying adds.
Kind = tuple[str, bool, int]

# ---------------------------------------------------------------- search


def _least(kind: Kind) -> int:
    """What a row costs at least, in any state."""
    initial, must_go, extra = kind
    if must_go:
        return DELETE
    return extra if initial in "sua" and initial else min(DELETE, REROLE + extra)


def search(kinds: list[Kind], state: int = 0, go_on: tuple[int, ...] | None = None, stats: dict | None = None) -> tuple[str, int, int]:
    """(edits, their cost, state after them) of the best path from ``state``.

    ``go_on``: cost to go after the rows, by state, where more rows follow; else the path ends in an accepting state.
    """
    n = len(kinds)
    bounds = [0 if go_on is None else min(go_on)] * (n + 1)
    for i in range(n - 1, -1, -1):
        bounds[i] = bounds[i + 1] + _least(kinds[i])
    failed = [-1] * (4 * (n + 1))
    path: list[str] = []
    visits = 0

    def walk(i: int, state: int, left: int) -> int | None:
        """The state after an accepting path within ``left``, or None; ``path`` then has it."""
        nonlocal visits
        if i == n:
            if go_on is not None:
                return state if go_on[state] <= left else None
            if _END[state] == 0:
                return state
        if left < bounds[i] or left <= failed[4 * i + state]:
            return None
        visits += 1
        initial, must_go, extra = kinds[i] if i < n else ("", True, 0)
        for edit, cost, to, step in (
            ("D", DELETE, state, 1),
            ("I", INSERT, _GIVE[state], 0),
            ("K", extra, _KEEP[state].get(initial, -1), 1),
            ("R", REROLE + extra, _GIVE[state], 1),
        ):
            if cost > left or (i == n and edit != "I") or (must_go and edit in "KR") or to < 0:
                continue
            path.append(edit)
            if (end := walk(i + step, to, left - cost)) is not None:
                return end
            path.pop()
        failed[4 * i + state] = left
        return None

    bound = bounds[0]
    while (end := walk(0, state, bound)) is None:
        bound += 1
    if stats is not None:
        stats["visits"] = stats.get("visits", 0) + visits
    return "".join(path), bound - (0 if go_on is None else go_on[end]), end


def _to_go(kinds: Iterator[Kind], after: tuple[int, ...]) -> tuple[int, ...]:
    """Least cost to go before rows that come last to first, by state."""
    for initial, must_go, extra in kinds:
        own = []
        for state in range(4):
            best = DELETE + after[state]
            if not must_go:
                best = min(best, REROLE + extra + after[_GIVE[state]])
                if (to := _KEEP[state].get(initial)) is not None:
                    best = min(best, extra + after[to])
            own.append(best)
        once = [min(own[s], INSERT + own[_GIVE[s]]) for s in range(4)]
        after = tuple(min(once[s], INSERT + once[_GIVE[s]]) for s in range(4))
    return after


class Kinds:
    """Rows of a conversation, a byte each: initial, must go, truncated."""

    INITIALS = ("s", "u", "a", "")

    def __init__(self):
        self.data = bytearray()

    def add(self, role: str, must_go: bool, extra: int) -> None:
        self.data.append((self.INITIALS.index(role[:1]) if role[:1] in ("s", "u", "a") else 3) | must_go << 2 | extra << 3)

    def __len__(self) -> int:
        return len(self.data)

    def some(self, a: int, b: int) -> list[Kind]:
        return [(self.INITIALS[x & 3], bool(x & 4), x >> 3) for x in self.data[a:b]]


def repair(kinds: Kinds, block: int = BLOCK) -> tuple[str, int]:
    """(edits, cost) of the cheapest, then ASCII-least repair."""
    n = len(kinds)
    if n <= block:
        return search(kinds.some(0, n))[:2]
    cuts = list(range(0, n, block))
    to_go = [_END]
    for a in reversed(cuts[1:]):
        to_go.append(_to_go(reversed(kinds.some(a, a + block)), to_go[-1]))
    parts, cost, state = [], 0, 0
    for a, after in zip(cuts, reversed(to_go), strict=True):
        edits, own, state = search(kinds.some(a, a + block), state, None if a + block >= n else after)
        parts.append(edits)
        cost += own
    return "".join(parts), cost


# ---------------------------------------------------------------- conversations


class _Texts:
    """Rows (turn, role, text) in their order; beyond ``HELD`` bytes in a temporary file."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.size, self.file = 0, None

    def add(self, *row) -> None:
        self.rows.append(row)
        self.size += 64 + len(row[1]) + len(row[2])
        if self.size >= HELD:
            self.file = self.file or tempfile.TemporaryFile()
            pickle.dump(self.rows, self.file)
            self.rows, self.size = [], 0

    def __iter__(self) -> Iterator[tuple]:
        if self.file:
            end = self.file.tell()
            self.file.seek(0)
            while self.file.tell() < end:
                yield from pickle.load(self.file)
        yield from self.rows

    def close(self) -> None:
        if self.file:
            self.file.close()


@dataclass
class Conversation:
    """What is known of a conversation, row by row, and its repair."""

    conv_id: int | None
    kinds: Kinds = field(default_factory=Kinds)
    texts: _Texts = field(default_factory=_Texts)
    seen: set = field(default_factory=set)
    least: int | None = None
    most: int | None = None
    turns: int = 0
    faults: dict[str, int] = field(default_factory=lambda: dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0))
    last: str | None = None

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            self.turns += turn != self.most
            self.least, self.most = turn if self.least is None else self.least, turn
        if self.last is not None:
            self.faults["illegal"] += self.last + role[:1] not in ("su", "ua", "au")
        self.last = role[:1]
        bare = text.rstrip(_SPACE)
        own = hashlib.md5(f"{len(role)}:{role}{text}".encode(), usedforsecurity=False).digest()
        fault = "blank" if not bare else "duplicate" if own in self.seen else "truncated" if bare[-1] not in ".!?" else None
        self.seen.add(own)
        if fault:
            self.faults[fault] += 1
        self.kinds.add(role, fault in ("blank", "duplicate"), TRUNCATED * (fault == "truncated"))
        self.texts.add(turn, role, text)

    @property
    def gaps(self) -> int:
        return self.most - self.least + 1 - self.turns if self.turns else 0

    def repaired(self, edits: str) -> Iterator[tuple[str, int | None, str, str]]:
        """(edit, turn, role, text) of each row that is kept, changed or put in."""
        state, rows = 0, iter(self.texts)
        for edit in edits:
            if edit == "I":
                state = _GIVE[state]
                yield edit, None, _ROLE[state], ""
                continue
            turn, role, text = next(rows)
            if edit == "K":
                state = _KEEP[state][role[:1]]
                yield edit, turn, role, text
            elif edit == "R":
                state = _GIVE[state]
                yield edit, turn, _ROLE[state], text

    def report(self) -> tuple:
        edits, cost = repair(self.kinds)
        sha = hashlib.sha256()
        for k, (_, _, role, text) in enumerate(self.repaired(edits)):
            sha.update(("\n" * (k > 0) + f"{role}:{text}").encode())
        return self.conv_id, self.gaps, *self.faults.values(), cost, edits, sha.hexdigest()


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[Conversation]:
    """From rows (conv_id, turn, role, text, copies) in order."""
    now = None
    for batch in batches:
        for conv_id, turn, role, text, copies in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    yield now
                    now.texts.close()
                now = Conversation(conv_id)
            for _ in range(copies):
                now.add(turn, role, text)
    if now is not None:
        yield now
        now.texts.close()


def _sorted(conversations: DataFrame) -> DataFrame:
    """Rows of each conversation in one partition, in order. ``copies``, where there is such a column: how often a row counts."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    copies = F.col("copies").cast("int") if "copies" in conversations.columns else F.lit(1).alias("copies")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), value("role"), value("text"), copies)
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 4096, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0

    def taken() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        weight += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= most or weight >= size:
            yield taken()
            held, weight = [], 0
    if held:
        yield taken()


REPORT = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])
REPAIRED = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def _sql(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in schema)


def report(conversations: DataFrame) -> DataFrame:
    """Per conversation of (conv_id, turn, role, text): its faults, the repair's edits and cost, and a checksum of what is repaired."""
    return _sorted(conversations).mapInArrow(lambda batches: _batches((c.report() for c in _conversations(batches)), REPORT), _sql(REPORT))


def repaired(conversations: DataFrame) -> DataFrame:
    """The repaired conversations' rows in order: conv_id, position, edit (K, R or I), turn (null if put in), role and text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for c in _conversations(batches):
            for k, row in enumerate(c.repaired(repair(c.kinds)[0])):
                yield c.conv_id, k, *row

    return _sorted(conversations).mapInArrow(lambda batches: _batches(rows(batches), REPAIRED), _sql(REPAIRED))


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with faults by a checksum of conversation and turn: rows with 0, 1 or 2 ``copies``, emptied, without ends of sentences, or of another role."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(value("conv_id"), F.lit(":"), value("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(value("text"), ".!?", "")).otherwise(value("text"))
    return conversations.select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(value("role")).alias("role"),
        F.when(fault == 0, "").otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
    )


#: One bit, and one byte, of a CRC-32 in lists; the polynomial is a fixed value.
_BYTE = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda s, _: xor(s >> 1, (s & 1) * 3988292384))"
_CRC = f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(key) + 1), lambda i: ascii(substr(key, i, 1))::bigint)), lambda c, b: {_BYTE}), 4294967295)"


def _cells(state: int) -> str:
    """The best way on before a row in a state, without an insert first: cost, edits and repaired rows."""
    then = lambda edit, cost, to, row: f"{{'c': f[{to + 1}].c + {cost}, 'a': '{edit}' || f[{to + 1}].a, 't': {row}}}"
    out = [then("D", DELETE, state, f"f[{state + 1}].t")]
    keeps = [f"when initial = '{k}' then {then('K', 'extra', to, f'list_prepend(role || chr(58) || text, f[{to + 1}].t)')}" for k, to in _KEEP[state].items()]
    out.append(f"case when must_go then null {' '.join(keeps)} end")
    to = _GIVE[state]
    given = f"list_prepend('{_ROLE[to]}:' || text, f[{to + 1}].t)"
    out.append(f"case when not must_go then {then('R', f'{REROLE} + extra', to, given)} end")
    return f"list_min(list_filter([{', '.join(out)}], lambda x: x is not null))"


def _insert(state: int) -> str:
    to = _GIVE[state]
    return f"list_min([b[{state + 1}], {{'c': b[{to + 1}].c + {INSERT}, 'a': 'I' || b[{to + 1}].a, 't': list_prepend('{_ROLE[to]}:', b[{to + 1}].t)}}])"


#: ``report`` of ``damaged`` over the table conversations: from the last row to the first, the best way on from each state.
SQL = rf"""
with recursive c as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key from conversations),
k as (select conv_id, turn, role, text, {_CRC} % 20 as x from c),
d as (select conv_id, turn, case when x = 4 then 'user' else role end as role, case x when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
  unnest(range(case x when 0 then 0 when 3 then 2 else 1 end)) as copy from k),
o as (select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from d),
r as (select *, row_number() over (partition by conv_id, role, text order by i) > 1 as again, left(role, 1) as initial, not regexp_matches(text, '[^\x20\x09-\x0D]') as blank, not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') as cut,
  left(lag(role) over (partition by conv_id order by i), 1) || left(role, 1) as pair from o),
s as (select *, blank or again as must_go, case when cut and not blank and not again then {TRUNCATED} else 0 end as extra from r),
w as (select conv_id, max(i) + 1 as i, [{{'c': 0, 'a': '', 't': []::varchar[]}}, {{'c': {_END[1]}, 'a': 'II', 't': ['user:', 'assistant:']}}, {{'c': {_END[2]}, 'a': 'I', 't': ['assistant:']}}, {{'c': 0, 'a': '', 't': []::varchar[]}}] as f from s group by conv_id
  union all
  select conv_id, i, [{", ".join(map(_insert, range(4)))}] from (
    select s.conv_id, s.i, [{", ".join(map(_cells, range(4)))}] as b from w join s on s.conv_id is not distinct from w.conv_id and s.i = w.i - 1)),
g as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where blank) as blank, count(*) filter (where again and not blank) as duplicate,
  count(*) filter (where extra > 0) as truncated, count(*) filter (where pair not in ('su', 'ua', 'au')) as illegal from s group by conv_id)
select n.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(f[1].c, 0)::bigint as cost, coalesce(f[1].a, '') as audit, sha256(coalesce(array_to_string(f[1].t, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) n left join g on n.conv_id is not distinct from g.conv_id left join w on n.conv_id is not distinct from w.conv_id and w.i = 1
"""

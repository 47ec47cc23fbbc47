r"""Chat formatting by token-level assembly.

A turn becomes: the reserved id of its role's header, the ids of its text, the reserved id of the turn's
end. Headers of other roles than ``HEADERS`` are a reserved id, the ids of the role, and a reserved id.
Segments are encoded separately, so no merge of the tokenizer crosses a mark and no text can produce a
reserved id. The loss mask covers the ids of the texts of ``loss_roles``; it is the prefix sum of +1 where
such a text begins and -1 where it ends.

Read as text, reserved ids stand for their control strings, as in

    ### User:How are you?</turn>### Assistant:Fine.</turn>

so control strings inside a text, and backslashes, get a backslash in front before encoding; taking one
away again restores the text.

Formatting and reading back are by row, in any partition; only roles, texts and what is under the mask where it is not
the text are shuffled. The digests then go through each conversation in the order of turn (nulls first), then role and a
hash of the text: conversations are dealt by a hash of their id, sorted within tasks and read as a stream, so
memory holds one batch whatever a conversation's length. A digest over a whole conversation is sequential by
nature, so a conversation of a third of all rows is one task that hashes, at some hundred MB a second, what others
have read back.

Null roles and texts are empty. Rows with a null conv_id are one conversation. Repeated rows are turns
each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.llm.packing import encoder, token_bytes

# Control strings, in the order of their reserved ids.
HEADERS = {"system": "### System:", "user": "### User:", "assistant": "### Assistant:"}
OTHER, OTHER_END, END = "### Role:", "</role>", "</turn>"
CONTROLS = (*HEADERS.values(), OTHER, OTHER_END, END)

_ESCAPED = re.compile("|".join(map(re.escape, ("\\", *CONTROLS))))
_ESCAPE = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    role_of = {v: k for k, v in HEADERS.items()}
    turns, role, held = [], "", 0
    for m in re.finditer(r"\\.|" + "|".join(map(re.escape, CONTROLS)), formatted, re.DOTALL):
        if m[0] in role_of:
            role, held = role_of[m[0]], m.end()
        elif m[0] == OTHER:
            held = m.end()
        elif m[0] == OTHER_END:
            role, held = unescape(formatted[held : m.start()]), m.end()
        elif m[0] == END:
            turns.append((role, unescape(formatted[held : m.start()])))
    return turns


class Template:
    """Turns to ids and loss mask, and back."""

    def __init__(self, path: str, loss_roles: tuple[str, ...] = ("assistant",)):
        self.encode = encoder(path, specials=False)
        self.bytes_of = token_bytes(path)
        self.first = len(self.bytes_of)  # reserved ids follow the vocabulary's
        self.reserved = {s: self.first + k for k, s in enumerate(CONTROLS)}
        self.loss_roles = loss_roles

    def turns(self, pairs: list[tuple[str, str]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and loss mask of each turn (role, text). Segments are encoded each for itself, in one call."""
        segments = [s for role, text in pairs for s in ((text,) if role in HEADERS else (role, text))]
        encoded = (np.frombuffer(ids, np.int32) for ids in self.encode(map(escape, segments)))
        mark = {s: np.array([k], np.int32) for s, k in self.reserved.items()}
        for role, _ in pairs:
            head = [mark[HEADERS[role]]] if role in HEADERS else [mark[OTHER], next(encoded), mark[OTHER_END]]
            body = next(encoded)
            ids = np.concatenate([*head, body, mark[END]])
            delta = np.zeros(len(ids) + 1, np.int8)
            if role in self.loss_roles:
                begin = len(ids) - 1 - len(body)
                delta[begin] += 1
                delta[begin + len(body)] -= 1
            yield ids, np.cumsum(delta)[:-1].astype(bool)

    def text(self, ids: np.ndarray) -> str:
        """What ids without reserved ones stand for, still escaped."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode()

    def read(self, ids: np.ndarray, loss: np.ndarray) -> Iterator[tuple[str, str, str, int]]:
        """(role, text, text under the mask, formatted characters) of each turn of a sequence."""
        role_of = {self.reserved[v]: k for k, v in HEADERS.items()}
        role, begin, chars = "", 0, 0
        for at in np.flatnonzero(ids >= self.first).tolist():
            k = int(ids[at])
            chars += len(CONTROLS[k - self.first])
            if k in role_of:
                role = role_of[k]
            elif k != self.reserved[OTHER]:
                held = self.text(ids[begin:at])
                chars += len(held)
                if k == self.reserved[OTHER_END]:
                    role = unescape(held)
                else:
                    under = loss[begin:at]
                    yield role, unescape(held), unescape(self.text(ids[begin:at][under])), chars
                    chars = 0
            begin = at + 1


def format_turns(conversations: DataFrame, path: str, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Per row: conv_id, turn, role, text and what it adds to its conversation: ``ids`` and ``loss``, of equal length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(path, loss_roles)
        for batch in batches:
            pairs = list(template.turns(list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))))
            ids, loss = pa.array([p[0] for p in pairs], pa.list_(pa.int32())), pa.array([p[1] for p in pairs], pa.list_(pa.bool_()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, loss], [*batch.schema.names, "ids", "loss"])

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    return rows.mapInArrow(run, "conv_id long, turn long, role string, text string, ids array<int>, loss array<boolean>")


TURNS = "conv_id long, turn long, role string, text string, under string, chars long"


def read_turns(formatted: DataFrame, path: str) -> DataFrame:
    """Per row of ``format_turns``, read back from its ids and mask: role, text, ``under`` (the text under the mask; null if it is the text) and formatted characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(path)
        for batch in batches:
            rows = []
            for conv_id, turn, ids, loss in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                for role, text, under, chars in template.read(ids.values.to_numpy(), loss.values.to_numpy(zero_copy_only=False)):
                    rows.append((conv_id, turn, role, text, None if under == text else under, chars))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "turn", "role", "text", "under", "chars"])

    return formatted.select("conv_id", "turn", "ids", "loss").mapInArrow(run, TURNS)


class _Digest:
    def __init__(self):
        self.turns, self.loss, self.n, self.loss_chars, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def add(self, role: str, text: str, under: str, chars: int) -> None:
        self.turns.update(f"{role}\n{text}\n".encode())
        self.loss.update(under.encode())
        self.n += 1
        self.loss_chars += len(under)
        self.chars += chars

    def row(self, conv_id: int | None) -> tuple:
        return conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame, path: str) -> DataFrame:
    """Per conversation: what its ids and mask say, read back from ``format_turns``."""
    kinds = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done = []
            for conv_id, *turn in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if digest is None or conv_id != now:
                    if digest is not None:
                        done.append(digest.row(now))
                    now, digest = conv_id, _Digest()
                role, text, under, chars = turn
                digest.add(role, text, text if under is None else under, chars)
            if done:
                yield batch_of(done)
        if digest is not None:
            yield batch_of([digest.row(now)])

    turns = read_turns(formatted, path).repartition("conv_id").withColumn("tie", F.unhex(F.md5(F.col("text").cast("binary"))))
    spread = turns.sortWithinPartitions("conv_id", "turn", "role", "tie")
    return spread.select("conv_id", "role", "text", "under", "chars").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_COUNTS = " + ".join(f"(length(t) - length(replace(t, '{c}', ''))) // {len(c)}" for c in ("\\", *CONTROLS))
_ROLE_COUNTS = _COUNTS.replace("(t", "(r")
#: ``read_back`` of ``format_turns`` over the table conversations and one more conversation.
SQL = rf"""
with c as (select conv_id, turn, coalesce(role, '') as r, coalesce(text, '') as t from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
s as (select *, case r {" ".join(f"when '{r}' then {len(h)}" for r, h in HEADERS.items())} else {len(OTHER) + len(OTHER_END)} + length(r) + {_ROLE_COUNTS} end
  + length(t) + {_COUNTS} + {len(END)} as chars from c)
select conv_id, count(*) as n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' order by turn nulls first, r, md5(t))) as turns_sha256,
  cast(sum(case when r = 'assistant' then length(t) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(t, '' order by turn nulls first, r, md5(t)) filter (where r = 'assistant'), '')) as loss_sha256,
  cast(sum(chars) as bigint) as formatted_chars
from s group by conv_id
"""

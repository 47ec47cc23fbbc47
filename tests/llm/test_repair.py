import hashlib
import random
import re
import zlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barlab.llm import repair as R
from barlab.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"


def all_paths(kinds):
    """(cost, edits) by trying everything, from the last row back, with up to two inserts before a row."""
    keep, give, memo = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}), (2, 2, 3, 2), {}

    def rest(i, state):
        if (i, state) not in memo:
            out = []
            for inserts in range(3):
                s, cost, edits = state, 2 * inserts, "I" * inserts
                for _ in range(inserts):
                    s = give[s]
                if i == len(kinds):
                    out += [(cost, edits)] * (s in (0, 3))
                    continue
                initial, must_go, extra = kinds[i]
                options = [("D", 3, s)]
                if not must_go:
                    options += [("K", extra, keep[s].get(initial))] * (initial in keep[s]) + [("R", 2 + extra, give[s])]
                for edit, own, to in options:
                    c, e = rest(i + 1, to)
                    out.append((cost + own + c, edits + edit + e))
            memo[i, state] = min(out)
        return memo[i, state]

    for i in reversed(range(len(kinds))):
        for state in range(4):
            rest(i, state)
    return rest(0, 0)


def packed(kinds):
    out = R.Kinds()
    for kind in kinds:
        out.add(*kind)
    return out


kind = st.tuples(st.sampled_from(["s", "u", "a", "u", "a", ""]), st.booleans(), st.integers(0, 1))


@settings(max_examples=600, deadline=None)
@given(st.lists(kind, max_size=12), st.integers(1, 5))
def test_search_finds_the_least_of_all_paths(kinds, block):
    cost, edits = all_paths(kinds)
    assert R.search(kinds)[:2] == (edits, cost)
    assert R.repair(packed(kinds), block) == (edits, cost)  # block by block alike


def test_accepted_patterns():
    ok = re.compile(r"(s?(ua)+)?\Z")
    r = random.Random(2)
    for _ in range(300):
        kinds = [(r.choice("suax"), r.random() < 0.2, int(r.random() < 0.3)) for _ in range(r.randint(0, 30))]
        kinds = [(k if k != "x" else "", m, e) for k, m, e in kinds]
        state, roles, at = 0, "", 0
        for edit in R.search(kinds)[0]:
            role = {"K": kinds[at][0] if at < len(kinds) else "", "D": ""}.get(edit, {2: "u", 3: "a"}[(2, 2, 3, 2)[state]])
            roles += role
            state = {"": state, "s": 1, "u": 2, "a": 3}[role]
            at += edit != "I"
        assert ok.match(roles) and at == len(kinds)


def test_failed_states_are_not_walked_again():
    """All rows of one role: with the table the walk is at most rows, states and bounds; without it, it would double by row."""
    stats = {}
    edits, cost, _ = R.search([("a", False, 0)] * 40, stats=stats)
    assert (edits, cost) == all_paths([("a", False, 0)] * 40)[::-1]
    assert stats["visits"] < 40 * 4 * (cost + 1)


def row_by_contract(conv_id, rows):
    """The contract of op12 for one conversation: (turn, role, text) of its rows."""
    one = lambda x: " " if x is None else x
    kept = []
    for turn, role, text in rows:
        x = zlib.crc32(f"{one(conv_id)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        if x:
            text = "" if x == 1 else re.sub("[.!?]", "", text) if x == 2 else text
            kept += [(turn, "user" if x == 4 else role, text)] * (2 if x == 3 else 1)
    kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    kinds, seen, faults = [], set(), [0, 0, 0]
    for _, role, text in kept:
        last = re.findall("[^\x20\x09-\x0d]", text)
        fault = 0 if not last else 1 if (role, text) in seen else 2 if last[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            faults[fault] += 1
        kinds.append((role[:1] if role[:1] in ("s", "u", "a") else "", fault in (0, 1), int(fault == 2)))
    turns = [t for t, _, _ in kept if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:], strict=False))
    cost, edits = all_paths(kinds)
    out, left = [], iter(kept)
    for e in edits:
        _, role, text = (None, None, "") if e == "I" else next(left)
        if e != "D":
            chosen = "assistant" if out and out[-1].startswith("u") else "user"
            out.append(f"{role if e == 'K' else chosen}:{text}")
    return (conv_id, gaps, *faults, illegal, cost, edits, hashlib.sha256("\n".join(out).encode()).hexdigest())


def by_contract(rows):
    groups = {}
    for conv_id, *row in rows:
        groups.setdefault(conv_id, []).append(row)
    return sorted((row_by_contract(c, own) for c, own in groups.items()), key=str)


def test_query_equals_the_contract_and_sql(spark, sf_dir):
    got = QUERIES["op12_conversation_repair"](spark, sf_dir)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(map(tuple, got.collect()), key=str)
    assert got == by_contract(rows)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    assert got == sorted(con.execute(R.SQL).fetchall(), key=str)


def odd_rows():
    r = random.Random(7)
    texts = ["Yes.", "No", "", " \t\n", "Why?  ", "x ", None, "Yes.", "é!\x0b", "!.?"]
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "User", "sys"]
    for conv_id in [None, *range(120)]:
        for turn in range(r.randint(0, 9)):
            yield conv_id, r.choice([turn, turn, turn, None, 3, turn + 100]), r.choice(roles), r.choice(texts)
    yield from [(500, 1, "user", "Same.")] * 50
    dropped = next(k for k in range(1000, 9999) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    yield dropped, 0, "user", "Gone."


def test_odd_rows_and_further_columns(spark):
    rows = list(odd_rows())
    table = spark.createDataFrame([(*r, 9, "x") for r in rows], SCHEMA + ", copies int, audit string")
    got = sorted(map(tuple, R.report(R.damaged(table)).collect()), key=str)
    assert got == by_contract(rows)
    assert (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in {g[1:] for g in got}
    con = duckdb.connect()
    con.register("conversations", table.select("conv_id", "turn", "role", "text").toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    assert got == sorted(con.execute(R.SQL).fetchall(), key=str)


def test_long_conversation_is_searched_in_blocks_and_held_in_a_file(spark, monkeypatch):
    r = random.Random(3)
    rows = [(1, k, r.choice(["user", "assistant", "user", "assistant", "system"]), r.choice(["Yes.", "No", "", f"text {k}."]) + "." * r.randint(0, 900)) for k in range(1500)]
    want = by_contract(rows)
    frame = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(x) for x in R.report(R.damaged(frame)).collect()] == want
    monkeypatch.setattr(R, "HELD", 5_000)
    c = R.Conversation(1)
    for conv_id, turn, role, text in rows:
        c.add(turn, role, text)
    assert c.texts.file is not None and [t[0] for t in c.texts] == list(range(1500))
    c.texts.close()


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi"), (1, 2, "user", "Hi"), (2, 0, "user", "  ")]
    got = [tuple(g) for g in R.repaired(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "position").collect()]
    # Of the repairs that cost 8 (KI for the later user row would be another): what all paths say.
    assert all_paths([("a", False, 0), ("u", False, 1), ("u", True, 0)]) == (8, "IKDD")
    assert got == [(1, 0, "I", None, "user", ""), (1, 1, "K", 0, "assistant", "Hello.")]


@pytest.mark.parametrize("fn", [R.report, R.repaired])
def test_empty_table(spark, fn):
    assert fn(R.damaged(spark.createDataFrame([], SCHEMA))).count() == 0

import hashlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from barlab.llm import chat, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["\\", "#", "##", "### ", "User:", "<", "/turn>", "é", "<|endoftext|>", " ", "\n", *chat.CONTROLS]
TEXTS = st.lists(st.one_of(st.sampled_from(PIECES), st.characters(exclude_categories=["Cs"])), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", "tool", ""]), TEXTS), TEXTS), max_size=4))
def test_any_turns_come_back(turns):
    template = chat.Template(PATH)
    made = list(template.turns(turns))
    ids, loss = (np.concatenate([m[k] for m in made]) if made else np.zeros(0, np.int32) for k in (0, 1))
    read = list(template.read(ids, loss.astype(bool)))
    assert [(r, t) for r, t, _, _ in read] == turns
    assert [u for *_, u, _ in read] == [t if r == "assistant" else "" for r, t in turns]
    whole = "".join(chat.CONTROLS[i - template.first] if i >= template.first else "" for i in ids.tolist())
    assert whole.count(chat.END) == len(turns)
    formatted = "".join((chat.HEADERS.get(r) or chat.OTHER + chat.escape(r) + chat.OTHER_END) + chat.escape(t) + chat.END for r, t in turns)
    assert chat.parse(formatted) == turns and sum(c for *_, c in read) == len(formatted)


def test_query_and_sql(spark, sf_dir):
    got = sorted(map(tuple, queries.op1_chat_format(spark, sf_dir).collect()))
    con = duckdb.connect()
    con.sql(f"create view conversations as from '{sf_dir}/conversations.parquet'")
    assert got == sorted(con.sql(chat.SQL).fetchall())
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("turn").collect():
        turns[r.conv_id].append((r.role, r.text or ""))
    hard = r"\### Assistant: </turn> ok"
    turns[-7] = [("user", hard), ("assistant", hard)]
    for conv, n, sha, loss_chars, loss_sha, _ in got:
        loss = "".join(t for r, t in turns[conv] if r == "assistant")
        assert (n, sha) == (len(turns[conv]), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns[conv]).encode()).hexdigest())
        assert (loss_chars, loss_sha) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(1, 1, "assistant", None, 0), (1, 0, None, "x", 0), (None, 0, "user", "a", 0), (None, None, "assistant", "b", 0), (2, 0, "user", "y", 0), (2, 0, "user", "y", 0), (3, 0, "assistant", "w " * 300_000, 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids int")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars) for r in chat.read_back(chat.format_turns(df, PATH), PATH).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {1: (2, sha("\nx\nassistant\n\n"), 0), None: (2, sha("assistant\nb\nuser\na\n"), 1), 2: (2, sha("user\ny\n" * 2), 0), 3: (1, sha("assistant\n" + "w " * 300_000 + "\n"), 600_000)}
    assert chat.read_back(chat.format_turns(df.limit(0), PATH), PATH).count() == 0

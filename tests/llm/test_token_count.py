import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from barlab.llm.token_count import counter, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
ODD = ["", " ", "   ", "a  b", "  a b ", "a\tb\nc\r\n", "\0", "a\0b", "<s></s><unk><0x41>", "▁a▁▁", "é ﬁ １ 𐍈", "�", "x" * 5000, " " * 3001, "ab " * 4000, "梦" * 700]


def test_odd_texts():
    count = counter(PATH)
    assert [count(t) for t in ODD] == [len(LIBRARY.encode(t)) for t in ODD]


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" ▁\n\tabehint.,é"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_random_texts(text):
    assert counter(PATH)(text) == len(LIBRARY.encode(text))


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, PATH).collect()}
    want = {r.doc_id: (len(r.text.encode()), n := len(LIBRARY.encode(r.text)), n > 4096) for r in docs.collect()}
    assert got == want


def test_nulls_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, 5), (1, None, 5), (None, "a b", 6), (2, "", 7)], "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, token_counts(docs, PATH, limit=1).collect()), key=str)
    assert got == [(1, 0, 0, False), (1, 0, 0, False), (2, 0, 0, False), (None, 3, 2, True)]
    assert token_counts(docs.limit(0), PATH).count() == 0

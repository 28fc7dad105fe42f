import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltwork.llm import tokens

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(f"{tokens.VOCABULARIES}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def ours():
    return tokens.encoder(tokens.vocabulary("byte_bpe_50k")).encode


def test_same_as_library(library, ours):
    for text in ("", " ", "a", "don't  12,345\n\n x ", "倉庫の記録" * 50, "<|endoftext|>", "👩‍💻🇺🇳 é ß", "x" * 5000, "ab" * 3000, "\t\r\n" * 9):
        assert ours(text) == library(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_same_as_library_on_any_text(text):
    t = tokenizers.Tokenizer.from_file(f"{tokens.VOCABULARIES}/byte_bpe_50k.json") if not hasattr(test_same_as_library_on_any_text, "t") else test_same_as_library_on_any_text.t
    test_same_as_library_on_any_text.t = t
    t.encode_special_tokens = True
    assert tokens.encoder(tokens.vocabulary("byte_bpe_50k")).encode(text) == t.encode(text, add_special_tokens=False).ids


def test_merge_takes_lowest_rank_leftmost():
    ranks = {b"a": 0, b"b": 1, b"aa": 2, b"aab": 3, b"ab": 4}
    assert tokens.merge(b"aaab", ranks) == [2, 4]
    assert tokens.merge(b"aab", ranks) == [3]
    assert tokens.merge(b"b", ranks) == [1]
    assert tokens.merge(b"", ranks) == []


def test_corpus(spark, library):
    data = [(1, "hello world", [7]), (2, None, None), (3, "", []), (4, "x " * 20000, None), (1, "hello world", None), (None, "hi", None)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, ids array<int>")
    got = sorted(((r.doc_id, r.ids) for r in tokens.encode_corpus(df).collect()), key=lambda r: (r[0] is None, r))
    assert got == [(1, library("hello world"))] * 2 + [(2, []), (3, []), (4, library("x " * 20000)), (None, library("hi"))]
    counted = tokens.count_tokens(df.withColumnRenamed("ids", "tokens"))
    assert counted.columns == ["doc_id", "tokens"]
    assert {r.doc_id: r.tokens for r in counted.collect()}[4] == len(library("x " * 20000))
    assert tokens.encode_corpus(df.limit(0)).collect() == []

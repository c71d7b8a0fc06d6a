import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestrata.llm import tokens as T

PATH = os.path.join(T.TOKENIZERS, T.BYTE_BPE_50K)
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="public vocabulary not here")


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return T.Encoder(PATH), lambda xs: [e.ids for e in t.encode_batch([x or "" for x in xs], add_special_tokens=False)]


CASES = ["", None, " ", "\n\n \t x", "aaaaaaaaaaaaaaaa", "It's we'll THEY'RE", "<|endoftext|>", "é é 日本語 🎉👩‍👩‍👧 \u200b\ufeff", "x" * 5000, "1234567890 " * 50, "\r\n\r\n", "a\x00b", "ſ ß İ", "the the the  the"]


def test_cases(both):
    encoder, want = both
    assert encoder.encode(CASES) == want(CASES)
    assert encoder.encode([]) == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_text(both, texts):
    encoder, want = both
    assert encoder.encode(texts) == want(texts)


def test_memory_of_words_is_bounded(both, monkeypatch):
    encoder, want = both
    monkeypatch.setattr(T, "KEPT_WORDS", 5)
    for _ in range(3):
        assert encoder.encode(CASES) == want(CASES)


def test_on_spark(spark, both, monkeypatch):
    monkeypatch.setattr(T, "BLOCK_CHARS", 40)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(CASES)], "doc_id int, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in T.encode_texts(df, ["doc_id"], "text").collect()}
    assert [got[i] for i in range(len(CASES))] == both[1](CASES)
    assert T.encode_texts(df.limit(0), ["doc_id"], "text").count() == 0

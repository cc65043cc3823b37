import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import encode
from tests.conftest import rows

pytestmark = pytest.mark.skipif(not os.path.isdir(encode.TOKENIZERS), reason="no vocabularies here")
PLAIN = "It's the cat's 3rd page, isn't it?  Two  spaces\tand\n\nlines. "
TEXTS = [None, "", " ", "\n\n", "a", "<|endoftext|>", PLAIN * 40, "naïve café — 日本語のテキスト " * 60, "x" * 30_000, " " * 5_000 + "end", "'ll 've 's" * 500, "\x00﻿​" * 300, "1234567890" * 400, "word " * 60_000, "tail's\r\n" * 700]


@pytest.fixture(scope="module")
def coder():
    return encode.ChunkEncoder()


@pytest.mark.parametrize("i", range(len(TEXTS)))
def test_chunks_give_the_ids_of_the_whole(coder, i):
    text = TEXTS[i] or ""
    assert coder.ids(TEXTS[i]).tolist() == coder.codec.encode_ordinary(text)
    assert coder.codec.decode(coder.ids(TEXTS[i]).tolist()) == text


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["the page ", "isn't", "  ", "\n", "é", "日本", "42", "!?", "word", " 'll", " "]), max_size=400))
def test_any_text(parts):
    coder = encode.encoder(encode.TOKENIZERS, "byte_bpe_50k")
    text = "".join(parts)
    assert coder.ids(text).tolist() == coder.codec.encode_ordinary(text)


def test_shared_passages_are_encoded_once(monkeypatch):
    coder = encode.ChunkEncoder()
    passage = " ".join(f"word{i} and {i * 7919 % 1000}" for i in range(3000))
    coder.ids("first head " + passage)
    before = coder.encoded
    coder.ids("another and longer head here " + passage)
    assert coder.reused >= 10 and coder.encoded - before <= 4
    monkeypatch.setattr(encode, "CACHE_CHARS", 1000)
    assert coder.ids(passage).tolist() == coder.codec.encode_ordinary(passage)
    coder.ids(passage[::-1])
    assert coder.held <= 1000


def test_same_as_the_other_file_of_the_vocabulary(coder):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(encode.TOKENIZERS, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    for text in TEXTS[4:8]:
        assert coder.ids(text).tolist() == t.encode(text, add_special_tokens=False).ids


def test_tables(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "the page", 5), (None, "x", 5), (3, "the page", 5)], "doc_id long, text string, ids int")
    got = rows(encode.ids(df))
    assert [(r[0], list(r[1])) for r in got] == [(1, []), (2, []), (3, [1169, 2443]), (3, [1169, 2443]), (None, [87])]
    assert encode.ids(df.where("false")).count() == 0
    assert rows(encode.token_counts(df, "doc_id")) == [(1, 0), (2, 0), (3, 2), (3, 2), (None, 1)]

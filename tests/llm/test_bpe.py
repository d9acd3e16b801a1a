import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewheel.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary here")


@pytest.fixture(scope="module")
def coder():
    return bpe.load(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(os.path.dirname(bpe.VOCABULARY), "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_hash_is_minimal_and_perfect(coder):
    h = coder.hash
    assert sorted(h.slot_key) == list(range(len(coder.tokens)))
    assert all(coder.token_id(t) == i for i, t in enumerate(coder.tokens))
    assert coder.token_id(b"no such token at all") == -1


def test_random_texts(coder, library):
    rng = random.Random(7)
    letters = "ab'st re  \n\t\r\x0b\x0c\x1c\x1d\x85\xa0éßдж中文字９٣½²Ⅷ👍🏽‍﻿ªʰ_-.!<|endoftext|>\u0000�"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    memory = bpe.encoder(coder)
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert list(bpe.encode_text(memory, text)) == want.ids, text


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_any_text(text):
    coder = bpe.load(bpe.VOCABULARY)
    ids = list(bpe.encode_text(bpe.encoder(coder), text))
    assert b"".join(coder.tokens[i] for i in ids) == text.encode()


def test_long_piece_without_break(coder, library):
    text = "abcdefghij" * 3000
    assert list(bpe.encode_text(bpe.encoder(coder), text)) == library.encode(text, add_special_tokens=False).ids


def test_encode_frame(spark, library):
    rows = [(1, "Hello world", "x"), (2, "", "x"), (3, None, "x"), (4, "<|endoftext|>", "x"), (1, "Hello world", "x"), (None, "  ", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = [(r["doc_id"], r["ids"]) for r in bpe.encode(df).collect()]
    assert got == [(d, library.encode(t, add_special_tokens=False).ids if t else []) for d, t, _ in rows]
    assert [r["n_tokens"] for r in bpe.count_tokens(df).collect()] == [len(i) for _, i in got]
    assert bpe.encode(bpe.distinct_documents(df)).count() == 5
    assert bpe.encode(df.limit(0)).count() == 0

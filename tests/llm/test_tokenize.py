import json

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from waymark.llm import tokenize
from waymark.llm.tokenize import BYTE_BPE_50K, TOKENIZERS, count_tokens, encode, encoder


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda xs: [e.ids for e in t.encode_batch(xs, add_special_tokens=False)]


def ours(texts):
    n, ids = encoder(BYTE_BPE_50K).batch(pa.array(texts, pa.string()))
    at = np.concatenate([[0], np.cumsum(n)])
    return [ids[a:b].tolist() for a, b in zip(at, at[1:])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n\t'’sretdlvm!?.,0123aZé\u00a0\u3000日本ß<|endoftext|>\x1f\x85-_#\r🙂"), max_size=60), min_size=1, max_size=20))
def test_like_the_library(plain, xs):
    assert ours(xs) == plain(xs)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=200))
def test_any_text(plain, x):
    assert ours([x]) == plain([x])


def test_windows(plain, monkeypatch):
    texts = ["word, and another 12! " * 300, "", "x" * 700, "日本語のテキスト" * 90, " " * 500 + "a"]
    want = plain(texts)
    monkeypatch.setattr(tokenize, "WINDOW", 64)
    assert ours(texts) == want


def test_cuts_are_certain():
    e = encoder(BYTE_BPE_50K)
    assert e.cuts[(ord("a") << 8) | ord(" ")] and not e.cuts[(ord(" ") << 8) | ord("a")] and not e.cuts[(ord("t") << 8) | ord("h")] and not e.cuts[(ord("a") << 8) | ord("'")]
    for token in tokenize.read_ranks(BYTE_BPE_50K):
        assert not any(e.cuts[(a << 8) | b] for a, b in zip(token, token[1:]))


def test_frames(spark, plain):
    rows = [(1, "Hello world", "x"), (2, None, "x"), (3, "", "x"), (1, "Hello world", "y"), (None, "z", None), (4, "long text, " * 50_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = encode(df, ["doc_id"]).collect()
    assert len(got) == 6 and sorted(r.ids for r in got if r.doc_id in (1, 2, 3)) == sorted([plain(["Hello world"])[0]] * 2 + [[], []])
    assert next(r.ids for r in got if r.doc_id == 4) == plain(["long text, " * 50_000])[0]
    assert {(r.doc_id, r.n_tokens) for r in count_tokens(df, ["doc_id"]).collect()} == {(r.doc_id, len(r.ids)) for r in got}
    assert encode(df.limit(0), ["doc_id"]).count() == 0 and json.loads(encode(df, ["doc_id"]).schema.json())["fields"][1]["type"]["elementType"] == "integer"

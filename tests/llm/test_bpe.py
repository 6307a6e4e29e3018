import base64
from pathlib import Path

import pytest
from hypothesis import given, settings, strategies as st

from shatterlens.llm.bpe import BYTE_BPE_50K, TOKENIZERS, count_tokens, encode_corpus, encoder

FILE = f"{TOKENIZERS}/{BYTE_BPE_50K}"
pytestmark = pytest.mark.skipif(not Path(FILE).exists(), reason="no public tokenizers here")


def ids(text):
    import numpy as np

    return np.frombuffer(encoder(FILE).encode(text), dtype="<i4").tolist()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    return t


@settings(max_examples=400, deadline=None)
@given(text=st.text(max_size=60) | st.text(alphabet="aAb 1'.\n\t_-éß中", max_size=60))
def test_equals_the_library(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(FILE) if "t" not in _one else _one["t"]
    t.encode_special_tokens = True
    _one["t"] = t
    assert ids(text) == t.encode(text, add_special_tokens=False).ids


_one: dict = {}


@pytest.mark.parametrize("text", ["a" * 300_000, " " * 100_000, "ab" * 100_000, "\u200b" * 30_000, "<|endoftext|> don't"])
def test_very_long_and_special(library, text):
    assert ids(text) == library.encode(text, add_special_tokens=False).ids


def test_round_trip():
    ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, Path(f"{TOKENIZERS}/byte_bpe_50k.tiktoken").open("rb"))}
    text = "Tie-breaks: 10 < 9\r\n\tnaïve 网络 😀  end "
    assert b"".join(ranks[i] for i in ids(text)).decode() == text


def test_corpus(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "x"), (3, "", "x"), (1, "a b", "x")], "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in encode_corpus(df).collect())
    assert got == [(1, ids("a b")), (1, ids("a b")), (2, []), (3, [])]
    assert sorted(tuple(r) for r in count_tokens(df, ["doc_id", "ids"]).collect()) == [(1, "x", 2), (1, "x", 2), (2, "x", 0), (3, "x", 0)]
    assert encode_corpus(df.limit(0)).count() == 0


def test_separators_are_no_white_space():
    import random

    from shatterlens.llm import bpe

    rng = random.Random(5)
    for text in ["page one\n\n\x1cpage two", *("".join(rng.choices("ab 1.\n\t\r\x0b\x0c\x1c\x1d\x1e\x1f'", k=40)) for _ in range(500))]:
        assert bpe._ASCII.findall(text) == bpe._ANY.findall(text)

"""Own merges against the public library."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterloom.llm import encode as E

FILES = os.environ.get("TOKENIZERS", E.TOKENIZERS)
pytestmark = pytest.mark.skipif(not os.path.exists(f"{FILES}/byte_bpe_50k.tiktoken"), reason="no vocabulary files")


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{FILES}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return E.Encoder(E.read_ranks(f"{FILES}/byte_bpe_50k.tiktoken")), t


texts = st.one_of(st.text(max_size=80), st.text(alphabet="ab 'slt\n\té😀0 .,<|endoftext|>", max_size=120))


@settings(max_examples=400, deadline=None)
@given(texts)
def test_equals_the_library(both, text):
    assert both[0].encode(text) == both[1].encode(text, add_special_tokens=False).ids


def test_round_trip(both):
    back = {v: k for k, v in both[0].ranks.items()}
    text = "Größe — naïve “quoted” 画像 <|endoftext|>\r\n\t x" * 20
    assert b"".join(back[i] for i in both[0].encode(text)).decode() == text


def test_long_pieces(both):
    for text in ("a" * 50_000, "ab" * 30_000, "!?" * 20_000, " " * 40_000, "é" * 9_999):
        assert both[0].encode(text) == both[1].encode(text, add_special_tokens=False).ids


def test_tree_gives_the_leftmost_lowest():
    t = E.PairTree([5, 2, 9, 2], 100)
    assert t.best() == (2, 1)
    t.set(1, 100)
    assert t.best() == (2, 3)
    for i in range(4):
        t.set(i, 100)
    assert t.best()[0] == 100


def test_every_document_has_its_list(spark, both):
    df = spark.createDataFrame([(1, "Hello world", 1), (2, None, 2), (3, "", 3), (4, "   ", 4), (4, "x", 5), (None, "y", 6)], "doc_id bigint, text string, ids int")
    got = sorted(((r.doc_id, r.ids) for r in E.encode_texts(df).collect()), key=repr)
    assert got == sorted([(1, both[1].encode("Hello world").ids), (2, []), (3, []), (4, both[1].encode("   ").ids), (4, both[1].encode("x").ids), (None, both[1].encode("y").ids)], key=repr)
    assert E.encode_texts(df.limit(0)).count() == 0

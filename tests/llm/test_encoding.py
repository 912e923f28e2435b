import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import encoding as E

PATH = f"{E.TOKENIZERS}/byte_bpe_50k.tiktoken"


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aáb=- 机场가나🙂\n", min_size=0, max_size=400), st.integers(1, 30))
def test_any_text_round_trips(text, times):
    enc = E.encoder(PATH)
    whole = text * times
    ids = E.encode(enc, whole).tolist()
    assert ids == enc.encode_ordinary(whole) and enc.decode(ids) == whole


def test_tree_is_exact():
    enc = E.encoder(PATH)
    random.seed(7)
    for kinds in ("ab", "机场附近的", "a", "=", "가나다라마바", "aáb机🙂"):
        for size in (1, 1023, 1024, 1025, 5000):
            data = "".join(random.choice(kinds) for _ in range(size)).encode()
            assert E.encode_tree(enc, data) == enc._encode_single_piece(data)


def test_corpus(spark):
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file(f"{E.TOKENIZERS}/byte_bpe_50k.json")
    other.encode_special_tokens = True
    texts = ["Hello  world\r\n\t", "<|endoftext|> is text", "字" * 3000, "x" * 5000, " " * 2500, None, "", "同じ文"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as k", "array(1) as ids")
    got = {r.doc_id: r.ids for r in E.encode_corpus(frame, key="doc_id", text="text").collect()}
    for i, text in enumerate(texts):
        assert got[i] == (other.encode(text, add_special_tokens=False).ids if text else [])
    assert E.encode_corpus(frame.limit(0), key="doc_id", text="text").count() == 0

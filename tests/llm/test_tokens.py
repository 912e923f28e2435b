import math
import random

import pytest

from textloom.llm import tokens as T
from textloom.llm.encoding import TOKENIZERS

MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"


def brute(pieces, fallback, text):
    best = [(-math.inf, 0)] * (len(text) + 1)
    best[0] = (0.0, 0)
    for i in range(len(text)):
        for j in range(i + 1, min(len(text), i + T.DEPTH) + 1):
            if text[i:j] in pieces:
                best[j] = max(best[j], (best[i][0] + pieces[text[i:j]], best[i][1] + 1), key=lambda x: x[0])
        if text[i] not in pieces:
            n = len(text[i].encode())
            best[i + 1] = max(best[i + 1], (best[i][0] + fallback * n, best[i][1] + n), key=lambda x: x[0])
    return best[-1][1]


def test_viterbi_matches_brute_force():
    random.seed(3)
    for _ in range(20):
        pieces = {"".join(random.choice("abcé机") for _ in range(random.randint(1, 4))): -random.uniform(1, 9) for _ in range(25)}
        trie = T.DoubleArrayTrie(pieces)
        texts = ["".join(random.choice("abcé机x🙂") for _ in range(random.randint(1, 40))) for _ in range(50)]
        assert T.count_pieces(trie, -10.0, texts).tolist() == [brute(pieces, -10.0, t) for t in texts]


def test_long_segments_are_not_cut():
    random.seed(6)
    pieces = {"".join(random.choice("abc") for _ in range(random.randint(2, 5))): -random.uniform(1, 9) for _ in range(40)} | {"a": -3.0, "b": -4.0}
    trie = T.DoubleArrayTrie(pieces)
    texts = ["".join(random.choice("abcé🙂") for _ in range(n)) for n in (T.STEP, T.STEP + 1, 300, 1500, 70_000)] + ["abc"]
    assert T.count_pieces(trie, -10.0, texts).tolist() == [brute(pieces, -10.0, t) for t in texts]
    trie, fallback = T.vocabulary(MODEL)
    run = "unbroken" * 100
    whole = dict.fromkeys([run[i:j] for i in range(8) for j in range(i + 1, i + 17)])
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    ranked = sorted(plain, key=lambda i: (model.get_score(i) < -1e6, -model.get_score(i)))
    scores = {model.id_to_piece(i): s for i, s in zip(ranked, T.zipf_scores(len(ranked)), strict=True) if model.id_to_piece(i) in whole}
    assert T.count_pieces(trie, fallback, [run]).tolist() == [brute(scores, fallback, run)]


def test_segments_keep_every_character():
    assert T.segments("ab  cd机场12") == ["▁ab", "▁▁cd", "机场", "1", "2"]
    long = "字" * 1000
    assert "".join(T.segments(long)) == "▁" + long and len(T.segments(long)) == 1


def test_close_to_the_tokenizer(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = ["The committee shall keep the portable calendar under number 17.", "港口的日历真的晚了九十分钟吗", "携帯用の請求書を庭園に残した。" * 30]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, None, ""])], "tokens_of long, text string, k string")
    got = {r.tokens_of: r.tokens for r in T.estimate_tokens(frame, text="text", keep=["tokens_of"]).collect()}
    for i, text in enumerate(texts):
        assert abs(got[i] - len(model.encode(text))) <= 0.15 * len(model.encode(text)) + 1
    assert got[3] == got[4] == 0
    assert T.estimate_tokens(frame.limit(0), text="text", keep=["tokens_of"]).count() == 0


def test_budget_counts_each_slice(spark):
    rows = spark.createDataFrame(
        [("t", "s", "eng", "news", 5, 4), ("t", "s", "eng", None, 3, None), ("t", None, "kor", "news", 2, 2)],
        "record_table string, source string, language string, domain string, tokens long, stated long",
    )
    got = {(r.slice, r.source, r.language, r.domain): (r.records, r.tokens, r.stated_tokens, r.unstated_records) for r in T.token_budget(rows).collect()}
    assert got["source", "s", None, None] == (2, 8, 4, 1)
    assert got["language", None, "eng", None] == (2, 8, 4, 1)
    assert got["domain", None, None, "news"] == (2, 7, 6, 0)
    assert got["source_language_domain", "s", "eng", None] == (1, 3, None, 1)

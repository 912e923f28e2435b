"""The cleaning cascade and the output filter: every reason by its own text, in Spark and in SQL."""

import hashlib

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import clean
from textloom.plans import cleaning, sqltext

LONG = "The committee kept the portable calendar in the northern library over the winter. "
CASES = [
    (None, "eng_Latn", "missing_text"), ("", "eng_Latn", "empty"), ("short", "eng_Latn", "too_short"), (LONG * 40, "eng_Latn", "segment_bound_exceeded"),
    ("字" * 1400, "zho_Hans", "segment_bound_exceeded"), (LONG + "�", "eng_Latn", "replacement_characters"), (LONG + "\x07", "eng_Latn", "control_characters"),
    ("ab​​​​ cdefgh ijkl mnop", "eng_Latn", "low_visible_ratio"), (LONG + "<div class=x>", "eng_Latn", "html_residue"),
    ("Skip to: search | topNavigation and the rest", "eng_Latn", "template_residue"), ("Skip to: the next chapter of this book", "eng_Latn", None),
    ("Our casino has a welcome bonus for all of you", "eng_Latn", "template_residue"), ("시험 대비 최신 덤프 자료를 제공합니다 여러분", "kor_Hang", "template_residue"),
    ("The cafÃ© by the harbour is closed today", "eng_Latn", "mojibake"), (LONG + "0123456789abcdef" * 5, "eng_Latn", "encoded_blob"),
    ("学生" + hashlib.sha256(b"x").hexdigest() + "学 the harbour crane is old", "eng_Latn", "long_enough"), (LONG + "aB3/" * 4 + "xYz9" * 27 + "Qq==", "eng_Latn", "encoded_blob"),
    (LONG + "zzzzzzzzzzzz", "eng_Latn", "mechanical_repetition"), (LONG + "abcabcabcabcabc", "eng_Latn", "mechanical_repetition"), (LONG + "abcabcabcabc", "eng_Latn", None),
    ("12 34 56 78 - 90 / 11 + 22 = 33 ab", "eng_Latn", "numeric_symbol_dominance"), ("See https://a.example/some/long/path/to/a/page here", "eng_Latn", "url_email_dominance"),
    ("学生write@to.example.orgで連絡", "jpn_Jpan", "url_email_dominance"), ("A lone Casino, an old casino by the sea, they say", "eng_Latn", "keyword_stuffing"),
    ("カジノと在线试听が港にあった昔のことを書いた本", "jpn_Jpan", "keyword_stuffing"), ("The casinos and one casino stood by the sea there", "eng_Latn", None),
    ("格安 激安 口コミ 最安値 成人 の店が港に並んでいる", "jpn_Jpan", "keyword_stuffing"), ("格安 激安 口コミ 最安値の店が港に並んでいた。", "jpn_Jpan", None),
    ("港にあった昔のことを書いた本が図書館にある。", "eng_Latn", "script_mismatch"), ("這個學生認為圖書館應該開門讓讀者進來閱讀書籍", "zho_Hans", "chinese_variant_mismatch"),
    (LONG, "eng_Latn", None),
]


def test_every_reason(spark):
    duckdb = pytest.importorskip("duckdb")
    rows = [(i, t, lang) for i, (t, lang, _) in enumerate(CASES)]
    frame = spark.createDataFrame(rows, "id int, segment string, lang string")
    got = {r.id: r.reason for r in clean.with_reason(frame, "lang").collect()}
    link = duckdb.connect()
    link.execute("create table cut (id int, segment varchar, lang varchar)")
    link.executemany("insert into cut values (?, ?, ?)", rows)
    sql = f"with segments as (select *, {sqltext.flat('segment')} as flat from cut) select id, {cleaning.reason_sql()} from segments"
    assert dict(link.execute(sql).fetchall()) == got
    want = {i: reason for i, (_, _, reason) in enumerate(CASES)}
    assert {i: (got[i], CASES[i][0][:40] if CASES[i][0] else None) for i in want if got[i] != want[i] and want[i] != "long_enough"} == {}
    assert got[[w for _, _, w in CASES].index("long_enough")] is None  # no boundary between a Han character and a digit


def test_repetition_in_sql_is_that_of_the_pattern():
    import random
    import re

    duckdb = pytest.importorskip("duckdb")
    random.seed(1)
    texts = []
    for _ in range(300):
        part = "".join(random.choice("ab学") for _ in range(random.randint(1, 36)))
        texts.append("".join(random.choice("ab学") for _ in range(random.randint(0, 9))) + part * random.randint(1, 6) + random.choice(["", "b", "ab"]))
    link = duckdb.connect()
    link.execute("create table t (i int, x varchar)")
    link.executemany("insert into t values (?, ?)", list(enumerate(texts)))
    found = link.execute(f"select i, {sqltext.periodic('x', 2, '32', 5)}, {sqltext.periodic('x', 4, '1000000', 3)} from t").fetchall()
    assert {(i, a, b) for i, a, b in found} == {(i, bool(re.search(r"(.{2,32})\1{4,}", x)), bool(re.search(r"(.{4,}?)\1{2,}", x))) for i, x in enumerate(texts)}


def test_flat_text_has_the_same_length(spark):
    frame = spark.createDataFrame([("aé学1.٣ x",), ("",), (None,)], "t string")
    assert [r.f for r in frame.select(X.flat(F.col("t")).alias("f")).collect()] == ["a__1._ x", "", None]

import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm.canonical import canonical_text, fold, repair, same_look_pairs, skeleton, suspects


def test_fold_unifies_what_looks_alike():
    assert fold("ｶﾞｲﾄﾞ ＡＢＣ１") == "ガイド ABC1"
    assert fold("é​­ x y　z") == "é x y z"
    assert fold("⽔ﬁle") == "水file"
    assert fold("WN‑9045") == "WN-9045"
    assert fold(unicodedata.normalize("NFD", "각각")) == "각각"


def test_fold_keeps_visible_differences():
    for text in ("m²", "①", "x⁴", "½", "A b", "a,b", "體", "É"):
        assert fold(text) == text


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_fold_is_idempotent(text):
    assert fold(fold(text)) == fold(text)


def test_repair_by_script():
    assert skeleton("tһе соurt") == "the court"
    assert suspects("слово и дело, рот") == []  # a real Russian text
    assert repair("соurt", {"court"}) == "court"
    assert repair("соurt", {"other"}) == "соurt"


def test_repair_goes_both_ways():
    assert skeleton("приpода Mocквa") == "природа Москва"
    assert skeleton("λόγoς") == "λόγος"
    assert skeleton("Это моя cтpана") == "Это моя страна"
    assert suspects("Жwords") == []  # sure letters of both scripts


def test_repair_of_kana_and_han():
    assert skeleton("港ロ起重機 昨日のタ方") == "港口起重機 昨日の夕方"
    assert skeleton("力レンダーとフィル夕ーとデ一タ、夕ービン") == "カレンダーとフィルターとデータ、タービン"
    for plain in ("入力データ", "二週間", "カード", "すべてのページ", "口座"):
        assert skeleton(plain) == plain
    assert repair("港ロ起重機", {"港口"}) == "港口起重機"
    assert repair("3カ月", set()) == "3カ月"


def test_vocabulary_counts_records_not_rows(spark):
    def forms(rows):
        frame = spark.createDataFrame(rows, "id long, text string")
        return {r.id: r.canonical for r in canonical_text(frame, "text", key=["id"]).collect()}

    assert forms([(1, "zqxvcоde"), (1, "zqxvcоde")]) == {1: "zqxvcоde"}  # one record, delivered twice
    assert forms([(1, "zqxvcоde"), (2, "zqxvсode")]) == {1: "zqxvcode", 2: "zqxvcode"}
    assert forms([(1, "Mocквa"), (2, "Москва")])[1] == "Москва"
    assert forms([(1, "港ロ起重機"), (2, "港口")])[1] == "港口起重機"
    assert forms([(1, "3カ月"), (2, "3カ月"), (3, "力")])[1] == "3カ月"


def test_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        rows = [(i, f"the соurt {i // 2}" if i % 2 else f"the court {i // 2}") for i in range(120)]
        frame = spark.createDataFrame(rows, "id long, text string").selectExpr("'a' as t", "id", "text").coalesce(1)
        found = same_look_pairs(canonical_text(frame, "text", key=["t", "id"]), table="t", key="id").collect()
        assert sorted((r.left_id, r.right_id) for r in found) == [(i, i + 1) for i in range(0, 120, 2)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pairs(spark):
    rows = [
        ("a", 1, "the соurt"), ("a", 2, "the court"), ("a", 2, "the court"), ("a", 3, "the court"), ("a", 4, "The court"),
        ("b", 1, "the​ court"), ("a", 5, None), ("a", 6, ""), ("a", 7, "​"), ("a", 8, "m2"), ("a", 9, "m²"), ("b", 2, "x" * 200_000),
    ]
    frame = spark.createDataFrame(rows, "token string, stored_id long, base string").selectExpr("token as tab", "stored_id as key", "base as text", "1 as token")
    found = same_look_pairs(canonical_text(frame, "text", key=["tab", "key"]), table="tab", key="key")
    assert sorted(map(tuple, found.collect())) == [("a", 1, 2), ("a", 1, 3), ("a", 6, 7)]
    empty = canonical_text(frame.limit(0), "text", key=["tab", "key"])
    assert same_look_pairs(empty, table="tab", key="key").count() == 0

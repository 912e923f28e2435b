from textloom.plans import review


def test_foreign_characters_of_every_language(spark, tmp_path):
    texts = [
        ("eng_Latn", "Café: 5 + 3 = 8, fine."), ("eng_Latn", "The word 学校 is a noun."), ("eng_Latn", "Up → down"), ("zho_Hans", "港口，很旧。カナ"),
        ("zho_Hant", "港口😀abc"), ("jpn_Jpan", "カーテンと漢字。"), ("jpn_Jpan", "漢字\n😀かな"), ("jpn_Jpan", "漢字abc"), ("kor_Hang", "항구는 1월 я"), ("und", "я"), (None, "я"),
        ("kor_Hang", None), ("kor_Hang", ""), ("zho_Hans", "港" * 30 + "я" + "口" * 30),
    ]
    spark.createDataFrame([(i, x, t) for i, (t, x) in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.spot, r.context) for r in review.foreign_examples(spark, str(tmp_path)).collect()}
    spots = {1: 10, 2: 4, 3: 7, 4: 3, 6: 4, 7: 3, 8: 8, 13: 31}
    assert got == {i: (n, texts[i][1][max(0, n - 11) : max(1, n - 10) + 20]) for i, n in spots.items()}

from collections import Counter

from textloom.plans import vocabulary


def test_whole_alphabet_is_audited(spark, tmp_path):
    alphabet = vocabulary.must_cover_alphabet()
    assert {chr(c) for c in range(0xAC00, 0xD7A4)} | set("▁aÿぁヾᄀㄱꥠힰ！臺麼学訳、\u3000") <= alphabet and not set(" \n😀я") & alphabet
    texts = ["가각 gate 学校、ｶﾅ\u3000😀\n", "я가", "", None, "𠀀臺"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.character: (r.occurrences, r.state) for r in vocabulary.alphabet_states(spark, str(tmp_path)).collect()}
    counts = Counter("".join(t or "" for t in texts))
    assert got == {c: (0, "unused") for c in alphabet} | {c: (n, "used" if c in alphabet else "outside") for c, n in counts.items()}

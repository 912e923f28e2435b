import random

import numpy as np

from textloom.llm import spans


def brute(rows, span):
    where = {}
    for k, t in rows:
        for i in range(len(t or "") - span + 1):
            where.setdefault(t[i : i + span], set()).add(k)
    return {(a, b) for ks in where.values() for a in ks for b in ks if a < b}


def corpus():
    random.seed(9)
    texts = ["".join(random.choice("ab 学生\n") for _ in range(random.randint(0, 900))) for _ in range(60)]
    for _ in range(50):
        source, size = random.choice(texts), random.choice([150, 199, 200, 201, 260, 500])
        at = random.randrange(max(1, len(source) - size))
        texts.append("".join(random.choice("xy") for _ in range(80)) + source[at : at + size] + "q" * random.randrange(30))
    rows = list(enumerate([*texts, texts[3], texts[3], "ab" * 400, "ab" * 500, None, ""]))
    return [*rows, rows[5]]


def test_selection_depends_on_content_only(monkeypatch):
    random.seed(1)
    text = "".join(random.choice("abcdé学") for _ in range(3000))
    _, place, hashes = spans.select_windows([text], 200)
    assert np.diff(place).max() <= 200 - spans.GRAM + 1
    monkeypatch.setattr(spans, "CHUNK", 500)
    _, place2, hashes2 = spans.select_windows(["x" * 300, text], 200)
    assert {(p, h) for p, h in zip(place.tolist(), hashes.tolist())} <= set(zip(place2.tolist(), hashes2.tolist()))


def test_pairs_match_brute_force(spark):
    rows = corpus()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", "1 as same", "'x' as k", "2 as window")
    got = [tuple(r) for r in spans.span_pairs(frame, key="doc_id", text="text").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 200)
    assert spans.span_pairs(frame.limit(0), key="doc_id", text="text").count() == 0


def test_tasks_of_many_batches(spark):
    rows = corpus()
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = [tuple(r) for r in spans.span_pairs(frame, key="doc_id", text="text").collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert len(got) == len(set(got)) and set(got) == brute(rows, 200)


def test_shares_match_brute_force(spark):
    rows = [(k, t) for k, t in corpus() if t is None or not t.startswith("abab")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    holders = {}
    for k, t in rows:
        for i in range(len(t or "") - 199):
            holders.setdefault(t[i : i + 200], set()).add(k)
    got = {r.doc_id: (r.characters, r.shared) for r in spans.shared_shares(frame, key="doc_id", text="text").collect()}
    for k, t in rows:
        marked = set()
        for i in range(len(t or "") - 199):
            if len(holders[t[i : i + 200]]) > 1:
                marked.update(range(i, i + 200))
        assert got[k] == (len(t or ""), len(marked))


def test_sketch_never_underestimates(spark, monkeypatch):
    random.seed(4)
    values = [random.getrandbits(64) - (1 << 63) for _ in range(3000)]
    rows = [(v, i) for i, v in enumerate(values)] + [(v, -1) for v in values[:500]]
    random.shuffle(rows)
    frame = spark.createDataFrame([(v, str(i).encode(), 0) for v, i in rows], "window long, same binary, place int").repartition(5)
    for slices in (1, 7):
        bits = {r.slice: np.array(r.bits, np.int64).view(np.uint8) for r in spans.sketch(frame, slices).collect()}
        flat = {k: np.unpackbits(v, bitorder="little") for k, v in bits.items()}
        hashes = np.array(values, np.int64).view(np.uint64)
        cells = spans._cells(hashes).astype(np.int64)
        again = [all(flat[s][c] for c in cells[:, i]) for i, s in enumerate(spans._slices(hashes, slices).tolist())]
        assert all(again[:500]) and sum(again[500:]) < 50
    monkeypatch.setattr(spans, "PER_SLICE", 400)
    kept = {r.window for r in spans.repeated_windows(frame).collect()}
    assert kept == set(values[:500])


def test_a_template_in_many_texts_is_one_class(spark):
    random.seed(8)
    body = "".join(random.choice("abcdefgh ") for _ in range(700))
    rows = [(i, f"{i:09d}" * 30 + body + f"{i:09d}" * 30) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    classes, members = spans.window_classes(frame, key="doc_id", text="text", span=200)
    inner = classes.where("several").count()
    assert inner >= 3 and members.count() >= 40 * inner
    assert spans.span_pairs(frame, key="doc_id", text="text").count() == 40 * 39 // 2


def test_records_without_a_key_share_nothing(spark):
    random.seed(3)
    body = "".join(random.choice("abcdefgh ") for _ in range(400))
    frame = spark.createDataFrame([(None, body), (1, body[50:] + "x"), (2, body), (None, None)], "doc_id long, text string")
    assert [tuple(r) for r in spans.span_pairs(frame, key="doc_id", text="text").collect()] == [(1, 2)]
    assert {r.doc_id: r.shared for r in spans.shared_shares(frame, key="doc_id", text="text").collect()} == {1: 350, 2: 350}
    assert spans.shared_shares(frame.where("doc_id = 1"), key="doc_id", text="text").first().shared == 0

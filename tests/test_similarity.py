import hashlib
import json
import random

from textloom.plans import similarity


def save(spark, folder, name, rows, kinds):
    spark.createDataFrame(rows, kinds).write.parquet(f"{folder}/{name}.parquet")


ENTRY = "entry_id long, language string, source_id string, text string, normalized string, groups array<string>, splits array<string>"


def entry(number, language, text, groups=()):
    return (number, language, "s", text, (text or "").lower(), list(groups), ["train"])


def test_scan_follows_the_match_mode(spark, tmp_path):
    random.seed(4)
    words = "harbour court festival budget driver library filter old quiet narrow damp river".split()
    text = [" ".join(random.choice(words) for _ in range(40)) for _ in range(7)]
    near = lambda t, n: " ".join([*t.split()[:20], *["gate"] * n, *t.split()[20 + n :]])
    entries = [
        entry(1, "eng_Latn", text[0]), entry(2, "eng_Latn", near(text[1], 1)), entry(3, "eng_Latn", near(text[1], 2)), entry(4, "eng_Latn", text[2] + "!"),
        entry(5, "kor_Hang", text[3]), entry(6, "eng_Latn", text[4].upper()), entry(6, "eng_Latn", text[4].upper()), entry(7, "eng_Latn", None),
        entry(8, "eng_Latn", "ab"), entry(9, "eng_Latn", text[5]), entry(10, "eng_Latn", near(text[5], 1)), entry(11, "eng_Latn", text[0]),
    ]
    modes = ["exact", "exact-and-near", "exact", "exact-and-near", None, "exact-and-near", "exact-and-near"]
    items = [(i, f"r{i}", "eng_Latn", t, "set", "benchmark", "block", m) for i, (t, m) in enumerate(zip(text, modes, strict=True))]
    items += [items[1], (7, "r7", "eng_Latn", "AB", "set", "benchmark", "block", "exact-and-near")]
    save(spark, tmp_path, "text_entries", entries, ENTRY)
    save(spark, tmp_path, "reference_records", items, "item_id long, record_id string, language string, text string, reference_id string, kind string, policy string, match_mode string")
    rows = similarity.contamination_scan(spark, str(tmp_path)).collect()
    assert {r.item_id for r in rows if r.match is None} == {2, 3, 6, 7}
    rows = [r for r in rows if r.match]
    assert sorted((r.item_id, r.entry_id, r.match) for r in rows) == [(0, 1, "exact"), (0, 11, "exact"), (1, 2, "near"), (4, 6, "near"), (5, 9, "exact")]
    grams = lambda t: {f"^{t}$"[i : i + 3] for i in range(len(t))}
    a, b = grams(text[1]), grams(near(text[1], 1))
    assert {r.item_id: r.similarity for r in rows if r.match == "near"} == {1: round(len(a & b) / len(a | b), 6), 4: 1.0}


def test_tied_groups_share_component_and_split(spark, tmp_path):
    random.seed(5)
    words = "harbour court festival budget driver library filter old quiet narrow damp river".split()
    text = [" ".join(random.choice(words) for _ in range(40)) for _ in range(4)]
    entries = [
        entry(1, "eng_Latn", text[0], ["g01", "g02"]), entry(2, "eng_Latn", text[0].upper(), ["g03"]), entry(3, "eng_Latn", text[0] + " gate", ["g04"]),
        entry(4, "kor_Hang", text[0], ["g05"]), entry(5, "eng_Latn", text[1], ["g06", None]), entry(6, "eng_Latn", None, ["g07", "g08"]), entry(7, "eng_Latn", "", ["g09"]),
        entry(8, "eng_Latn", " ", ["g10"]), entry(9, "eng_Latn", "aaa", ["g11"]), entry(10, "eng_Latn", "aaaa", ["g12"]), entry(10, "eng_Latn", "aaaa", ["g12"]),
        entry(11, "eng_Latn", text[2], ["g13"]), entry(12, "eng_Latn", text[2], ["g06"]),
    ]
    save(spark, tmp_path, "text_entries", entries, ENTRY)
    save(spark, tmp_path, "encoded_samples", [("s1", "g01"), ("s2", "g14"), ("s3", "g14"), ("s4", None)], "sample_id string, sample_group_id string")
    got = {r.sample_group_id: (r.component_id, r.split) for r in similarity.component_splits(spark, str(tmp_path)).collect()}
    want = {}
    for members in (["g01", "g02", "g03", "g04"], ["g05"], ["g06", "g13"], ["g07", "g08"], ["g09"], ["g10"], ["g11"], ["g12"], ["g14"]):
        line = lambda x: (json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":")) + "\n").encode()
        name = "component-sha256:" + hashlib.sha256(line(members)).hexdigest()
        place = int(hashlib.sha256(line({"component_id": name, "split_profile_version": "massive-locked-count-hash-v1"})).hexdigest(), 16) % 16521
        want |= dict.fromkeys(members, (name, "train" if place < 11514 else "dev" if place < 13547 else "test"))
    assert got == want


def test_pieces_of_many_texts_at_once():
    import numpy as np
    import pyarrow as pa

    from textloom.operators import setjoin as S

    texts = ["", "a", "ab", "abcabcabc", "学生学生 x", "z" * 50]
    owner, hashes = S.batch_pieces(texts)
    for i, text in enumerate(texts):
        mine = hashes[owner == i]
        assert len(mine) == len(S.pieces(text)) and np.array_equal(mine, S.piece_hashes(text))
        assert S.parity_sketches(owner, hashes, len(texts))[i].tolist() == S.parity_sketch(mine)
    batch = pa.RecordBatch.from_pydict({"x": ["y" * S.CHARACTERS, *(["t"] * (S.TEXTS + 5)), "u" * (S.CHARACTERS + 9), "v"]})
    assert [p.num_rows for p in S._parts(batch, 0)] == [1, S.TEXTS, 5, 1, 1]


def test_similarity_join_over_many_batches(spark):
    import random

    from pyspark.sql import functions as F

    from textloom.operators import setjoin as S

    random.seed(3)
    texts = list(dict.fromkeys("".join(random.choice("abc ") for _ in range(random.randint(0, 30))) for _ in range(150)))
    texts += [t + "c" for t in texts if t and t + "c" not in texts]
    frame = spark.createDataFrame([(t,) for t in dict.fromkeys(texts)], "form string").coalesce(1).withColumn("h", F.md5("form"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        found = S.similar_pairs(frame, frame, S.count_table(frame.select("form")), similar=82, both=True)
        names = {r.h: r.form for r in frame.collect()}
        got = {frozenset((names[r.left_h], names[r.right_h])) for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    kept = [(t, S.pieces(t)) for t in dict.fromkeys(texts)]
    want = {frozenset((a, b)) for i, (a, x) in enumerate(kept) for b, y in kept[i + 1 :] if x & y and 100 * len(x & y) >= 82 * len(x | y)}
    assert got == want and want


def test_blocks_meet_only_themselves(spark):
    from textloom.operators import setjoin as S

    rows = [(1, "the quiet harbour", "a"), (2, "the quiet harbours", "a"), (3, "the quiet harbour!", "b"), (4, "the quiet harbour?", None), (5, "the quiet harbour.", None)]
    frame = spark.createDataFrame(rows, "h long, form string, language string")
    found = S.similar_pairs(frame, frame, S.count_table(frame.select("form")), similar=75, both=True, block="language")
    assert sorted((r.left_h, r.right_h) for r in found.collect()) == [(1, 2), (4, 5)]


def test_classes_of_linked_nodes(spark):
    from textloom.operators import dedup as D

    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 5, 0.9), (3, 4, 0.9)], "left_id long, right_id long, similarity double")
    nodes = spark.createDataFrame([(i,) for i in range(1, 7)], "entry_id long")
    got = {r.entry_id: (r.class_id, r.links) for r in D.linked_classes(pairs, nodes, "entry_id").collect()}
    assert got == {1: (1, 1), 2: (1, 2), 5: (1, 1), 3: (3, 1), 4: (3, 1), 6: (6, 0)}

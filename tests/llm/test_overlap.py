import random

from textloom.llm.overlap import SIMILAR, overlap_form, overlap_report, parity_sketch, piece_hashes, pieces, split_overlaps


def test_sketch_never_exceeds_the_difference():
    random.seed(2)
    for _ in range(100):
        a = "".join(random.choice("abcdef ") for _ in range(80))
        b = "".join(c if random.random() > 0.2 else "z" for c in a)
        apart = sum((x ^ y).bit_count() for x, y in zip([v & (1 << 64) - 1 for v in parity_sketch(piece_hashes(a))], [v & (1 << 64) - 1 for v in parity_sketch(piece_hashes(b))], strict=True))
        assert apart <= len(pieces(a) ^ pieces(b))


def brute(rows):
    def side(splits):
        names = {(s or "").strip().lower() for s in splits or []}
        return "train" in names, bool(names & {"dev", "test", "valid", "validation"})

    out, kept = set(), {}
    for k, text, splits in rows:
        if text is not None and overlap_form(text):
            kept[k] = (overlap_form(text), *side(splits))
    for i, (a, t, h) in kept.items():
        if t and h:
            out.add((i, i))
        for j, (b, u, v) in kept.items():
            if i < j and ((t and v) or (h and u)):
                x, y = pieces(a), pieces(b)
                if len(x | y) and 100 * len(x & y) >= SIMILAR * len(x | y):
                    out.add((i, j))
    return out


def test_matches_brute_force(spark):
    random.seed(4)
    words = "harbour court festival budget driver 学生 图书馆 라이브러리 filter old quiet 17 203".split()
    rows = []
    for k in range(240):
        text = " ".join(random.choice(words) for _ in range(random.randint(1, 25)))
        if rows and random.random() < 0.5:
            text = random.choice(rows)[1] or text
            at = random.randrange(len(text))
            text = random.choice([text, text.upper(), text + ".", text[:at] + "x" + text[at + 1 :], text.replace("o", "о"), "  ".join(text.split())])
        rows.append((k, text, random.choice([["train"], ["Train "], ["dev"], [" test"], ["validation", "train"], [], None, [None, "TEST"]])))
    rows += [(900, None, ["train", "dev"]), (901, "", ["train"]), (902, "", ["test"]), rows[3], rows[3]]
    frame = spark.createDataFrame(rows, "entry_id long, normalized string, splits array<string>").selectExpr("*", "1 as h", "2 as form", "true as train")
    found = split_overlaps(frame, key="entry_id", text="normalized", splits="splits")
    got = [(r.left_id, r.right_id) for r in found.where("similar").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert split_overlaps(frame.limit(0), key="entry_id", text="normalized", splits="splits").count() == 0


def test_hot_form_meets_once(spark):
    rows = [(k, "the same form of everything", ["train"] if k else ["test"]) for k in range(400)]
    frame = spark.createDataFrame(rows, "entry_id long, normalized string, splits array<string>")
    assert split_overlaps(frame, key="entry_id", text="normalized", splits="splits").count() == 399


def test_hash_matches_are_kept_whatever_their_similarity(spark):
    rows = [(1, "Hello, world! OK?", ["train"]), (2, "hello world ok", ["test"]), (3, "!!!", ["train"]), (4, "???", ["test"]), (5, "HELLO  world ok", ["dev"]), (6, "the old harbour bridge is closed today", ["train"]), (7, "The old harbour bridge is closed todays", ["test"])]
    frame = spark.createDataFrame(rows, "entry_id long, normalized string, splits array<string>")
    got = {(r.left_id, r.right_id): (r.match, r.similar) for r in split_overlaps(frame, key="entry_id", text="normalized", splits="splits").collect()}
    assert got == {(1, 2): ("loose", False), (1, 5): ("loose", False), (6, 7): ("near", True)}


def test_report_counts_by_split_and_source(spark):
    pairs = spark.createDataFrame([(1, 2, "same"), (1, 3, "near"), (4, 4, "same")], "left_id long, right_id long, match string")
    rows = [(1, "a", ["train"], ["g"]), (2, "b", ["test"], None), (3, "b", ["dev", "Valid "], []), (4, None, ["train", "dev"], ["g", "x"])]
    entries = spark.createDataFrame(rows, "entry_id long, source_id string, splits array<string>, groups array<string>")
    samples = spark.createDataFrame([("g", "s"), ("g", "s")], "sample_group_id string, source_id string")
    got = {tuple(r) for r in overlap_report(pairs, entries, key="entry_id", splits="splits", source="source_id", groups="groups", samples=samples).collect()}
    assert got == {
        ("entry", "train", "a", 1, 2, 1, 0, 1), ("entry", "test", "b", 1, 1, 1, 0, 0), ("entry", "dev", "b", 1, 1, 0, 0, 1), ("entry", "train", None, 1, 1, 1, 0, 0),
        ("entry", "dev", None, 1, 1, 1, 0, 0), ("group", "train", "s", 2, 3, 2, 0, 1), ("group", "dev", "s", 1, 1, 1, 0, 0),
    }

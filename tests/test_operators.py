import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import identity as I
from textloom.functions import text as X
from textloom.operators import clean, dedup, parallel, select, summary
from textloom.operators.graph import components


def one(spark, text, *columns, language="eng_Latn"):
    return spark.createDataFrame([(text, language)], "t string, l string").select(*columns).first()


@pytest.mark.parametrize(
    "text, reason",
    [
        (None, "missing_text"), ("", "empty"), ("short", "too_short"), ("x y " * 700, "segment_bound_exceeded"), ("字" * 1400, "segment_bound_exceeded"),
        ("A sentence of words with � in the middle of it.", "replacement_characters"), ("A sentence with a \x01 control sign in it.", "control_characters"),
        ("A paragraph of words <div>with markup</div> in it.", "html_residue"), ("Posts tagged with words of any kind here", "template_residue"),
        ("A sentence with Ã© broken letters in it.", "mojibake"), ("a1" * 40, "encoded_blob"), ("word " + "h" * 30 + " and more words", "mechanical_repetition"),
        ("12 + 34 = 46; 56 / 7 = 8; 1, 2, 3, 4.", "numeric_symbol_dominance"), ("see https://a.example/some/long/address/of/a/page", "url_email_dominance"),
        ("casino words and casino words again here", "keyword_stuffing"), ("A perfectly ordinary sentence about a harbour.", None),
    ],
)
def test_cleaning_cascade(spark, text, reason):
    assert one(spark, text, X.clean_reason(F.col("t")).alias("r")).r == reason


def test_scripts_and_estimates(spark):
    t, tag = F.col("t"), F.col("l")
    assert one(spark, "abc漢字かなカナ한글", X.script_counts(t).alias("s")).s.asDict() == {"latin": 3, "hiragana": 2, "katakana": 2, "hangul": 2, "han": 2}
    row = one(spark, "ab", X.wrong_script(t, tag).alias("a"), X.wrong_script_dominates(t, tag).alias("b"), X.token_estimate(t).alias("n"))
    assert (row.a, row.b, row.n) == (True, False, 1)  # short text fails the one rule and passes the other
    row = one(spark, "漢字漢字漢字", X.wrong_script_dominates(t, tag).alias("b"), X.token_estimate(t).alias("n"), X.script_ratio(t, tag).alias("r"))
    assert (row.b, row.n, row.r) == (True, 4, 0.0)
    assert one(spark, "唔好嘅", X.cantonese(t).alias("c")).c and not one(spark, "唔唔唔", X.cantonese(t).alias("c")).c
    assert one(spark, " a　 b\t", X.collapse(t).alias("c")).c == "a b"


def test_segments_keep_all_text(spark):
    text = "One sentence. " * 60 + "\n&lt;b&gt; &amp; more\n\n" + "字" * 900
    units = clean.cut_units(text, 200, 400)
    assert all(len(u) <= 200 and len(u.encode()) <= 400 for u in units)
    assert "".join("".join(units).split()) == "".join(("One sentence. " * 60 + "<b> & more" + "字" * 900).split())
    frame = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string")
    assert clean.bounded_segments(frame, "text", most=200, most_bytes=400).groupBy("id").count().count() == 3


def test_output_reasons(spark):
    def reasons(source, target, tag="zho_Hans", finish="stop"):
        row = one(spark, source, clean.output_reasons(F.col("t"), F.lit(target), F.lit(tag), F.lit(finish)).alias("r"))
        return row.r

    assert reasons("The harbour is old.", "港口很旧。") == []
    assert reasons("The harbour is old.", "") == ["empty_output", "output_too_short"]
    assert "source_copy" in reasons("The harbour", "the  harbour") and "source_copy" not in reasons("山上有人家", "山上有人家", "zho_Hant")
    assert reasons("Dear {name}, the harbour", "译文：港口", finish="length") == ["extra_explanation", "truncated", "placeholder_mismatch"]
    assert "traditional_output_for_simplified_target" in reasons("The harbour is old.", "港口記錄")
    assert "abnormal_repetition" in reasons("The harbour is old.", "港口很旧港口很旧港口很旧")


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(max_size=6), min_size=1, max_size=8))
def test_hash_splits(spark, keys):
    import hashlib

    rows = spark.createDataFrame([(k,) for k in keys], "k string").select("k", I.hash_mod(I.sha(F.col("k")), 16521).alias("m"), I.hash_below(I.sha(F.col("k")), 0.25).alias("b")).collect()
    for row in rows:
        digest = hashlib.sha256(row.k.encode()).hexdigest()
        assert row.m == int(digest, 16) % 16521 and row.b == (int(digest[:16], 16) < int(0.25 * 2**64))


def test_components_of_chains_and_hubs(spark):
    edges = [(f"r{i}", f"e{i + j:04d}") for i in range(200) for j in (0, 1)] + [("hub", f"x{i:04d}") for i in range(500)] + [(None, "n"), ("solo", "y")]
    got = {r.entity: r.component for r in components(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()}
    assert len(got) == 201 + 500 + 1 and {v for k, v in got.items() if k[0] == "e"} == {"e0000"} and {v for k, v in got.items() if k[0] == "x"} == {"x0000"}
    assert components(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


def test_shares_are_a_fixed_point():
    keep = select.capped_shares({"a": 100, "t": 90, "l": 90}, {"t": 0.15, "l": 0.20})
    total = sum(keep.values())
    assert keep["a"] == 100 and keep["t"] <= 0.15 * total and keep["l"] <= 0.20 * total and keep["t"] + 2 > 0.15 * total - 1
    assert select.capped_shares({"t": 5}, {"t": 0.5}) == {"t": 0}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=5), st.integers(0, 60))
def test_smooth_shares_add_up(weights, draws):
    names = {str(i): w for i, w in enumerate(weights)}
    drawn = select.smooth_shares(names, draws)
    assert sum(drawn.values()) == draws and all(abs(drawn[n] - draws * w / sum(weights)) < len(weights) for n, w in names.items())


def test_greedy_fill_skips_and_batches_reset(spark):
    rows = [("g", i, n) for i, n in enumerate([50, 60, 30, 100, 20, 1])] + [("h", 0, None), ("h", 1, 7)]
    frame = spark.createDataFrame(rows, "g string, i long, n long")
    assert sorted((r.g, r.i) for r in select.greedy_fill(frame, "g", "i", "n", 100).collect()) == [("g", 0), ("g", 2), ("g", 4), ("h", 1)]
    got = {(r.g, r.i): r.batch for r in select.token_batches(frame, "g", "i", "n", most_rows=3, most_tokens=110).collect()}
    assert [got["g", i] for i in range(6)] == [0, 0, 1, 2, 3, 3] and got["h", 1] == 0
    assert select.greedy_fill(frame.limit(0), "g", "i", "n", 100).count() == 0


def test_band_pairs_find_what_brute_force_finds(spark):
    random.seed(3)
    words = "harbour court festival budget driver library filter old quiet narrow damp".split()
    texts = {" ".join(random.choice(words) for _ in range(12)) for _ in range(60)}
    texts |= {t[:-1] + "z" for t in list(texts)[:30]} | {t + " x" for t in list(texts)[:30]}
    rows = [(i, "en", t) for i, t in enumerate(sorted(texts))]
    frame = spark.createDataFrame(rows, "id long, l string, t string")
    grams = {i: {f"^{t}$"[j : j + 3] for j in range(len(t))} for i, _, t in rows}
    want = {(a, b) for a in grams for b in grams if a < b and len(grams[a] & grams[b]) >= 0.82 * len(grams[a] | grams[b])}
    pairs = dedup.band_pairs(frame, "id", ["l"], "t")
    assert {(r.left_id, r.right_id) for r in pairs.collect()} == want
    classes = {r.id: (r.class_id, r.links) for r in dedup.linked_classes(pairs, frame, "id").collect()}
    assert len(classes) == len(rows) and sum(n for _, n in classes.values()) == 2 * len(want)


def test_greedy_near_duplicates_match_one_pass(spark):
    random.seed(6)
    base = [" ".join(random.choice("abcdefgh") * 3 for _ in range(60)) for _ in range(12)]
    texts = [random.choice(base) for _ in range(40)]
    texts = [t if random.random() < 0.4 else t + " tail" * random.randint(1, 2) for t in texts]
    rows = [(i, "en", t) for i, t in enumerate(texts)] + [(99, "en", None)]
    frame = spark.createDataFrame(rows, "id long, l string, t string")
    got = {r.id: r.verdict for r in dedup.greedy_near_duplicates(frame, "id", "l", "t").collect()}
    seen, owners, want = set(), {}, {}
    for i, _, t in rows[:-1]:
        if t in seen:
            want[i] = "exact"
            continue
        sig = dedup.one_permutation_minhash(t)
        keys = [(b, tuple(sig[b * 8 : b * 8 + 8])) for b in range(4)]
        if any(k in owners and dedup.minhash_similarity(sig, owners[k]) >= 0.9 for k in keys):
            want[i] = "near"
            continue
        seen.add(t)
        for k in keys:
            owners.setdefault(k, sig)
        want[i] = "kept"
    assert got == want and set(want.values()) >= {"exact", "kept"}


def test_long_near_copies_are_found(spark):
    random.seed(12)
    texts = ["".join(random.choice("abcdefghij klmnop") for _ in range(n)) for n in (700, 1500, 3000, 6000) for _ in range(5)]
    copies = [t[:20] + "xyz" + t[20:] for t in texts]
    frame = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts + copies)], "id long, l string, t string")
    got = {r.id: r.verdict for r in dedup.greedy_near_duplicates(frame, "id", "l", "t").collect()}
    assert [got[i] for i in range(20)] == ["kept"] * 20 and [got[i] for i in range(20, 40)].count("near") == 20
    capped = [dedup.minhash_similarity(*(dedup.one_permutation_minhash(t, most=512) for t in pair)) >= 0.9 for pair in zip(texts, copies, strict=True)]
    assert sum(capped) < 5  # the parity form loses them


def test_quantile_rules(spark):
    import math

    random.seed(2)
    values = [random.randint(0, 50) for _ in range(101)]
    frame = spark.createDataFrame([("g", v) for v in values] + [("g", None), ("h", 4)], "g string, v int")
    for rule, index in (("truncate", math.floor), ("even", round)):
        row = summary.at_index(frame, ["g"], "v", {"a": 0.35, "b": 0.985}, rule).where("g = 'g'").first()
        assert (row.a, row.b) == tuple(sorted(values)[index((len(values) - 1) * p)] for p in (0.35, 0.985))


def test_scores(spark):
    pairs = [("the quiet harbour, in 1.5 km", "the quiet harbour in 1.5 km."), ("港口很旧。", "港口很旧了。"), ("", "something"), ("abc", "xyz"), ("a &amp; b", "")]
    frame = spark.createDataFrame([("r", a, b) for a, b in pairs] + [("n", None, None)], "g string, a string, b string")
    for tokens, order in (("13a", 0), ("char", 2), ("char", 0)):
        got = {r.g: (r.bleu, r.chrf) for r in summary.corpus_scores(frame, "g", "a", "b", tokens=tokens, word_order=order).collect()}
        assert got["r"] == pytest.approx(summary.scores_of(pairs, tokens, order)) and got["n"] == (0.0, 0.0)
    same = spark.createDataFrame([("r", a, a) for a, _ in pairs], "g string, a string, b string")
    assert summary.corpus_scores(same, "g", "a", "b").first().bleu == pytest.approx(100)


def test_published_score_definitions():
    assert summary.bleu_tokens("It's 1,000.5 (ca. 3-4) &quot;x&quot;, ok-ay.", "13a") == ["It's", "1,000.5", "(", "ca", ".", "3", "-", "4", ")", '"', "x", '"', ",", "ok-ay", "."]
    assert summary.word_pieces('"Well," he said...') == ['"Well,', '"', "he", "said..", "."]
    # One match of four words, none of longer n-grams: precisions 25, 100 / (2 * 3), 100 / (4 * 2), 100 / (8 * 1).
    bleu, _ = summary.scores_of([("a x y z", "a b c d")])
    assert bleu == pytest.approx((25 * (100 / 6) * (100 / 8) * (100 / 8)) ** 0.25)
    assert summary.scores_of([("a", "a b")])[0] == pytest.approx(100 * math.exp(-1))  # effective order and brevity
    # chrF averages precisions and recalls over the orders before it joins them.
    _, chrf = summary.scores_of([("ab", "abc")])
    p, r = (1 + 1) / 2, (2 / 3 + 1 / 2) / 2
    assert chrf == pytest.approx(100 * 5 * p * r / (4 * p + r))


def test_gates_and_assertions(spark):
    frame = spark.createDataFrame([("a", 1.0), ("b", 0.2), ("c", None)], "k string, v double")
    checks = {"high": F.col("v") >= 0.5}
    assert sorted(map(tuple, summary.gates(frame, "k", checks).collect())) == [("b", "high"), ("c", "high")]
    assert [tuple(r) for r in summary.assertions(frame, checks).collect()] == [("high", 2)]


def test_pairs_and_relations(spark):
    rows = [(" K1", "eng_Latn", "train", "The harbour is old."), ("k1", "zho_Hans", "train", "港口很旧。"), ("k2", "eng_Latn", "dev", "<b>x</b> harbour"), (None, "eng_Latn", "dev", "x")]
    frame = spark.createDataFrame(rows, "alignment_key string, lang string, split string, text string")
    got = {(r.key, r.source, r.target): r.reason for r in parallel.pair_samples(parallel.locale_states(frame)).collect()}
    assert len(got) == 20 and got["k1", "eng_Latn", "zho_Hans"] is None and got["k2", "eng_Latn", "zho_Hans"] == "eng_Latn:html_residue"
    assert got["k1", "eng_Latn", "jpn_Jpan"] == "jpn_Jpan:missing"
    both = parallel.both_directions(spark.createDataFrame([("a", "b", "x")], "s string, t string, g string"), {"s": "t"})
    assert sorted((r.direction, r.s, r.t) for r in both.collect()) == [("forward", "a", "b"), ("reverse", "b", "a")]
    assert parallel.relation_faults(both.withColumn("split", F.lit("x")), ["g"], "s", "t", "split").count() == 0
    assert parallel.relation_faults(both.limit(1).withColumn("split", F.lit("x")), ["g"], "s", "t", "split").count() == 1


def test_ranked_numbers_groups_of_any_size(spark):
    random.seed(8)
    rows = [(random.choice(["a", "a", "a", "b", None]), i, f"v{i}") for i in random.sample(range(1000), 400)]
    frame = spark.createDataFrame(rows, "g string, o long, v string").repartition(5)
    got = {(r.g, r.o): r.position for r in select.ranked(frame, "g", ["o"]).collect()}
    for group in ("a", "b", None):
        assert [got[group, o] for o in sorted(o for g, o, _ in rows if g == group)] == list(range(sum(g == group for g, _, _ in rows)))


def test_first_of_a_near_identity_wins(spark):
    rows = [(3, "n", "x"), (1, "n", "y"), (2, "n", "y"), (5, "m", "z")]
    frame = spark.createDataFrame(rows, "id long, near string, exact string")
    got = {r.id: r.duplicate for r in select.exact_or_near_first(frame, "near", "exact", "id").collect()}
    assert got == {1: None, 2: "exact_duplicate", 3: "near_duplicate", 5: None}


def test_merge_rounds_has_bounded_fan_in(spark):
    from textloom.operators.merge import merge_rounds

    def add(blobs):
        assert len(blobs) <= 3
        return str(sum(map(int, blobs))).encode()

    rows = spark.createDataFrame([(k, p, str(p).encode()) for k in range(2) for p in range(40) if p % 3 or k], "k int, part int, blob binary")
    got = {r.k: int(r.blob) for r in merge_rounds(rows, ["k"], add, 40, fan=3).collect()}
    assert got == {0: sum(p for p in range(40) if p % 3), 1: sum(range(40))}
    whole = merge_rounds(rows.where("k = 1").select("part", "blob"), [], add, 40, fan=3).collect()
    assert [int(r.blob) for r in whole] == [sum(range(40))]
    assert merge_rounds(rows.limit(0), ["k"], add, 1).count() == 0


def test_greedy_disjoint_is_the_scan(spark):
    random.seed(6)
    rows = [(i, [random.choice("abcdefghijklmnop") + random.choice("xyz") if random.random() > 0.05 else None for _ in range(random.randint(0, 3))]) for i in range(150)]
    order = {i: random.random() for i, _ in rows}
    frame = spark.createDataFrame([(i, c, order[i]) for i, c in rows], "id long, c array<string>, o double")
    for start in ([], ["ax", "by", "cz"]):
        used, want = set(start), set()
        for i, claims in sorted(rows, key=lambda r: order[r[0]]):
            mine = {c for c in claims if c}
            if not mine & used:
                want.add(i)
                used |= mine
        before = spark.createDataFrame([(c,) for c in start], "claim string")
        got = select.greedy_disjoint(frame, "id", F.col("o"), F.col("c"), used=before)
        assert {r.id for r in got.collect()} == want and got.columns == frame.columns
    assert select.greedy_disjoint(frame.limit(0), "id", F.col("o"), F.col("c")).count() == 0

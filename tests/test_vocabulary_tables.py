import os
import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import dedup, sampler
from textloom.operators import vocabulary as V
from textloom.plans.vocabulary import TOKENIZER

needs_tokenizer = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer file")


def faults(spark, ids, **more):
    given = {"fixed": {"<s>": 0, "<unk>": 3}, "languages": ["eng_Latn", "kor_Hang"], "removed": ["old"], "size": 7} | more
    return {r.check: r.violations for r in V.vocabulary_faults(V.vocabulary_table(spark, ids), **given).collect() if r.violations}


def test_vocabulary_faults(spark):
    sound = {"<s>": 0, "</s>": 1, "<pad>": 2, "<unk>": 3, "eng_Latn": 4, "kor_Hang": 5, "a": 6}
    assert faults(spark, sound) == {}
    assert faults(spark, sound | {"a": 9}) == {"gaps": 3}
    assert faults(spark, sound | {"a": 5}) == {"repeated_ids": 1} and faults(spark, sound | {"old": 7}) == {"removed_tokens": 1, "size": 1}
    assert faults(spark, sound | {"<unk>": 6, "a": 3}) == {"special_ids": 1}
    assert set(faults(spark, {k: v for k, v in sound.items() if k != "kor_Hang"})) == {"gaps", "missing_languages", "size"}
    table = V.vocabulary_table(spark, sound)
    ids = V.language_ids(table, ["eng_Latn", "kor_Hang"])
    assert ids == {"eng_Latn": 4, "kor_Hang": 5} and V.forced_start(ids, "kor_Hang") == 5
    for call in (lambda: V.language_ids(table, ["zho_Hans"]), lambda: V.forced_start(ids, "zho_Hans"), lambda: V.Allowlist([])):
        with pytest.raises(ValueError):
            call()
    assert V.ordered_differences(table, table).count() == 0
    assert [r.id for r in V.ordered_differences(table, V.vocabulary_table(spark, sound | {"a": 7})).orderBy("id").collect()] == [6, 7]


def test_alphabet_limit():
    assert V.alphabet_limit(64_000, 30_000) == 32_048 and V.alphabet_limit(64_000, 30_000, 30_500) == 30_500
    assert V.alphabet_limit(2_000, 1_500) == 2_000 - 10 - 250
    for given in ((1_000, 990), (64_000, 30_000, 29_999), (64_000, 30_000, 63_500)):
        with pytest.raises(ValueError):
            V.alphabet_limit(*given)


def test_parameters():
    assert V.parameters(width=4, inner=8, vocabulary=10, encoder=2, decoder=1)["total"] == 40 + 2 * (64 + 64) + (128 + 64)


@needs_tokenizer
def test_evaluation_and_caches(spark):
    rows = [("eng_Latn", "The harbour is old."), ("kor_Hang", "항구가 낡았다 🙂"), ("eng_Latn", ""), ("eng_Latn", None)]
    frame = spark.createDataFrame(rows, "language string, text string")
    got = V.evaluate_texts(frame, ["language"], "text", TOKENIZER).collect()
    assert len(got) == 3 and all(r.exact and r.unknown_tokens == 0 for r in got) and {r.characters for r in got} == {19, 9, 0}
    summary = V.evaluation_summary(V.evaluate_texts(frame, ["language"], "text", TOKENIZER), "language")
    assert {r.language: (r.texts, r.exact) for r in V.coverage_summary(summary, "language", ["eng_Latn", "kor_Hang"]).collect()} == {"eng_Latn": (2, 2), "kor_Hang": (1, 1)}
    with pytest.raises(ValueError):
        V.coverage_summary(summary, "language", ["eng_Latn", "zho_Hans"])
    assert V.covered(TOKENIZER, "字")
    pairs = spark.createDataFrame([("1", "eng_Latn", "kor_Hang", "The harbour", "항구"), ("2", "eng_Latn", "kor_Hang", "The harbour", "낡은 항구")], "id string, source_language string, target_language string, source_text string, target_text string")
    keys = V.text_keys(pairs)
    cache = V.encode_once(keys, TOKENIZER)
    assert keys.count() == 3 and V.cache_identity(keys, "t", ["a", "b"]) == V.cache_identity(keys.repartition(3), "t", ["b", "a"]) != V.cache_identity(keys.limit(2), "t", ["a", "b"])
    out = {r.id: r for r in V.encode_pairs(pairs, cache, most_source=4, most_target=4, start={"eng_Latn": 70_000, "kor_Hang": 70_001}, end=70_002).collect()}
    assert out["1"].source_ids[0] == 70_000 and out["1"].source_ids[-1] == 70_002 and len(out["2"].target_ids) == 4 and out["2"].target_cut
    with pytest.raises(Exception, match="no encoding"):
        V.encode_pairs(pairs, cache.where("language = 'eng_Latn'"), most_source=4, most_target=4).collect()
    with pytest.raises(ValueError):
        V.merge_caches(cache, cache)
    assert V.merge_caches(cache.where("language = 'eng_Latn'"), cache.where("language = 'kor_Hang'")).count() == 3


def test_feed(spark):
    frame = spark.createDataFrame([("a b a",), (" b　c ",), (None,), ("",)], "text string")
    feed = V.word_feed(frame, "text")
    assert {r.word: r.occurrences for r in feed.collect()} == {"▁a": 2, "▁b": 2, "▁c": 1}
    state = V.feed_state(feed)
    assert (state["words"], state["occurrences"]) == (3, 5) and state == V.feed_state(feed.repartition(3)) != V.feed_state(feed.where("word <> '▁c'"))
    assert V.feed_state(feed.limit(0))["words"] == 0


def reference_draws(records, weights, seed, count):
    from hashlib import sha256

    total, score, nth, out = sum(weights.values()), dict.fromkeys(weights, 0), dict.fromkeys(weights, 0), []
    for draw in range(count):
        for name in weights:
            score[name] += weights[name]
        best = max(weights, key=lambda n: (score[n], -list(weights).index(n)))
        score[best] -= total
        held = records[best]
        epoch, place = divmod(nth[best], len(held))
        nth[best] += 1
        order = sorted(held, key=lambda k: (sha256(f"{seed}\0{epoch}\0{k}".encode()).hexdigest(), k))
        out.append((draw, best, epoch, place, order[place]))
    return out


def test_draws_go_on_where_they_stopped(spark):
    records = {"a": [f"a{i}" for i in range(7)], "b": [f"b{i}" for i in range(3)], "c": ["c0"]}
    frame = spark.createDataFrame([(r, k) for r, ks in records.items() for k in ks] + [("a", None), (None, "x")], "route string, sample string")
    weights = {"a": 4, "b": 2, "c": 2}
    want = reference_draws(records, weights, "s", 90)
    take = lambda start, count: sorted(map(tuple, sampler.draws(frame, route="route", key="sample", weights=weights, seed="s", start=start, count=count).collect()))
    assert take(0, 90) == want and take(37, 20) == want[37:57] and take(5, 0) == []
    state = sampler.SamplerState(sampler.sampler_identity("d", weights, "s")).advanced(37)
    assert state.resumed(sampler.sampler_identity("d", weights, "s")).drawn == 37
    with pytest.raises(ValueError):
        state.resumed(sampler.sampler_identity("d", weights | {"c": 1}, "s"))
    with pytest.raises(ValueError):
        sampler.turns({"a": 0})
    drawn = sampler.draws(frame, route="route", key="sample", weights=weights, seed="s", start=0, count=48)
    whole = {tuple(r) for r in sampler.bucketed(drawn, F.substring("sample", 2, 1).cast("int"), batch=4, pool=3).select("batch", "draw").collect()}
    assert {b for b, _ in whole} == set(range(12)) and all(sum(x == b for x, _ in whole) == 4 for b in range(12))
    later = sampler.draws(frame, route="route", key="sample", weights=weights, seed="s", start=24, count=24)
    assert {tuple(r) for r in sampler.bucketed(later, F.substring("sample", 2, 1).cast("int"), batch=4, pool=3).select("batch", "draw").collect()} == {x for x in whole if x[0] >= 6}


def test_packed_signatures():
    random.seed(2)
    for _ in range(50):
        a, b = ([random.choice([-1, 5, 9, (1 << 127) + 3]) for _ in range(8)] for _ in range(2))
        assert dedup.packed_similarity(dedup.pack_minhash(a), dedup.pack_minhash(b)) == pytest.approx(dedup.minhash_similarity(a, b))
        assert all(0 <= k < 1 << 96 for k in dedup.bucket_keys(a, 4))
    assert dedup.packed_similarity(b"", b"") == 1.0
    with pytest.raises(ValueError):
        dedup.packed_similarity(bytes(16), bytes(32))


def test_signatures_of_many_texts(monkeypatch):
    random.seed(9)
    texts = ["", None, "abcd", "abcde", "  a  b   c d e f "] + ["".join(random.choice("ab学 ") for _ in range(random.randint(0, 200))) for _ in range(60)]
    want = [dedup.pack_minhash(dedup.one_permutation_minhash(t or "")) for t in texts]
    assert dedup.packed_signatures(texts) == want and dedup.packed_signatures(texts[:2]) == want[:2] and dedup.packed_signatures([]) == []


def test_command_line(capsys):
    from textloom.__main__ import arguments, main

    assert arguments(["run", "script_ratio", "/x", "--explain"]).query == "script_ratio"
    with pytest.raises(SystemExit):
        arguments(["run", "no_such_query", "/x"])
    main(["list"])
    assert "clean_reason_counts" in capsys.readouterr().out

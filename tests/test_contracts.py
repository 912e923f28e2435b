import json

import pytest

from textloom.functions import contract as C
from textloom.plans import registry
from textloom.plans.explain import dry_run
from textloom.sources import readers as R

DATA = "/root/testdata/sf0.001"


def test_contracts_report_every_breach():
    good = [{"reference_id": "a", "kind": "mt", "policy": "block", "match_mode": "exact", "path": "p", "sha256": "0" * 64}]
    C.check(good, C.REFERENCE_SETS)
    assert C.complete(good, {"mt"}) and not C.complete(good, {"mt", "web"})
    bad = [dict(good[0], policy="maybe", extra=1), dict(good[0], sha256="xyz")]
    with pytest.raises(C.ContractError) as caught:
        C.check(bad, C.REFERENCE_SETS)
    assert set(caught.value.faults) == {"config[0].extra: unknown", "config[0].policy: out of range", "config[1].sha256: out of range"}
    with pytest.raises(C.ContractError):
        C.check(good * 2, C.REFERENCE_SETS)
    assert C.faults({"least_characters": True}, C.mapping(least_characters=C.positive())) == ["config.least_characters: bool"]


def test_dry_run_shows_pruned_scans(spark):
    plan = dry_run(registry.queries()["token_estimates"](spark, DATA))
    assert plan["scans"][0]["columns"] == ["text", "lang"] and "IsNotNull(text)" in plan["scans"][0]["filters"] and plan["exchanges"] == 1
    for name in ("pair_samples", "cohort_match", "contamination_sentences", "shingle_jaccard_pairs", "isolation_overlaps"):
        assert dry_run(registry.queries()[name](spark, DATA))["cartesian"] == 0


def test_files_and_builds(spark, tmp_path):
    for build, body in (("a", "one"), ("b", "two")):
        (tmp_path / build).mkdir()
        (tmp_path / build / "x").write_text("same")
        (tmp_path / build / "y").write_text(body)
    assert [r.name for r in R.compare_builds(spark, str(tmp_path / "a"), str(tmp_path / "b")).collect()] == ["y"]
    assert R.compare_builds(spark, str(tmp_path / "a"), str(tmp_path / "a")).count() == 0
    one = R.file_identities(spark, str(tmp_path / "a" / "x")).first()
    got = dict(map(tuple, R.verify_files(spark, str(tmp_path / "a"), {"x": (4, one.sha256), "y": (3, "0" * 64), "z": (1, "0" * 64)}).collect()))
    assert got == {"x": "equal", "y": "differs", "z": "missing"}


def test_parallel_laws(spark, tmp_path):
    def law(name, articles):
        (tmp_path / name).write_text(json.dumps({"Laws": [{"LawName": "L", "LawURL": "u?pcode=B2", "LawArticles": [{"ArticleType": k, "ArticleNo": str(i), "ArticleContent": t} for i, (k, t) in enumerate(articles)]}]}))
        return R.read_laws(spark, str(tmp_path / name))

    left = law("zh.json", [("A", "甲。"), ("A", "乙。丙。"), ("C", "丁。"), ("A", "戊。")])
    right = law("en.json", [("A", "One!"), ("A", "Two!"), ("C", "Three!"), ("A", "Four? Five!")])
    assert [(r.article, r.left_text, r.right_text) for r in R.parallel_laws(left, right).collect()] == [(0, "甲。", "One!")]

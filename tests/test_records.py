import hashlib
import json

import pytest
from pyspark.sql import functions as F

from textloom.sources import records as R

ROUTES = [("eng_Latn", "zho_Hans"), ("zho_Hans", "eng_Latn")]


def sample(i, **other):
    base = {"sample_id": f"s{i}", "sample_group_id": f"g{i}", "src_lang": "eng_Latn", "tgt_lang": "zho_Hans", "source_text": f"text {i}", "target_text": f"文 {i}", "split": "train"}
    return json.dumps(base | other, ensure_ascii=False)


def identity(path):
    body = path.read_bytes()
    return {"path": path.name, "bytes": len(body), "sha256": hashlib.sha256(body).hexdigest()}


def test_objects(spark, tmp_path):
    good = tmp_path / "a.jsonl"
    good.write_text('{"a": 1}\n\n{"a": 2, "b": "x"}\n')
    assert [(r.line, r.a) for r in R.typed(R.read_objects(spark, str(good)), "a int").orderBy("line").collect()] == [(1, 1), (3, 2)]
    for body in ("[1]\n", '{"a": \n'):
        (tmp_path / "b.jsonl").write_text(body)
        with pytest.raises(Exception, match="no (object|JSON)"):
            R.read_objects(spark, str(tmp_path / "b.jsonl")).collect()
    (tmp_path / "o.json").write_text('{"x": 1}')
    assert R.read_object(str(tmp_path / "o.json")) == {"x": 1}


def test_readers_pass_on_bounded_batches(spark, tmp_path, monkeypatch):
    (tmp_path / "many.jsonl").write_text("\n".join(f'{{"a": {i}}}' for i in range(10_000)))
    assert R.read_objects(spark, str(tmp_path / "many.jsonl")).agg(F.max("line"), F.count("*")).first()[:] == (10_000, 10_000)


def test_parallel_objects_keep_their_contract(spark, tmp_path):
    path = tmp_path / "p.jsonl"
    path.write_text("\n".join(sample(i) for i in range(5)))
    digest = identity(path)["sha256"]
    assert R.read_parallel_objects(spark, str(path), split="train", routes=ROUTES, sha256=digest).count() == 5
    with pytest.raises(R.InputError):
        R.read_parallel_objects(spark, str(path), split="train", routes=ROUTES, sha256="0" * 64)
    for other in ({"split": "dev"}, {"tgt_lang": "kor_Hang"}, {"source_text": ""}, {"sample_group_id": None}):
        path.write_text("\n".join([sample(1), sample(2, **other)]))
        with pytest.raises(Exception, match="broken"):
            R.read_parallel_objects(spark, str(path), split="train", routes=ROUTES).collect()
    path.write_text("\n")
    with pytest.raises(R.InputError):
        R.read_parallel_objects(spark, str(path), split="train", routes=ROUTES)


def test_sample_and_contract(spark, tmp_path):
    path = tmp_path / "p.jsonl"
    path.write_text("\n".join(sample(i) for i in range(9)))
    given = dict(split="train", routes=ROUTES, sha256=identity(path)["sha256"], seed="x", per_route=4, settings={"temperature": 0})
    rows, contract = R.prepare_inputs(spark, str(path), **given)
    again, same = R.prepare_inputs(spark, str(path), **given)
    assert rows.count() == 4 and rows.select("sample_id").collect() == again.select("sample_id").collect() and contract == same
    assert R.prepare_inputs(spark, str(path), **(given | {"seed": "y"}))[1] != contract


def test_manifests_of_references(spark, tmp_path):
    (tmp_path / "t.txt").write_text("first\n\nsecond\n")
    (tmp_path / "j.jsonl").write_text('{"text": "third"}\n')
    text, objects = identity(tmp_path / "t.txt"), identity(tmp_path / "j.jsonl")
    (tmp_path / "lines.jsonl").write_text(json.dumps({"language": "eng_Latn", "file": "t.txt", "bytes": text["bytes"], "sha256": text["sha256"]}))
    (tmp_path / "map.json").write_text(json.dumps({"files": {"kor_Hang": objects}}))
    locked = {"bytes": text["bytes"], "format": "text-lines", "language": "eng_Latn", "path": "t.txt", "records": 2, "sha256": text["sha256"], "split": "dev"}
    (tmp_path / "locked.json").write_text(json.dumps({"status": "complete", "usage": "evaluation", "files": [locked]}))
    files = R.manifest_files(str(tmp_path / "lines.jsonl"), R.LINE_MANIFEST) + R.manifest_files(str(tmp_path / "map.json"), R.MAP_MANIFEST)
    rows = R.read_verified_references(spark, files, "held").collect()
    assert sorted((r.language, r.record_id, r.text) for r in rows) == [("eng_Latn", "t.txt:1", "first"), ("eng_Latn", "t.txt:3", "second"), ("kor_Hang", "j.jsonl:1", "third")]
    assert R.manifest_files(str(tmp_path / "locked.json"), R.LOCKED_MANIFEST, usage="evaluation") == [f for f in files if f["name"] == "t.txt"]
    with pytest.raises(R.InputError):
        R.manifest_files(str(tmp_path / "locked.json"), R.LOCKED_MANIFEST, usage="training")
    for field, value in (("path", "../t.txt"), ("records", 0), ("sha256", "x"), ("format", "csv")):
        (tmp_path / "locked.json").write_text(json.dumps({"status": "complete", "files": [locked | {field: value}]}))
        with pytest.raises(R.InputError):
            R.manifest_files(str(tmp_path / "locked.json"), R.LOCKED_MANIFEST)
    with pytest.raises(Exception, match="stated identity"):
        R.read_verified_references(spark, [files[0] | {"bytes": 1}], "held").collect()


def test_published_folders(spark, tmp_path):
    (tmp_path / "train.jsonl").write_text('{"id": "a"}\n{"id": "b"}\n')
    (tmp_path / "dev.jsonl").write_text('{"id": "c"}\n')
    files = {n: identity(tmp_path / f"{n}.jsonl") | {"records": k} for n, k in (("train", 2), ("dev", 1))}
    manifest = {"status": "complete", "identity": {"seed": 1}, "files": files}
    (tmp_path / "manifest.json").write_text(json.dumps(manifest))
    assert sorted((r.split, r.id) for r in R.load_finalized(spark, str(tmp_path), "id string").collect()) == [("dev", "c"), ("train", "a"), ("train", "b")]
    assert R.load_sample_set(spark, str(tmp_path), "id string", {"seed": 1}).count() == 3
    with pytest.raises(R.InputError):
        R.load_sample_set(spark, str(tmp_path), "id string", {"seed": 2})
    (tmp_path / "dev.jsonl").write_text('{"id": "d"}\n')
    with pytest.raises(R.InputError):
        R.load_finalized(spark, str(tmp_path), "id string")


def test_route_shards(spark, tmp_path):
    for route in ("a__b", "b__a"):
        (tmp_path / f"{route}.jsonl").write_text("\n".join(json.dumps({"route": route.replace("__", "->"), "split": "train", "id": i}) for i in range(3)))
    load = lambda routes, n: R.load_route_shards(spark, str(tmp_path), routes, "route string, split string, id int", records=n)
    assert load(["b->a", "a->b"], 3).groupBy("route_order", "route").count().orderBy("route_order").collect()[0].route == "b->a"
    for routes, n in ((["a->b"], 4), (["a->c"], 3)):
        with pytest.raises(R.InputError):
            load(routes, n)


def test_run_log_goes_on_after_a_crash(spark, tmp_path):
    path = str(tmp_path / "run.jsonl")
    with R.RunLog(path, every=2) as log:
        for i in range(3):
            log.append("step", loss=i / 2)
    with open(path, "ab") as out:
        out.write(b'{"sequence": 3, "ev')
    with R.RunLog(path) as log:
        assert log.sequence == 3
        log.append("end")
    assert [r.event for r in R.read_run_log(spark, path).orderBy("sequence").collect()] == ["step", "step", "step", "end"]
    with open(path, "ab") as out:
        out.write(b'{"sequence": 9, "event": "x"}\n')
    with pytest.raises(R.InputError):
        R.read_run_log(spark, path)


def test_configurations_differ_only_where_allowed():
    a, b = {"name": "x", "data": {"path": "p", "n": 1}}, {"name": "y", "data": {"path": "q", "n": 1}, "more": {}}
    assert R.differing_fields(a, b) == ["data.path", "more", "name"] and R.differing_fields(a, b, ["name", "data.path", "more"]) == []


def test_a_resumed_run_equals_the_whole_one(spark, tmp_path):
    whole, halves = str(tmp_path / "a"), str(tmp_path / "b")
    with R.RunLog(whole) as log:
        for i in range(6):
            log.append("step", loss=i * 0.5)
    for part in (range(3), range(3, 6)):
        with R.RunLog(halves) as log:
            log.append("start")
            for i in part:
                log.append("step", loss=i * 0.5)
    schema = "sequence long, event string, loss double"
    logs = [R.read_run_log(spark, p, schema) for p in (whole, halves)]
    assert R.log_differences(*logs, ["loss"], events=["step"]).count() == 0
    changed = logs[1].withColumn("loss", F.when(F.col("loss") == 2.0, 9.0).otherwise(F.col("loss")))
    assert [(r.place, r.first, r.second) for r in R.log_differences(logs[0], changed, ["loss"], events=["step"]).collect()] == [(5, '{"v":2.0}', '{"v":9.0}')]

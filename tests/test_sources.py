import hashlib
import io
import json
import tarfile
import zipfile

import pytest

from textloom.sources import readers as R
from textloom.sources import writers as Wr


def test_zst_prefix(spark, tmp_path):
    zstandard = pytest.importorskip("zstandard")
    lines = [json.dumps({"text": f"line {i}", "u": f"http://h/{i}"}) for i in range(2000)] + ["{broken", "[1]", '{"text": 3}']
    body = zstandard.ZstdCompressor().compress("\n".join(lines).encode())
    (tmp_path / "a.zst").write_bytes(body)
    rows = R.read_jsonl_zst(spark, str(tmp_path / "a.zst")).collect()
    assert len(rows) == 2001 and rows[0].text == "line 0" and rows[-1].text is None
    (tmp_path / "b.zst").write_bytes(body[: len(body) // 2])
    assert R.read_jsonl_zst(spark, str(tmp_path / "b.zst")).count() < 2001


def test_lists(spark, tmp_path):
    (tmp_path / "m").write_text("https://x/y/8_2.jsonl.zst\nhttps://x/y/9_1.jsonl.zst\nhttps://x/y/5_1.jsonl.zst\nhttps://x/readme\n")
    assert [(r.quality, r.shard) for r in R.read_shard_map(spark, str(tmp_path / "m"), 6, 10).collect()] == [(9, 1), (8, 2)]
    (tmp_path / "d").write_text(f"{'a' * 32}  dir/x\n# no\n")
    assert [tuple(r) for r in R.read_digest_list(spark, str(tmp_path / "d")).collect()] == [("a" * 32, "dir/x")]


def test_tar_members_are_verified(spark, tmp_path):
    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as out:
        for name, body in (("a.txt", b"one"), ("b.txt", b"two"), ("c.txt", b"three")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            out.addfile(info, io.BytesIO(body))
    lock = {"a.txt": (3, hashlib.sha256(b"one").hexdigest()), "b.txt": (3, "0" * 64)}
    got = {r.member: (bytes(r.body), r.ok) for r in R.read_tar_members(spark, str(tmp_path / "t.tar.gz"), lock).collect()}
    assert got == {"a.txt": (b"one", True), "b.txt": (b"two", False)}


def test_locales(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"id": "1", "partition": "train", "utt": "hi"}\n{"id": "1", "partition": "train", "utt": "ho"}\n')
    rows = R.read_locale_jsonl(spark, str(tmp_path / "l.jsonl"), "eng_Latn")
    assert rows.first().alignment_key == '{"id":"1","partition":"train"}'
    assert R.repeated_keys(rows, "lang", "alignment_key").first().records == 2
    (tmp_path / "bad.jsonl").write_text("{nope\n")
    with pytest.raises(Exception):
        R.read_locale_jsonl(spark, str(tmp_path / "bad.jsonl"), "eng_Latn").collect()


def test_archives_of_pages(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as out:
        out.writestr("a.xml", "<r><content>第一句。第二<b>句</b>！</content><x>no</x></r>")
        out.writestr("b.md", "---\ntitle: x\n---\n# 標題\n\n這是[連結](http://a)。English line.\n```\ncode\n```\n> 引文`x`在此。\n")
    assert [(r.ordinal, r.text) for r in R.read_zip_xml(spark, str(tmp_path / "z.zip")).collect()] == [(0, "第一句。"), (1, "第二句！")]
    assert [r.text for r in R.read_zip_markdown(spark, str(tmp_path / "z.zip")).collect()] == ["標題", "這是連結。", "引文在此。"]
    assert [r.text for r in R.read_zip_markdown(spark, str(tmp_path / "z.zip"), only_quotes=True).collect()] == ["引文在此。"]


def test_laws_and_treebanks(spark, tmp_path):
    laws = {"Laws": [{"LawName": "L", "LawURL": "http://l?pcode=A001&x", "LawArticles": [{"ArticleType": "A", "ArticleNo": "1", "ArticleContent": "甲乙。丙\n丁戊；"}]}]}
    (tmp_path / "l.json").write_text(json.dumps(laws))
    assert [(r.law, r.ordinal, r.text) for r in R.read_laws(spark, str(tmp_path / "l.json")).collect()] == [("a001", 0, "甲乙。"), ("a001", 2, "丁戊；")]
    (tmp_path / "t.conllu").write_text("# sent_id = 3\n# text = 你好\n1\tx\n\n# sent_id = 900\n# note\n# text = 法律\n1\ty\n")
    assert [tuple(r) for r in R.read_conllu(spark, str(tmp_path / "t.conllu")).collect()] == [("3", "你好", "dialogue"), ("900", "法律", "legal")]


def test_parallel_lines_and_references(spark, tmp_path):
    (tmp_path / "a").write_text("a\nb\nc\n")
    (tmp_path / "b").write_text("x\ny\n")
    got = {r.line: (r.left_text, r.right_text, r.unequal) for r in R.read_parallel_lines(spark, str(tmp_path / "a"), str(tmp_path / "b")).collect()}
    assert got == {1: ("a", "x", False), 2: ("b", "y", False), 3: ("c", None, True)}
    assert R.read_references(spark, str(tmp_path / "a"), "text").count() == 3
    assert R.file_identities(spark, str(tmp_path / "a")).first().sha256 == hashlib.sha256(b"a\nb\nc\n").hexdigest()


def test_snapshots(spark, tmp_path):
    records = [b"", b"one", "二".encode() * 100]
    (tmp_path / "s.bin").write_bytes(Wr.pack_records(records))
    assert [bytes(r.record) for r in R.read_snapshot(spark, str(tmp_path / "s.bin")).collect()] == records
    assert Wr.order_digest(records) != Wr.order_digest(records[::-1])
    for bad in (b"x" * 40, Wr.pack_records(records)[:-1], Wr.pack_records(records) + b"z"):
        with pytest.raises(Exception):
            list(R.unpack_records(bad))


def test_publication(spark, tmp_path):
    frame = spark.createDataFrame([(2, "b", None), (1, "a", "x")], "z int, a string, m string")
    assert [r.value for r in Wr.canonical_lines(frame).collect()] == ['{"a":"b","m":null,"z":2}', '{"a":"a","m":"x","z":1}']
    root = f"file://{tmp_path}"
    first = Wr.publish(frame, root, "t", ["z"])
    again = Wr.publish(frame.repartition(2), root, "t", ["z"])
    assert first == again == Wr.read_manifest(spark, root, "t") and first["records"] == 2
    blocked = Wr.publish(frame, root, "u", ["z"], gate=frame.where("z = 1"))
    assert blocked["status"] == "blocked" and not (tmp_path / "u").exists() and Wr.read_manifest(spark, root, "v") is None
    split = Wr.publish(frame, root, "w", ["z"], partitions=["a"])
    assert (tmp_path / "w" / "a=b").exists() and split["records"] == 2


def test_stages_are_bound_to_their_identity(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for identity in ({"v": 1}, {"v": 1}, {"v": 2}):
        assert Wr.stage(spark, f"file://{tmp_path}", "s", identity, build).count() == 3
    assert len(built) == 2


def test_directory(tmp_path):
    for body in (b"1", b"2"):
        Wr.publish_directory(str(tmp_path / "d"), {"a": body})
    assert (tmp_path / "d" / "a").read_bytes() == b"2" and json.loads((tmp_path / "d" / "manifest.json").read_text())["files"]["a"]["bytes"] == 1


def test_objects_in_one_file(spark, tmp_path):
    frame = spark.createDataFrame([(i, f"行 {i}") for i in range(1000)], "z int, a string").repartition(7)
    done = Wr.write_objects(frame, f"file://{tmp_path}/o.jsonl", ["z"])
    body = (tmp_path / "o.jsonl").read_bytes()
    assert done == {"bytes": len(body), "records": 1000, "sha256": hashlib.sha256(body).hexdigest()}
    assert [json.loads(line)["z"] for line in body.splitlines()] == list(range(1000)) and len(list(tmp_path.iterdir())) <= 2
    assert Wr.write_objects(frame.limit(0), f"file://{tmp_path}/o.jsonl", ["z"])["records"] == 0


def test_finalized_corpus_is_published_or_blocked(spark, tmp_path):
    from textloom.sources import records

    frame = spark.createDataFrame([("a", "train"), ("b", "train"), ("c", "dev")], "id string, split string")
    groups = spark.createDataFrame([("g",)], "group string")
    given = dict(split="split", splits=["train", "dev", "test"], order=["id"], groups=groups, report={"pairs": 3}, identity={"v": 1}, registry_complete=True)
    root = f"file://{tmp_path}"
    entry = Wr.publish_splits(frame, root, blocking=0, **given)
    assert entry["records"] == 3 and entry["files"]["test"]["records"] == 0
    assert sorted((r.split, r.id) for r in records.load_finalized(spark, f"{root}/finalized", "id string").collect()) == [("dev", "c"), ("train", "a"), ("train", "b")]
    for blocking, complete in ((2, True), (0, False)):
        with pytest.raises(Wr.Blocked):
            Wr.publish_splits(frame, root, blocking=blocking, **(given | {"registry_complete": complete}))
        assert not (tmp_path / "finalized" / "manifest.json").exists() and json.loads((tmp_path / "reports" / "blocked.json").read_text())["status"] == "blocked"
    Wr.publish_splits(frame, root, blocking=0, **given)
    assert not (tmp_path / "reports" / "blocked.json").exists()


def test_results_are_published_once(spark, tmp_path):
    frame = spark.createDataFrame([("s1", 0.5)], "id string, score double")
    entry = Wr.publish_results(frame, f"file://{tmp_path}/e", ["id"], {"bleu": 3.5}, {"data": "x"})
    assert set(entry["files"]) == {"samples.jsonl", "summary.json", "report.md"} and "| bleu | 3.5 |" in (tmp_path / "e" / "report.md").read_text()
    with pytest.raises(Wr.Blocked):
        Wr.publish_results(frame, f"file://{tmp_path}/e", ["id"], {}, {})


def test_transfer_checks_what_it_moves(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"one")
    digest = hashlib.sha256(b"one").hexdigest()
    with pytest.raises(ValueError):
        Wr.transfer(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/x/b", size=4, sha256=digest)
    Wr.transfer(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/x/b", size=3, sha256=digest)
    assert (tmp_path / "x" / "b").read_bytes() == b"one" and not (tmp_path / "a").exists()

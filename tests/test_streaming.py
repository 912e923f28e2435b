from pyspark.sql import functions as F

from textloom.streaming import pipelines as P


def stream(spark, path, rows, schema, files=2):
    frame = spark.createDataFrame(rows, schema)
    size = -(-len(rows) // files)
    for i in range(files):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def drain(frame, name, mode="append"):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return frame.sparkSession.table(name)


SCHEMA = "id long, ts timestamp, kind string, value double"


def rows(n):
    from datetime import datetime, timedelta

    return [(i, datetime(2024, 1, 1) + timedelta(seconds=20 * i), "ab"[i % 2], float(i)) for i in range(n)]


def test_windows_equal_a_batch(spark, tmp_path):
    data = rows(60)
    got = drain(P.windowed_counts(stream(spark, tmp_path / "a", data, SCHEMA), time="ts", key="kind", value="value", width="5 minutes", late="10 minutes"), "w", "complete")
    want = spark.createDataFrame(data, SCHEMA).groupBy(F.window("ts", "5 minutes").alias("w"), "kind").agg(F.count("*").alias("n"), F.sum("value").alias("t"))
    assert {(r.start, r.kind, r.events, r.total) for r in got.collect()} == {(r.w.start, r.kind, r.n, r.t) for r in want.collect()}


def test_sessions_and_first_wins(spark, tmp_path):
    data = rows(30)
    assert drain(P.session_counts(stream(spark, tmp_path / "a", data, SCHEMA), time="ts", key="kind", gap="1 minute", late="1 hour"), "s", "complete").count() == 2
    twice = [(i % 10, ts, k, v) for i, ts, k, v in data]
    assert drain(P.first_wins(stream(spark, tmp_path / "b", twice, SCHEMA), identity="id", time="ts", late="1 day"), "f").count() == 10


def test_online_buckets(spark, tmp_path):
    text = "the quiet harbour of the northern town was moved again before noon " * 4
    data = [(1, "b", text), (2, "b", text + "x"), (3, "b", "something else altogether, of another kind and length"), (4, "c", text)]
    frame = stream(spark, tmp_path / "a", data, "id long, bucket string, text string")
    got = {r.id: (r.owner, r.near) for r in drain(P.online_near_duplicates(frame, bucket="bucket", key="id", text="text"), "o").collect()}
    assert got == {1: ("1", False), 2: ("1", True), 3: ("1", False), 4: ("4", False)}


def test_journal_does_each_job_once(spark, tmp_path):
    data = [(i % 7, None, "a", 1.0) for i in range(20)]
    jobs = stream(spark, tmp_path / "a", data, SCHEMA, files=3)
    journal = f"file://{tmp_path}/journal"
    for attempt in ("c1", "c2"):  # the second run has lost its offsets and replays everything
        P.resume_journal(spark, jobs, journal, key="id", work=lambda r: r.select("id"), checkpoint=str(tmp_path / attempt)).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(journal).collect()) == list(range(7))


def test_top_of_a_stream(spark, tmp_path):
    data = rows(40)[::-1]
    top = f"file://{tmp_path}/top"
    P.merge_top(spark, stream(spark, tmp_path / "a", data, SCHEMA, files=4), top, order=["id"], size=5, checkpoint=str(tmp_path / "c")).awaitTermination()
    assert sorted(r.id for r in P.read_top(spark, top).collect()) == [0, 1, 2, 3, 4]
    versions = P._versions(spark, top)
    assert 1 <= len(versions) <= 2 and P.read_top(spark, f"file://{tmp_path}/none") is None
    (tmp_path / "top" / f"version={versions[-1] + 1}").mkdir()  # a batch that died before it was done
    assert P.read_top(spark, top).count() == 5


def test_forgotten_buckets(spark, tmp_path):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    data = [(1, "b", "x", start), (2, "c", "y", start + timedelta(days=9)), (3, "c", "y", start + timedelta(days=9, hours=1)), (4, "b", "x", start + timedelta(days=9, hours=2))]
    frame = stream(spark, tmp_path / "a", data, "id long, bucket string, text string, ts timestamp", files=4)
    found = P.online_near_duplicates(frame, bucket="bucket", key="id", text="text", time="ts", late="1 minute", forget_seconds=3600)
    assert {r.id: r.owner for r in drain(found, "z").collect()} == {1: "1", 2: "2", 3: "2", 4: "4"}

"""Structured Streaming counterparts of the batch operators that keep state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textloom.operators.dedup import minhash_similarity, one_permutation_minhash


def windowed_counts(events: DataFrame, *, time: str, key: str, value: str, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts and sums by event-time window and key; rows later than ``late`` are dropped."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    rows = events.withWatermark(time, late).groupBy(window.alias("w"), key).agg(F.count("*").alias("events"), F.sum(value).alias("total"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "events", "total")


def session_counts(events: DataFrame, *, time: str, key: str, gap: str, late: str) -> DataFrame:
    """Events by session of a key, closed when nothing comes for ``gap``."""
    rows = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("events"))
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "events")


def first_wins(records: DataFrame, *, identity: str, time: str, late: str) -> DataFrame:
    """First record of every identity; state is forgotten once the watermark has passed it."""
    return records.withWatermark(time, late).dropDuplicatesWithinWatermark([identity])


def online_near_duplicates(records: DataFrame, *, bucket: str, key: str, text: str, similarity: float = 0.90, time: str | None = None, late: str = "1 hour", forget_seconds: int = 86_400) -> DataFrame:
    """First-owner near-duplicate check of a stream, keyed by bucket: ``key, bucket, owner, near``.

    The state of a bucket is its owner's key and signature, nothing that grows with the number of records. With
    ``time`` a bucket is forgotten once the watermark is ``forget_seconds`` beyond its last record, so the number of
    buckets is bounded as well; a later record of it is an owner again.
    """

    def update(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        owner, signature = state.get if state.exists else (None, None)
        ours = [int(v, 16) for v in signature.split(",")] if signature else None
        for frame in frames:
            rows = frame.sort_values(key)
            out = []
            for k, t in zip(rows[key].tolist(), rows[text].tolist(), strict=True):
                mine = one_permutation_minhash(t or "")
                if ours is None:
                    owner, ours = str(k), mine
                    out.append((k, group[0], str(k), False))
                else:
                    out.append((k, group[0], owner, minhash_similarity(mine, ours) >= similarity and str(k) != owner))
            state.update((owner, ",".join(format(v, "x") for v in ours)))
            if time is not None:
                latest = int(rows[time].max().timestamp() * 1000)
                state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + forget_seconds * 1000)
            yield pd.DataFrame(out, columns=[key, bucket, "owner", "near"])

    kind = records.schema[key].dataType.simpleString()
    records = records if time is None else records.withWatermark(time, late)
    return records.groupBy(bucket).applyInPandasWithState(
        update, f"{key} {kind}, {bucket} string, owner string, near boolean", "owner string, signature string", "append",
        GroupStateTimeout.NoTimeout if time is None else GroupStateTimeout.EventTimeTimeout,
    )


#: Parts of a journal by key; a batch reads only those that its keys fall into.
SHARDS = 256


def resume_journal(spark: SparkSession, jobs: DataFrame, journal: str, *, key: str, work, checkpoint: str):
    """Do each job of a stream once: batches are joined against the journal, done jobs are left out, results appended.

    The journal is kept in parts by a hash of the key, and a batch reads the parts of its own keys. A batch that is
    replayed after a failure finds its own entries in the journal and adds nothing.
    """
    from textloom.session import _hadoop_path

    def batch(rows: DataFrame, number: int) -> None:
        fs, path = _hadoop_path(spark, journal)
        shard = F.pmod(F.xxhash64(key), F.lit(SHARDS)).cast("int")
        pending = rows.dropDuplicates([key]).persist()
        try:
            if fs.exists(path):
                parts = [r[0] for r in pending.select(shard.alias("shard")).distinct().collect()]  # at most SHARDS
                done = spark.read.parquet(journal).where(F.col("shard").isin(*parts)).select(key).distinct()
                todo = pending.join(done, key, "left_anti")
            else:
                todo = pending
            results = work(todo).withColumn("batch", F.lit(number)).withColumn("shard", shard)
            results.write.mode("append").partitionBy("shard").parquet(journal)
        finally:
            pending.unpersist()

    return jobs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_top(spark: SparkSession, target: str) -> DataFrame | None:
    """The newest complete version of a running top."""
    from textloom.session import _hadoop_path

    numbers = _versions(spark, target)
    return spark.read.parquet(f"{_hadoop_path(spark, target)[1].toString()}/version={numbers[-1]}") if numbers else None


def _versions(spark: SparkSession, target: str) -> list[int]:
    from textloom.session import _hadoop_path

    fs, path = _hadoop_path(spark, target)
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("version=")]
    done = [p for p in found if fs.exists(_hadoop_path(spark, f"{p.toString()}/_SUCCESS")[1])]
    return sorted(int(p.getName().split("=")[1]) for p in done)


def merge_top(spark: SparkSession, stream: DataFrame, target: str, *, order: list[str], size: int, checkpoint: str):
    """Keep the ``size`` least rows of a stream: each batch's own least are merged with those kept so far.

    Every batch writes a version of its own and then drops the older ones, so there is a whole version at any moment; a
    batch that is replayed starts from the version before it and writes the same again. ``read_top`` reads the newest.
    """
    from textloom.session import drop_path

    def batch(rows: DataFrame, number: int) -> None:
        least = rows.orderBy(*order).limit(size)
        before = [n for n in _versions(spark, target) if n < number]
        if before:
            kept = spark.read.parquet(f"{target}/version={before[-1]}")
            least = least.unionByName(kept).distinct().orderBy(*order).limit(size)
        least.write.mode("overwrite").parquet(f"{target}/version={number}")
        for old in before[:-1]:  # the version before this one stays until the next batch, for a replay
            drop_path(spark, f"{target}/version={old}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

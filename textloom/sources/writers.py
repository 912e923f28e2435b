"""Writers: canonical JSON lines, manifests that come last, stages bound to an identity, snapshots."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import struct
import tempfile
import uuid
from collections.abc import Callable, Iterable
from typing import BinaryIO
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.identity import canonical_json
from textloom.session import _hadoop_path, drop_path
from textloom.sources.readers import MAGIC, opened


def canonical_bytes(value: object) -> bytes:
    """Canonical JSON of a value: keys in order, compact, UTF-8, a line feed at the end."""
    return (json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False) + "\n").encode()


def atomic_write(path: str, body: bytes) -> str:
    """Write a local file under another name, force it to disk and rename it; returns its SHA-256."""
    handle, staged = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(handle, "wb") as out:
        out.write(body)
        out.flush()
        os.fsync(out.fileno())
    os.replace(staged, path)
    return hashlib.sha256(body).hexdigest()


def canonical_lines(frame: DataFrame) -> DataFrame:
    """Every row as one canonical JSON line without its line feed."""
    return frame.select(F.rtrim(canonical_json({c: F.col(c) for c in frame.columns}), F.lit("\n")).alias("value"))


def _written(path: str) -> BinaryIO:
    if path.startswith("file:"):
        name = unquote(urlparse(path).path)
        os.makedirs(os.path.dirname(name), exist_ok=True)
        return open(name, "wb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_output_stream(inner)


def write_objects(frame: DataFrame, path: str, order: list[str]) -> dict:
    """Write a table as one file of canonical JSON lines in order: its ``bytes, records, sha256``.

    Rows are sorted and written in parallel; the parts are then strung together in their order as a stream, so the driver
    holds a piece at a time, and the file takes its name only when it is whole.
    """
    spark = frame.sparkSession
    fs, final = _hadoop_path(spark, path)
    final = fs.makeQualified(final)
    staged = f"{final.toString()}.{uuid.uuid4().hex}"
    canonical_lines(frame.orderBy(*order)).write.text(f"{staged}-parts")
    names = sorted(s.getPath().toString() for s in fs.listStatus(_hadoop_path(spark, f"{staged}-parts")[1]) if s.getPath().getName().startswith("part-"))
    digest, size, records = hashlib.sha256(), 0, 0
    with _written(staged) as out:
        for name in names:
            with opened(name) as part:
                while chunk := part.read(1 << 20):
                    digest.update(chunk)
                    size += len(chunk)
                    records += chunk.count(b"\n")
                    out.write(chunk)
    drop_path(spark, f"{staged}-parts")
    fs.delete(final, False)
    fs.rename(_hadoop_path(spark, staged)[1], final)
    return {"bytes": size, "records": records, "sha256": digest.hexdigest()}


def write_small(spark: SparkSession, path: str, value: object) -> dict:
    """Write one canonical JSON object under another name and rename it."""
    fs, final = _hadoop_path(spark, path)
    body = canonical_bytes(value)
    _, staged = _hadoop_path(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(staged, True)
    out.write(bytearray(body))
    out.close()
    fs.delete(final, False)
    fs.rename(staged, final)
    return {"bytes": len(body), "sha256": hashlib.sha256(body).hexdigest()}


class Blocked(RuntimeError):
    """A publication that its checks forbid."""


def publish_splits(frame: DataFrame, root: str, *, split: str, splits: list[str], order: list[str], groups: DataFrame, report: dict, identity: dict, blocking: int, registry_complete: bool) -> dict:
    """Publish a finalized corpus: a file of JSON lines for each split, the test groups, the report, and the manifest last.

    Hits that block, or an incomplete registry of references, forbid it: then the report alone is written, as blocked,
    and an earlier manifest is gone, so nobody takes the old files for the new ones. Returns the manifest.
    """
    spark = frame.sparkSession
    manifest, blocked = f"{root}/finalized/manifest.json", f"{root}/reports/blocked.json"
    drop_path(spark, manifest)
    reason = "incomplete registry" if not registry_complete else "blocking hits" if blocking else None
    if reason:
        write_small(spark, blocked, report | {"status": "blocked", "reason": reason, "blocking": blocking})
        raise Blocked(reason)
    drop_path(spark, blocked)
    files = {}
    for name in splits:
        files[name] = {"path": f"{name}.jsonl"} | write_objects(frame.where(F.col(split) == name), f"{root}/finalized/{name}.jsonl", order)
    listed = {"test_groups": {"path": "test-groups.jsonl"} | write_objects(groups, f"{root}/finalized/test-groups.jsonl", groups.columns)}
    listed["report"] = {"path": "../reports/report.json"} | write_small(spark, f"{root}/reports/report.json", report | {"status": "complete"})
    digest = hashlib.sha256(canonical_bytes(identity)).hexdigest()
    entry = {"status": "complete", "identity": identity, "identity_sha256": digest, "records": sum(f["records"] for f in files.values()), "files": files, "beside": listed}
    write_small(spark, manifest, entry)
    return entry


def publish_results(frame: DataFrame, folder: str, order: list[str], summary: dict, identity: dict) -> dict:
    """Publish an evaluation once: samples as JSON lines, the summary as JSON and as a table in Markdown, the manifest last. A folder that is there is refused."""
    spark = frame.sparkSession
    fs, final = _hadoop_path(spark, folder)
    if fs.exists(final):
        raise Blocked(f"{folder} is there already")
    staged = f"{folder}.{uuid.uuid4().hex}"
    files = {"samples.jsonl": write_objects(frame, f"{staged}/samples.jsonl", order), "summary.json": write_small(spark, f"{staged}/summary.json", summary)}
    lines = ["| measure | value |", "|-|-|", *(f"| {name} | {value} |" for name, value in sorted(summary.items()))]
    files["report.md"] = _text(spark, f"{staged}/report.md", "\n".join(lines) + "\n")
    entry = {"status": "complete", "identity": identity, "files": files}
    write_small(spark, f"{staged}/manifest.json", entry)
    fs.rename(_hadoop_path(spark, staged)[1], final)
    return entry


def _text(spark: SparkSession, path: str, body: str) -> dict:
    fs, final = _hadoop_path(spark, path)
    out = fs.create(final, True)
    out.write(bytearray(body.encode()))
    out.close()
    return {"bytes": len(body.encode()), "sha256": hashlib.sha256(body.encode()).hexdigest()}


def transfer(spark: SparkSession, staged: str, final: str, *, size: int, sha256: str) -> None:
    """Move a staged file to its place if it has the stated size and digest; it is read again where it then lies."""
    from textloom.sources.records import verify

    source, (fs, path) = _hadoop_path(spark, staged)[1], _hadoop_path(spark, final)
    verify(fs.makeQualified(source).toString(), size=size, sha256=sha256)
    fs.mkdirs(path.getParent())
    fs.delete(path, False)
    if not fs.rename(source, path):
        raise OSError(f"{staged} could not be moved to {final}")
    verify(fs.makeQualified(path).toString(), size=size, sha256=sha256)


def publish(frame: DataFrame, root: str, name: str, order: list[str], *, partitions: list[str] | None = None, gate: DataFrame | None = None) -> dict:
    """Write a table and its manifest, the manifest last, so a reader that finds it finds all of the table.

    ``gate`` may hold rows that forbid publication; then nothing but a manifest with status "blocked" is written. The
    data go to a staging folder that is renamed when complete. Returns the manifest.
    """
    spark = frame.sparkSession
    fs, final = _hadoop_path(spark, f"{root}/{name}")
    _, manifest = _hadoop_path(spark, f"{root}/{name}.manifest.json")
    fs.delete(manifest, False)
    blocking = gate.count() if gate is not None else 0
    entry: dict = {"name": name, "status": "blocked" if blocking else "complete", "blocking": blocking}
    if not blocking:
        _, staged = _hadoop_path(spark, f"{root}/.{name}-{uuid.uuid4().hex}")
        rows = frame.repartition(*partitions).sortWithinPartitions(*partitions, *order) if partitions else frame.orderBy(*order)
        writer = rows.write.option("compression", "zstd")
        (writer.partitionBy(*partitions) if partitions else writer).parquet(str(staged.toString()))
        fs.delete(final, True)
        fs.rename(staged, final)
        written = spark.read.parquet(final.toString())
        digest = F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(F.col("d")))), 256)
        # One digest for each of 256 groups of row digests, and one over those: no list grows with the table alone.
        rows_digest = canonical_lines(written).select(F.sha2("value", 256).alias("d"))
        groups = rows_digest.groupBy(F.substring("d", 1, 2).alias("g")).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("d")).alias("x"), F.sum(F.xxhash64("d", F.lit(1)).cast("decimal(38,0)")).alias("s"))
        parts = groups.select(F.concat_ws(",", "g", "n", "x", "s").alias("d"), "n").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), digest.alias("digest")).first()
        entry |= {"records": parts.records, "digest": parts.digest}
    out = fs.create(manifest, True)
    out.write(bytearray(canonical_bytes(entry)))
    out.close()
    return entry


def read_manifest(spark: SparkSession, root: str, name: str) -> dict | None:
    """The manifest of a table, None if it was never completed."""
    fs, path = _hadoop_path(spark, f"{root}/{name}.manifest.json")
    return json.loads(spark.read.text(path.toString(), wholetext=True).first().value) if fs.exists(path) else None


def stage(spark: SparkSession, root: str, name: str, identity: object, build: Callable[[], DataFrame]) -> DataFrame:
    """A resumable stage: the table of an earlier run if its identity is the same, else built, written and bound to it."""
    digest = hashlib.sha256(canonical_bytes(identity)).hexdigest()
    fs, path = _hadoop_path(spark, f"{root}/{name}-{digest[:24]}")
    _, done = _hadoop_path(spark, f"{path.toString()}/_SUCCESS")
    if not fs.exists(done):
        build().write.mode("overwrite").parquet(path.toString())
    return spark.read.parquet(path.toString())


def publish_directory(root: str, files: dict[str, bytes]) -> None:
    """Replace a local folder by one that holds exactly these files, manifest included, in one rename."""
    staged = f"{root.rstrip('/')}.{uuid.uuid4().hex}"
    os.makedirs(staged)
    index = {name: {"bytes": len(body), "sha256": atomic_write(os.path.join(staged, name), body)} for name, body in sorted(files.items())}
    atomic_write(os.path.join(staged, "manifest.json"), canonical_bytes({"files": index}))
    old = f"{staged}.old"
    if os.path.exists(root):
        os.rename(root, old)
    os.rename(staged, root)
    shutil.rmtree(old, ignore_errors=True)


def pack_records(records: Iterable[bytes]) -> bytes:
    """A snapshot of length-prefixed records."""
    bodies = list(records)
    return b"".join([MAGIC, struct.pack("<Q", len(bodies)), *(struct.pack("<Q", len(b)) + b for b in bodies)])


def order_digest(records: Iterable[bytes]) -> str:
    """Digest of records in their order, lengths included."""
    digest = hashlib.sha256()
    for body in records:
        digest.update(struct.pack("<Q", len(body)))
        digest.update(body)
    return digest.hexdigest()

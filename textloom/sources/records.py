"""Strict readers: JSON lines, manifests, verified inputs and run logs. What breaks the contract of an input is an error, never a row."""

from __future__ import annotations

import hashlib
import json
import os
import posixpath
import re
from collections.abc import Iterator, Mapping, Sequence
from typing import Any, BinaryIO

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.sources.readers import _exploded, _files, opened, text_lines

#: Formats of manifests of held-out passages, and that of the files each names.
LINE_MANIFEST, MAP_MANIFEST, LOCKED_MANIFEST = "lines", "map", "locked"


class InputError(ValueError):
    """An input that differs from what was stated of it."""


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines: ``path, line, value`` with the object as text. Blank lines are passed over; anything but an object fails."""

    def read(name: str, stream: BinaryIO) -> Iterator[tuple]:
        for number, line in enumerate(text_lines(stream), 1):
            if not line.strip():
                continue
            try:
                value = json.loads(line)
            except ValueError as error:
                raise InputError(f"no JSON at {name}:{number}") from error
            if not isinstance(value, dict):
                raise InputError(f"no object at {name}:{number}")
            yield name, number, line

    return _exploded(_files(spark, path), "path string, line int, value string", read)


def read_object(path: str) -> dict[str, Any]:
    """The one JSON object of a small file, on the driver."""
    with opened(path if ":" in path else f"file:{os.path.abspath(path)}") as stream:
        value = json.loads(stream.read().decode("utf-8"))
    if not isinstance(value, dict):
        raise InputError(f"no object in {path}")
    return value


def typed(objects: DataFrame, schema: str) -> DataFrame:
    """Fields of ``read_objects`` by a schema; a field of another type fails."""
    parsed = F.from_json("value", schema, {"mode": "FAILFAST"})
    return objects.select("path", "line", parsed.alias("x")).select("path", "line", "x.*")


def required(frame: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """The same rows; a row that breaks a named check fails the query when it is read."""
    broken = F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()))
    where = F.concat_ws(":", "path", "line") if {"path", "line"} <= set(frame.columns) else F.lit("")
    fault = F.raise_error(F.concat(F.lit("broken: "), broken, F.lit(" at "), where)).cast("boolean")
    return frame.where(F.when(broken.isNull(), F.lit(True)).otherwise(fault))


def nonempty(frame: DataFrame, what: str) -> DataFrame:
    """The same rows; none at all is an error."""
    if frame.limit(1).count() == 0:
        raise InputError(f"{what} is empty")
    return frame


PARALLEL = "sample_id string, sample_group_id string, src_lang string, tgt_lang string, source_text string, target_text string, split string"


def read_parallel_objects(spark: SparkSession, path: str, *, split: str, routes: Sequence[tuple[str, str]], sha256: str | None = None) -> DataFrame:
    """Parallel samples of one split: every field is there, every route is known, and the file has the stated digest."""
    if sha256 is not None:
        verify(path, sha256=sha256)
    rows = typed(read_objects(spark, path), PARALLEL)
    texts = {name: F.length(name) > 0 for name in ("sample_id", "sample_group_id", "source_text", "target_text")}
    known = F.concat_ws("->", "src_lang", "tgt_lang").isin(*("->".join(r) for r in routes))
    return required(nonempty(rows, path), {"split": F.col("split") == split, "route": known, **texts})


def verify(path: str, *, size: int | None = None, sha256: str | None = None) -> None:
    """Compare a file with its stated size and digest, streaming it once."""
    digest, read = hashlib.sha256(), 0
    with opened(path if ":" in path else f"file:{os.path.abspath(path)}") as stream:
        while chunk := stream.read(1 << 20):
            digest.update(chunk)
            read += len(chunk)
    if size is not None and read != size or sha256 is not None and digest.hexdigest() != sha256:
        raise InputError(f"{path} differs from its stated identity")


def read_corpus_manifest(spark: SparkSession, path: str, schema: str, *, status: str | None = None) -> DataFrame:
    """A manifest of one object a language; with ``status`` one of another status is refused."""
    rows = nonempty(typed(read_objects(spark, path), schema), path)
    repeated = rows.groupBy("language").count().where("count > 1").limit(1).count()
    if repeated:
        raise InputError(f"{path} names a language twice")
    return rows if status is None else required(rows, {"status": F.col("status") == status})


def _inside(folder: str, name: str) -> str:
    if posixpath.isabs(name) or ".." in name.split("/") or "\\" in name:
        raise InputError(f"unsafe path {name}")
    return posixpath.join(folder, name)


def manifest_files(path: str, kind: str, *, usage: str | None = None) -> list[dict[str, Any]]:
    """Files that a manifest of held-out passages names: ``language, path, name, format, bytes, sha256``.

    ``lines`` has an object a line (``language, file, bytes, sha256``); ``map`` has them under ``files`` by language
    (``path, bytes, sha256``); ``locked`` is a complete list under ``files`` with format, records and split, for the
    stated usage only. A path that leaves the manifest's folder is refused.
    """
    folder = posixpath.dirname(path)
    with opened(path if ":" in path else f"file:{os.path.abspath(path)}") as stream:
        body = stream.read().decode("utf-8")
    if kind == LINE_MANIFEST:
        rows = [{**r, "path": r["file"], "format": "text"} for r in map(json.loads, filter(None, body.splitlines()))]
    elif kind == MAP_MANIFEST:
        rows = [{**r, "language": language, "format": "jsonl"} for language, r in sorted(json.loads(body)["files"].items())]
    else:
        whole = json.loads(body)
        if whole.get("status") != "complete" or usage is not None and whole.get("usage") != usage or not isinstance(whole.get("files"), list):
            raise InputError(f"{path} is no complete manifest for this use")
        rows = whole["files"]
        for row in rows:
            fields = {"bytes": int, "format": str, "language": str, "path": str, "records": int, "sha256": str, "split": str}
            if set(row) != set(fields) or not all(isinstance(row[k], t) and row[k] for k, t in fields.items()):
                raise InputError(f"{path} holds an incomplete record")
            if row["format"] != "text-lines" or not re.fullmatch("[0-9a-f]{64}", row["sha256"]):
                raise InputError(f"{path} holds a record of an unknown kind")
        rows = [{**row, "format": "text"} for row in rows]
    return [{"language": r["language"], "path": _inside(folder, r["path"]), "name": r["path"], "format": r["format"], "bytes": int(r["bytes"]), "sha256": r["sha256"]} for r in rows]


def read_verified_references(spark: SparkSession, files: Sequence[Mapping[str, Any]], reference_id: str) -> DataFrame:
    """Held-out passages of the named files: ``reference_id, language, record_id, text``.

    A file is hashed while it is read; one that ends with another size or digest than stated fails the query. Empty
    lines are no passages; a JSON line without a text is an error.
    """
    stated = {f["path"] if ":" in f["path"] else f"file:{os.path.abspath(f['path'])}": f for f in files}

    def read(name: str, _stream: BinaryIO) -> Iterator[tuple]:
        file = stated[name]
        digest, size = hashlib.sha256(), 0
        with opened(name) as stream:
            for number, raw in enumerate(stream, 1):
                digest.update(raw)
                size += len(raw)
                line = raw.decode("utf-8").rstrip("\r\n")
                if not line:
                    continue
                text = line if file["format"] == "text" else json.loads(line).get("text")
                if not isinstance(text, str):
                    raise InputError(f"no text at {name}:{number}")
                yield reference_id, file["language"], f"{file['name']}:{number}", text
        if size != file["bytes"] or digest.hexdigest() != file["sha256"]:
            raise InputError(f"{name} differs from its stated identity")

    names = spark.createDataFrame([(n,) for n in stated], "path string").repartition(max(1, len(stated)))
    return _exploded(names, "reference_id string, language string, record_id string, text string", read)


def load_finalized(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Split files of a published folder: ``split`` and the fields; every file has the size, digest and records its manifest states.

    The manifest is written last, so a folder without one is unfinished and refused.
    """
    manifest = read_object(posixpath.join(folder, "manifest.json"))
    if manifest.get("status") != "complete":
        raise InputError(f"{folder} is not complete")
    parts = []
    for split, file in sorted(manifest["files"].items()):
        path = _inside(folder, file["path"])
        verify(path, size=file["bytes"], sha256=file["sha256"])
        rows = typed(read_objects(spark, path), schema)
        if rows.count() != file["records"]:
            raise InputError(f"{path} has not the stated number of records")
        parts.append(rows.withColumn("split", F.lit(split)))
    if not parts:
        raise InputError(f"{folder} names no files")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def load_route_shards(spark: SparkSession, folder: str, routes: Sequence[str], schema: str, *, records: int, split: str = "train") -> DataFrame:
    """One shard a route, in the order of the routes: ``route_order`` and the fields. A shard that is missing, holds another
    number of records, or a record of another route or split, is an error."""
    parts = []
    for order, route in enumerate(routes):
        path = posixpath.join(folder, route.replace("->", "__") + ".jsonl")
        try:
            rows = typed(read_objects(spark, path), schema)
            found = rows.agg(F.count("*").alias("n"), F.count_if((F.col("route") != route) | (F.col("split") != split)).alias("other")).first()
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                raise InputError(f"no shard of route {route}") from error
            raise
        if found.n != records or found.other:
            raise InputError(f"the shard of route {route} has not the stated records")
        parts.append(rows.withColumn("route_order", F.lit(order)))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def load_sample_set(spark: SparkSession, folder: str, schema: str, identity: Mapping[str, Any]) -> DataFrame:
    """A frozen evaluation set: used again only if its manifest has the same identity and its files the stated digests."""
    manifest = read_object(posixpath.join(folder, "manifest.json"))
    if manifest.get("identity") != dict(identity):
        raise InputError(f"{folder} was drawn under another identity")
    for file in manifest["files"].values():
        verify(_inside(folder, file["path"]), size=file["bytes"], sha256=file["sha256"])
    paths = [_inside(folder, f["path"]) for f in manifest["files"].values()]
    rows = typed(read_objects(spark, paths[0]), schema)
    for path in paths[1:]:
        rows = rows.unionByName(typed(read_objects(spark, path), schema))
    return rows


class RunLog:
    """Events of a run as JSON lines, appended; the sequence goes on where an earlier part of the run ended.

    A line cut off by a crash is dropped when the log is opened again. Events are flushed every ``every`` lines and at
    the end. For the driver's own events: a stream's rows go to ``writeStream``.
    """

    def __init__(self, path: str, every: int = 1):
        self.path, self.every, self.sequence, self._held = path, every, 0, 0
        if os.path.exists(path):
            with open(path, "rb+") as log:
                body = log.read()
                whole = body[: body.rfind(b"\n") + 1]
                log.truncate(len(whole))
            for line in whole.splitlines():
                if json.loads(line)["sequence"] != self.sequence:
                    raise InputError(f"{path} is no unbroken log")
                self.sequence += 1
        self._log = open(path, "ab")

    def append(self, event: str, **fields: Any) -> None:
        row = {"sequence": self.sequence, "event": event, **fields}
        self._log.write(json.dumps(row, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode() + b"\n")
        self.sequence += 1
        self._held += 1
        if self._held >= self.every:
            self.flush()

    def flush(self) -> None:
        self._log.flush()
        os.fsync(self._log.fileno())
        self._held = 0

    def close(self) -> None:
        self.flush()
        self._log.close()

    def __enter__(self) -> RunLog:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def read_run_log(spark: SparkSession, path: str, schema: str = "sequence long, event string") -> DataFrame:
    """Events of run logs in their order; a gap or a repetition in the sequence is an error."""
    rows = typed(read_objects(spark, path), schema)
    bad = rows.groupBy("path").agg(F.count("*").alias("n"), F.count_distinct("sequence").alias("d"), F.max("sequence").alias("m"), F.min("sequence").alias("l"))
    if bad.where("n <> d or l <> 0 or m <> n - 1").limit(1).count():
        raise InputError(f"{path} holds a broken log")
    return rows


def prepare_inputs(spark: SparkSession, path: str, *, split: str, routes: Sequence[tuple[str, str]], sha256: str, seed: str, per_route: int, settings: Mapping[str, Any]) -> tuple[DataFrame, str]:
    """Verified input, its sample of each route by seeded rank, and the digest of the contract of the run."""
    from textloom.functions.identity import seeded
    from textloom.operators.select import top_per_group

    rows = read_parallel_objects(spark, path, split=split, routes=routes, sha256=sha256).withColumn("route", F.concat_ws("->", "src_lang", "tgt_lang"))
    sample = top_per_group(rows.withColumn("digest", seeded(seed, F.col("route"), F.col("sample_id"))), ["route"], ["digest", "sample_id"], per_route)
    contract = {"input": sha256, "seed": seed, "per_route": per_route, "split": split, "routes": ["->".join(r) for r in routes], **settings}
    body = json.dumps(contract, sort_keys=True, separators=(",", ":"), ensure_ascii=False) + "\n"
    return sample, hashlib.sha256(body.encode()).hexdigest()


def differing_fields(first: Mapping[str, Any], second: Mapping[str, Any], allowed: Sequence[str] = ()) -> list[str]:
    """Dotted names of the fields in which two configurations differ, save for the allowed ones."""

    def flat(value: Any, name: str) -> Iterator[tuple[str, Any]]:
        if isinstance(value, Mapping) and value:
            for key, inner in value.items():
                yield from flat(inner, f"{name}.{key}" if name else str(key))
        else:
            yield name, value

    a, b = dict(flat(first, "")), dict(flat(second, ""))
    marker = object()
    return sorted(k for k in a.keys() | b.keys() if a.get(k, marker) != b.get(k, marker) and k not in allowed)




def log_differences(first: DataFrame, second: DataFrame, fields: Sequence[str], *, events: Sequence[str]) -> DataFrame:
    """Where a run that was interrupted and resumed differs from one that was not: ``event, place, field, first, second``.

    Both are run logs; only the named events and fields are compared, each event by its place among its kind, so the
    marks that a resumption leaves behind do not count.
    """
    from pyspark.sql import Window as W

    def side(frame: DataFrame, name: str) -> DataFrame:
        place = F.row_number().over(W.partitionBy("event").orderBy("sequence"))
        values = F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*(F.to_json(F.struct(F.col(f).alias("v"))) for f in fields)))
        return frame.where(F.col("event").isin(*events)).select("event", place.alias("place"), F.explode(values).alias("field", name))

    both = side(first, "first").join(side(second, "second"), ["event", "place", "field"], "full")
    return both.where(~F.col("first").eqNullSafe(F.col("second")))

"""Readers of the formats a corpus arrives in. Every reader keeps where a record stood: file, line or member."""

from __future__ import annotations

import hashlib
import io
import json
import re
import struct
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from typing import BinaryIO
from urllib.parse import unquote, urlparse
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from textloom.functions import text as X
from textloom.functions.arrow import map_stream

SENTENCE = re.compile(r"(?<=[。！？!?；;])\s*|\n+")
#: First bytes of a snapshot of length-prefixed records.
MAGIC = b"TLRECORDS\x00\x00\x00\x00\x00\x01\x00"


#: Rows, and bytes of their text, that a reader hands on at once.
ROWS, BYTES = 4096, 1 << 23


def _files(spark: SparkSession, path: str) -> DataFrame:
    """Names of files; what is in them is opened and streamed inside the task that reads it, so no file is held whole."""
    names = spark.read.format("binaryFile").load(path).select("path")
    return names.repartition(max(1, spark.sparkContext.defaultParallelism), "path")


def opened(name: str) -> BinaryIO:
    """A file of the shared file system as a seekable stream."""
    if name.startswith("file:"):
        return open(unquote(urlparse(name).path), "rb")
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(name)
    return system.open_input_file(inner)


def _exploded(files: DataFrame, schema: str, read: Callable[[str, BinaryIO], Iterator[tuple]]) -> DataFrame:
    struct = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            arrays = [pa.array([row[i] for row in rows], f.type) for i, f in enumerate(arrow)]
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=arrow)

        for names in batches:
            for name in names.column(0).to_pylist():
                with opened(name) as stream:
                    for row in read(name, stream):
                        rows.append(row)
                        held += sum(len(x) for x in row if isinstance(x, (str, bytes)))
                        if len(rows) >= ROWS or held >= BYTES:
                            yield batch()
                            held = 0
        if rows:
            yield batch()

    return map_stream(files, work, struct)


def zst_lines(stream: BinaryIO) -> Iterator[str]:
    """Whole lines of a zstd stream; a frame that is cut off ends them quietly, together with the line it cuts."""
    import zstandard

    reader = zstandard.ZstdDecompressor().stream_reader(stream, read_across_frames=True)
    held = b""
    while True:
        try:
            chunk = reader.read(1 << 20)
        except zstandard.ZstdError:
            return
        if not chunk:
            break
        *whole, held = (held + chunk).split(b"\n")
        yield from (line.decode("utf-8", "replace") for line in whole)
    if held:
        yield held.decode("utf-8", "replace")


def read_jsonl_zst(spark: SparkSession, path: str) -> DataFrame:
    """Objects of compressed JSON lines: ``path, line, text, u``; malformed lines and other values are passed over."""

    def read(name: str, stream: BinaryIO) -> Iterator[tuple]:
        for number, line in enumerate(zst_lines(stream), 1):
            try:
                value = json.loads(line)
            except ValueError:
                continue
            if isinstance(value, dict):
                text, url = value.get("text"), value.get("u")
                yield name, number, text if isinstance(text, str) else None, url if isinstance(url, str) else None

    return _exploded(_files(spark, path), "path string, line int, text string, u string", read)


def in_order(*shards: DataFrame) -> DataFrame:
    """Shards one after another, with ``shard`` as their order."""
    parts = [shard.withColumn("shard", F.lit(i)) for i, shard in enumerate(shards)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def read_shard_map(spark: SparkSession, path: str, least: int, most: int) -> DataFrame:
    """Shard addresses ``.../<quality>_<shard>.jsonl.zst`` with a quality in a range, best first."""
    lines = spark.read.text(path).withColumn("url", F.trim("value"))
    pattern = r"/([0-9]+)_([0-9]+)\.jsonl\.zst$"
    rows = lines.where(F.rlike("url", F.lit(pattern))).select(
        "url", F.regexp_extract("url", pattern, 1).cast("int").alias("quality"), F.regexp_extract("url", pattern, 2).cast("int").alias("shard")
    )
    return rows.where(F.col("quality").between(least, most)).orderBy(F.desc("quality"), "shard", "url")


def read_digest_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``digest  name`` of a checksum list."""
    pattern = r"^([0-9a-fA-F]{32,128})\s+\*?(.+)$"
    rows = spark.read.text(path).select(F.lower(F.regexp_extract("value", pattern, 1)).alias("digest"), F.trim(F.regexp_extract("value", pattern, 2)).alias("name"))
    return rows.where("digest <> ''")


def read_tar_members(spark: SparkSession, path: str, locked: dict[str, tuple[int, str]]) -> DataFrame:
    """Members of tar archives that a lock names, with ``ok``: whether size and SHA-256 are those of the lock."""

    def read(name: str, stream: BinaryIO) -> Iterator[tuple]:
        with tarfile.open(fileobj=stream) as archive:
            for member in archive:
                if member.isfile() and member.name in locked:
                    body = archive.extractfile(member).read()
                    size, digest = locked[member.name]
                    yield name, member.name, body, len(body) == size and hashlib.sha256(body).hexdigest() == digest

    return _exploded(_files(spark, path), "path string, member string, body binary, ok boolean", read)


def read_locale_jsonl(spark: SparkSession, path: str, language: str) -> DataFrame:
    """Aligned utterances of one locale: ``lang, alignment_key, split, source_record_id, text``; a malformed line fails."""
    rows = spark.read.schema("id string, partition string, utt string").option("mode", "FAILFAST").json(path)
    key = F.to_json(F.struct("id", "partition"), {"ignoreNullFields": "false"})
    return rows.select(F.lit(language).alias("lang"), key.alias("alignment_key"), F.col("partition").alias("split"), F.col("id").alias("source_record_id"), F.col("utt").alias("text"))


def repeated_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that stand more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("records")).where("records > 1")


def read_zip_xml(spark: SparkSession, path: str, tag: str = "content") -> DataFrame:
    """Sentences of every ``tag`` element of the XML members of zip archives: ``member, ordinal, text``."""

    def read(name: str, stream: BinaryIO) -> Iterator[tuple]:
        with zipfile.ZipFile(stream) as archive:
            for member in sorted(n for n in archive.namelist() if n.lower().endswith(".xml")):
                ordinal = 0
                for element in ElementTree.fromstring(archive.read(member)).iter():
                    if element.tag.rpartition("}")[2] == tag:
                        for part in SENTENCE.split(" ".join("".join(element.itertext()).split())):
                            if part.strip():
                                yield member, ordinal, part.strip()
                                ordinal += 1

    return _exploded(_files(spark, path), "member string, ordinal int, text string", read)


def markdown_sentences(text: str, *, only_quotes: bool = False) -> list[str]:
    """Prose sentences of a Markdown page, without front matter, fences, markup and links' addresses."""
    body = re.sub(r"\A---\n.*?\n---\n", "", text, flags=re.DOTALL)
    out, fenced = [], False
    for line in body.splitlines():
        if line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
            continue
        if fenced or line.lstrip().startswith(("<", "|", "{{")):
            continue
        if only_quotes and not re.match(r"\s*[>\-*]\s", line):
            continue
        line = re.sub(r"^\s*(?:#{1,6}|[>\-*+]|\d+\.)\s+", "", line)
        line = re.sub(r"`[^`]*`", "", re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", line))
        out += [part.strip(" *_") for part in SENTENCE.split(line) if part.strip(" *_")]
    return out


def read_zip_markdown(spark: SparkSession, path: str, *, only_quotes: bool = False) -> DataFrame:
    """Prose of the Markdown members of zip archives; sentences that begin in ASCII are code or names and left out."""

    def read(name: str, stream: BinaryIO) -> Iterator[tuple]:
        with zipfile.ZipFile(stream) as archive:
            for member in sorted(n for n in archive.namelist() if n.endswith(".md")):
                sentences = markdown_sentences(archive.read(member).decode("utf-8", "replace"), only_quotes=only_quotes)
                for ordinal, sentence in enumerate(s for s in sentences if not s[0].isascii()):
                    yield member, ordinal, sentence

    return _exploded(_files(spark, path), "member string, ordinal int, text string", read)


def read_laws(spark: SparkSession, path: str) -> DataFrame:
    """Sentences of law articles that end in terminal punctuation: ``law, article, ordinal, text``."""
    schema = "Laws array<struct<LawName: string, LawURL: string, LawArticles: array<struct<ArticleType: string, ArticleNo: string, ArticleContent: string>>>>"
    laws = spark.read.schema(schema).option("multiLine", "true").json(path).select(F.explode("Laws").alias("l"))
    code = F.lower(F.regexp_extract("l.LawURL", r"(?i)pcode=([^&]+)", 1))
    articles = laws.select(code.alias("law"), F.posexplode("l.LawArticles").alias("article", "a"))
    parts = articles.select("law", "article", F.col("a.ArticleType").alias("kind"), F.posexplode(F.split("a.ArticleContent", r"(?<=[。！？!?；;])\s*|\n+")).alias("ordinal", "part"))
    parts = parts.withColumn("text", X.collapse(F.col("part")))
    return parts.where(F.rlike("text", F.lit(f"{X.TERMINAL}$"))).select("law", "article", "kind", "ordinal", "text")


def read_conllu(spark: SparkSession, path: str, last_dialogue: int = 650) -> DataFrame:
    """``# text`` lines of treebanks with their sentence id; the first ones are dialogue, the rest legal."""
    whole = spark.read.text(path, wholetext=True)
    pattern = r"(?m)^# sent_id = (\S+)\s*\n(?:#(?! text =).*\n)*# text = (.+)$"
    ids = F.regexp_extract_all("value", F.lit(pattern), F.lit(1))
    texts = F.regexp_extract_all("value", F.lit(pattern), F.lit(2))
    rows = whole.select(F.explode(F.arrays_zip(ids.alias("sent_id"), texts.alias("text"))).alias("x")).select("x.sent_id", "x.text")
    number = F.regexp_extract("sent_id", r"([0-9]+)$", 1).cast("int")
    return rows.withColumn("domain", F.when(number <= last_dialogue, "dialogue").otherwise("legal"))


def text_lines(stream: BinaryIO) -> Iterator[str]:
    """Lines of a UTF-8 stream without their ends, a mark at its start left out."""
    for line in io.TextIOWrapper(stream, "utf-8-sig", "replace", newline=""):
        yield from line.splitlines() or [""]


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their file and number from 1."""

    def read(name: str, stream: BinaryIO) -> Iterator[tuple]:
        for number, line in enumerate(text_lines(stream), 1):
            yield name, number, line

    return _exploded(_files(spark, path), "path string, line int, text string", read)


def read_parallel_lines(spark: SparkSession, left: str, right: str) -> DataFrame:
    """Two files joined by line number; ``unequal`` marks lines without a partner."""
    a = numbered_lines(spark, left).select("line", F.col("text").alias("left_text"))
    b = numbered_lines(spark, right).select("line", F.col("text").alias("right_text"))
    return a.join(b, "line", "full").withColumn("unequal", F.col("left_text").isNull() | F.col("right_text").isNull())


def read_references(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Held-out passages of a text or JSON-lines file, identified by file and line."""
    rows = numbered_lines(spark, path).where("trim(text) <> ''")
    text = F.get_json_object("text", "$.text") if kind == "jsonl" else F.col("text")
    return rows.select(F.concat_ws(":", "path", "line").alias("record_id"), text.alias("text"))


def file_identities(spark: SparkSession, path: str) -> DataFrame:
    """Size and SHA-256 of files."""

    def read(name: str, stream: BinaryIO) -> Iterator[tuple]:
        digest, size = hashlib.sha256(), 0
        while chunk := stream.read(1 << 20):
            digest.update(chunk)
            size += len(chunk)
        yield name, size, digest.hexdigest()

    return _exploded(_files(spark, path), "path string, bytes bigint, sha256 string", read)


def verify_files(spark: SparkSession, path: str, locked: dict[str, tuple[int, str]]) -> DataFrame:
    """Files against a lock of size and SHA-256 by name: ``name, state`` (equal, differs, missing or unknown)."""
    have = file_identities(spark, path).withColumn("name", F.substring_index("path", "/", -1))
    want = spark.createDataFrame([(n, b, d) for n, (b, d) in locked.items()], "name string, want_bytes long, want_sha string")
    both = have.join(want, "name", "full")
    state = F.when(F.col("path").isNull(), "missing").when(F.col("want_sha").isNull(), "unknown")
    state = state.when((F.col("bytes") == F.col("want_bytes")) & (F.col("sha256") == F.col("want_sha")), "equal").otherwise("differs")
    return both.select("name", state.alias("state"))


def compare_builds(spark: SparkSession, first: str, second: str) -> DataFrame:
    """Files of two builds by name that differ or stand in one only; none if the builds are byte for byte the same."""
    side = lambda path, n: file_identities(spark, path).select(F.substring_index("path", "/", -1).alias("name"), F.col("sha256").alias(n))
    both = side(first, "a").join(side(second, "b"), "name", "full")
    return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("name", "a", "b")


def parallel_laws(first: DataFrame, second: DataFrame) -> DataFrame:
    """Articles of two translations of laws, as ``read_laws`` gives them, joined by law and number.

    Only ordinary articles (kind A) of one sentence on either side are kept, as sentences of longer ones need not match.
    """

    def single(frame: DataFrame, name: str) -> DataFrame:
        rows = frame.where("kind = 'A'").groupBy("law", "article").agg(F.count("*").alias("n"), F.min("text").alias(name))
        return rows.where("n = 1").drop("n")

    return single(first, "left_text").join(single(second, "right_text"), ["law", "article"])


def unpack_records(stream: BinaryIO) -> Iterator[bytes]:
    """Records of a snapshot; a wrong head, a short record or a wrong count is an error."""
    if stream.read(16) != MAGIC:
        raise ValueError("not a snapshot of records")
    (count,) = struct.unpack("<Q", stream.read(8))
    for _ in range(count):
        head = stream.read(8)
        body = stream.read(struct.unpack("<Q", head)[0]) if len(head) == 8 else None
        if body is None or len(body) != struct.unpack("<Q", head)[0]:
            raise ValueError("snapshot ends inside a record")
        yield body
    if stream.read(1):
        raise ValueError("snapshot holds more than it counts")


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Records of snapshots: ``path, ordinal, record``."""

    def read(name: str, stream: BinaryIO) -> Iterator[tuple]:
        for ordinal, body in enumerate(unpack_records(stream)):
            yield name, ordinal, body

    return _exploded(_files(spark, path), "path string, ordinal bigint, record binary", read)


#: Reader by name; further ones may be added.
ADAPTERS: dict[str, Callable[..., DataFrame]] = {
    "jsonl_zst": read_jsonl_zst,
    "locale_jsonl": read_locale_jsonl,
    "zip_xml": read_zip_xml,
    "zip_markdown": read_zip_markdown,
    "laws_json": read_laws,
    "conllu": read_conllu,
    "parallel_lines": read_parallel_lines,
    "snapshot": read_snapshot,
}

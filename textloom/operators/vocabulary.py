"""Vocabularies as tables: checks, language ids, evaluation of a tokenizer on texts, encoding of distinct texts, the feed of a trainer."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.functions.arrow import map_batches

#: The mark that takes the place of the white space before a word.
MARK = "▁"
#: Label of a position that counts for no loss.
IGNORED = -100


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """A tokenizer file, once in a process; strings of special tokens are ordinary text."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


class Allowlist:
    """Names that may be used; anything else is an error."""

    def __init__(self, allowed: Iterable[str]):
        self.allowed = frozenset(allowed)
        if not self.allowed:
            raise ValueError("an empty list allows nothing")

    def check(self, name: str) -> str:
        if name not in self.allowed:
            raise ValueError(f"{name} is not one of {sorted(self.allowed)}")
        return name


def vocabulary_table(spark: SparkSession, ids: Mapping[str, int]) -> DataFrame:
    """``token, id`` of a vocabulary."""
    return spark.createDataFrame(list(ids.items()), "token string, id int")


def vocabulary_faults(vocabulary: DataFrame, *, fixed: Mapping[str, int], languages: Sequence[str], removed: Sequence[str] = (), size: int | None = None) -> DataFrame:
    """How often a vocabulary (``token, id``) breaks each rule: ``check, violations``; all 0 for a sound one.

    Ids are dense from 0 and unique; fixed tokens have their ids; every language has a token and no removed one is left;
    the size is the stated one.
    """
    stats = vocabulary.agg(F.count("*").alias("n"), F.count_distinct("id").alias("d"), F.min("id").alias("low"), F.max("id").alias("high"))
    spark = vocabulary.sparkSession
    wanted = spark.createDataFrame([*fixed.items(), *((x, None) for x in languages)], "token string, want int")
    met = wanted.join(vocabulary, "token", "left").agg(
        F.count_if(F.col("want").isNotNull() & ~F.col("id").eqNullSafe(F.col("want"))).alias("special_ids"), F.count_if(F.col("want").isNull() & F.col("id").isNull()).alias("missing_languages")
    )
    left = vocabulary.agg(F.count_if(F.col("token").isin(*removed) if removed else F.lit(False)).alias("removed_tokens"))
    flat = stats.crossJoin(met).crossJoin(left)  # one row each
    checks = {
        "repeated_ids": F.col("n") - F.col("d"),
        "gaps": F.when((F.col("low") == 0) & (F.col("high") == F.col("d") - 1), 0).otherwise(F.coalesce(F.col("high") + 1 - F.col("d"), F.lit(0)) + F.coalesce(F.abs("low"), F.lit(1))),
        "special_ids": F.col("special_ids"),
        "missing_languages": F.col("missing_languages"),
        "removed_tokens": F.col("removed_tokens"),
        "size": F.lit(0) if size is None else F.abs(F.col("n") - size),
    }
    pairs = F.array(*(F.struct(F.lit(name).alias("check"), value.cast("bigint").alias("violations")) for name, value in checks.items()))
    return flat.select(F.explode(pairs).alias("x")).select("x.*")


def language_ids(vocabulary: DataFrame, languages: Sequence[str], unknown: str = "<unk>") -> dict[str, int]:
    """The id of each language's token; one that is missing, unknown or shared is an error."""
    rows = {r.token: r.id for r in vocabulary.where(F.col("token").isin(*languages, unknown)).collect()}
    found = {x: rows.get(x) for x in languages}
    if any(i is None or i == rows.get(unknown) for i in found.values()) or len(set(found.values())) != len(found):
        raise ValueError(f"languages without an id of their own: {found}")
    return found


def forced_start(ids: Mapping[str, int], language: str) -> int:
    """The id that a translation into a language starts with."""
    return ids[Allowlist(ids).check(language)]


def ordered_differences(first: DataFrame, second: DataFrame) -> DataFrame:
    """Ids at which two vocabularies hold different tokens, or only one holds any."""
    a, b = first.select("id", F.col("token").alias("first")), second.select("id", F.col("token").alias("second"))
    return a.join(b, "id", "full").where(~F.col("first").eqNullSafe(F.col("second")))


def alphabet_limit(size: int, initial: int, requested: int | None = None, *, specials: int = 10, more: int = 2048, merges: tuple[int, int, int] = (32, 1024, 8)) -> int:
    """How many characters a vocabulary of ``size`` may hold beside its merges.

    A share of the vocabulary, within bounds, is kept for merges. By default the initial alphabet may grow by ``more``;
    a requested limit below the initial alphabet or beyond what is left is an error.
    """
    least, most, part = merges
    kept = min(most, max(least, size // part))
    room = size - specials - kept
    if room < initial:
        raise ValueError(f"{size} tokens are too few for an alphabet of {initial}: {initial + specials + kept} are needed")
    limit = min(room, initial + more) if requested is None else requested
    if not initial <= limit <= room:
        raise ValueError(f"a limit of {limit} is not between {initial} and {room}")
    return limit


def covered(path: str, char: str, unknown: str = "<unk>") -> bool:
    """Whether a tokenizer has ids for a character, none of them the unknown one."""
    found = tokenizer(path).encode(char, add_special_tokens=False).ids
    return bool(found) and tokenizer(path).token_to_id(unknown) not in found


def evaluate_texts(frame: DataFrame, keep: Sequence[str], text: str, path: str, unknown: str = "<unk>") -> DataFrame:
    """Each text encoded and decoded: the ``keep`` columns, ``characters, visible, tokens, unknown_tokens, unknown_characters, unplaced, exact``.

    Unknown tokens are laid over the characters their offsets cover, white space left out; ``unplaced`` are those that
    cover none. ``exact`` says whether decoding gives the text back. Null texts give no row.
    """

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        tool = tokenizer(path)
        none = tool.token_to_id(unknown)
        texts = batch.column(batch.num_columns - 1).to_pylist()
        out: dict[str, Any] = {n: batch.column(i) for i, n in enumerate(batch.schema.names[:-1])}
        rows = []
        for value, encoding in zip(texts, tool.encode_batch(texts, add_special_tokens=False), strict=True):
            places, unplaced = set(), 0
            for i, (start, end) in zip(encoding.ids, encoding.offsets, strict=True) if none is not None and none in encoding.ids else ():
                if i == none:
                    here = {p for p in range(start, min(end, len(value))) if not value[p].isspace()}
                    places |= here
                    unplaced += not here
            exact = tool.decode(encoding.ids, skip_special_tokens=True) == value
            rows.append((len(value), len("".join(value.split())), len(encoding.ids), sum(i == none for i in encoding.ids) if none is not None else 0, len(places), unplaced, exact))
        names = ("characters", "visible", "tokens", "unknown_tokens", "unknown_characters", "unplaced", "exact")
        return out | dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))

    kinds = ", ".join(f"`{k}` {frame.schema[k].dataType.simpleString()}" for k in keep)
    rows = frame.where(F.col(text).isNotNull()).select(*keep, F.col(text).alias("__text"))
    return map_batches(rows, work, f"{kinds}, characters int, visible int, tokens int, unknown_tokens int, unknown_characters int, unplaced int, exact boolean")


def evaluation_summary(evaluated: DataFrame, group: str) -> DataFrame:
    """Totals of ``evaluate_texts`` by group: texts, characters, tokens, tokens a visible character, lost characters, exact round trips, length quantiles."""
    return evaluated.groupBy(group).agg(
        F.count("*").alias("texts"), F.sum("characters").alias("characters"), F.sum("tokens").alias("tokens"),
        F.round(F.try_divide(F.sum("tokens"), F.sum("visible")), 6).alias("tokens_per_character"),
        F.sum("unknown_tokens").alias("unknown_tokens"), F.sum("unknown_characters").alias("unknown_characters"), F.sum("unplaced").alias("unplaced"),
        F.count_if("exact").alias("exact"), F.expr("percentile_disc(0.95) within group (order by tokens)").alias("p95"), F.expr("percentile_disc(0.99) within group (order by tokens)").alias("p99"),
    )


def coverage_summary(summary: DataFrame, group: str, names: Sequence[str]) -> DataFrame:
    """The summary of exactly the named groups; one that is missing or has no finite figure is an error."""
    rows = summary.where(F.col(group).isin(*names)).collect()
    bad = [r[group] for r in rows if any(v is None or isinstance(v, float) and not math.isfinite(v) for v in r)]
    if {r[group] for r in rows} != set(names) or bad:
        raise ValueError(f"no whole summary of {sorted(set(names) - {r[group] for r in rows}) or bad}")
    return summary.where(F.col(group).isin(*names))


def text_keys(pairs: DataFrame) -> DataFrame:
    """Distinct ``language, text`` of both sides of samples: ``source_language, source_text, target_language, target_text``."""
    source = pairs.select(F.col("source_language").alias("language"), F.col("source_text").alias("text"))
    return source.unionByName(pairs.select(F.col("target_language").alias("language"), F.col("target_text").alias("text"))).where("text is not null").distinct()


def encode_once(keys: DataFrame, path: str) -> DataFrame:
    """Ids of every distinct text of a language: ``language, digest, ids``; what a cache of encodings holds."""

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        texts = batch.column(2).to_pylist()
        return {"language": batch.column(0), "digest": batch.column(1), "ids": [e.ids for e in tokenizer(path).encode_batch(texts, add_special_tokens=False)]}

    return map_batches(keys.select("language", F.sha2("text", 256).alias("digest"), "text"), work, "language string, digest string, ids array<int>")


def cache_identity(keys: DataFrame, tokenizer_sha256: str, source_sha256: Sequence[str]) -> str:
    """Identity of a cache: its sources, its tokenizer and the set of its texts, whatever their order."""
    import hashlib

    digests = keys.select(F.sha2(F.concat_ws("\x1f", "language", "text"), 256).alias("d"))
    lanes = [F.sum(F.conv(F.substring("d", 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(5)]
    row = digests.agg(F.count("*").alias("n"), *lanes).first()
    return hashlib.sha256("|".join([tokenizer_sha256, *sorted(source_sha256), *map(str, row)]).encode()).hexdigest()


def merge_caches(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both caches; a text that both hold is an error."""
    shared = first.select("language", "digest").join(second.select("language", "digest"), ["language", "digest"])
    if shared.limit(1).count():
        raise ValueError("caches overlap")
    return first.unionByName(second)


def encode_pairs(pairs: DataFrame, cache: DataFrame, *, most_source: int, most_target: int, start: Mapping[str, int] | None = None, end: int | None = None) -> DataFrame:
    """Samples with the ids of both sides from a cache, cut to their lengths: adds ``source_ids, target_ids, source_cut, target_cut``.

    With ``start`` and ``end`` a side begins with its language's id and ends with the end id, both kept when it is cut. A
    text that the cache lacks is an error.
    """
    held = cache.select("language", "digest", "ids")
    rows = pairs
    for side, most in (("source", most_source), ("target", most_target)):
        mine = held.select(F.col("language").alias(f"{side}_language"), F.col("digest").alias("_digest"), F.col("ids").alias(f"{side}_ids"))
        rows = rows.withColumn("_digest", F.sha2(f"{side}_text", 256)).join(mine, [f"{side}_language", "_digest"], "left").drop("_digest")
        ids = F.when(F.col(f"{side}_ids").isNotNull(), F.col(f"{side}_ids")).otherwise(F.raise_error(F.concat(F.lit("no encoding of "), F.col(f"{side}_text"))))
        extra = (start is not None) + (end is not None)
        cut = F.slice(ids, 1, most - extra)
        if start is not None:
            first = F.try_element_at(F.create_map(*[F.lit(x) for pair in start.items() for x in pair]), F.col(f"{side}_language"))
            cut = F.concat(F.array(first.cast("int")), cut)
        if end is not None:
            cut = F.concat(cut, F.array(F.lit(end)))
        rows = rows.withColumn(f"{side}_cut", F.size(ids) > most - extra).withColumn(f"{side}_ids", cut)
    return rows


def word_feed(frame: DataFrame, text: str) -> DataFrame:
    """``word, occurrences`` of every piece between white space, marked at its start.

    Counted with partial aggregation, so the feed of a corpus of any size is as large as its distinct words.
    """
    pieces = frame.where(F.col(text).isNotNull()).select(F.explode(F.split(text, f"[{X.WHITE}]+")).alias("w")).where("w <> ''")
    return pieces.groupBy("w").agg(F.count("*").alias("occurrences")).select(F.concat(F.lit(MARK), "w").alias("word"), "occurrences")


def feed_state(feed: DataFrame) -> dict[str, int | str]:
    """What a finished feed is checked by: its words, their occurrences, and a digest that no order changes."""
    lanes = [F.sum(F.conv(F.substring(F.sha2(F.concat_ws("\x1f", "word", "occurrences"), 256), 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(5)]
    row = feed.agg(F.count("*").alias("words"), F.coalesce(F.sum("occurrences"), F.lit(0)).alias("occurrences"), *lanes).first()
    return {"words": row.words, "occurrences": row.occurrences, "digest": "-".join(str(row[f"s{i}"] or 0) for i in range(5))}


def parameters(*, width: int, inner: int, vocabulary: int, encoder: int, decoder: int) -> dict[str, float]:
    """Parameters of an encoder-decoder with shared embeddings, by part, and the MiB they take."""
    parts = {"embedding": vocabulary * width, "encoder": encoder * (4 * width**2 + 2 * width * inner), "decoder": decoder * (8 * width**2 + 2 * width * inner)}
    total = sum(parts.values())
    return parts | {"total": total} | {name: total * size / 2**20 for name, size in (("fp16_mib", 2), ("int8_mib", 1), ("int4_mib", 0.5))}

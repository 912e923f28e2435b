"""Aligned locales, pairs, directions and their audits."""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators.clean import utterance_reason

LANGUAGES = ("eng_Latn", "zho_Hans", "zho_Hant", "jpn_Jpan", "kor_Hang")


def pair_table(languages: tuple[str, ...] = LANGUAGES) -> list[tuple[str, str]]:
    """Undirected pairs in the order of the languages."""
    return list(combinations(languages, 2))


def routes(frame: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """All directed routes with their position."""
    rows = [(i, a, b, f"{a}->{b}") for i, (a, b) in enumerate(permutations(languages, 2))]
    return frame.sparkSession.createDataFrame(rows, "position int, source string, target string, route string")


def clean_key(key: Column) -> Column:
    """An alignment key without blanks around it, in lower case."""
    return F.lower(F.btrim(key))


def locale_states(locales: DataFrame) -> DataFrame:
    """One row per key and language: the least text, its reason, and whether copies disagree."""
    rows = locales.where("alignment_key is not null").withColumn("key", clean_key(F.col("alignment_key")))
    rows = rows.withColumn("clean", X.collapse(X.nfc("text")))
    rows = rows.withColumn("reason", utterance_reason(F.col("clean"), F.col("lang")))
    return rows.groupBy("key", "lang").agg(
        F.min(F.struct("clean", "reason", F.lower(F.btrim("split")).alias("split"))).alias("least"), F.count_distinct("clean").alias("versions")
    ).select("key", "lang", F.col("least.clean").alias("text"), F.col("least.reason").alias("reason"), F.col("least.split").alias("split"), "versions")


def missing_locales(locales: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """Keys that lack a language, with the sorted languages they lack."""
    held = locales.where("alignment_key is not null").groupBy(clean_key(F.col("alignment_key")).alias("key")).agg(F.collect_set("lang").alias("held"))
    lacking = F.array_except(F.array(*map(F.lit, sorted(languages))), "held")
    return held.select("key", F.size("held").alias("locales"), lacking.alias("missing")).where(F.size("missing") > 0)


def pair_samples(states: DataFrame, languages: tuple[str, ...] = LANGUAGES, most_ratio: float = 8.0) -> DataFrame:
    """Every key's language pairs with both texts and the first failing reason, prefixed by its language.

    One aggregation gathers a key's locales - as many as there are languages - into a map; the pairs are exploded from
    constants, so no join of the table with itself is needed.
    """
    grouped = states.groupBy("key").agg(
        F.map_from_entries(F.collect_list(F.struct("lang", F.struct("text", "reason", "split")))).alias("by")
    )
    pairs = F.array(*(F.struct(F.lit(a).alias("source"), F.lit(b).alias("target")) for a, b in pair_table(languages)))
    rows = grouped.withColumn("pair", F.explode(pairs)).select(
        "key", "pair.source", "pair.target", F.try_element_at("by", "pair.source").alias("s"), F.try_element_at("by", "pair.target").alias("t")
    )
    side = lambda tag, x: F.when(x.isNull(), F.concat(tag, F.lit(":missing"))).when(x["reason"].isNotNull(), F.concat(tag, F.lit(":"), x["reason"]))
    ratio = F.when(X.length_ratio(F.col("s.text"), F.col("t.text")) > most_ratio, F.lit("length_ratio"))
    copied = F.when(F.lower("s.text") == F.lower("t.text"), F.lit("cross_language_copy"))
    reason = F.coalesce(side(F.col("source"), F.col("s")), side(F.col("target"), F.col("t")), ratio, copied)
    return rows.select("key", "source", "target", F.col("s.text").alias("source_text"), F.col("t.text").alias("target_text"), reason.alias("reason"))


def both_directions(samples: DataFrame, swaps: dict[str, str]) -> DataFrame:
    """Every row and its reverse; ``swaps`` names the columns that change places. Adds ``direction``."""
    other = {**swaps, **{b: a for a, b in swaps.items()}}
    forward = F.struct(F.lit("forward").alias("direction"), *samples.columns)
    reverse = F.struct(F.lit("reverse").alias("direction"), *(F.col(other.get(c, c)).alias(c) for c in samples.columns))
    return samples.select(F.explode(F.array(forward, reverse)).alias("x")).select("x.*")


def relation_faults(directed: DataFrame, relation: list[str], source: str, target: str, split: str) -> DataFrame:
    """Relations that are not two rows in two directions in one split."""
    rows = directed.groupBy(*relation).agg(
        F.count("*").alias("rows"), F.count_distinct(F.concat_ws("->", source, target)).alias("directions"), F.count_distinct(split).alias("splits")
    )
    return rows.where("rows <> 2 or directions <> 2 or splits <> 1")


def unique_matches(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Join of two tables on a key that stands once on either side."""

    def once(frame: DataFrame, name: str) -> DataFrame:
        return frame.groupBy(key).agg(F.count("*").alias("n"), F.min(value).alias(name)).where("n = 1").drop("n")

    return once(left, "left_value").join(once(right, "right_value"), key)


def positional_join(left: DataFrame, right: DataFrame, position: str) -> DataFrame:
    """Two tables joined line by line; a line without a partner shows as ``unequal``."""
    joined = left.alias("l").join(right.alias("r"), F.col(f"l.{position}") == F.col(f"r.{position}"), "full")
    return joined.withColumn("unequal", F.col(f"l.{position}").isNull() | F.col(f"r.{position}").isNull())

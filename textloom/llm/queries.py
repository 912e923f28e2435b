"""The queries of the training-data problems, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import canonical, encoding, leakage, overlap, pairs, residue, spans, splits, stuffing, tokens
from textloom.session import load, spread, write_table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment keys whose component shows two splits or more."""
    locales, samples = load(spark, sf_dir, "locale_records", "encoded_samples")
    tied = samples.select(F.col("sample_group_id").alias("group"), F.col("provenance.alignment_key").alias("alignment_key"))
    return splits.crossing_keys(locales.select("alignment_key", "split"), tied)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every locale record and encoded sample once, with its component and its label: ``record_table, record_id, component, label``."""
    locales, samples = load(spark, sf_dir, "locale_records", "encoded_samples")
    tied = samples.select(F.col("sample_group_id").alias("g"), splits.blank_free("provenance.alignment_key").alias("alignment_key"))
    of_key = splits.key_components(tied, group="g", key="alignment_key")
    of_group = tied.join(of_key, "alignment_key").where("g is not null").groupBy("g").agg(F.min("component_key").alias("group_component"))
    left = (
        locales.select("lang", splits.blank_free("alignment_key").alias("alignment_key"), "source_record_id")
        .distinct()
        .join(of_key, "alignment_key", "left")
        .select(
            F.lit("locale_records").alias("record_table"),
            F.concat_ws("|", "lang", "source_record_id").alias("record_id"),
            F.coalesce("component_key", "alignment_key", F.concat_ws("|", F.lit("record"), "lang", "source_record_id")).alias("component"),
            F.col("lang").alias("label"),
        )
    )
    keyed = samples.select(
        "sample_id", F.col("sample_group_id").alias("g"), splits.blank_free("provenance.alignment_key").alias("alignment_key"), F.col("target_language").alias("label")
    ).dropDuplicates(["sample_id"])
    right = keyed.join(of_group, "g", "left").join(of_key, "alignment_key", "left").select(
        F.lit("encoded_samples").alias("record_table"),
        F.col("sample_id").alias("record_id"),
        F.coalesce("group_component", "component_key", "alignment_key", F.concat_ws("|", F.lit("group"), F.coalesce("g", "sample_id"))).alias("component"),
        "label",
    )
    return write_table(left.unionByName(right), "records").frame


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every locale record and encoded sample with its component and the split it is given."""
    rows, targets = _records(spark, sf_dir), load(spark, sf_dir, "split_targets")
    sizes = rows.groupBy("component", "label").agg(F.count("*").alias("records"))
    return rows.join(splits.assign_splits(sizes, targets), "component").select("record_table", "record_id", F.col("component").alias("component_key"), "split")


def p1_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each split and label, with their share against the target."""
    rows, targets = _records(spark, sf_dir), load(spark, sf_dir, "split_targets")
    sizes = write_table(rows.groupBy("component", "label").agg(F.count("*").alias("records")), "sizes").frame
    return splits.split_shares(sizes, splits.assign_splits(sizes, targets), targets)


def _name(column: str):
    """A source id or language tag in one spelling."""
    return F.lower(F.regexp_replace(F.trim(column), r"[\s_-]+", "_"))


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate and document once, with its estimated tokens and the slices it belongs to."""
    candidates, documents, catalog = load(spark, sf_dir, "text_candidates", "documents", "source_catalog")
    known = catalog.select(_name("source_id").alias("source"), F.col("domain").alias("known")).groupBy("source").agg(F.max("known").alias("known"))
    keep = ["candidate_id", "source_id", "language_tag", "domain", "student_tokens", "ingested_at"]
    counted = tokens.estimate_tokens(spread(candidates.select("text", *keep)).withColumn("ingested_at", F.unix_micros("ingested_at")), text="text", keep=keep)
    latest = F.struct("ingested_at", "tokens", "source_id", "language_tag", "domain", "student_tokens")
    once = counted.groupBy("candidate_id").agg(F.max(latest).alias("x")).select("candidate_id", "x.*")
    stated = F.when((F.col("student_tokens") > 0) & (F.col("student_tokens") <= 20 * F.greatest("tokens", F.lit(1))), F.col("student_tokens"))
    left = once.select(
        F.lit("text_candidates").alias("record_table"), F.col("candidate_id").alias("record_id"), _name("source_id").alias("source"),
        _name("language_tag").alias("language"), "domain", "tokens", stated.cast("bigint").alias("stated"),
    )
    right = tokens.estimate_tokens(spread(documents.select("text", "doc_id", "source", "lang", "domain")), text="text", keep=["doc_id", "source", "lang", "domain"]).select(
        F.lit("documents").alias("record_table"), F.col("doc_id").alias("record_id"), _name("source").alias("source"),
        _name("lang").alias("language"), "domain", "tokens", F.lit(None).cast("bigint").alias("stated"),
    )
    both = left.unionByName(right).join(known, "source", "left")
    return both.select("record_table", "record_id", "source", "language", F.coalesce("domain", "known").alias("domain"), "tokens", "stated")


def p2_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals of candidates and documents by source, language and domain."""
    return tokens.token_budget(p2_records(spark, sf_dir))


def p3_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct record of both tables with its consistent form."""
    candidates, entries = load(spark, sf_dir, "text_candidates", "text_entries")
    both = candidates.select(
        F.lit("text_candidates").alias("record_table"), F.col("candidate_id").alias("record_id"), "text"
    ).unionByName(
        entries.select(F.lit("text_entries").alias("record_table"), F.col("entry_id").alias("record_id"), F.col("normalized").alias("text"))
    )
    return canonical.canonical_text(both, "text", key=["record_table", "record_id"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records that look the same but are stored differently."""
    return canonical.same_look_pairs(p3_forms(spark, sf_dir), table="record_table", key="record_id")


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that look like another one stored differently, with their class."""
    return canonical.look_classes(p3_forms(spark, sf_dir), table="record_table", key="record_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that are or hold template residue, filler, error messages or script notices."""
    return residue.residue_evidence(spread(load(spark, sf_dir, "text_candidates").select("candidate_id", "text", "source_id")), key="candidate_id", text="text", host="source_id").select("candidate_id")


def _against_manifest(spark: SparkSession, sf_dir: str, found: DataFrame, field: str) -> DataFrame:
    """Counts of found candidates by shard and language beside what the manifest says."""
    candidates, manifest = load(spark, sf_dir, "text_candidates", "corpus_manifest")
    tag = F.lower(F.regexp_replace(F.trim("language_tag"), "-", "_"))
    slices = candidates.select("candidate_id", "shard_id", tag.alias("language_key")).dropDuplicates(["candidate_id"])
    counts = slices.join(found.select("candidate_id"), "candidate_id").groupBy("shard_id", "language_key").agg(F.count("*").alias("found"))
    stated = manifest.select("shard_id", "language", F.lower("language").alias("language_key"), F.col(f"filters.{field}").alias("stated"))
    return stated.join(counts, ["shard_id", "language_key"], "left").select(
        "shard_id", "language", F.coalesce("found", F.lit(0)).alias("found"), "stated", (F.coalesce("found", F.lit(0)) - F.col("stated")).alias("difference")
    )


def p4_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template residue by shard and language against the manifest's count."""
    return _against_manifest(spark, sf_dir, p4_found(spark, sf_dir), "template_residue")


def p5_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a training and an evaluation entry whose texts match, by kind of match."""
    return overlap.split_overlaps(load(spark, sf_dir, "text_entries"), key="entry_id", text="normalized", splits="splits")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a training and an evaluation entry that are the same or nearly so."""
    return p5_matches(spark, sf_dir).where("similar").select("left_id", "right_id")


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that match one on the other side, with their class and number of links."""
    return overlap.overlap_classes(load(spark, sf_dir, "text_entries"), key="entry_id", text="normalized", splits="splits")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matching entries by split and source of the entries and of their sample groups."""
    entries, samples = load(spark, sf_dir, "text_entries", "encoded_samples")
    found = write_table(p5_matches(spark, sf_dir), "overlaps").frame
    return overlap.overlap_report(found, entries, key="entry_id", splits="splits", source="source_id", groups="groups", samples=samples)


def p6_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate's share of keyword, link and tag stretches."""
    return stuffing.stuffing(spread(load(spark, sf_dir, "text_candidates").select("candidate_id", "text")), key="candidate_id", text="text")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates more than half of which is keywords, links or tags."""
    return p6_shares(spark, sf_dir).where(F.col("share") > stuffing.SHARE).select("candidate_id")


def p6_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword-stuffed candidates by shard and language against the manifest's count."""
    return _against_manifest(spark, sf_dir, p6_found(spark, sf_dir), "keyword_stuffing")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective translations with the first defect that applies."""
    return pairs.defects(
        load(spark, sf_dir, "hymt2_decode_ab"),
        key="id",
        source="source_text",
        answer="challenger_translation",
        source_language="source_language",
        target_language="target_language",
        sound="baseline_translation",
    )


def p7_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defects by route and type, with the share of the route's distinct records."""
    rows = load(spark, sf_dir, "hymt2_decode_ab").select("id", "route").dropDuplicates(["id"])
    totals = rows.groupBy("route").agg(F.count("*").alias("records"))
    counts = rows.join(p7_found(spark, sf_dir), "id").groupBy("route", "defect_type").agg(F.count("*").alias("defects"))
    return counts.join(totals, "route").select("route", "defect_type", "defects", "records", (F.col("defects") / F.col("records")).alias("share"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids by the 50k byte-level vocabulary, without special tokens."""
    return encoding.encode_corpus(load(spark, sf_dir, "documents"), key="doc_id", text="text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the evaluation items of which they hold at least half."""
    documents, items = load(spark, sf_dir, "documents", "reference_records")
    return leakage.leaks(documents, items, key="doc_id", text="text", item="item_id", passage="text")


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every evaluation item with the number of documents it leaked into and whether its policy blocks."""
    items = load(spark, sf_dir, "reference_records")
    counts = p9_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents"))
    rows = items.select("item_id", "reference_id", "kind", "policy").dropDuplicates(["item_id"])
    return rows.join(counts, "item_id", "left").withColumn("documents", F.coalesce("documents", F.lit(0))).withColumn(
        "blocking", (F.col("documents") > 0) & (F.col("policy") == "block")
    )


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents that share a stretch of at least 200 code points."""
    return spans.span_pairs(load(spark, sf_dir, "documents"), key="doc_id", text="text")


def p10_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share a stretch with another, with their class."""
    return spans.span_classes(load(spark, sf_dir, "documents"), key="doc_id", text="text")


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the share of it that stands elsewhere."""
    return spans.shared_shares(load(spark, sf_dir, "documents"), key="doc_id", text="text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = "p1_found p1_splits p1_shares p2_totals p2_records p3_found p3_classes p3_forms p4_found p4_manifest p5_found p5_matches p5_classes p5_report p6_found p6_shares p6_manifest p7_found p7_routes p8_ids p9_found p9_items p10_found p10_classes p10_shares".split()
    return {name: globals()[name] for name in names}

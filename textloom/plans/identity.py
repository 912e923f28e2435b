"""Content ids, hash splits and ranks over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import identity as I
from textloom.session import load

SEED = "20260713"


def hash_split_documents(spark, sf_dir):
    """Hold-out by url, else by text: the digest's first 64 bits below 3 % of their range."""
    docs = load(spark, sf_dir, "documents")
    key = F.coalesce("url", I.sha(F.col("text")), F.lit("missing"))
    held = I.hash_below(I.seeded(SEED, key), 0.03)
    return docs.select("doc_id", F.when(held, F.lit("holdout")).otherwise(F.lit("train")).alias("split"))


def component_split_mod(spark, sf_dir):
    """Split of every sample group by its own digest modulo 16521; `component_splits` keeps tied groups together."""
    groups = load(spark, sf_dir, "encoded_samples").select("sample_group_id").distinct()
    digest = I.sha(I.canonical_json({"group": F.col("sample_group_id")}))
    return groups.select("sample_group_id", I.hash_mod(digest, 16521).alias("place"), I.split_of(digest).alias("split"))


def content_ids(spark, sf_dir):
    """Canonical JSON identity of every aligned record."""
    rows = load(spark, sf_dir, "locale_records").distinct()
    body = I.canonical_json({"lang": F.col("lang"), "alignment_key": F.col("alignment_key"), "text": F.col("text"), "split": F.col("split")})
    return rows.select("lang", "source_record_id", F.concat(F.lit("record-sha256:"), I.sha(body)).alias("content_id"))


def alignment_keys(spark, sf_dir):
    """Canonical JSON key of record number and partition."""
    rows = load(spark, sf_dir, "locale_records").where("source_record_id is not null").select("source_record_id", "split").distinct()
    return rows.select("source_record_id", "split", F.to_json(F.struct(F.col("source_record_id").alias("id"), F.col("split").alias("partition")), {"ignoreNullFields": "false"}).alias("alignment_key"))


def group_ids(spark, sf_dir):
    """Identity of every alignment key over the content of its locales."""
    rows = load(spark, sf_dir, "locale_records").where("alignment_key is not null and text is not null")
    parts = rows.groupBy(F.lower(F.btrim("alignment_key")).alias("key")).agg(F.array_sort(F.collect_set(F.concat_ws("=", "lang", I.sha(F.col("text"))))).alias("p"))
    return parts.select("key", F.size("p").alias("parts"), F.concat(F.lit("group-sha256:"), I.sha(F.concat_ws("\n", F.col("key"), F.array_join("p", "\n")))).alias("group_id"))


def stable_ranks(spark, sf_dir):
    """Rank and 31-bit seed of every candidate."""
    rows = load(spark, sf_dir, "text_candidates").select("candidate_id", "source_id", "source_record_id").dropDuplicates(["candidate_id"])
    return rows.select("candidate_id", I.stable_rank("source_id", "source_record_id").alias("rank"), I.seed_31(F.lit(SEED), F.col("candidate_id").cast("string")).alias("seed"))


def blind_sides(spark, sf_dir):
    """Which side of a blind pair shows the challenger, by parity of a digest."""
    rows = load(spark, sf_dir, "hymt2_decode_ab").select("id", "route").dropDuplicates(["id"])
    return rows.withColumn("side", F.when(I.parity(I.sha(F.col("id"))) == 0, F.lit("A")).otherwise(F.lit("B"))).groupBy("route", "side").agg(F.count("*").alias("records"))


def trace_digest(spark, sf_dir):
    """Digest of each user's events in order, without noise columns: of parts of 1,024 numbers, then of the parts."""
    events = load(spark, sf_dir, "events").where("event_type <> 'view'")
    line = F.concat_ws("|", F.col("event_id").cast("string"), "event_type", "props")
    part = F.floor(F.col("event_id") / 1024).cast("bigint")
    parts = events.groupBy("user_id", part.alias("part")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))).alias("e"))
    parts = parts.select("user_id", "part", "n", I.sha(F.array_join(F.col("e.line"), "\n")).alias("d"))
    rows = parts.groupBy("user_id").agg(F.sum("n").alias("events"), F.array_sort(F.collect_list(F.struct("part", "d"))).alias("p"))
    return rows.select("user_id", "events", I.sha(F.array_join(F.col("p.d"), "\n")).alias("digest"))


_J = lambda c: f"coalesce(to_json({c})::varchar, 'null')"
_MOD = "list_reduce(list_prepend(0::bigint, list_transform(range(1, 65), lambda i: (strpos('0123456789abcdef', substr(d, i::int, 1)) - 1)::bigint)), lambda a, x: (a * 16 + x) % 16521)"

QUERIES = {f.__name__: f for f in (hash_split_documents, component_split_mod, content_ids, alignment_keys, group_ids, stable_ranks, blind_sides, trace_digest)}

SQL = {
    "hash_split_documents": f"select doc_id, case when substr(sha256('{SEED}' || chr(0) || coalesce(url, sha256(text), 'missing')), 1, 16) < '{int(0.03 * 2**64):016x}' then 'holdout' else 'train' end as split from documents",
    "component_split_mod": f"""with g as (select distinct sample_group_id, sha256('{{"group":' || {_J("sample_group_id")} || '}}' || chr(10)) as d from encoded_samples), m as (select *, {_MOD} as place from g)
select sample_group_id, place, case when place < 11514 then 'train' when place < 13547 then 'dev' else 'test' end as split from m""",
    "content_ids": f"""select lang, source_record_id, 'record-sha256:' || sha256('{{"alignment_key":' || {_J("alignment_key")} || ',"lang":' || {_J("lang")} || ',"split":' || {_J("split")} || ',"text":' || {_J("text")} || '}}' || chr(10)) as content_id from (select distinct * from locale_records)""",
    "alignment_keys": f"""select source_record_id, split, '{{"id":' || {_J("source_record_id")} || ',"partition":' || {_J("split")} || '}}' as alignment_key from (select distinct source_record_id, split from locale_records where source_record_id is not null)""",
    "group_ids": "with p as (select lower(trim(alignment_key)) as key, list_sort(list_distinct(list(lang || '=' || sha256(text)))) as p from locale_records where alignment_key is not null and text is not null group by 1) select key, len(p) as parts, 'group-sha256:' || sha256(key || chr(10) || array_to_string(p, chr(10))) as group_id from p",
    "stable_ranks": f"select candidate_id, sha256(concat_ws(chr(31), source_id, source_record_id)) as rank, ('0x' || substr(sha256('{SEED}' || chr(0) || candidate_id), 1, 8))::bigint % 2147483648 as seed from (select distinct on (candidate_id) * from text_candidates)",
    "blind_sides": "select route, case when (strpos('0123456789abcdef', substr(sha256(id), 2, 1)) - 1) % 2 = 0 then 'A' else 'B' end as side, count(*) as records from (select distinct on (id) id, route from hymt2_decode_ab) group by all",
    "trace_digest": "with p as (select user_id, event_id // 1024 as part, count(*) as n, sha256(string_agg(event_id || '|' || event_type || '|' || props, chr(10) order by event_id)) as d from events where event_type <> 'view' group by all) select user_id, sum(n)::bigint as events, sha256(string_agg(d, chr(10) order by part)) as digest from p group by user_id",
}

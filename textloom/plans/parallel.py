"""Alignment, pairs, directions, cohorts and their audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import parallel as P
from textloom.operators.select import ranked, top_per_group
from textloom.functions.identity import stable_rank
from textloom.plans import cleaning as C
from textloom.plans import sqltext as S
from textloom.session import load


def _states(spark, sf_dir):
    return P.locale_states(load(spark, sf_dir, "locale_records"))


def alignment_missing_keys(spark, sf_dir):
    """Alignment keys without all five locales."""
    found = P.missing_locales(load(spark, sf_dir, "locale_records"))
    return found.select("key", "locales", F.array_join("missing", ",").alias("missing"))


def alignment_conflicts(spark, sf_dir):
    """Locales of a key that disagree on text or split."""
    rows = load(spark, sf_dir, "locale_records").where("alignment_key is not null")
    per = rows.groupBy(P.clean_key(F.col("alignment_key")).alias("key")).agg(
        F.count_distinct(F.lower(F.btrim("split"))).alias("splits"), F.count("*").alias("records"), F.count_distinct("lang", "text").alias("texts")
    )
    return per.where("splits > 1 or records > texts")


def pair_samples(spark, sf_dir):
    """Pairs of every key by language pair and first failing reason."""
    rows = P.pair_samples(_states(spark, sf_dir))
    return rows.groupBy("source", "target", F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("pairs"))


def pair_length_ratios(spark, sf_dir):
    """Length ratio of accepted pairs: extremes and rounded mean."""
    rows = P.pair_samples(_states(spark, sf_dir)).where("reason is null")
    ratio = X.length_ratio(F.col("source_text"), F.col("target_text"))
    return rows.groupBy("source", "target").agg(F.count("*").alias("pairs"), F.round(F.min(ratio), 6).alias("least"), F.round(F.max(ratio), 6).alias("most"), F.round(F.avg(ratio), 6).alias("mean"))


def reverse_expansion(spark, sf_dir):
    """Accepted pairs in both directions, by route."""
    rows = P.pair_samples(_states(spark, sf_dir)).where("reason is null").drop("reason")
    both = P.both_directions(rows, {"source": "target", "source_text": "target_text"})
    return both.groupBy(F.concat_ws("->", "source", "target").alias("route"), "direction").agg(F.count("*").alias("samples"), F.sum(F.length("source_text")).alias("source_characters"))


def relation_audit(spark, sf_dir):
    """Sample relations that are not two rows in two directions."""
    rows = load(spark, sf_dir, "encoded_samples").dropDuplicates(["sample_id"]).where("sample_group_id is not null")
    low, high = F.least("source_language", "target_language"), F.greatest("source_language", "target_language")
    rows = rows.withColumn("pair", F.concat_ws("--", low, high)).withColumn("split", F.lit("all"))
    return P.relation_faults(rows, ["sample_group_id", "pair"], "source_language", "target_language", "split")


def multiparallel_groups(spark, sf_dir):
    """Keys with all five locales, as one row with a column per language."""
    rows = _states(spark, sf_dir).where("text is not null and text <> ''")
    wide = rows.groupBy("key").pivot("lang", list(P.LANGUAGES)).agg(F.first("text"))
    return wide.dropna()


def unique_english_matches(spark, sf_dir):
    """Japanese and Chinese texts joined on an English text that stands once on either side."""
    states = _states(spark, sf_dir).where("text is not null and text <> ''")
    english = states.where("lang = 'eng_Latn'").select("key", F.col("text").alias("english"))
    side = lambda tag: states.where(F.col("lang") == tag).select("key", F.col("text").alias("other")).join(english, "key").select("english", "other")
    return P.unique_matches(side("jpn_Jpan"), side("zho_Hans"), "english", "other")


def positional_alignment(spark, sf_dir):
    """English and Korean records joined by their number, with the lines that lack a partner."""
    rows = load(spark, sf_dir, "locale_records").select("lang", "source_record_id", "text").dropDuplicates(["lang", "source_record_id"])
    numbered = rows.withColumn("line", F.regexp_extract("source_record_id", r"([0-9]+)$", 1).cast("bigint")).where("line is not null")
    side = lambda tag: numbered.where(F.col("lang") == tag).groupBy("line").agg(F.min("text").alias("text"))
    joined = P.positional_join(side("eng_Latn"), side("kor_Hang"), "line")
    return joined.groupBy("unequal").agg(F.count("*").alias("lines"), F.count("l.text").alias("left_texts"), F.count("r.text").alias("right_texts"))


def reverse_pairs_bounded(spark, sf_dir):
    """Accepted answers turned round, at most half of a route's outgoing number, with numbers kept."""
    rows = load(spark, sf_dir, "hymt2_decode_ab").dropDuplicates(["id"]).where("challenger_filter_accepted and challenger_translation is not null")
    found = lambda c: F.array_sort(F.regexp_extract_all(F.col(c), F.lit(X.NUMBER), F.lit(0)))
    outgoing = rows.groupBy(F.col("source_language").alias("target"), F.col("target_language").alias("source")).agg(F.floor(F.count("*") / 2).alias("limit"))
    kept = rows.where(found("source_text") == found("challenger_translation")).select(
        "id", F.col("target_language").alias("source"), F.col("source_language").alias("target"), stable_rank("id").alias("rank_key")
    )
    top = top_per_group(kept.join(outgoing, ["source", "target"]), ["source", "target"], ["rank_key", "id"], F.col("limit"))
    return top.groupBy("source", "target").agg(F.count("*").alias("pairs"), F.max("limit").alias("limit"), F.min("rank_key").alias("first_rank"))


def cohort_match(spark, sf_dir):
    """Human and teacher samples matched on record and direction; what is left over on either side by route."""
    rows = load(spark, sf_dir, "encoded_samples").where("provenance.source_record_id is not null")
    kind = F.col("provenance.kind")
    keys = rows.groupBy(F.col("provenance.source_record_id").alias("record"), "source_language", "target_language").agg(
        F.bool_or(kind == "human_parallel").alias("human"), F.bool_or(kind == "teacher_generated").alias("teacher")
    )
    human, teacher = F.coalesce("human", F.lit(False)), F.coalesce("teacher", F.lit(False))
    state = F.when(human & teacher, "matched").when(human, "human_only").when(teacher, "teacher_only")
    keys = keys.withColumn("state", state).where("state is not null")
    return keys.groupBy(F.concat_ws("->", "source_language", "target_language").alias("route"), "state").agg(F.count("*").alias("samples"))


def verdict_comparison(spark, sf_dir):
    """Baseline against challenger: both pass, improves, regresses, both flagged."""
    rows = load(spark, sf_dir, "hymt2_decode_ab").dropDuplicates(["id"])
    base, new = F.col("baseline_filter_accepted"), F.when(F.col("exact_match"), F.col("baseline_filter_accepted")).otherwise(F.col("challenger_filter_accepted"))
    verdict = F.when(base & new, "both_pass").when(~base & new, "improves").when(base & ~new, "regresses").when(~base & ~new, "both_flagged").otherwise("unknown")
    return rows.groupBy("route", verdict.alias("verdict")).agg(F.count("*").alias("records"), F.count_if("exact_match").alias("identical"))


def provenance_fallback(spark, sf_dir):
    """Domain of every candidate: its own, else its source's, else its shard's most frequent one."""
    rows = load(spark, sf_dir, "text_candidates").select("candidate_id", "source_id", "shard_id", "domain").dropDuplicates(["candidate_id"])
    catalog = load(spark, sf_dir, "source_catalog").select("source_id", F.col("domain").alias("of_source"))
    counts = rows.where("domain is not null").groupBy("shard_id", "domain").agg(F.count("*").alias("n"))
    shard = counts.groupBy("shard_id").agg(F.min_by("domain", F.struct(-F.col("n"), "domain")).alias("of_shard"))
    found = rows.join(catalog, "source_id", "left").join(shard, "shard_id", "left")
    level = F.when(F.col("domain").isNotNull(), "own").when(F.col("of_source").isNotNull(), "source").when(F.col("of_shard").isNotNull(), "shard").otherwise("none")
    return found.groupBy(level.alias("level"), F.coalesce("domain", "of_source", "of_shard").alias("resolved")).agg(F.count("*").alias("records"))


def manifest_coverage(spark, sf_dir):
    """Candidates against the manifest: slices that are missing, unknown or differ."""
    candidates, manifest = load(spark, sf_dir, "text_candidates", "corpus_manifest")
    have = candidates.select("candidate_id", "shard_id", "language_tag").dropDuplicates(["candidate_id"]).groupBy("shard_id", F.col("language_tag").alias("language")).agg(F.count("*").alias("records"))
    stated = manifest.groupBy("shard_id", "language").agg(F.sum("documents").alias("documents"), F.count("*").alias("entries"))
    both = have.join(stated, ["shard_id", "language"], "full")
    state = F.when(F.col("entries").isNull(), "unknown").when(F.col("records").isNull(), "missing").when(F.col("entries") > 1, "repeated").when(F.col("records").eqNullSafe(F.col("documents")), "equal").otherwise("differs")
    return both.select("shard_id", "language", "records", "documents", state.alias("state"))


def generation_jobs(spark, sf_dir):
    """Jobs of every English utterance to each other language, the first 50 of a route by rank."""
    states = _states(spark, sf_dir).where("reason is null and lang = 'eng_Latn'").select("key", "text")
    targets = [t for t in P.LANGUAGES if t != "eng_Latn"]
    jobs = states.withColumn("target", F.explode(F.array(*map(F.lit, targets)))).withColumn("digest", stable_rank("key", "target"))
    return top_per_group(jobs, ["target"], ["digest", "key"], 50).select("target", "rank", "key", "digest")


def pending_jobs(spark, sf_dir):
    """Jobs without a journal entry: aligned records that no sample was made of."""
    states = _states(spark, sf_dir).where("reason is null").select("key", "lang")
    done = load(spark, sf_dir, "encoded_samples").where("provenance.alignment_key is not null").select(P.clean_key(F.col("provenance.alignment_key")).alias("key"), F.col("source_language").alias("lang")).distinct()
    return states.join(done, ["key", "lang"], "left_anti").groupBy("lang").agg(F.count("*").alias("pending"))


def truncated_sequences(spark, sf_dir):
    """Token lists cut to a maximum that keep their last id, by route."""
    rows = load(spark, sf_dir, "encoded_samples").dropDuplicates(["sample_id"]).where("input_ids is not null")
    most = 24
    cut = F.when(F.size("input_ids") > most, F.concat(F.slice("input_ids", 1, most - 1), F.slice("input_ids", -1, 1))).otherwise(F.col("input_ids"))
    return rows.groupBy(F.concat_ws("->", "source_language", "target_language").alias("route")).agg(
        F.count("*").alias("samples"), F.sum("source_original_tokens").alias("original_tokens"), F.sum(F.size(cut)).alias("used_tokens"),
        F.count_if(F.size("input_ids") > most).alias("truncated"), F.sum(F.aggregate(cut, F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("id_sum"),
    )


def padded_batches(spark, sf_dir):
    """Label lists padded with -100 to the longest of their batch of 32."""
    from pyspark.sql import Window as W

    rows = load(spark, sf_dir, "encoded_samples").dropDuplicates(["sample_id"]).where("labels is not null").select("sample_id", "target_language", "labels")
    rows = ranked(rows, "target_language", ["sample_id"]).withColumn("batch", F.floor(F.col("position") / 32).cast("int"))
    rows = rows.withColumn("width", F.max(F.size("labels")).over(W.partitionBy("target_language", "batch")))
    padded = F.concat("labels", F.array_repeat(F.lit(-100), F.col("width") - F.size("labels")))
    return rows.groupBy("target_language", "batch").agg(F.count("*").alias("rows"), F.max("width").alias("width"), F.sum(F.size(padded)).alias("cells"), F.sum(F.size(F.filter(padded, lambda x: x == -100))).alias("padding"))


_STATES = f"""
loc as (select *, lower(trim(alignment_key)) as key, {C._NFC("text")} as clean from locale_records where alignment_key is not null),
why as (select *, {C._UTTERANCE} as why from loc),
states as (select key, lang, arg_min(clean, k) as text, arg_min(why, k) as reason, count(distinct clean) as versions
  from (select *, row(clean is not null, clean, why is not null, why, lower(trim(split)) is not null, lower(trim(split))) as k from why) group by key, lang)
"""
_PAIRS = f"""
{_STATES}, wanted as (select * from (values {", ".join(f"('{a}','{b}')" for a, b in P.pair_table())}) t(source, target)),
keys as (select distinct key from states),
paired as (select k.key, w.source, w.target, s.key as sk, t.key as tk, s.text as source_text, t.text as target_text, s.reason as sr, t.reason as tr
  from keys k cross join wanted w left join states s on s.key = k.key and s.lang = w.source left join states t on t.key = k.key and t.lang = w.target),
pairs as (select *, case when sk is null then source || ':missing' when sr is not null then source || ':' || sr when tk is null then target || ':missing' when tr is not null then target || ':' || tr
  when {S.length_ratio("source_text", "target_text")} > 8.0 then 'length_ratio' when lower(source_text) = lower(target_text) then 'cross_language_copy' end as reason from paired)
"""
_ENC = "(select distinct on (sample_id) * from encoded_samples)"
_ENGLISH = "states where text is not null and text <> ''"

QUERIES = {
    f.__name__: f
    for f in (
        alignment_missing_keys, alignment_conflicts, pair_samples, pair_length_ratios, reverse_expansion, relation_audit, multiparallel_groups,
        unique_english_matches, positional_alignment, reverse_pairs_bounded, cohort_match, verdict_comparison, provenance_fallback,
        manifest_coverage, generation_jobs, pending_jobs, truncated_sequences, padded_batches,
    )
}

SQL = {
    "alignment_missing_keys": f"with h as (select lower(trim(alignment_key)) as key, list_distinct(list(lang)) as held from locale_records where alignment_key is not null group by 1), m as (select key, len(held) as locales, list_filter({sorted(P.LANGUAGES)!r}, lambda x: not list_contains(held, x)) as missing from h) select key, locales, array_to_string(missing, ',') as missing from m where len(missing) > 0",
    "alignment_conflicts": "select lower(trim(alignment_key)) as key, count(distinct lower(trim(split))) as splits, count(*) as records, count(distinct case when lang is not null and text is not null then lang || chr(0) || text end) as texts from locale_records where alignment_key is not null group by 1 having splits > 1 or records > texts",
    "pair_samples": f"with {_PAIRS} select source, target, coalesce(reason, 'accepted') as reason, count(*) as pairs from pairs group by all",
    "pair_length_ratios": f"with {_PAIRS} select source, target, count(*) as pairs, round(min(r), 6) as least, round(max(r), 6) as most, round(avg(r), 6) as mean from (select *, {S.length_ratio('source_text', 'target_text')} as r from pairs where reason is null) group by all",
    "reverse_expansion": f"with {_PAIRS} select route, direction, count(*) as samples, sum(n)::bigint as source_characters from (select source || '->' || target as route, 'forward' as direction, length(source_text) as n from pairs where reason is null union all select target || '->' || source, 'reverse', length(target_text) from pairs where reason is null) group by all",
    "relation_audit": f"select sample_group_id, least(source_language, target_language) || '--' || greatest(source_language, target_language) as pair, count(*) as rows, count(distinct source_language || '->' || target_language) as directions, 1::bigint as splits from {_ENC} where sample_group_id is not null group by 1, 2 having rows <> 2 or directions <> 2",
    "multiparallel_groups": f"with {_STATES} select key, {', '.join(f"max(text) filter (lang = '{t}') as {t}" for t in P.LANGUAGES)} from {_ENGLISH} group by key having count(distinct lang) = 5",
    "unique_english_matches": f"""with {_STATES}, e as (select key, text as english from {_ENGLISH} and lang = 'eng_Latn'),
l as (select english, min(text) as left_value from {_ENGLISH.replace("states where", "states join e using (key) where")} and lang = 'jpn_Jpan' group by 1 having count(*) = 1),
r as (select english, min(text) as right_value from {_ENGLISH.replace("states where", "states join e using (key) where")} and lang = 'zho_Hans' group by 1 having count(*) = 1)
select english, left_value, right_value from l join r using (english)""",
    "positional_alignment": "with n as (select lang, try_cast(regexp_extract(source_record_id, '([0-9]+)$', 1) as bigint) as line, text from (select distinct on (lang, source_record_id) lang, source_record_id, text from locale_records order by lang, source_record_id, text nulls first)), l as (select line, min(text) as t from n where lang = 'eng_Latn' and line is not null group by 1), r as (select line, min(text) as t from n where lang = 'kor_Hang' and line is not null group by 1) select (l.line is null or r.line is null) as unequal, count(*) as lines, count(l.t) as left_texts, count(r.t) as right_texts from l full join r on l.line = r.line group by 1",
    "reverse_pairs_bounded": f"with a as (select * from {C._AB} where challenger_filter_accepted and challenger_translation is not null), o as (select source_language as target, target_language as source, count(*) // 2 as lim from a group by 1, 2), k as (select id, target_language as source, source_language as target, sha256(id) as rk from a where list_sort({C._FOUND('source_text', X.NUMBER)}) = list_sort({C._FOUND('challenger_translation', X.NUMBER)})), n as (select *, row_number() over (partition by source, target order by rk, id) as n from k join o using (source, target)) select source, target, count(*) as pairs, max(lim) as limit, min(rk) as first_rank from n where n <= lim group by all".replace("as limit", 'as "limit"'),
    "cohort_match": f"with f as (select distinct provenance.kind as kind, provenance.source_record_id as r, source_language as s, target_language as t from {_ENC} where provenance.source_record_id is not null), h as (select r, s, t from f where kind = 'human_parallel'), g as (select r, s, t from f where kind = 'teacher_generated'), u as (select s, t, 'matched' as state from h where exists (select 1 from g where g.r = h.r and g.s = h.s and g.t = h.t) union all select s, t, 'human_only' from h where not exists (select 1 from g where g.r = h.r and g.s = h.s and g.t = h.t) union all select s, t, 'teacher_only' from g where not exists (select 1 from h where g.r = h.r and g.s = h.s and g.t = h.t)) select s || '->' || t as route, state, count(*) as samples from u group by all",
    "verdict_comparison": f"with v as (select route, exact_match, baseline_filter_accepted as b, case when exact_match then baseline_filter_accepted else challenger_filter_accepted end as c from {C._AB}) select route, case when b and c then 'both_pass' when not b and c then 'improves' when b and not c then 'regresses' when not b and not c then 'both_flagged' else 'unknown' end as verdict, count(*) as records, count(*) filter (exact_match) as identical from v group by all",
    "provenance_fallback": f"with c as (select candidate_id, source_id, shard_id, domain from {C._ONCE}), n as (select shard_id, domain, count(*) as n from c where domain is not null group by all), s as (select shard_id, arg_min(domain, row(-n, domain)) as of_shard from n group by 1), f as (select c.*, k.domain as of_source, of_shard from c left join source_catalog k using (source_id) left join s using (shard_id)) select case when domain is not null then 'own' when of_source is not null then 'source' when of_shard is not null then 'shard' else 'none' end as level, coalesce(domain, of_source, of_shard) as resolved, count(*) as records from f group by all",
    "manifest_coverage": f"with h as (select shard_id, language_tag as language, count(*) as records from {C._ONCE} group by all), m as (select shard_id, language, sum(documents)::bigint as documents, count(*) as entries from corpus_manifest group by all) select coalesce(h.shard_id, m.shard_id) as shard_id, coalesce(h.language, m.language) as language, records, documents, case when entries is null then 'unknown' when records is null then 'missing' when entries > 1 then 'repeated' when records is not distinct from documents then 'equal' else 'differs' end as state from h full join m on h.shard_id = m.shard_id and h.language = m.language",
    "generation_jobs": f"with {_STATES}, j as (select key, t.target, sha256(key || chr(31) || t.target) as digest from states cross join (values {', '.join(f"('{t}')" for t in P.LANGUAGES if t != 'eng_Latn')}) t(target) where reason is null and lang = 'eng_Latn'), n as (select *, row_number() over (partition by target order by digest, key) as rank from j) select target, rank, key, digest from n where rank <= 50",
    "pending_jobs": f"with {_STATES} select lang, count(*) as pending from states where reason is null and not exists (select 1 from encoded_samples e where lower(trim(e.provenance.alignment_key)) = states.key and e.source_language = states.lang) group by lang",
    "truncated_sequences": f"with c as (select *, case when len(input_ids) > 24 then list_append(input_ids[1:23], input_ids[-1]) else input_ids end as cut from {_ENC} where input_ids is not null) select source_language || '->' || target_language as route, count(*) as samples, sum(source_original_tokens)::bigint as original_tokens, sum(len(cut))::bigint as used_tokens, count(*) filter (len(input_ids) > 24) as truncated, sum(list_sum(cut))::bigint as id_sum from c group by 1",
    "padded_batches": f"with n as (select *, ((row_number() over (partition by target_language order by sample_id) - 1) // 32)::int as batch from {_ENC} where labels is not null), w as (select *, max(len(labels)) over (partition by target_language, batch) as width from n) select target_language, batch, count(*) as rows, max(width)::int as width, sum(width)::bigint as cells, sum(width - len(labels) + len(list_filter(labels, lambda x: x = -100)))::bigint as padding from w group by all",
}

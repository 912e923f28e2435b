"""Grouped summaries, quantile rules, gates, reconciliations."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import summary as M
from textloom.plans import sqltext as S
from textloom.session import load


def _answers(spark, sf_dir):
    return load(spark, sf_dir, "hymt2_decode_ab").dropDuplicates(["id"])


def _samples(spark, sf_dir):
    return load(spark, sf_dir, "encoded_samples").dropDuplicates(["sample_id"])


def quantiles_nearest(spark, sf_dir):
    """Document lengths by language: nearest-rank quantiles."""
    docs = load(spark, sf_dir, "documents").where("n_chars is not null")
    return docs.groupBy("lang").agg(
        F.min("n_chars").alias("least"), *(M.nearest_rank("n_chars", p).cast("bigint").alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)), F.max("n_chars").alias("most")
    )


def quantiles_truncated(spark, sf_dir):
    """Completion tokens by route: the value at floor((n - 1) * p) of the histogram."""
    return M.at_index(_answers(spark, sf_dir), ["route"], "challenger_completion_tokens", {"p50": 0.5, "p90": 0.9, "p99": 0.99}, "truncate")


def quantiles_even(spark, sf_dir):
    """Source tokens by language: the value at the half-even rounded index."""
    return M.at_index(_samples(spark, sf_dir), ["source_language"], "source_original_tokens", {"p50": 0.5, "p95": 0.95}, "even")


def latency_summary(spark, sf_dir):
    """Mean, interpolated median and throughput of generation by route."""
    rows = _answers(spark, sf_dir).where("challenger_latency_seconds is not null")
    return rows.groupBy("route").agg(
        F.count("*").alias("records"), F.round(F.avg("challenger_latency_seconds"), 6).alias("mean"), F.round(F.percentile("challenger_latency_seconds", 0.5), 6).alias("median"),
        F.round(F.sum("challenger_completion_tokens") / F.sum("challenger_latency_seconds"), 6).alias("tokens_per_second"),
    )


def grouped_results(spark, sf_dir):
    """Overall, by route, and by source language, in one pass over grouping sets."""
    rows = _answers(spark, sf_dir).withColumn("accepted", F.coalesce("challenger_filter_accepted", F.lit(False)))
    grouped = rows.groupingSets([[], [F.col("route")], [F.col("source_language")]], "route", "source_language").agg(
        F.count("*").alias("records"), F.count_if("accepted").alias("accepted"), F.count_if("exact_match").alias("identical"), F.sum(F.length("challenger_translation")).alias("characters")
    )
    return grouped.withColumn("slice", F.when(F.col("route").isNotNull(), "route").when(F.col("source_language").isNotNull(), "language").otherwise("overall"))


def reason_grouping_sets(spark, sf_dir):
    """Rejection reasons by reason, by route, and by both."""
    rows = _answers(spark, sf_dir).select("route", F.explode("challenger_rejection_reasons").alias("reason"))
    return rows.groupingSets([[F.col("reason")], [F.col("route")], [F.col("route"), F.col("reason")]], "route", "reason").agg(F.count("*").alias("records"))


def split_distributions(spark, sf_dir):
    """Aligned records of a language by split, as columns."""
    rows = load(spark, sf_dir, "locale_records").distinct()
    split = F.lower(F.btrim("split"))
    rows = rows.withColumn("s", F.when(split.isin("valid", "validation"), "dev").otherwise(F.coalesce(split, F.lit("none"))))
    return rows.groupBy("lang").pivot("s", ["train", "dev", "test", "none"]).agg(F.count(F.lit(1))).na.fill(0)


def token_weighted_rates(spark, sf_dir):
    """Acceptance by route weighted by tokens, and flags as rates."""
    rows = _answers(spark, sf_dir).where("challenger_completion_tokens is not null and challenger_filter_accepted is not null")
    weight = F.when(F.col("challenger_filter_accepted"), F.col("challenger_completion_tokens")).otherwise(0)
    return rows.groupBy("route").agg(
        F.round(F.sum(weight) / F.sum("challenger_completion_tokens"), 6).alias("weighted_acceptance"), F.round(F.avg(F.col("challenger_filter_accepted").cast("int")), 6).alias("acceptance"),
        F.round(F.avg(F.col("exact_match").cast("int")), 6).alias("identical"), F.count("*").alias("records"),
    )


def macro_and_micro(spark, sf_dir):
    """Acceptance pooled over all answers, and as the plain mean over routes."""
    rows = _answers(spark, sf_dir).where("challenger_filter_accepted is not null")
    per = rows.groupBy("route").agg(F.count("*").alias("n"), F.count_if("challenger_filter_accepted").alias("k"))
    return per.agg(F.count("*").alias("routes"), F.round(F.sum("k") / F.sum("n"), 6).alias("micro"), F.round(F.avg(F.col("k") / F.col("n")), 6).alias("macro"), F.round(F.min(F.col("k") / F.col("n")), 6).alias("least"))


def route_gates(spark, sf_dir):
    """Gates that routes fail."""
    per = _answers(spark, sf_dir).groupBy("route").agg(
        F.avg(F.coalesce("challenger_filter_accepted", F.lit(False)).cast("int")).alias("acceptance"), F.avg(F.coalesce(F.col("challenger_finish_reason") == "length", F.lit(False)).cast("int")).alias("cut"), F.count("*").alias("n")
    )
    return M.gates(per, "route", {"acceptance": F.col("acceptance") >= 0.95, "cut": F.col("cut") <= 0.02, "records": F.col("n") >= 20})


def reason_histogram(spark, sf_dir):
    """Reasons of candidates by language as a sorted text."""
    rows = load(spark, sf_dir, "text_candidates").select("candidate_id", "language_tag", "reason").dropDuplicates(["candidate_id"])
    counts = rows.groupBy("language_tag", F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count("*").alias("n"))
    parts = counts.groupBy("language_tag").agg(F.array_sort(F.collect_list(F.concat_ws("=", "reason", "n"))).alias("h"), F.sum("n").alias("records"))
    return parts.select("language_tag", F.array_join("h", ",").alias("histogram"), "records")


def token_cost(spark, sf_dir):
    """Cost of generation by language at tiered prices a million tokens."""
    rows = _answers(spark, sf_dir)
    asked, given = X.token_estimate(F.col("source_text")), F.coalesce("challenger_completion_tokens", F.lit(0))
    return rows.groupBy("target_language").agg(F.sum(asked).alias("asked"), F.sum(given).alias("given"), F.round((F.sum(asked) * 27 + F.sum(given) * 110) / 100 / 1e6, 6).alias("cost"))


def route_token_statistics(spark, sf_dir):
    """Original and kept tokens by route, and how many samples lost some."""
    rows = _samples(spark, sf_dir)
    return rows.groupBy(F.concat_ws("->", "source_language", "target_language").alias("route")).agg(
        F.count("*").alias("samples"), F.sum("source_original_tokens").alias("source_original"), F.sum(F.size(F.coalesce("input_ids", F.array()))).alias("source_kept"),
        F.sum("target_original_tokens").alias("target_original"), F.sum(F.size(F.coalesce("labels", F.array()))).alias("target_kept"),
        F.count_if(F.col("source_original_tokens") > F.size("input_ids")).alias("source_cut"),
    )


def manifest_differences(spark, sf_dir):
    """Manifest counts against recomputed ones, by shard and language."""
    candidates, manifest = load(spark, sf_dir, "text_candidates", "corpus_manifest")
    rows = candidates.select("candidate_id", "shard_id", "language_tag", "text").dropDuplicates(["candidate_id"])
    per = rows.groupBy("shard_id", F.col("language_tag").alias("language")).agg(
        F.count_if(F.coalesce(F.length("text"), F.lit(0)) == 0).alias("empty"), F.count_if(F.length("text").between(1, 19)).alias("short"), F.sum(F.length("text")).alias("characters")
    )
    flat = manifest.select("shard_id", "language", F.col("filters.empty").alias("stated_empty"), F.col("filters.too_short").alias("stated_short"), F.col("characters").alias("stated_characters"))
    return flat.join(per, ["shard_id", "language"], "left")


def named_assertions(spark, sf_dir):
    """Invariants of the encoded samples and how many rows break each."""
    rows = load(spark, sf_dir, "encoded_samples")
    return M.assertions(
        rows,
        {
            "directions_differ": F.col("source_language") != F.col("target_language"),
            "ids_within_original": F.size("input_ids") <= F.col("source_original_tokens"),
            "ids_not_negative": F.forall("input_ids", lambda x: x >= 0),
            "has_key": F.col("provenance.alignment_key").isNotNull(),
            "known_kind": F.col("provenance.kind").isin("human_parallel", "teacher_generated"),
        },
    )


def duplicate_ids(spark, sf_dir):
    """Delivered rows beyond the first of every table, one row a table."""
    from functools import reduce

    parts = []
    for table, key in (("text_candidates", "candidate_id"), ("encoded_samples", "sample_id"), ("text_entries", "entry_id"), ("hymt2_decode_ab", "id"), ("documents", "doc_id")):
        rows = load(spark, sf_dir, table)
        parts.append(rows.agg(F.lit(table).alias("record_table"), F.count("*").alias("delivered"), F.count_distinct(key).alias("records")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def arm_deltas(spark, sf_dir):
    """Acceptance of challenger less baseline by route, the least delta last of all."""
    rows = _answers(spark, sf_dir)
    rate = lambda c: F.avg(F.coalesce(F.col(c), F.lit(False)).cast("int"))
    per = rows.groupBy("route").agg(rate("baseline_filter_accepted").alias("b"), rate("challenger_filter_accepted").alias("c"))
    return per.select("route", F.round("b", 6).alias("baseline"), F.round("c", 6).alias("challenger"), F.round(F.col("c") - F.col("b"), 6).alias("delta"))


def best_arm(spark, sf_dir):
    """The source whose answers do best: highest acceptance, then fewest tokens, then name."""
    rows = _answers(spark, sf_dir).groupBy("source_id").agg(
        F.round(F.avg(F.coalesce("challenger_filter_accepted", F.lit(False)).cast("int")), 6).alias("acceptance"), F.round(F.avg("challenger_completion_tokens"), 6).alias("tokens"), F.count("*").alias("records")
    )
    return rows.orderBy(F.desc("acceptance"), "tokens", "source_id").limit(1)


def translation_scores(spark, sf_dir):
    """Corpus BLEU over 13a tokens and chrF of the challenger against the baseline, by route."""
    return _scores(spark, sf_dir, "13a", 0)


def translation_scores_char(spark, sf_dir):
    """Corpus BLEU over characters and chrF++ of the challenger against the baseline, by route."""
    return _scores(spark, sf_dir, "char", 2)


def _scores(spark, sf_dir, tokens, word_order):
    rows = M.corpus_scores(_answers(spark, sf_dir), "route", "challenger_translation", "baseline_translation", tokens=tokens, word_order=word_order)
    return rows.select("route", "records", F.round("bleu", 6).alias("bleu"), F.round("chrf", 6).alias("chrf"))


def replay_consistency(spark, sf_dir):
    """Whether redelivered answers equal each other, column by column."""
    rows = load(spark, sf_dir, "hymt2_decode_ab").groupBy("id").agg(F.count("*").alias("n"), F.count_distinct(F.coalesce(F.sha2("challenger_translation", 256), F.lit("none"))).alias("answers"), F.count_distinct("challenger_seed").alias("seeds"))
    return rows.groupBy("n").agg(F.count("*").alias("ids"), F.count_if(F.col("answers") > 1).alias("differing"), F.count_if(F.col("seeds") > 1).alias("reseeded"))


_AB = "(select distinct on (id) * from hymt2_decode_ab)"


def _scores_sql(tokens: str, word_order: int) -> str:
    """N-grams of both sides unnested and counted, the smaller counts summed; the scores over the sums."""
    text = "replace(replace(replace(t, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    for name, char in M.ENTITIES:
        text = f"replace({text}, {S.quoted(name)}, {S.quoted(char)})"
    text = f"' ' || {text} || ' '"
    for pattern, new in M.TOKEN_RULES:
        text = f"regexp_replace({text}, {S.quoted(pattern)}, {S.quoted(new)}, 'g')"
    white = S.quoted(f"[{X.WHITE}]+")
    words = lambda t: f"list_filter(regexp_split_to_array({t}, {white}), lambda w: w <> '')"
    chars = f"list_filter(string_split(regexp_replace(t, {white}, '', 'g'), ''), lambda c: c <> '')"
    marks = S.quoted("[!-/:-@\\[-`{-~]")
    piece = f"case when length(w) > 1 and regexp_matches(right(w, 1), {marks}) then [left(w, -1), right(w, 1)] when length(w) > 1 and regexp_matches(left(w, 1), {marks}) then [left(w, 1), substr(w, 2)] else [w] end"
    kinds = [("b", words(text) if tokens == "13a" else chars, M.ORDERS), ("c", chars, M.CHARACTER_ORDER), ("w", f"flatten(list_transform({words('t')}, lambda w: {piece}))", word_order)]
    unions = " union all ".join(f"select id, route, side, '{k}' as kind, {items} as x, unnest(range(1, {order + 1})) as n from texts" for k, items, order in kinds if order)
    orders = [("b", n) for n in range(1, M.ORDERS + 1)], [(k, n) for k, _, order in kinds[1:] for n in range(1, order + 1)]
    pick = lambda k, n, what: f"coalesce(max({what}) filter (kind = '{k}' and n = {n}), 0)"
    wide = ", ".join(f"{pick(k, n, w)} as {k}{n}{w[0]}" for k, n in [*orders[0], *orders[1]] for w in ("match", "hyp", "ref"))
    live = [" and ".join(f"b{m}h > 0" for m in range(1, n + 1)) for n in range(1, M.ORDERS + 1)]
    zeros = [" + ".join(f"(b{m}m = 0)::int" for m in range(1, n + 1)) for n in range(1, M.ORDERS + 1)]
    logs = " + ".join(f"case when {live[n - 1]} then ln(case when b{n}m > 0 then 100.0 * b{n}m / b{n}h else 100.0 / (power(2, {zeros[n - 1]}) * b{n}h) end) else 0 end" for n in range(1, M.ORDERS + 1))
    used = " + ".join(f"({x})::int" for x in live)
    bleu = f"case when {' + '.join(f'b{n}m' for n in range(1, M.ORDERS + 1))} > 0 then (case when b1h >= b1r then 1.0 else exp(1 - b1r / b1h) end) * exp(({logs}) / ({used})) else 0 end"
    both = [f"({k}{n}h > 0 and {k}{n}r > 0)" for k, n in orders[1]]
    mean = lambda side: f"(({' + '.join(f'case when {b} then {k}{n}m / {k}{n}{side} else 0 end' for b, (k, n) in zip(both, orders[1], strict=True))}) / greatest({' + '.join(f'{b}::int' for b in both)}, 1))"
    return f"""
with texts as (select id, route, 'h' as side, coalesce(challenger_translation, '') as t from {_AB} union all select id, route, 'r', coalesce(baseline_translation, '') from {_AB}),
items as ({unions}),
grams as (select id, route, side, kind, n, array_to_string(x[i:i + n - 1], chr(31)) as g from (select *, unnest(range(1, len(x) - n + 2)) as i from items)),
counted as (select id, route, kind, n, g, count(*) filter (side = 'h') as a, count(*) filter (side = 'r') as b from grams group by all),
pairs as (select id, route, kind, n, sum(least(a, b)) as match, case when kind = 'b' or sum(b) > 0 then sum(a) else 0 end as hyp, sum(b) as ref from counted group by id, route, kind, n),
sums as (select route, kind, n, sum(match)::double as match, sum(hyp)::double as hyp, sum(ref)::double as ref from pairs group by all),
wide as (select route, {wide} from sums group by route),
scored as (select route, {bleu} as bleu, {mean('h')} as p, {mean('r')} as r from wide)
select route, count(*) as records, coalesce(max(round(bleu, 6)), 0) as bleu, coalesce(max(round(case when p + r > 0 then 100 * {1 + M.BETA**2} * p * r / ({M.BETA**2} * p + r) else 0 end, 6)), 0) as chrf from {_AB} left join scored using (route) group by route"""


_ONCE = "(select distinct on (candidate_id) * from text_candidates)"
_ENC = "(select distinct on (sample_id) * from encoded_samples)"


def _index_sql(table: str, group: str, value: str, shares: dict[str, float], rule: str) -> str:
    at = "floor((n - 1) * {p})" if rule == "truncate" else "round_even((n - 1) * {p}, 0)"
    picks = ", ".join(f"max(v) filter (k = {at.format(p=p)}) as {name}" for name, p in shares.items())
    return f"with r as (select {group}, {value} as v, row_number() over (partition by {group} order by {value}) - 1 as k, count(*) over (partition by {group}) as n from {table} where {value} is not null) select {group}, {picks} from r group by {group}"


QUERIES = {
    f.__name__: f
    for f in (
        quantiles_nearest, quantiles_truncated, quantiles_even, latency_summary, grouped_results, reason_grouping_sets, split_distributions,
        token_weighted_rates, macro_and_micro, route_gates, reason_histogram, token_cost, route_token_statistics, manifest_differences,
        named_assertions, duplicate_ids, arm_deltas, best_arm, translation_scores, translation_scores_char, replay_consistency,
    )
}

SQL = {
    "translation_scores": _scores_sql("13a", 0),
    "translation_scores_char": _scores_sql("char", 2),
    "quantiles_nearest": "select lang, min(n_chars) as least, quantile_disc(n_chars, 0.5) as p50, quantile_disc(n_chars, 0.95) as p95, quantile_disc(n_chars, 0.99) as p99, max(n_chars) as most from documents where n_chars is not null group by lang",
    "quantiles_truncated": _index_sql(_AB, "route", "challenger_completion_tokens", {"p50": 0.5, "p90": 0.9, "p99": 0.99}, "truncate"),
    "quantiles_even": _index_sql(_ENC, "source_language", "source_original_tokens", {"p50": 0.5, "p95": 0.95}, "even"),
    "latency_summary": f"select route, count(*) as records, round(avg(challenger_latency_seconds), 6) as mean, round(quantile_cont(challenger_latency_seconds, 0.5), 6) as median, round(sum(challenger_completion_tokens) / sum(challenger_latency_seconds), 6) as tokens_per_second from {_AB} where challenger_latency_seconds is not null group by route",
    "grouped_results": f"select route, source_language, case when route is not null then 'route' when source_language is not null then 'language' else 'overall' end as slice, count(*) as records, count(*) filter (coalesce(challenger_filter_accepted, false)) as accepted, count(*) filter (exact_match) as identical, sum(length(challenger_translation))::bigint as characters from {_AB} group by grouping sets ((), (route), (source_language))",
    "reason_grouping_sets": f"select route, reason, count(*) as records from (select route, unnest(challenger_rejection_reasons) as reason from {_AB}) group by grouping sets ((reason), (route), (route, reason))",
    "split_distributions": "with r as (select lang, case when lower(trim(split)) in ('valid', 'validation') then 'dev' else coalesce(lower(trim(split)), 'none') end as s from (select distinct * from locale_records)) select lang, count(*) filter (s = 'train') as train, count(*) filter (s = 'dev') as dev, count(*) filter (s = 'test') as test, count(*) filter (s = 'none') as none from r group by lang",
    "token_weighted_rates": f"select route, round(sum(case when challenger_filter_accepted then challenger_completion_tokens else 0 end) / sum(challenger_completion_tokens), 6) as weighted_acceptance, round(avg(challenger_filter_accepted::int), 6) as acceptance, round(avg(exact_match::int), 6) as identical, count(*) as records from {_AB} where challenger_completion_tokens is not null and challenger_filter_accepted is not null group by route",
    "macro_and_micro": f"with p as (select route, count(*) as n, count(*) filter (challenger_filter_accepted) as k from {_AB} where challenger_filter_accepted is not null group by route) select count(*) as routes, round(sum(k) / sum(n), 6) as micro, round(avg(k / n), 6) as macro, round(min(k / n), 6) as least from p",
    "route_gates": f"with p as (select route, avg(coalesce(challenger_filter_accepted, false)::int) as a, avg(coalesce(challenger_finish_reason = 'length', false)::int) as c, count(*) as n from {_AB} group by route) select route, unnest(list_filter([case when not a >= 0.95 then 'acceptance' end, case when not c <= 0.02 then 'cut' end, case when not n >= 20 then 'records' end], lambda x: x is not null)) as gate from p",
    "reason_histogram": f"with c as (select language_tag, coalesce(reason, 'none') as reason, count(*) as n from {_ONCE} group by all) select language_tag, string_agg(reason || '=' || n, ',' order by reason || '=' || n) as histogram, sum(n)::bigint as records from c group by 1",
    "token_cost": f"with r as (select target_language, {S.token_estimate('source_text')} as a, coalesce(challenger_completion_tokens, 0) as g from {_AB}) select target_language, sum(a)::bigint as asked, sum(g)::bigint as given, round((sum(a) * 27 + sum(g) * 110) / 100 / 1e6, 6) as cost from r group by 1",
    "route_token_statistics": f"select source_language || '->' || target_language as route, count(*) as samples, sum(source_original_tokens)::bigint as source_original, sum(coalesce(len(input_ids), 0))::bigint as source_kept, sum(target_original_tokens)::bigint as target_original, sum(coalesce(len(labels), 0))::bigint as target_kept, count(*) filter (source_original_tokens > len(input_ids)) as source_cut from {_ENC} group by 1",
    "manifest_differences": f"with p as (select shard_id, language_tag as language, count(*) filter (coalesce(length(text), 0) = 0) as empty, count(*) filter (length(text) between 1 and 19) as short, sum(length(text))::bigint as characters from {_ONCE} group by all) select m.shard_id, m.language, m.filters.empty as stated_empty, m.filters.too_short as stated_short, m.characters as stated_characters, p.empty, p.short, p.characters from corpus_manifest m left join p on p.shard_id = m.shard_id and p.language = m.language",
    "named_assertions": "with c as (select count(*) filter (not coalesce(source_language <> target_language, false)) as directions_differ, count(*) filter (not coalesce(len(input_ids) <= source_original_tokens, false)) as ids_within_original, count(*) filter (not coalesce(len(list_filter(input_ids, lambda x: x < 0)) = 0, false)) as ids_not_negative, count(*) filter (provenance.alignment_key is null) as has_key, count(*) filter (not coalesce(provenance.kind in ('human_parallel', 'teacher_generated'), false)) as known_kind from encoded_samples) unpivot c on columns(*) into name assertion value violations",
    "duplicate_ids": " union all ".join(f"select '{t}' as record_table, count(*) as delivered, count(distinct {k}) as records from {t}" for t, k in (("text_candidates", "candidate_id"), ("encoded_samples", "sample_id"), ("text_entries", "entry_id"), ("hymt2_decode_ab", "id"), ("documents", "doc_id"))),
    "arm_deltas": f"with p as (select route, avg(coalesce(baseline_filter_accepted, false)::int) as b, avg(coalesce(challenger_filter_accepted, false)::int) as c from {_AB} group by 1) select route, round(b, 6) as baseline, round(c, 6) as challenger, round(c - b, 6) as delta from p",
    "best_arm": f"select source_id, round(avg(coalesce(challenger_filter_accepted, false)::int), 6) as acceptance, round(avg(challenger_completion_tokens), 6) as tokens, count(*) as records from {_AB} group by 1 order by acceptance desc, tokens, source_id limit 1",
    "replay_consistency": "with r as (select id, count(*) as n, count(distinct coalesce(sha256(challenger_translation), 'none')) as answers, count(distinct challenger_seed) as seeds from hymt2_decode_ab group by id) select n, count(*) as ids, count(*) filter (answers > 1) as differing, count(*) filter (seeds > 1) as reseeded from r group by n",
}

"""Prompts, review batches, contracts and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.functions.identity import parity, sha, stable_rank
from textloom.operators import review as R
from textloom.operators import select as O
from textloom.plans import sqltext as S
from textloom.session import load

PROMPT = "Translate the following text into {target}. Only output the translated result:\n\n{text}"


def _answers(spark, sf_dir):
    return load(spark, sf_dir, "hymt2_decode_ab").dropDuplicates(["id"])


def _batched(spark, sf_dir):
    rows = _answers(spark, sf_dir).select("id", "route", "source_text", "challenger_translation", X.token_estimate(F.col("source_text")).alias("tokens"))
    return O.ranked(rows, "route", ["id"]).withColumn("batch", F.floor(F.col("position") / 12).cast("int")).drop("position")


def prompts(spark, sf_dir):
    """Digest and length of every answer's prompt."""
    body = R.render(PROMPT, {"target": F.col("target_language"), "text": F.col("source_text")})
    return _answers(spark, sf_dir).select("id", F.length(body).alias("characters"), sha(body).alias("digest"))


def request_payloads(spark, sf_dir):
    """One request of each batch: items, length and digest of its JSON."""
    rows = R.payloads(_batched(spark, sf_dir), ["route", "batch"], "id", ["id", "source_text"])
    return rows.select("route", "batch", "items", F.length("payload").alias("characters"), sha(F.col("payload")).alias("digest"))


def batch_plan(spark, sf_dir):
    """The frozen plan of review batches."""
    return R.batch_plan(_batched(spark, sf_dir), ["route", "batch"], "id", "tokens")


def decision_contract(spark, sf_dir):
    """Faults of the stored review reasons against the queue of rejected answers."""
    rows = load(spark, sf_dir, "hymt2_decode_ab")
    decisions = rows.where("challenger_rejection_reasons is not null").select(
        "id", F.when(F.col("challenger_filter_accepted"), "pass").otherwise("fail").alias("verdict"), F.col("challenger_rejection_reasons").alias("categories"),
        F.substring("challenger_translation", 1, 12).alias("evidence"),
    )
    items = rows.where("not exact_match").select("id", "challenger_translation").distinct()
    faults = R.decision_faults(decisions, items, "id", verdicts=["pass", "fail"], categories=["source_copy", "truncated", "empty_output"], text="challenger_translation")
    return faults.groupBy("fault").agg(F.count("*").alias("ids"))


def final_verdicts(spark, sf_dir):
    """Rule verdicts corrected by hand: answers with a length finish are rejected, exact matches accepted."""
    rows = _answers(spark, sf_dir)
    final = R.finalize(F.col("challenger_filter_accepted"), F.col("challenger_finish_reason") == "length", F.col("exact_match"))
    return rows.groupBy("route").agg(F.count_if(final).alias("accepted"), F.count_if(~final).alias("filtered"), F.count_if(final & ~F.coalesce("challenger_filter_accepted", F.lit(False))).alias("by_hand"))


def run_contracts(spark, sf_dir):
    """Identity of each route's ordered inputs."""
    rows = _answers(spark, sf_dir).withColumn("digest", sha(F.col("source_text")))
    return R.contract_identity(rows, ["route"], "id", ["id", "digest", "target_language"])


def prefix_property(spark, sf_dir):
    """Whether the five first of a route's sample begin its twenty first."""
    rows = _answers(spark, sf_dir).select("id", "route").withColumn("digest", stable_rank("route", "id"))
    small, large = (O.top_per_group(rows, ["route"], ["digest", "id"], n) for n in (5, 20))
    return R.is_prefix(small, large, ["route"], "rank", "id")


def checkpoint_gaps(spark, sf_dir):
    """Languages whose record numbers do not run from 0 without a gap."""
    rows = load(spark, sf_dir, "locale_records").withColumn("n", F.regexp_extract("source_record_id", r"([0-9]+)$", 1).cast("bigint")).where("n is not null")
    return R.contiguous(rows.select("lang", "n").distinct(), ["lang"], "n")


def blind_queue(spark, sf_dir):
    """Blind review queue: disagreements first, sides by parity, by kind and side."""
    rows = _answers(spark, sf_dir).where("not exact_match and challenger_translation is not null")
    kind = F.when(F.col("baseline_filter_accepted") != F.col("challenger_filter_accepted"), "disagree").otherwise("agree")
    rows = rows.select("id", kind.alias("kind"), F.when(parity(sha(F.col("id"))) == 0, "left").otherwise("right").alias("side"), sha(F.col("id")).alias("digest"))
    top = O.bottom_k(rows, [F.when(F.col("kind") == "disagree", 0).otherwise(1), F.col("digest"), F.col("id")], 100)
    return top.groupBy("kind", "side").agg(F.count("*").alias("items"), F.min("id").alias("first_id"))


def training_rows(spark, sf_dir):
    """Accepted answers as training rows: trimmed, both sides present, by route with a digest of all of them."""
    rows = _answers(spark, sf_dir).where("challenger_filter_accepted").select("id", "route", X.collapse(F.col("source_text")).alias("s"), X.collapse(F.col("challenger_translation")).alias("t"))
    rows = rows.where("s <> '' and t <> ''").withColumn("d", sha(F.concat_ws("\x1f", "route", "s", "t")))
    return rows.groupBy("route").agg(F.count("*").alias("rows"), F.count_distinct("d").alias("distinct_rows"), F.sum(F.length("s") + F.length("t")).alias("characters"), F.min("d").alias("least_digest"))


def input_ids(spark, sf_dir):
    """Which of three ids a row is known by."""
    rows = _answers(spark, sf_dir)
    chosen = F.coalesce("source_record_id", "semantic_group_id", "id")
    which = F.when(F.col("source_record_id").isNotNull(), "record").when(F.col("semantic_group_id").isNotNull(), "group").otherwise("row")
    return rows.groupBy(which.alias("kind")).agg(F.count("*").alias("records"), F.count_distinct(chosen).alias("distinct_ids"))


def marginal_examples(spark, sf_dir):
    """The first Cyrillic character, arrow or emoji of Japanese and Korean documents, with ten characters to each side; `foreign_examples` has all languages and scripts."""
    docs = load(spark, sf_dir, "documents").where("text is not null and lang in ('jpn_Jpan', 'kor_Hang')")
    odd = r"[\x{400}-\x{4FF}\x{2190}-\x{21FF}\x{1F300}-\x{1FAFF}]"
    # The length of what stands before it: positions of matches count UTF-16 units, lengths count code points.
    at = F.length(F.regexp_extract("text", rf"(?s)^(.*?){odd}", 1)) + 1
    return docs.where(F.rlike("text", F.lit(odd))).withColumn("spot", at).select("doc_id", "lang", "spot", F.expr("substring(text, greatest(spot - 10, 1), 21)").alias("context"))


def foreign_examples(spark, sf_dir):
    """The first letter or pictorial symbol outside the language's scripts of every document, with ten characters to each side.

    Languages are those of the script table. Digits, punctuation, white space, combining marks, modifier letters and the
    signs of ASCII and Latin-1 are shared by all scripts and foreign to none.
    """
    docs = load(spark, sf_dir, "documents").where("text is not null")
    # Letters without those of the language, and symbols beyond Latin-1: arrows, shapes, emoji.
    classes = {tag: rf"[\p{{L}}\p{{So}}\x{{2190}}-\x{{21FF}}\x{{1F300}}-\x{{1FAFF}}&&[^\p{{Lm}}\x{{0}}-\x{{40}}\x{{5B}}-\x{{60}}\x{{7B}}-\x{{BF}}{''.join(X.SCRIPTS[s] for s in names)}]]" for tag, names in X.EXPECTED.items()}
    before, found = F.lit(None).cast("string"), F.lit(False)
    for tag, odd in classes.items():
        before = F.when(F.col("lang") == tag, F.regexp_extract("text", rf"(?s)^(.*?){odd}", 1)).otherwise(before)
        found = F.when(F.col("lang") == tag, F.rlike("text", F.lit(odd))).otherwise(found)
    rows = docs.where(found).withColumn("spot", F.length(before) + 1)
    return rows.select("doc_id", "lang", "spot", F.expr("substring(text, greatest(spot - 10, 1), 21)").alias("context"))


_AB = "(select distinct on (id) * from hymt2_decode_ab)"
_BATCH = f"b as (select *, ((row_number() over (partition by route order by id) - 1) // 12)::int as batch, {S.token_estimate('source_text')} as tokens from {_AB})"
_BODY = S.quoted(PROMPT).replace("{target}", "' || target_language || '").replace("{text}", "' || source_text || '")



def _foreign_sql() -> str:
    """Characters one by one: a letter or pictorial sign that is neither shared by all scripts nor of the language's own."""
    own = " ".join(f"when '{tag}' then {S.quoted('[' + ''.join(X.SCRIPTS[s] for s in names) + ']')}" for tag, names in X.EXPECTED.items())
    some = S.quoted(r"[\p{L}\p{So}\x{2190}-\x{21FF}\x{1F300}-\x{1FAFF}]")
    shared = S.quoted(r"[\p{Lm}\x{0}-\x{40}\x{5B}-\x{60}\x{7B}-\x{BF}]")
    odd = f"lambda c: regexp_matches(c, {some}) and not regexp_matches(c, {shared}) and not regexp_matches(c, own)"
    return f"""with d as (select doc_id, lang, text, string_split(text, '') as chars, case lang {own} end as own from documents where text is not null and text <> '' and lang in ({', '.join(f"'{t}'" for t in X.EXPECTED)})),
f as (select doc_id, lang, text, list_position(list_transform(chars, {odd}), true) as spot from d)
select doc_id, lang, spot::int as spot, substr(text, greatest(spot - 10, 1), 21) as context from f where spot > 0"""


QUERIES = {
    f.__name__: f
    for f in (
        prompts, request_payloads, batch_plan, decision_contract, final_verdicts, run_contracts, prefix_property, checkpoint_gaps,
        blind_queue, training_rows, input_ids, marginal_examples, foreign_examples,
    )
}

SQL = {
    "prompts": f"select id, length({_BODY}) as characters, sha256({_BODY}) as digest from {_AB}",
    "request_payloads": f"""with {_BATCH}, p as (select route, batch, count(*) as items, '{{"items":[' || string_agg('{{"id":' || to_json(id)::varchar || ',"source_text":' || to_json(source_text)::varchar || '}}', ',' order by id) || ']}}' as payload from b group by all) select route, batch, items, length(payload) as characters, sha256(payload) as digest from p""",
    "batch_plan": f"with {_BATCH} select route, batch, count(*) as items, sum(tokens)::bigint as tokens, min(id) as first_item, max(id) as last_item, sha256(string_agg(id, chr(10) order by id)) as identity from b group by all",
    "decision_contract": "with d as (select id, count(*) as answers, any_value(case when challenger_filter_accepted then 'pass' else 'fail' end) as verdict, any_value(challenger_rejection_reasons) as c, any_value(substr(challenger_translation, 1, 12)) as e from hymt2_decode_ab where challenger_rejection_reasons is not null group by id), i as (select distinct id, challenger_translation as t from hymt2_decode_ab where not exact_match), f as (select unnest([case when i.id is null then 'unknown' end, case when d.id is null then 'missing' end, case when answers > 1 then 'repeated' end, case when len(list_filter(coalesce(c, []), lambda x: x not in ('source_copy', 'truncated', 'empty_output'))) > 0 then 'category' end, case when not contains(t, e) then 'evidence' end]) as fault from d full join i on d.id = i.id) select fault, count(*) as ids from f where fault is not null group by 1",
    "final_verdicts": f"with v as (select route, coalesce(challenger_filter_accepted, false) as a, (coalesce(challenger_filter_accepted, false) and not coalesce(challenger_finish_reason = 'length', false)) or coalesce(exact_match, false) as f from {_AB}) select route, count(*) filter (f) as accepted, count(*) filter (not f) as filtered, count(*) filter (f and not a) as by_hand from v group by 1",
    "run_contracts": f"with p as (select route, substr(sha256(id), 1, 3) as p, count(*) as n, sha256(string_agg(concat_ws(chr(9), id, sha256(source_text), target_language), chr(10) order by id)) as d from {_AB} group by all) select route, sum(n)::bigint as records, sha256(string_agg(p || '=' || d, chr(10) order by p || '=' || d)) as identity from p group by 1",
    "prefix_property": f"with n as (select route, row_number() over (partition by route order by sha256(concat_ws(chr(31), route, id)), id) as rank from {_AB}) select route, count(*) as records, true as prefix from n where rank <= 5 group by 1",
    "checkpoint_gaps": "with r as (select distinct lang, try_cast(regexp_extract(source_record_id, '([0-9]+)$', 1) as bigint) as n from locale_records) select lang, count(*) as n, min(n) as low, max(n) as high from r where n is not null group by 1 having min(r.n) <> 0 or max(r.n) + 1 <> count(*)",
    "blind_queue": f"with r as (select id, case when baseline_filter_accepted <> challenger_filter_accepted then 'disagree' else 'agree' end as kind, case when (strpos('0123456789abcdef', substr(sha256(id), 2, 1)) - 1) % 2 = 0 then 'left' else 'right' end as side from {_AB} where not exact_match and challenger_translation is not null), t as (select * from r order by kind <> 'disagree', sha256(id), id limit 100) select kind, side, count(*) as items, min(id) as first_id from t group by all",
    "training_rows": f"with r as (select route, {S.collapse('source_text')} as s, {S.collapse('challenger_translation')} as t from {_AB} where challenger_filter_accepted), d as (select *, sha256(concat_ws(chr(31), route, s, t)) as d from r where s <> '' and t <> '') select route, count(*) as rows, count(distinct d) as distinct_rows, sum(length(s) + length(t))::bigint as characters, min(d) as least_digest from d group by 1",
    "input_ids": f"select case when source_record_id is not null then 'record' when semantic_group_id is not null then 'group' else 'row' end as kind, count(*) as records, count(distinct coalesce(source_record_id, semantic_group_id, id)) as distinct_ids from {_AB} group by 1",
    "foreign_examples": _foreign_sql(),
    "marginal_examples": r"with r as (select doc_id, lang, text, length(regexp_extract(text, '^(?s:(.*?))[\x{400}-\x{4FF}\x{2190}-\x{21FF}\x{1F300}-\x{1FAFF}]', 1)) + 1 as spot from documents where text is not null and lang in ('jpn_Jpan', 'kor_Hang') and regexp_matches(text, '[\x{400}-\x{4FF}\x{2190}-\x{21FF}\x{1F300}-\x{1FAFF}]')) select doc_id, lang, spot::int as spot, substr(text, greatest(spot - 10, 1), 21) as context from r",
}

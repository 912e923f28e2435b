"""Row-level quality: segments, scripts, reasons, estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.functions.identity import sha
from textloom.operators import clean
from textloom.plans import sqltext as S
from textloom.plans.identity import SQL as IDENTITY_SQL
from textloom.plans.identity import hash_split_documents
from textloom.session import load, spread

RULES = X.CleaningRules()


def _segments(spark, sf_dir, rules=RULES):
    docs = spread(load(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    return clean.with_reason(clean.line_segments(docs, "text"), "lang", rules).drop("text")


def clean_reason_counts(spark, sf_dir):
    """Segments of all documents by language and reason; the flagship."""
    rows = _segments(spark, sf_dir)
    return rows.groupBy("lang", F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(
        F.count("*").alias("segments"), F.sum(F.coalesce(F.length("segment"), F.lit(0))).alias("characters")
    )


def clean_first_reason(spark, sf_dir):
    """Every document with its kept and rejected segments and the reason of the first rejected one."""
    rows = _segments(spark, sf_dir)
    return rows.groupBy("doc_id").agg(
        F.count_if(F.col("reason").isNull()).alias("kept"),
        F.count_if(F.col("reason").isNotNull()).alias("rejected"),
        F.min_by("reason", F.when(F.col("reason").isNotNull(), F.coalesce("position", F.lit(0)))).alias("first_reason"),
    )


def language_build(spark, sf_dir):
    """A language's corpus in one pass: segments accepted, exact copies inside a split and across splits, and what each split keeps.

    The first accepted segment of a text, by document and position, is kept; a later copy is counted by whether its
    document is in the same split. Counts by split are aggregated with partial results, so a text that a third of all
    rows repeat is one partial row a partition.
    """
    rows = _segments(spark, sf_dir).where("reason is null")
    docs = hash_split_documents(spark, sf_dir).select("doc_id", (F.col("split") == "holdout").alias("held"))
    rows = rows.join(docs, "doc_id").select("lang", sha(F.col("segment")).alias("content"), F.length("segment").alias("characters"), "held", F.struct("doc_id", "position", "held").alias("at"))
    texts = rows.groupBy("lang", "content").agg(
        F.count("*").alias("n"), F.count_if("held").alias("held"), F.min("at").alias("first"), F.any_value("characters").alias("characters")
    )
    own = F.when(F.col("first.held"), F.col("held")).otherwise(F.col("n") - F.col("held"))
    return texts.groupBy("lang").agg(
        F.sum("n").alias("accepted"), F.count("*").alias("kept"), F.sum(own - 1).alias("copies_inside"), F.sum(F.col("n") - own).alias("copies_across"),
        F.sum(F.when(F.col("first.held"), 0).otherwise(F.col("characters"))).alias("train_characters"), F.sum(F.when(F.col("first.held"), F.col("characters")).otherwise(0)).alias("held_characters"),
    )


def bounded_segment_counts(spark, sf_dir):
    """Segments cut to both caps, with entities resolved, by language and reason."""
    docs = spread(load(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    rows = clean.with_reason(clean.bounded_segments(docs, "text"), "lang", RULES)
    return rows.groupBy("lang", F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("segments"))


def script_counts(spark, sf_dir):
    """Letters of every document by script."""
    docs = load(spark, sf_dir, "documents")
    return docs.select("doc_id", *(X.script_count(F.col("text"), s).alias(s) for s in X.SCRIPTS), X.mixed_script(F.col("text")).alias("mixed"))


def script_ratio(spark, sf_dir):
    """Share of expected script and both wrong-script verdicts."""
    docs = load(spark, sf_dir, "documents")
    text, tag = F.col("text"), F.col("lang")
    return docs.select(
        "doc_id", X.script_ratio(text, tag).alias("ratio"), X.wrong_script_dominates(text, tag).alias("dominated"), X.wrong_script(text, tag).alias("wrong")
    )


def chinese_variant(spark, sf_dir):
    """Distinctive characters of both written forms of Chinese."""
    docs = load(spark, sf_dir, "documents").where(F.col("lang").isin("zho_Hans", "zho_Hant"))
    text = F.col("text")
    return docs.select("doc_id", "lang", X.simplified_count(text).alias("simplified"), X.traditional_count(text).alias("traditional"), X.cantonese(text).alias("cantonese"))


def character_shares(spark, sf_dir):
    """Address, numeric and long-token measures of every candidate."""
    rows = load(spark, sf_dir, "text_candidates").dropDuplicates(["candidate_id"])
    text = F.col("text")
    return rows.select(
        "candidate_id",
        X.matched(text, f"{X.URL}|{X.EMAIL}").alias("address_characters"),
        X.count(text, r"\p{N}\p{P}\p{S}").alias("numeric_symbol_characters"),
        F.array_max(F.transform(F.split(text, f"[{X.WHITE}]+"), F.length)).alias("longest_token"),
        F.rlike(text, F.lit(X.TAG)).alias("has_tag"),
        X.runs(text, 6).alias("has_run"),
    )


def token_estimates(spark, sf_dir):
    """Tokens by script weights, summed by language."""
    rows = load(spark, sf_dir, "documents").where("text is not null")
    return rows.withColumn("tokens", X.token_estimate(F.col("text"))).groupBy("lang").agg(F.sum("tokens").alias("tokens"), F.max("tokens").alias("largest"), F.count("*").alias("documents"))


def utterance_reasons(spark, sf_dir):
    """Reasons of aligned utterances, recomputed beside the stored ones."""
    rows = load(spark, sf_dir, "locale_records").withColumn("clean", X.collapse(X.nfc("text")))
    return rows.groupBy(
        "lang", F.coalesce("rejection_reason", F.lit("none")).alias("stored"), F.coalesce(clean.utterance_reason(F.col("clean"), F.col("lang")), F.lit("none")).alias("reason")
    ).agg(F.count("*").alias("records"))


def candidate_decisions(spark, sf_dir):
    """Decisions on candidates by tag, agreement with the stored one included."""
    rows = load(spark, sf_dir, "text_candidates").select("candidate_id", "language_tag", "accepted", "text", "student_tokens").dropDuplicates(["candidate_id"])
    rows = rows.withColumn("clean", X.collapse(X.nfc("text")))
    decided = rows.withColumn("d", clean.quality_decision(F.col("clean"), F.col("language_tag"), F.col("student_tokens")))
    return decided.groupBy("language_tag", F.coalesce("d.reason", F.lit("accepted")).alias("reason")).agg(
        F.count("*").alias("records"), F.count_if(F.col("accepted") == F.col("d.accepted")).alias("agreeing"), F.sum("d.characters").alias("characters")
    )


def prose_sentences(spark, sf_dir):
    """Sentences of every document and how many end in terminal punctuation."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    parts = docs.select("doc_id", F.explode(F.split("text", r"(?<=[。！？!?；;])\s*|\n+")).alias("part"))
    parts = parts.withColumn("part", X.collapse(F.col("part"))).where("part <> ''")
    return parts.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.count_if(F.rlike("part", F.lit(f"{X.TERMINAL}$"))).alias("terminated"), F.max(F.length("part")).alias("longest"))


def output_filter(spark, sf_dir):
    """Reasons to reject generated answers by route, one row per reason."""
    rows = load(spark, sf_dir, "hymt2_decode_ab").dropDuplicates(["id"]).withColumn("answer", X.collapse(X.nfc("challenger_translation")))
    reasons = clean.output_reasons(F.col("source_text"), F.col("answer"), F.col("target_language"), F.col("challenger_finish_reason"))
    rows = rows.select("id", "route", F.explode_outer(F.when(F.size(reasons) > 0, reasons)).alias("reason"))
    return rows.groupBy("route", F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("records"))


def answer_consistency(spark, sf_dir):
    """Numbers, placeholders, length ratio and script compliance of answers, by route."""
    rows = load(spark, sf_dir, "hymt2_decode_ab").dropDuplicates(["id"]).where("challenger_translation is not null")
    source, target = F.col("source_text"), X.collapse(F.col("challenger_translation"))
    found = lambda c, p: F.regexp_extract_all(c, F.lit(p), F.lit(0))
    own = F.when(F.col("target_language") == "zho_Hans", X.simplified_count(target) >= X.traditional_count(target))
    own = own.when(F.col("target_language") == "zho_Hant", X.traditional_count(target) >= X.simplified_count(target)).otherwise(True)
    return rows.groupBy("route").agg(
        F.count_if(F.transform(found(source, X.NUMBER), lambda n: F.replace(n, F.lit(","), F.lit(""))) == F.transform(found(target, X.NUMBER), lambda n: F.replace(n, F.lit(","), F.lit("")))).alias("same_numbers"),
        F.count_if(F.array_sort(found(source, X.PLACEHOLDER)) == F.array_sort(found(target, X.PLACEHOLDER))).alias("same_placeholders"),
        F.count_if(X.length_ratio(source, target) > 8.0).alias("ratio_rejected"),
        F.count_if((target != "") & ~X.wrong_script_dominates(target, F.col("target_language")) & own).alias("script_compliant"),
        F.count("*").alias("records"),
    )


def character_classes(spark, sf_dir):
    """Characters of all documents by language and class."""
    names = list(X.SCRIPTS) + ["digit", "space", "punctuation", "symbol"]
    bodies = list(X.SCRIPTS.values()) + ["0-9", X.WHITE, r"\p{P}", r"\p{S}"]
    text = F.col("text")
    docs = load(spark, sf_dir, "documents").where("text is not null")
    return docs.groupBy("lang").agg(F.sum(F.length(text)).alias("characters"), *(F.sum(X.count(text, b)).alias(n) for n, b in zip(names, bodies, strict=True)))


def markdown_prose(spark, sf_dir):
    """Documents with headings, bullets, links, inline code and tags taken off, counted by what was taken."""
    docs = load(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    bare = F.col("text")
    for pattern, new in _MARKDOWN:
        bare = F.regexp_replace(bare, pattern, new)
    return docs.select("doc_id", F.length("text").alias("characters"), F.length(bare).alias("prose_characters"), F.md5(bare).alias("prose_digest"))


_MARKDOWN = (
    (r"(?s)```.*?```", ""),
    (r"(?m)^#{1,6}[ \t]+", ""),
    (r"(?m)^[ \t]*[\-*+][ \t]+", ""),
    (r"!?\[([^\]]+)\]\([^)]*\)", "$1"),
    (r"`[^`]*`", ""),
    (r"</?[A-Za-z][^>]{0,200}>", ""),
)

_T = "segment"


def reason_sql() -> str:
    """The reason of ``segment`` in ``lang``, beside its ``flat`` form."""
    least = " ".join(f"when '{k}' then {v}" for k, v in X.LEAST_RATIO.items())
    return f"""coalesce({S.clean_reason(_T, RULES)},
    case when {S.script_ratio(_T, "lang")} < (case lang {least} end) then 'script_mismatch'
         when lang in ('zho_Hans', 'zho_Hant') and {S.simplified(_T)} + {S.traditional(_T)} >= 4
          and (case lang when 'zho_Hans' then {S.simplified(_T)} else {S.traditional(_T)} end) / ({S.simplified(_T)} + {S.traditional(_T)}) < 0.20 then 'chinese_variant_mismatch' end)"""


_LINES = f"""
lines as (
  select doc_id, lang, source, unnest(parts) as raw, unnest(range(0, len(parts))) as position
  from (select *, case when text is null then [null] else regexp_split_to_array(text, {S.quoted(X.BREAK)}) end as parts from documents)
), cut as (select doc_id, lang, source, position, {S.collapse("raw")} as segment from lines),
segments as (select *, {S.flat("segment")} as flat from cut),
reasoned as (select *, {reason_sql()} as reason from segments)
"""
_ONCE = "(select distinct on (candidate_id) * from text_candidates)"
_AB = "(select distinct on (id) * from hymt2_decode_ab)"
_NFC = lambda t: S.collapse(f"nfc_normalize({t})")

_UTTERANCE = f"""case when clean is null or clean = '' then 'empty_text' when {S.count("clean", "\\p{Cc}")} > 0 then 'control_character'
 when contains(clean, chr(65533)) then 'replacement_character' when regexp_matches(clean, {S.quoted(X.TAG)}) then 'html_residue'
 when length(clean) < 2 then 'too_short' when length(clean) > 512 then 'too_long' when {S.run("clean", 16)} then 'mechanical_repetition'
 when {S.dominated("clean", "lang")} then 'wrong_script' end"""
_CANTONESE = " + ".join(f"contains(clean, '{m}')::int" for m in X.CANTONESE)
_DECISION = f"""case when clean is null or clean = '' then 'empty' when {S.count("clean", "\\p{Cc}")} > 0 then 'control_character'
 when contains(clean, chr(65533)) then 'replacement_character' when regexp_matches(clean, {S.quoted(f"{X.URL}|{X.EMAIL}")}) then 'url_or_email'
 when regexp_matches(clean, {S.quoted(f"{X.TAG}|{X.TEMPLATE}")}) then 'html_or_template' when {S.run("clean", 6)} then 'mechanical_repetition'
 when length(clean) < 20 or length(clean) > 256 then 'character_length' when {S.wrong_script("clean", "language_tag")} then 'wrong_script'
 when language_tag = 'zho_Hant' and {_CANTONESE} >= 2 then 'written_cantonese'
 when student_tokens is null or student_tokens < 4 or student_tokens > 256 then 'token_length' end"""


def _output_sql() -> str:
    t, s, tag = "answer", "source_text", "target_language"
    squeeze = lambda c: f"lower({S.strip(c, f'[{X.WHITE}]')})"
    holders = lambda c: f"list_sort(regexp_extract_all({c}, {S.quoted(X.PLACEHOLDER)}))"
    other = S.count(s, "".join(X.SCRIPTS[x] for x in ("hiragana", "katakana", "hangul")))
    ratio = f"{S.compact(t)} / greatest({S.compact(s)}, 4)"
    run = f"len(list_filter(list_distinct(string_split({t}, '')), lambda c: c <> '' and not regexp_matches(c, '\\s') and contains({t}, repeat(c, 12)))) > 0"
    checks = [
        ("empty_output", f"{t} = ''"),
        ("prompt_echo", " or ".join(f"contains(lower({t}), {S.quoted(m)})" for m in X.PROMPT_ECHO)),
        ("extra_explanation", f"regexp_matches({t}, {S.quoted(X.EXPLANATION)})"),
        ("source_copy", f"{squeeze(s)} <> '' and {squeeze(s)} = {squeeze(t)} and not ({S.script(s, 'han')} > 0 and {other} = 0 and (case {tag} when 'zho_Hant' then {S.simplified(s)} = 0 when 'zho_Hans' then {S.traditional(s)} = 0 else false end))"),
        ("truncated", "coalesce(challenger_finish_reason = 'length', false)"),
        ("abnormal_repetition", f"{run} or {S.periodic(t, 4, '1000000', 3)}"),
        ("placeholder_mismatch", f"{holders(s)} <> {holders(t)}"),
        ("wrong_script_dominance", S.dominated(t, tag)),
        ("traditional_output_for_simplified_target", f"{tag} = 'zho_Hans' and {S.traditional(t)} > 0 and {S.simplified(t)} = 0"),
        ("simplified_output_for_traditional_target", f"{tag} = 'zho_Hant' and {S.simplified(t)} > 0 and {S.traditional(t)} = 0"),
        ("output_too_short", f"{ratio} < 0.15"),
        ("output_too_long", f"{ratio} > 6.0"),
    ]
    listed = ", ".join(f"case when {found} then '{name}' end" for name, found in checks)
    return f"""
with answers as (select *, coalesce({_NFC("challenger_translation")}, '') as answer from {_AB}),
marked as (select id, route, list_filter([{listed}], lambda r: r is not null) as reasons from answers),
flat as (select route, unnest(case when len(reasons) = 0 then ['accepted'] else reasons end) as reason from marked)
select route, reason, count(*) as records from flat group by all"""


_FOUND = lambda c, p: f"regexp_extract_all({c}, {S.quoted(p)})"
_CLASSES = dict(zip([*X.SCRIPTS, "digit", "space", "punctuation", "symbol"], [*X.SCRIPTS.values(), "0-9", X.WHITE, r"\p{P}", r"\p{S}"], strict=True))
_BARE = "text"
for _pattern, _new in _MARKDOWN:
    _BARE = f"regexp_replace({_BARE}, {S.quoted(_pattern)}, {S.quoted(_new.replace('$1', chr(92) + '1'))}, 'g')"

QUERIES = {
    f.__name__: f
    for f in (
        clean_reason_counts, clean_first_reason, language_build, bounded_segment_counts, script_counts, script_ratio, chinese_variant,
        character_shares, token_estimates, utterance_reasons, candidate_decisions, prose_sentences, output_filter,
        answer_consistency, character_classes, markdown_prose,
    )
}

_PARTS = f"regexp_split_to_array(regexp_replace(text, '([。！？!?；;])', '\\1' || chr(10), 'g'), '\\n+')"

SQL = {
    "language_build": f"with {_LINES}, d as (select doc_id, split = 'holdout' as held from ({IDENTITY_SQL['hash_split_documents']})), a as (select lang, sha256(segment) as content, length(segment) as characters, held, doc_id, position from reasoned join d using (doc_id) where reason is null), w as (select *, first_value(held) over (partition by lang, content order by doc_id, position) as f, row_number() over (partition by lang, content order by doc_id, position) as k from a) select lang, count(*) as accepted, count(*) filter (k = 1) as kept, count(*) filter (k > 1 and held = f) as copies_inside, count(*) filter (k > 1 and held <> f) as copies_across, coalesce(sum(characters) filter (k = 1 and not held), 0)::bigint as train_characters, coalesce(sum(characters) filter (k = 1 and held), 0)::bigint as held_characters from w group by lang",
    "prose_sentences": f"with p as (select doc_id, {S.collapse('part')} as part from (select doc_id, unnest({_PARTS}) as part from documents)) select doc_id, count(*) as sentences, count(*) filter (regexp_matches(part, {S.quoted(X.TERMINAL + '$')})) as terminated, max(length(part)) as longest from p where part <> '' group by doc_id",
    "clean_reason_counts": f"with {_LINES} select lang, coalesce(reason, 'accepted') as reason, count(*) as segments, sum(coalesce(length(segment), 0))::bigint as characters from reasoned group by all",
    "clean_first_reason": f"with {_LINES} select doc_id, count(*) filter (reason is null) as kept, count(*) filter (reason is not null) as rejected, arg_min(reason, position) filter (reason is not null) as first_reason from reasoned group by doc_id",
    "script_counts": f"select doc_id, {', '.join(f'{S.script("text", s)} as {s}' for s in X.SCRIPTS)}, {' + '.join(f'coalesce({S.script("text", s)} > 0, false)::int' for s in X.SCRIPTS)} >= 2 as mixed from documents",
    "script_ratio": f"select doc_id, {S.script_ratio('text', 'lang')} as ratio, {S.dominated('text', 'lang')} as dominated, {S.wrong_script('text', 'lang')} as wrong from documents",
    "chinese_variant": f"select doc_id, lang, {S.simplified('text')} as simplified, {S.traditional('text')} as traditional, {' + '.join(f"coalesce(contains(text, '{m}'), false)::int" for m in X.CANTONESE)} >= 2 as cantonese from documents where lang in ('zho_Hans', 'zho_Hant')",
    "character_shares": f"select candidate_id, {S.matched('text', f'{X.URL}|{X.EMAIL}')} as address_characters, {S.count('text', '\\p{N}\\p{P}\\p{S}')} as numeric_symbol_characters, list_max(list_transform(regexp_split_to_array(text, {S.quoted(f'[{X.WHITE}]+')}), lambda x: length(x))) as longest_token, regexp_matches(text, {S.quoted(X.TAG)}) as has_tag, {S.run('text', 6)} as has_run from {_ONCE}",
    "token_estimates": f"select lang, sum(tokens)::bigint as tokens, max(tokens) as largest, count(*) as documents from (select lang, {S.token_estimate('text')} as tokens from documents where text is not null) group by lang",
    "utterance_reasons": f"with c as (select *, {_NFC('text')} as clean from locale_records) select lang, coalesce(rejection_reason, 'none') as stored, coalesce({_UTTERANCE}, 'none') as reason, count(*) as records from c group by all",
    "candidate_decisions": f"with c as (select *, {_NFC('text')} as clean from {_ONCE}), d as (select *, {_DECISION} as why from c) select language_tag, coalesce(why, 'accepted') as reason, count(*) as records, count(*) filter (accepted = (why is null)) as agreeing, sum(length(clean))::bigint as characters from d group by all",
    "output_filter": _output_sql(),
    "answer_consistency": f"""with a as (select *, {S.collapse('challenger_translation')} as t from {_AB} where challenger_translation is not null)
select route, count(*) filter (list_transform({_FOUND('source_text', X.NUMBER)}, lambda n: replace(n, ',', '')) = list_transform({_FOUND('t', X.NUMBER)}, lambda n: replace(n, ',', ''))) as same_numbers,
count(*) filter (list_sort({_FOUND('source_text', X.PLACEHOLDER)}) = list_sort({_FOUND('t', X.PLACEHOLDER)})) as same_placeholders,
count(*) filter ({S.length_ratio('source_text', 't')} > 8.0) as ratio_rejected,
count(*) filter (t <> '' and not {S.dominated('t', 'target_language')} and case target_language when 'zho_Hans' then {S.simplified('t')} >= {S.traditional('t')} when 'zho_Hant' then {S.traditional('t')} >= {S.simplified('t')} else true end) as script_compliant,
count(*) as records from a group by route""",
    "character_classes": f"select lang, sum(length(text))::bigint as characters, {', '.join(f'sum({S.count("text", b)})::bigint as {n}' for n, b in _CLASSES.items())} from documents where text is not null group by lang",
    "markdown_prose": f"select doc_id, length(text) as characters, length({_BARE}) as prose_characters, md5({_BARE}) as prose_digest from documents where text is not null",
}

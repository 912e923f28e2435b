"""Characters, words and token ids: inventories, coverage, utilisation."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import vocabulary as V
from textloom.plans import sqltext as S
from textloom.session import load, spread, write_table

#: File of the public tokenizer that is evaluated.
TOKENIZER = os.path.join(os.environ.get("TEXTLOOM_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.json")

#: First and last code points of the alphabet a vocabulary must cover.
ALPHABET_RANGES = (
    (0x21, 0x7E), (0xA1, 0xFF), (0x1100, 0x11FF), (0x3000, 0x30FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7A3), (0xD7B0, 0xD7FF), (0xFF01, 0xFF9F),
)
#: Lead bytes of the frequently used characters of Big5.
COMMON_TRADITIONAL = (0xA4, 0xC6)


def _characters(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").where("text is not null")
    chars = F.explode(F.split("text", ""))
    return docs.select("lang", chars.alias("c")).where((F.col("c") != "") & ~F.rlike("c", F.lit(f"[{X.WHITE}]"))).groupBy("lang", "c").agg(F.count("*").alias("n"))


def char_inventory(spark, sf_dir):
    """Characters of the documents by language with their counts."""
    return _characters(spark, sf_dir).select("lang", F.col("c").alias("character"), F.col("n").alias("occurrences"))


def char_coverage(spark, sf_dir):
    """Share of characters and of occurrences that two national character sets and ASCII cover, by language."""
    counts = _characters(spark, sf_dir).where("lang is not null")
    covered = F.rlike("c", F.lit(r"^[\x{21}-\x{7E}\x{3000}-\x{30FF}\x{AC00}-\x{D7A3}\x{4E00}-\x{9FA5}\x{FF01}-\x{FF5E}]$"))
    return counts.groupBy("lang").agg(
        F.count("*").alias("characters"), F.count_if(covered).alias("covered"), F.sum("n").alias("occurrences"), F.sum(F.when(covered, F.col("n")).otherwise(0)).alias("covered_occurrences")
    )


def shared_han(spark, sf_dir):
    """Han characters that each two languages share."""
    counts = _characters(spark, sf_dir).where(F.rlike("c", F.lit(f"^[{X.SCRIPTS['han']}]$")) & F.col("lang").isin("jpn_Jpan", "zho_Hans", "zho_Hant"))
    held = counts.groupBy("c").agg(F.collect_set("lang").alias("l"))
    pairs = F.array(*(F.struct(F.lit(a).alias("left_lang"), F.lit(b).alias("right_lang")) for a, b in (("jpn_Jpan", "zho_Hans"), ("jpn_Jpan", "zho_Hant"), ("zho_Hans", "zho_Hant"))))
    flat = held.select(F.explode(pairs).alias("p"), "l").select("p.*", F.array_contains("l", F.col("p.left_lang")).alias("a"), F.array_contains("l", F.col("p.right_lang")).alias("b"))
    return flat.groupBy("left_lang", "right_lang").agg(F.count_if(F.col("a") & F.col("b")).alias("shared"), F.count_if(F.col("a") | F.col("b")).alias("either"))


def alphabet_audit(spark, sf_dir):
    """Kana of the documents against the kana they must be covered by: counts by state; `alphabet_states` has the whole alphabet."""
    counts = _characters(spark, sf_dir).groupBy("c").agg(F.sum("n").alias("n"))
    code = F.col("id").cast("bigint")
    wanted = spark.range(0x3041, 0x30FF).select(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32").alias("c"))
    both = counts.where(F.rlike("c", F.lit(r"^[\x{3041}-\x{30FE}]$"))).join(wanted, "c", "full").withColumn("state", F.when(F.col("n").isNull(), "unused").otherwise("used"))
    return both.groupBy("state").agg(F.count("*").alias("characters"), F.sum(F.coalesce("n", F.lit(0))).alias("occurrences"))


def must_cover_alphabet() -> set[str]:
    """Printable Latin, Jamo, CJK punctuation, kana, Hangul, full-width forms, the Han of GB 2312 and Shift JIS, and by rule the frequent ones of Big5."""
    found = {chr(code) for first, last in ALPHABET_RANGES for code in range(first, last + 1)} | {"▁"}
    for name in ("gb2312", "shift_jis", "big5"):
        codes = range(COMMON_TRADITIONAL[0] << 8, (COMMON_TRADITIONAL[1] + 1) << 8) if name == "big5" else range(1 << 16)
        for code in codes:
            try:
                char = code.to_bytes(2, "big").decode(name)
            except UnicodeDecodeError:
                continue
            if len(char) == 1 and "\u3400" <= char <= "\u9fff":
                found.add(char)
    return found


def alphabet_states(spark, sf_dir):
    """Every character of the documents, white space too, or of the whole alphabet: how often it stands, and whether it is used, unused, or outside the alphabet."""
    docs = load(spark, sf_dir, "documents").where("text is not null").select(F.explode(F.split("text", "")).alias("c")).where("c <> ''")
    counts = docs.groupBy("c").agg(F.count("*").alias("n"))
    wanted = spark.createDataFrame([(c,) for c in sorted(must_cover_alphabet())], "c string").withColumn("must", F.lit(True))
    state = F.when(F.col("must").isNull(), "outside").when(F.col("n").isNull(), "unused").otherwise("used")
    return counts.join(wanted, "c", "full").select(F.col("c").alias("character"), F.coalesce("n", F.lit(0)).alias("occurrences"), state.alias("state"))


def word_counts(spark, sf_dir):
    """English words of the documents in lower case, with their counts."""
    docs = load(spark, sf_dir, "documents").where("lang = 'eng_Latn' and text is not null")
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("occurrences"))


def word_feed(spark, sf_dir):
    """What a vocabulary trainer is fed: every piece between white space, with the mark of its start, and how often it stands, over all documents."""
    return V.word_feed(load(spark, sf_dir, "documents"), "text")


def tokenizer_evaluation(spark, sf_dir):
    """Tokens, unknown characters and exact round trips of all documents by language, under a public tokenizer."""
    docs = spread(load(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return V.evaluation_summary(V.evaluate_texts(docs, ["doc_id", "lang"], "text", TOKENIZER), "lang")


def encoded_samples_again(spark, sf_dir):
    """Translations encoded through a cache of distinct texts: samples, tokens of both sides and cut sides by route."""
    rows = load(spark, sf_dir, "hymt2_decode_ab").dropDuplicates(["id"]).where("source_text is not null and baseline_translation is not null")
    rows = rows.select("id", "route", "source_language", "target_language", "source_text", F.col("baseline_translation").alias("target_text"))
    cache = write_table(V.encode_once(V.text_keys(rows), TOKENIZER), "encoded").frame
    encoded = V.encode_pairs(rows, cache, most_source=64, most_target=64)
    return encoded.groupBy("route").agg(
        F.count("*").alias("samples"), F.sum(F.size("source_ids")).alias("source_tokens"), F.sum(F.size("target_ids")).alias("target_tokens"),
        F.count_if("source_cut").alias("source_cut"), F.count_if("target_cut").alias("target_cut"),
    )


def word_lengths(spark, sf_dir):
    """English words by length: distinct ones, occurrences, and mean length weighted by occurrence."""
    docs = load(spark, sf_dir, "documents").where("lang = 'eng_Latn' and text is not null")
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.groupBy(F.length("word").alias("length")).agg(F.count("*").alias("words"), F.sum("n").alias("occurrences"))


def token_utilisation(spark, sf_dir):
    """Token ids used by language: distinct ids, occurrences, the largest, and whether they are dense."""
    rows = load(spark, sf_dir, "encoded_samples").dropDuplicates(["sample_id"]).select("source_language", F.explode("input_ids").alias("token"))
    ids = rows.groupBy("source_language", "token").agg(F.count("*").alias("n"))
    return ids.groupBy("source_language").agg(
        F.count("*").alias("distinct_ids"), F.sum("n").alias("occurrences"), F.max("token").alias("largest"), (F.max("token") + 1 == F.count("*")).alias("dense")
    )


def fertility(spark, sf_dir):
    """Characters a token of candidates by language, where tokens are stated and possible, and their parity with English."""
    rows = load(spark, sf_dir, "text_candidates").dropDuplicates(["candidate_id"]).where("student_tokens > 0 and student_tokens <= characters * 4 and text is not null")
    per = rows.groupBy("language_tag").agg(F.count("*").alias("records"), F.sum("characters").alias("characters"), F.sum("student_tokens").alias("tokens"))
    return per.withColumn("characters_per_token", F.round(F.col("characters") / F.col("tokens"), 6))


def distinct_text_keys(spark, sf_dir):
    """Distinct texts by language that an encoder would have to see once, against all texts."""
    rows = load(spark, sf_dir, "hymt2_decode_ab").dropDuplicates(["id"])
    sides = rows.select(F.col("source_language").alias("language"), F.col("source_text").alias("t")).unionAll(rows.select("target_language", "baseline_translation")).where("t is not null")
    keys = sides.groupBy("language", F.sha2("t", 256).alias("k")).agg(F.count("*").alias("n"))
    return keys.groupBy("language").agg(F.count("*").alias("distinct_texts"), F.sum("n").alias("texts"))


_CHARS = f"chars as (select lang, c, count(*) as n from (select lang, unnest(string_split(text, '')) as c from documents where text is not null) where c <> '' and not regexp_matches(c, '[{X.WHITE}]') group by all)"
_WORDS = "words as (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from documents where lang = 'eng_Latn' and text is not null)"
_COVER = r"'^[\x{21}-\x{7E}\x{3000}-\x{30FF}\x{AC00}-\x{D7A3}\x{4E00}-\x{9FA5}\x{FF01}-\x{FF5E}]$'"

QUERIES = {
    f.__name__: f
    for f in (char_inventory, char_coverage, shared_han, alphabet_audit, alphabet_states, word_counts, word_feed, tokenizer_evaluation, encoded_samples_again, word_lengths, token_utilisation, fertility, distinct_text_keys)
}

SQL = {
    "alphabet_states": f"with c as (select ch, count(*) as n from (select unnest(string_split(text, '')) as ch from documents where text is not null) where ch <> '' group by ch), a as (select distinct unnest(string_split({S.quoted(''.join(sorted(must_cover_alphabet())))}, '')) as ch) select coalesce(c.ch, a.ch) as character, coalesce(n, 0) as occurrences, case when a.ch is null then 'outside' when n is null then 'unused' else 'used' end as state from c full join a on a.ch = c.ch",
    "word_feed": f"with w as (select unnest(regexp_split_to_array(text, '[{X.WHITE}]+')) as w from documents where text is not null) select '▁' || w as word, count(*) as occurrences from w where w <> '' group by w",
    "char_inventory": f"with {_CHARS} select lang, c as character, n as occurrences from chars",
    "char_coverage": f"with {_CHARS} select lang, count(*) as characters, count(*) filter (regexp_matches(c, {_COVER})) as covered, sum(n)::bigint as occurrences, sum(case when regexp_matches(c, {_COVER}) then n else 0 end)::bigint as covered_occurrences from chars where lang is not null group by lang",
    "shared_han": f"with {_CHARS}, h as (select c, list(distinct lang) as l from chars where regexp_matches(c, '^[{X.SCRIPTS['han']}]$') and lang in ('jpn_Jpan', 'zho_Hans', 'zho_Hant') group by c), p as (select * from (values ('jpn_Jpan', 'zho_Hans'), ('jpn_Jpan', 'zho_Hant'), ('zho_Hans', 'zho_Hant')) t(left_lang, right_lang)) select left_lang, right_lang, count(*) filter (list_contains(l, left_lang) and list_contains(l, right_lang)) as shared, count(*) filter (list_contains(l, left_lang) or list_contains(l, right_lang)) as either from h, p group by all",
    "alphabet_audit": rf"with {_CHARS}, k as (select c, sum(n) as n from chars where regexp_matches(c, '^[\x{{3041}}-\x{{30FE}}]$') group by c), w as (select chr(i::int) as c from range(12353, 12543) t(i)) select case when n is null then 'unused' else 'used' end as state, count(*) as characters, sum(coalesce(n, 0))::bigint as occurrences from w full join k using (c) group by 1",
    "word_counts": f"with {_WORDS} select word, count(*) as occurrences from words group by word",
    "word_lengths": f"with {_WORDS}, c as (select word, count(*) as n from words group by word) select length(word) as length, count(*) as words, sum(n)::bigint as occurrences from c group by 1",
    "token_utilisation": "with t as (select source_language, unnest(input_ids) as token from (select distinct on (sample_id) * from encoded_samples)), i as (select source_language, token, count(*) as n from t group by all) select source_language, count(*) as distinct_ids, sum(n)::bigint as occurrences, max(token) as largest, max(token) + 1 = count(*) as dense from i group by 1",
    "fertility": "select language_tag, count(*) as records, sum(characters)::bigint as characters, sum(student_tokens)::bigint as tokens, round(sum(characters) / sum(student_tokens), 6) as characters_per_token from (select distinct on (candidate_id) * from text_candidates) where student_tokens > 0 and student_tokens <= characters * 4 and text is not null group by 1",
    "distinct_text_keys": "with r as (select distinct on (id) * from hymt2_decode_ab), s as (select source_language as language, source_text as t from r union all select target_language, baseline_translation from r), k as (select language, t, count(*) as n from s where t is not null group by all) select language, count(*) as distinct_texts, sum(n)::bigint as texts from k group by 1",
}

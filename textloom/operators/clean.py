"""Segments and the reasons to reject them."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as X


def cut_units(text: str, most: int, most_bytes: int) -> list[str]:
    """A document's lines, entities resolved and white space made single, each cut to both caps.

    A line beyond a cap is cut after the last sentence end, else before the last space, if that lies at 55 % of the cap
    or later; else at the cap itself. Nothing is lost but the spaces at the cuts.
    """
    units = []
    for line in re.split(r"\r\n|[\n-\r\x1c-\x1e\x85\u2028\u2029]", text):
        line = " ".join(html.unescape(line).replace("\xa0", " ").split())
        while len(line) > most or len(line.encode()) > most_bytes:
            size = min(most, len(line))
            while len(line[:size].encode()) > most_bytes:
                size -= max(1, (len(line[:size].encode()) - most_bytes) // 4)
            least = int(size * 0.55)
            ends = [m.end() for m in re.finditer(r"[.!?。！？；;]", line[:size])]
            at = ends[-1] if ends and ends[-1] >= least else line.rfind(" ", least, size)
            at = at if at > 0 else size
            units.append(line[:at].strip())
            line = line[at:].strip()
        units.append(line)
    return units


def bounded_segments(frame: DataFrame, text: str, *, most: int = 2048, most_bytes: int = 4096) -> DataFrame:
    """Add ``position`` and ``segment``, one row per bounded unit of ``text``; a null text gives one null segment."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else cut_units(t, most, most_bytes))

    return frame.select(*frame.columns, F.posexplode_outer(cut(F.col(text))).alias("position", "segment"))


def line_segments(frame: DataFrame, text: str) -> DataFrame:
    """Add ``position`` and ``segment``, one row per line of ``text`` with single spaces; all native."""
    exploded = frame.select(*frame.columns, F.posexplode_outer(X.lines(F.col(text))).alias("position", "raw"))
    return exploded.withColumn("segment", X.horizontal(F.col("raw"))).drop("raw")


def with_reason(segments: DataFrame, language: str, rules: X.CleaningRules = X.CleaningRules()) -> DataFrame:
    """Add ``reason``: the cleaning cascade, then script share and written form of Chinese by language; null if kept."""
    text, tag = F.col("segment"), F.col(language)
    limit = F.create_map(*[F.lit(x) for pair in X.LEAST_RATIO.items() for x in pair])
    low = X.script_ratio(text, tag) < F.try_element_at(limit, tag)
    own = F.when(tag == "zho_Hans", X.simplified_count(text)).when(tag == "zho_Hant", X.traditional_count(text))
    both = X.simplified_count(text) + X.traditional_count(text)
    variant = (both >= 4) & (own / both < 0.20)
    late = F.coalesce(F.when(low, F.lit("script_mismatch")), F.when(variant, F.lit("chinese_variant_mismatch")))
    return segments.withColumn("reason", F.coalesce(X.clean_reason(text, rules), late))


def utterance_reason(text: Column, language: Column, *, least: int = 2, most: int = 512) -> Column:
    """Reason to reject an aligned utterance, already composed and with single spaces; null if kept."""
    return F.coalesce(
        F.when(text.isNull() | (text == ""), F.lit("empty_text")),
        F.when(X.count(text, r"\p{Cc}") > 0, F.lit("control_character")),
        F.when(F.contains(text, F.lit("�")), F.lit("replacement_character")),
        F.when(F.rlike(text, F.lit(X.TAG)), F.lit("html_residue")),
        F.when(F.length(text) < least, F.lit("too_short")),
        F.when(F.length(text) > most, F.lit("too_long")),
        F.when(X.runs(text, 16), F.lit("mechanical_repetition")),
        F.when(X.wrong_script_dominates(text, language), F.lit("wrong_script")),
    )


def candidate_reason(text: Column) -> Column:
    """Reason to reject a monolingual candidate; null if kept."""
    return F.coalesce(
        F.when(text.isNull() | (text == ""), F.lit("empty")),
        F.when(X.count(text, r"\p{Cc}") > 0, F.lit("control_character")),
        F.when(F.contains(text, F.lit("�")), F.lit("replacement_character")),
        F.when(F.rlike(text, F.lit(f"{X.URL}|{X.EMAIL}")), F.lit("url_or_email")),
        F.when(F.rlike(text, F.lit(f"{X.TAG}|{X.TEMPLATE}")), F.lit("html_or_template")),
        F.when(X.runs(text, 6), F.lit("mechanical_repetition")),
    )


def quality_decision(
    text: Column, language: Column, tokens: Column, *, least: int = 20, most: int = 256, least_tokens: int = 4, most_tokens: int = 256
) -> Column:
    """Decision on a candidate: ``accepted, reason, characters, tokens``; the first reason wins."""
    reason = F.coalesce(
        candidate_reason(text),
        F.when((F.length(text) < least) | (F.length(text) > most), F.lit("character_length")),
        F.when(X.wrong_script(text, language), F.lit("wrong_script")),
        F.when((language == "zho_Hant") & X.cantonese(text), F.lit("written_cantonese")),
        F.when(tokens.isNull() | (tokens < least_tokens) | (tokens > most_tokens), F.lit("token_length")),
    )
    return F.struct(reason.isNull().alias("accepted"), reason.alias("reason"), F.length(text).alias("characters"), tokens.alias("tokens"))


def output_reasons(source: Column, target: Column, language: Column, finish: Column, *, low: float = 0.15, high: float = 6.0) -> Column:
    """All reasons to reject a generated answer, in order; an empty array if it is kept.

    ``target`` is composed and has single spaces. A copy is excused where the source reads the same in the target's
    written form of Chinese.
    """
    text = F.coalesce(target, F.lit(""))
    squeeze = lambda c: F.lower(F.regexp_replace(c, f"[{X.WHITE}]", ""))
    holders = lambda c: F.array_sort(F.regexp_extract_all(c, F.lit(X.PLACEHOLDER), F.lit(0)))
    simplified, traditional = X.simplified_count(text), X.traditional_count(text)
    chinese = (X.script_count(source, "han") > 0) & (X.count(source, "".join(X.SCRIPTS[s] for s in ("hiragana", "katakana", "hangul"))) == 0)
    neutral = F.when(language == "zho_Hant", X.simplified_count(source) == 0).when(language == "zho_Hans", X.traditional_count(source) == 0)
    same = chinese & F.coalesce(neutral, F.lit(False))
    ratio = X.compact_length(text) / F.greatest(X.compact_length(source), F.lit(4))
    repeated = F.rlike(text, F.lit(r"([^\s])\1{11,}")) | F.rlike(text, F.lit(r"(.{4,}?)\1{2,}"))
    checks = [
        ("empty_output", text == ""),
        ("prompt_echo", sum((F.when(F.contains(F.lower(text), F.lit(m)), 1).otherwise(0) for m in X.PROMPT_ECHO), F.lit(0)) > 0),
        ("extra_explanation", F.rlike(text, F.lit(X.EXPLANATION))),
        ("source_copy", (squeeze(source) != "") & (squeeze(source) == squeeze(text)) & ~same),
        ("truncated", finish == "length"),
        ("abnormal_repetition", repeated),
        ("placeholder_mismatch", holders(source) != holders(text)),
        ("wrong_script_dominance", X.wrong_script_dominates(text, language)),
        ("traditional_output_for_simplified_target", (language == "zho_Hans") & (traditional > 0) & (simplified == 0)),
        ("simplified_output_for_traditional_target", (language == "zho_Hant") & (simplified > 0) & (traditional == 0)),
        ("output_too_short", ratio < low),
        ("output_too_long", ratio > high),
    ]
    return F.array_compact(F.array(*(F.when(F.coalesce(found, F.lit(False)), F.lit(name)) for name, found in checks)))

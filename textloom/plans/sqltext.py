"""SQL twins of the text measures, for DuckDB."""

from __future__ import annotations

from textloom.functions import text as X


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strip(t: str, pattern: str) -> str:
    return f"regexp_replace({t}, {quoted(pattern)}, '', 'g')"


def count(t: str, body: str) -> str:
    return f"(length({t}) - length({strip(t, f'[{body}]')}))"


def matched(t: str, pattern: str) -> str:
    return f"(length({t}) - length({strip(t, pattern)}))"


def collapse(t: str) -> str:
    return f"trim(regexp_replace({t}, {quoted(f'[{X.WHITE}]+')}, ' ', 'g'))"


def script(t: str, name: str) -> str:
    return count(t, X.SCRIPTS[name])


def letters(t: str) -> str:
    return count(t, "".join(X.SCRIPTS.values()))


def expected(t: str, language: str) -> str:
    cases = " ".join(f"when '{tag}' then {count(t, ''.join(X.SCRIPTS[s] for s in names))}" for tag, names in X.EXPECTED.items())
    return f"(case {language} {cases} end)"


def simplified(t: str) -> str:
    return f"(length({t}) - length(translate({t}, '{X.chinese_forms()[0]}', '')))"


def traditional(t: str) -> str:
    return f"(length({t}) - length(translate({t}, '{X.chinese_forms()[1]}', '')))"


def script_ratio(t: str, language: str) -> str:
    tags = ", ".join(f"'{tag}'" for tag in X.EXPECTED)
    return f"(case when {letters(t)} = 0 then case when {language} in ({tags}) then 0.0 end else {expected(t, language)} / {letters(t)} end)"


def dominated(t: str, language: str) -> str:
    counts = ", ".join(script(t, s) for s in X.SCRIPTS)
    return f"coalesce({letters(t)} >= 4 and {expected(t, language)} = 0 and greatest({counts}) / {letters(t)} >= 0.85, false)"


def wrong_script(t: str, language: str) -> str:
    return f"coalesce({letters(t)} < 4 or {expected(t, language)} / {letters(t)} < 0.55, true)"


def compact(t: str) -> str:
    return f"length(replace({t}, ' ', ''))"


def length_ratio(a: str, b: str) -> str:
    return f"(greatest({compact(a)}, {compact(b)}) / greatest(least({compact(a)}, {compact(b)}), 4))"


def token_estimate(t: str) -> str:
    han = script(t, "han")
    syllables = count(t, X.SCRIPTS["hiragana"] + X.SCRIPTS["katakana"] + X.SCRIPTS["hangul"])
    low = count(t, r"\x{0}-\x{24F}")
    return f"greatest(1, ceil((6*{han} + 10*{syllables} + 3*{low} + 7*(length({t}) - {han} - {syllables} - {low})) / 10))::bigint"


def run(t: str, least: int) -> str:
    """Whether one character stands so often in a row; written without a backreference."""
    return f"len(list_filter(list_distinct(string_split({t}, '')), lambda c: c <> '' and contains({t}, repeat(c, {least})))) > 0"


def flat(t: str) -> str:
    return f"regexp_replace({t}, {quoted(X.WORDLIKE)}, '_', 'g')"


def periodic(t: str, least: int, most: str, times: int) -> str:
    """Whether a part of ``least`` to ``most`` characters stands ``times`` in a row; written without a backreference.

    For a period p that is so if (times - 1) * p characters in a row equal the one p places on.
    """
    chars = f"string_split({t}, '')"
    same = f"array_to_string(list_transform(list_zip({chars}[:-p-1], {chars}[p+1:]), lambda z: case when z[1] = z[2] then '1' else '0' end), '')"
    return f"len(list_filter(range({least}, least({most}, length({t}) // {times}) + 1), lambda p: contains({same}, repeat('1', ({times - 1} * p)::int)))) > 0"


def clean_reason(t: str, rules: X.CleaningRules) -> str:
    """The cascade, on ``t`` and its flat form in column ``flat``."""
    bare = strip(t, f"[{X.WHITE}]")
    numeric = f"(length({bare}) - length({strip(bare, '[\\p{N}\\p{P}\\p{S}]')}))"
    visible = f"length({strip(t, '[\\p{Cc}\\p{Cf}\\p{Co}\\p{Cs}]')})"
    tokens = f"regexp_split_to_array({t}, {quoted(f'[{X.WHITE}]+')})"
    ascii_count = count("x", r"\x{0}-\x{7F}")
    long = f"len(list_filter({tokens}, lambda x: length(x) > {rules.token_characters} and {ascii_count} >= {rules.token_ascii_share} * length(x))) > 0"
    bounded, others = X.keyword_parts(rules.keyword)
    keyword = f"len(regexp_extract_all(flat, {quoted(bounded)})) + len(regexp_extract_all({t}, {quoted(others)}))"
    checks = [
        ("missing_text", f"{t} is null"),
        ("empty", f"length({t}) = 0"),
        ("too_short", f"length({t}) < {rules.least_characters}"),
        ("segment_bound_exceeded", f"length({t}) > {rules.most_characters} or octet_length(encode({t})) > {rules.most_bytes}"),
        ("replacement_characters", f"{count(t, '\\x{FFFD}')} > {rules.replacement_share} * length({t})"),
        ("control_characters", f"{count(t, '\\p{Cc}')} > {rules.control_share} * length({t})"),
        ("low_visible_ratio", f"{visible} < {rules.visible_share} * length({t})"),
        ("html_residue", f"regexp_matches({t}, {quoted(X.HTML)})"),
        ("template_residue", f"regexp_matches({t}, {quoted(rules.template)})"),
        ("mojibake", f"regexp_matches({t}, {quoted(X.MOJIBAKE)})"),
        ("encoded_blob", f"regexp_matches(flat, {quoted(X.BLOB)})"),
        ("mechanical_repetition", f"{run(t, rules.run)} or {periodic(t, 2, '32', 5)}"),
        ("numeric_symbol_dominance", f"{numeric} > {rules.numeric_share} * length({bare})"),
        ("url_email_dominance", f"{matched('flat', X.ADDRESS)} > {rules.address_share} * length({t})"),
        ("long_mechanical_token", long),
        ("keyword_stuffing", f"{keyword} > {rules.keyword_most}"),
        ("keyword_stuffing", f"len(regexp_extract_all({t}, {quoted(rules.spam)})) > {rules.spam_most}"),
    ]
    return "case " + " ".join(f"when {found} then '{name}'" for name, found in checks) + " end"

"""Visually identical text with different characters: one consistent form.

Two steps. ``fold`` replaces, character by character, forms that differ only in width, composition or a look-alike
compatibility form, drops invisible characters and unifies kinds of space and of hyphen. Then a script-aware repair
looks at single tokens: the dominant script of a token of mixed scripts is that of its letters that look like no letter
of the other script, and its look-alikes are replaced by letters of that script - to Latin as well as to Cyrillic and
Greek - but only if the result is in the corpus vocabulary. In writing without spaces a token is a look-alike of kana
and Han with a neighbour. A token made of look-alikes only tells nothing itself: the rest of its text does.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.arrow import map_batches
from textloom.session import write_table

# Letters of Cyrillic and of Greek that cannot be told from a Latin letter, pair by pair.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХаеорсухѕіјһԁԛԝ", "ABESIJKMHOPCTYXaeopcyxsijhdqw", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳ", "ABEZHIKMNOPTYXovcj", strict=True))
LOOKALIKES = CYRILLIC | GREEK
# Katakana that cannot be told from a Han character, and katakana that cannot be told from hiragana.
KANA_HAN = dict(zip("エオカタトニハロー", "工才力夕卜二八口一", strict=True))
KANA_KANA = dict(zip("ヘベペ", "へべぺ", strict=True))
# Marks drawn like the ASCII hyphen-minus.
HYPHENS = "‐‑﹣－"
# Compatibility forms that a reader sees as different: raised, lowered, circled, squared, fractions, styled letters.
VISIBLE = ("<super>", "<sub>", "<circle>", "<square>", "<fraction>", "<font>", "<vertical>")
# Blocks whose plain <compat> forms are drawn with brackets or stops around them, and symbol variants of letters.
ENCLOSED = ((0x2460, 0x24FF), (0x3200, 0x33FF), (0x1F100, 0x1F2FF), (0x017F, 0x017F), (0x03D0, 0x03F6), (0x1E9A, 0x1E9B))
# Ranges in which the character database is asked: ideographs, syllables, surrogates, private and empty planes need no rule.
TABLED = ((0x80, 0x33FF), (0xA000, 0xABFF), (0xF900, 0x1FFFF), (0xE0000, 0xE0FFF))
# Invisible characters outside category Cf.
INVISIBLE = ((0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0100, 0xE01EF))

_LETTERS = r"A-Za-z\u00AA-\u024F\u0370-\u052F\u1E00-\u1FFF"
_WORD = re.compile(f"[{_LETTERS}]+")
_CYRILLIC, _GREEK = re.compile(r"[\u0400-\u052F]"), re.compile(r"[\u0370-\u03FF\u1F00-\u1FFF]")
_FOREIGN = re.compile(r"[\u0370-\u052F\u1F00-\u1FFF]")
_LATIN = re.compile(r"[A-Za-z\u00AA-\u024F\u1E00-\u1EFF]")
_TO_LATIN = str.maketrans(LOOKALIKES)
#: For each foreign script: its letters, its look-alikes, and the translation from Latin to it.
_SCRIPTS = tuple((letters, set(table), str.maketrans({v: k for k, v in table.items()})) for letters, table in ((_CYRILLIC, CYRILLIC), (_GREEK, GREEK)))

_KATAKANA, _HAN = r"\u30A1-\u30FA\u30FC", r"\u3400-\u4DBF\u4E00-\u9FFF\u3005"
_K, _H = "".join(KANA_HAN), "".join(KANA_HAN.values())
_SURE_KATAKANA, _SURE_HAN = f"(?:(?![{_K}])[{_KATAKANA}])", f"(?:(?![{_H}])[{_HAN}])"
_UNSPACED = re.compile(
    f"(?<={_SURE_HAN})[{_K}](?![{_KATAKANA}])|(?<![{_KATAKANA}])[{_K}](?=[{_H}]*{_SURE_HAN})"
    f"|(?<={_SURE_KATAKANA})[{_H}](?![{_HAN}])|(?<![{_HAN}])[{_H}](?=[{_K}]*{_SURE_KATAKANA})"
    f"|[{''.join(KANA_KANA)}](?![{_KATAKANA}])|[{''.join(KANA_KANA.values())}](?=[{_KATAKANA}])"
)
_SWAP = {**KANA_HAN, **KANA_KANA, **{v: k for k, v in [*KANA_HAN.items(), *KANA_KANA.items()]}}
_AMBIGUOUS = "".join(_SWAP)
_UNSPACED_ANY = re.compile(f"[{_AMBIGUOUS}]")
_RUN = re.compile(f"[{_KATAKANA}{_HAN}]")
#: Tokens of the corpus vocabulary, as Java patterns: words, and look-alikes of kana and Han with a neighbour.
WORD_TOKENS = f"([{_LETTERS}]+)"
UNSPACED_TOKENS = f"(?=([{_KATAKANA}{_HAN}][{_AMBIGUOUS}]|[{_AMBIGUOUS}][{_KATAKANA}{_HAN}]))"


def _within(code: int, ranges: tuple[tuple[int, int], ...]) -> bool:
    return any(low <= code <= high for low, high in ranges)


@lru_cache(maxsize=1)
def _tables() -> tuple[dict[int, str | None], re.Pattern[str]]:
    """The replacement of every code point that has one, by rule from the character database."""
    table: dict[int, str | None] = {}
    for code in (code for first, last in TABLED for code in range(first, last + 1)):
        char = chr(code)
        kind = unicodedata.category(char)
        if kind == "Cf" or _within(code, INVISIBLE):
            table[code] = None
        elif kind == "Zs":
            table[code] = " "
        elif char in HYPHENS:
            table[code] = "-"
        elif 0xFF9E <= code <= 0xFF9F:  # half-width voicing marks join the letter before them
            table[code] = chr(0x3099 + code - 0xFF9E)
        else:
            shape = unicodedata.decomposition(char)
            if shape.startswith("<") and not shape.startswith(VISIBLE) and not _within(code, ENCLOSED):
                plain = unicodedata.normalize("NFKC", char)
                if not plain.startswith(" ") or kind == "Zs":
                    table[code] = plain
    for code in [*range(0x00, 0x09), 0x0B, 0x0C, *range(0x0E, 0x20), *range(0x7F, 0xA0)]:
        table[code] = None
    codes = sorted(table)
    spans, start = [], codes[0]
    for left, right in zip(codes, [*codes[1:], None], strict=True):
        if right != left + 1:
            spans.append((start, left))
            start = right
    body = "".join(f"\\U{a:08x}" + (f"-\\U{b:08x}" if b > a else "") for a, b in spans)
    return table, re.compile(f"[{body}]")


def fold(text: str) -> str:
    """Character-level form: width, composition, invisible characters, spaces and hyphens made one."""
    if text.isascii() and text.isprintable():
        return text
    table, special = _tables()
    if special.search(text):
        text = text.translate(table)
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def suspects(text: str) -> list[tuple[str, str]]:
    """Words of a folded text that hold look-alikes of another script, with their repaired form.

    In a word of mixed scripts the letters that look like none of the other script are sure; the word is repaired
    towards the one script that has sure letters. If neither has, and in a word of look-alikes only, the sure letters of
    the whole text decide. A word with sure letters of both scripts is left as it is.
    """
    if not _FOREIGN.search(text):
        return []
    words = list(dict.fromkeys(_WORD.findall(text)))
    sure = [any(c not in alike for w in words for c in letters.findall(w)) for letters, alike, _ in _SCRIPTS]
    found = []
    for word in words:
        if word.isascii() and not any(sure):
            continue
        latin = _LATIN.findall(word)
        own = [i for i, (letters, _, _) in enumerate(_SCRIPTS) if letters.search(word)]
        foreign = [c for i in own for c in _SCRIPTS[i][0].findall(word)]
        certain = any(c not in LOOKALIKES for c in foreign)
        if foreign and not certain:  # nothing but look-alikes beside the Latin letters, if any
            script = own[0]
            plain = any(ord(c) not in _SCRIPTS[script][2] for c in latin)
            if plain or len(own) > 1 or not sure[script]:
                found.append((word, word.translate(_TO_LATIN)))
            elif latin:
                found.append((word, word.translate(_SCRIPTS[script][2])))
        elif latin and len(own) == 1 and certain:
            back = _SCRIPTS[own[0]][2]
            if all(ord(c) in back for c in latin):
                found.append((word, word.translate(back)))
        elif latin and not foreign and sum(sure) == 1:  # a Latin word of look-alikes in a text without a sure Latin letter
            back = _SCRIPTS[sure.index(True)][2]
            if all(ord(c) in back for c in latin) and all(ord(c) in back for c in _LATIN.findall(text)):
                found.append((word, word.translate(back)))
    return found


def unspaced_suspects(text: str) -> list[tuple[int, str, list[str]]]:
    """Look-alikes of kana and Han in the company of the other script: place, replacement, and what it makes with either neighbour."""
    if not _UNSPACED_ANY.search(text):
        return []
    found = []
    for m in _UNSPACED.finditer(text):
        at, new = m.start(), _SWAP[m[0]]
        near = [text[at - 1] + new] if at and _RUN.match(text[at - 1]) else []
        if at + 1 < len(text) and _RUN.match(text[at + 1]):
            near.append(new + text[at + 1])
        found.append((at, new, near))
    return found


def repair(text: str, accepted: set[str] | None) -> str:
    """Replace suspects whose repaired token is accepted; all of them if ``accepted`` is None."""
    pairs = {raw: new for raw, new in suspects(text) if accepted is None or new.lower() in accepted}
    marks = [(at, new) for at, new, near in unspaced_suspects(text) if accepted is None or not accepted.isdisjoint(near)]
    if marks:  # one character for one, so words keep their places
        changed = list(text)
        for at, new in marks:
            changed[at] = new
        text = "".join(changed)
    return _WORD.sub(lambda m: pairs.get(m[0], m[0]), text) if pairs else text


def skeleton(text: str) -> str:
    """The form to compare single texts by: folded, and repaired without asking a vocabulary."""
    return text if text.isascii() and text.isprintable() else repair(fold(text), None)


def canonical_text(frame: DataFrame, text: str, *, key: list[str]) -> DataFrame:
    """Add ``canonical``, the consistent form of column ``text``, to the key columns of every row.

    The corpus vocabulary of the repair holds the tokens that stand clean in any row of ``frame`` and the repaired
    words that two different records lead to; a redelivered record counts once. Only suspect tokens are looked up: clean tokens are aggregated per
    partition before the shuffle and joined with the suspects on the token, so nothing corpus-sized is broadcast.

    Returns the ``key`` columns, ``stored`` (MD5 of the text as stored) and ``canonical``. A null text stays null, an
    empty one empty; a repeated row may come out once or as often as it stands; an empty table gives an empty table.
    """

    inner = [f"__k{i}" for i in range(len(key))]

    def folded(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        base = [None if t is None else fold(t) for t in texts]
        odd = [None if b is None else (list(dict.fromkeys([*(n.lower() for _, n in suspects(b)), *(t for _, _, near in unspaced_suspects(b) for t in near)])) or None) for b in base]
        kept = batch.columns[:-1]
        return pa.RecordBatch.from_arrays(
            [*kept, pa.array(base, pa.string()), pa.array(odd, pa.list_(pa.string()))], names=[*inner, "stored", "base", "odd"]
        )

    source = frame.select(*(F.col(k).alias(i) for k, i in zip(key, inner, strict=True)), F.md5(text).alias("stored"), F.col(text).alias("text"))
    types = ", ".join(f"{i} {source.schema[i].dataType.simpleString()}" for i in inner)
    base = write_table(map_batches(source, folded, f"{types}, stored string, base string, odd array<string>"), "folded").frame
    record = F.struct(*inner)
    wanted = base.where("odd is not null").select(F.explode("odd").alias("token"), record.alias("r"))
    wanted = wanted.groupBy("token").agg((F.min("r") < F.max("r")).alias("several"))
    words = F.transform(F.regexp_extract_all("base", F.lit(WORD_TOKENS), F.lit(1)), F.lower)
    pairs = F.when(F.rlike("base", F.lit(f"[{_AMBIGUOUS}]")), F.regexp_extract_all("base", F.lit(UNSPACED_TOKENS), F.lit(1))).otherwise(F.array())
    clean = base.select(F.explode(F.array_distinct(F.concat(words, pairs))).alias("token"))
    clean = clean.groupBy("token").agg(F.lit(1).alias("seen"))
    word = F.col("token").rlike(f"^{WORD_TOKENS}$")
    accepted = wanted.join(clean, "token", "left").where((F.col("seen") == 1) | (F.col("several") & word)).select("token")
    # Rows with suspects are few; they are told apart by a hash of key and text, and meet only their own tokens.
    odd = base.where("odd is not null").withColumn("token", F.explode("odd")).join(accepted, "token")
    odd = odd.groupBy(*inner, "stored").agg(F.any_value("base").alias("base"), F.collect_set("token").alias("accepted"))

    def repaired(batch: pa.RecordBatch) -> pa.RecordBatch:
        *kept, texts, tokens = batch.columns
        done = [repair(b, set(a)) for b, a in zip(texts.to_pylist(), tokens.to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([*kept, pa.array(done, pa.string())], names=[*inner, "stored", "canonical"])

    fixed = map_batches(odd, repaired, f"{types}, stored string, canonical string")
    kept = base.where("odd is not null").join(odd.select(*inner, "stored"), [*inner, "stored"], "left_anti")
    rest = base.where("odd is null").unionByName(kept).select(*inner, "stored", F.col("base").alias("canonical"))
    return rest.unionByName(fixed).toDF(*key, "stored", "canonical")


def same_look_pairs(canon: DataFrame, *, table: str, key: str) -> DataFrame:
    """Pairs of one table's records that look the same but are stored differently, smaller id first.

    ``canon`` has ``table, key, stored, canonical``. Rows are reduced to a 128-bit digest of the canonical form
    before the first shuffle and kept, without their texts, as a table; only groups that hold two stored forms or more are joined, on the digest and with the
    stored forms unequal, so exact copies never meet each other. Redelivered rows count once.
    """
    rows = canon.where(F.col("canonical").isNotNull()).select(
        F.col(table).alias("t"), F.col(key).alias("k"), "stored", F.md5("canonical").alias("look")
    )
    rows = write_table(rows, "looks").frame
    groups = rows.groupBy("t", "look").agg(F.min("stored").alias("a"), F.max("stored").alias("b")).where("a <> b")
    members = rows.join(groups.select("t", "look"), ["t", "look"], "left_semi").distinct()
    left, right = members.alias("x"), members.alias("y")
    same = F.expr("x.t = y.t and x.look = y.look and x.k < y.k and x.stored <> y.stored")
    return (
        left.join(right, same)
        .select(F.col("x.t").alias("record_table"), F.col("x.k").alias("left_id"), F.col("y.k").alias("right_id"))
        .distinct()
    )


def look_classes(canon: DataFrame, *, table: str, key: str) -> DataFrame:
    """Records that look like another one stored differently, one row each, without pairs.

    Returns the table and key columns, ``class_id`` (the smallest key of the class), ``records`` and ``forms`` (how many
    records and stored forms the class holds).
    """
    rows = canon.where(F.col("canonical").isNotNull()).select(F.col(table).alias("t"), F.col(key).alias("k"), "stored", F.md5("canonical").alias("look"))
    rows = write_table(rows.distinct(), "looks").frame
    sizes = rows.groupBy("t", "look").agg(F.min("k").alias("class_id"), F.count_distinct("k").alias("records"), F.count_distinct("stored").alias("forms")).where("forms > 1")
    return rows.select("t", "k", "look").distinct().join(sizes, ["t", "look"]).select(F.col("t").alias(table), F.col("k").alias(key), "class_id", "records", "forms")

"""Keyword-stuffed and link-list pages.

A text is read as a sequence of terms with their positions. Four signals mark stretches of it:

* recurrence: a content term that comes back at short or even gaps. The gaps of a term are divided by their mean: where
  terms come back by chance their coefficient of variation is about one, where somebody repeats them on purpose it is
  far lower. Besides, the positional autocorrelation of the stretch - for each lag the share of positions whose term
  stands again just so many positions later - must be high in some window of neighbouring lags;
* links: bare addresses, Markdown links, and anchor-and-address items;
* labels: hashtags, and ``label: value`` items whose labels recur;
* nouns: long lists of short distinct items without any function word.

A text is stuffed if the marked stretches hold more than half of its visible characters.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.arrow import map_batches
from textloom.llm.canonical import skeleton
from textloom.llm.residue import LATIN_FILLER

#: Lags in terms over which a term may come back to start a stretch, and those of an evenly repeated term.
LAG, FAR = 8, 24
#: Least number of occurrences in a chain of short gaps, and in one of even gaps.
CHAIN, EVEN = 4, 6
#: Neighbouring lags taken together, and the least autocorrelation of a stretch in some such window.
LAGS, AUTOCORRELATION = 3, 0.15
#: Least share of the occurrences of an evenly repeated term that come back within one such window.
RETURN = 0.5
#: Largest variation of the gaps of a stretch, and of the gaps of one evenly repeated term.
VARIATION, EVENNESS = 0.75, 0.35
#: Least number of items in a list of distinct nouns.
ITEMS = 8
#: Share of the visible characters from which on a text is stuffed.
SHARE = 0.5

# Words that carry a sentence.
FUNCTION_WORDS = frozenset(
    "a an the this that these those and or but nor so if then than as at by for from in into of off on onto out over to under up with within "
    "without is are was were be been being am do does did has have had will would shall should can could may might must not no it its he she they "
    "them we you i me my your his her their our who whom whose which what when where why how while there here very also only just both each every all "
    "any some more most other such because although though before after during between against about beside".split()
)
# Characters and endings that carry a sentence in writing without spaces or with attached particles.
CHINESE_FUNCTION = re.compile(r"[的了着著把被是與与而且也都就在和对對从從这這那将將]|因[为為]|所以|以及")
JAPANESE_FUNCTION = re.compile(r"[はがをにでとへもや]|から|まで|ので|です|ます|した|する|ない")
KOREAN_FUNCTION = re.compile(r"(?:은|는|을|를|에|에서|에게|으로|로|와|과|의|다|요|고|며|까지|부터|만|지만|려고|했다|한다)$")

_LINK = r"\[[^\[\]\n]{0,80}\]\([^()\s]{3,300}\)|(?:https?://|ftp://|www\.)[^\s<>\"'、，,;|]+|\b(?:[a-z0-9](?:[a-z0-9\-]*[a-z0-9])?\.)+(?:com|org|net|info|biz|example|[a-z]{2})\b(?:/[^\s<>\"'、，,;|]*)?"
_TERM = re.compile(
    rf"(?P<link>{_LINK})|(?P<tag>[#＃][^\s#＃,;|、，；/·•]+)|(?P<label>[^\W\d_]{{1,16}}(?:[ \-][^\W\d_]{{1,12}})?)[:：=](?!//)[ \t]*(?P<value>[^\s,;|、，；/·•]+)"
    r"|(?P<word>[^\W\d_]+(?:['’\-][^\W\d_]+)*|\d+)|(?P<end>[.!?。！？…]+(?=\s|$|[^\s\w])|[。！？]+)|(?P<cut>[,;|、，；/·•‧・»›>→~*+\n\r\t]|\s-\s)",
    re.IGNORECASE,
)


def _function(word: str) -> bool:
    if word.isascii():
        return word in FUNCTION_WORDS or word in LATIN_FILLER
    first = ord(word[0])
    if 0xAC00 <= first <= 0xD7A3:
        return len(word) > 1 and bool(KOREAN_FUNCTION.search(word))
    if any(0x3040 <= ord(c) <= 0x30FF for c in word):
        return len(word) > 10 or len(JAPANESE_FUNCTION.findall(word)) >= 2
    return len(word) > 8 or bool(len(word) > 2 and CHINESE_FUNCTION.search(word))


def _visible(text: str) -> int:
    return len("".join(text.split()))


def stuffed_share(text: str) -> tuple[float, dict[str, int]]:
    """The share of visible characters in marked stretches, and the number of marked terms by signal."""
    text = skeleton(text).lower()
    total = _visible(text)
    if not total:
        return 0.0, {}
    terms: list[tuple[str, str, int, int]] = []  # kind, form, start, end
    for m in _TERM.finditer(text):
        kind = m.lastgroup if m.lastgroup != "value" else "label"
        form = m["label"] if kind == "label" else m[0]
        if kind == "cut" and terms and terms[-1][0] == "cut":
            continue
        terms.append((kind, form, m.start(), m.end()))
    marked = [False] * len(terms)
    signals: dict[str, int] = defaultdict(int)

    def mark(i: int, signal: str) -> None:
        if not marked[i]:
            marked[i] = True
            signals[signal] += 1

    # Links, with the anchor written before an arrow.
    links = [i for i, t in enumerate(terms) if t[0] == "link"]
    if len(links) >= 2:
        for i in links:
            mark(i, "links")
            j = i - 1
            while j >= 0 and terms[j][0] == "cut" and terms[j][1] == "»":
                j -= 1
            if j < i - 1:
                for _ in range(3):
                    if j >= 0 and terms[j][0] == "word" and not (terms[j][1] in FUNCTION_WORDS):
                        mark(j, "links")
                        j -= 1
    # Hashtags, and labels that recur.
    tags = [i for i, t in enumerate(terms) if t[0] == "tag"]
    if len(tags) >= CHAIN:
        for i in tags:
            mark(i, "labels")
    labels: dict[str, list[int]] = defaultdict(list)
    for i, t in enumerate(terms):
        if t[0] == "label":
            labels[t[1]].append(i)
    held = [i for group in labels.values() for i in group]
    if len(held) >= CHAIN and (len(held) >= ITEMS or max(map(len, labels.values())) >= 2):
        for i in held:
            mark(i, "labels")
    # Recurrence gaps of content terms within the lag window, over words alone.
    words = [i for i, t in enumerate(terms) if t[0] == "word"]
    ended = [0] * (len(terms) + 1)  # sentence ends before each term; no stretch reaches over one
    for i, t in enumerate(terms):
        ended[i + 1] = ended[i] + (t[0] == "end")
    places: dict[str, list[int]] = defaultdict(list)
    for p, i in enumerate(words):
        if not terms[i][1].isdigit():
            places[terms[i][1]].append(p)
    repeats = [False] * len(words)
    for form, at in places.items():
        if len(at) < 2 or _function(form):
            continue
        for a, b in zip(at, at[1:], strict=False):
            if b - a <= LAG and ended[words[a]] == ended[words[b]]:
                repeats[a] = repeats[b] = True
    chain: list[int] = []
    for p in [*[q for q, r in enumerate(repeats) if r], None]:
        if p is not None and (not chain or (p - chain[-1] <= LAG - 2 and ended[words[p]] == ended[words[chain[-1]]])):
            chain.append(p)
            continue
        _close(chain, words, terms, mark)
        chain = [p] if p is not None else []
    # A term that comes back evenly, though at longer gaps.
    for form, at in places.items():
        if len(at) < EVEN or _function(form):
            continue
        chain = []
        for p in [*at, None]:
            if p is not None and (not chain or (p - chain[-1] <= FAR and ended[words[p]] == ended[words[chain[-1]]])):
                chain.append(p)
                continue
            if len(chain) >= EVEN and gap_variation([chain]) <= EVENNESS:
                _close(chain, words, terms, mark, even=True)
            chain = [p] if p is not None else []
    # Lists of short items without function words; every fourth item may break the rule.
    run: list[list[int]] = []
    item: list[int] = []
    plain = 0

    def close_items() -> None:
        nonlocal plain
        if plain >= ITEMS and 4 * plain >= 3 * len(run):
            for x in run:
                for i in x:
                    mark(i, "nouns")
        run.clear()
        plain = 0

    for i, t in enumerate([*terms, ("end", "", 0, 0)]):
        if t[0] == "word":
            item.append(i)
        elif t[0] in ("cut", "end"):
            if item:
                forms = [terms[j][1] for j in item]
                short = terms[item[-1]][3] - terms[item[0]][2] <= 40 and len(item) <= 5
                good = short and len(item) <= 4 and not any(map(_function, forms)) and not all(f.isdigit() for f in forms)
                if not short:
                    close_items()
                else:
                    run.append(item)
                    plain += good
                item = []
            if t[0] == "end":
                close_items()
    # Marked characters: marked terms, and what stands between two of them without an unmarked word.
    covered, last = 0, None
    for i, t in enumerate(terms):
        if marked[i]:
            covered += _visible(text[last if last is not None else t[2] : t[3]])
            last = t[3]
        elif t[0] != "cut":
            last = None
    return covered / total, dict(signals)


def gap_variation(places: Iterable[list[int]]) -> float:
    """Coefficient of variation of recurrence gaps, each divided by the mean of its term's; about one where terms fall by chance."""
    gaps = [np.diff(at) / np.mean(np.diff(at)) for at in places if len(at) >= 3]
    return float(np.std(np.concatenate(gaps))) if gaps else np.inf


def autocorrelation(terms: np.ndarray, at: np.ndarray | None = None) -> float:
    """The highest sum over ``LAGS`` neighbouring lags, up to ``FAR``, of the share of positions whose term stands again that many positions later.

    ``at`` restricts the positions to those of one term.
    """
    start = np.arange(len(terms)) if at is None else at
    lags = np.arange(1, FAR + LAGS)
    later = start[None, :] + lags[:, None]
    inside = later < len(terms)
    same = inside & (terms[np.minimum(later, len(terms) - 1)] == terms[start][None, :])
    share = same.sum(axis=1) / np.maximum(inside.sum(axis=1), 1)
    return float(np.convolve(share, np.ones(LAGS), "valid").max())


def _close(chain: list[int], words: list[int], terms: list, mark, even: bool = False) -> None:
    """Mark the stretch of a chain if it is unnaturally regular and not prose; ``even`` for the chain of one term."""
    if len(chain) < CHAIN:
        return
    forms = [terms[words[p]][1] for p in range(chain[0], chain[-1] + 1)]
    at: dict[str, list[int]] = defaultdict(list)
    for i, form in enumerate(forms):
        at[form].append(i)
    functional = sum(len(x) for form, x in at.items() if _function(form))
    if max(len(at[terms[words[p]][1]]) for p in chain) < CHAIN or functional > 0.25 * len(forms):
        return
    if not even:
        numbers = {form: i for i, form in enumerate(at)}
        if autocorrelation(np.array([numbers[f] for f in forms])) < AUTOCORRELATION:
            return
        if gap_variation(x for form, x in at.items() if not _function(form)) > VARIATION:
            return
    else:
        own = np.array([f == forms[0] for f in forms])
        if autocorrelation(own, np.flatnonzero(own)) < RETURN:
            return
    lead = 0
    while lead < 2 and chain[0] - lead - 1 >= 0:  # the qualifier before the first occurrence
        p = chain[0] - lead - 1
        if words[p] + 1 != words[p + 1] or _function(terms[words[p]][1]) or terms[words[p]][1].isdigit():
            break
        lead += 1
    for p in range(chain[0] - lead, chain[-1] + 1):
        mark(words[p], "recurrence")


def stuffing(frame: DataFrame, *, key: str, text: str) -> DataFrame:
    """One row per distinct record with its ``share`` of marked characters and the ``signals`` that marked them.

    A single pass over the texts, without a shuffle of them: every text is judged whole, alone and once per delivery;
    redelivered rows are then counted once by ``key``. Null and empty texts have share 0; an empty table gives no rows.
    """

    def judge(batch: pa.RecordBatch) -> dict[str, list]:
        keys, texts = (c.to_pylist() for c in batch.columns)
        done = [stuffed_share(x) if x else (0.0, {}) for x in texts]
        return {"k": keys, "share": [s for s, _ in done], "signals": [sorted(n) for _, n in done]}

    kind = frame.schema[key].dataType.simpleString()
    judged = map_batches(frame.select(F.col(key).alias("k"), F.col(text).alias("x")), judge, f"k {kind}, share double, signals array<string>")
    return judged.groupBy(F.col("k").alias(key)).agg(F.max("share").alias("share"), F.max_by("signals", "share").alias("signals"))

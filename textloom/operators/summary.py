"""Grouped summaries, quantile rules, gates and translation scores."""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def nearest_rank(value: Column | str, share: float) -> Column:
    """The value at rank ceil(p * n)."""
    return F.expr(f"percentile_disc({share}) within group (order by {value})") if isinstance(value, str) else F.percentile(value, share)


def at_index(frame: DataFrame, group: Sequence[str], value: str, shares: dict[str, float], rule: str) -> DataFrame:
    """Quantiles by index from 0: ``floor((n - 1) * p)`` for rule "truncate", ``round half even`` of it for rule "even".

    Works on a histogram: values are counted first, so a group's rows are never sorted, only its distinct values.
    """
    counts = frame.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"))
    line = W.partitionBy(*group).orderBy(value)
    placed = counts.withColumn("upto", F.sum("n").over(line.rowsBetween(W.unboundedPreceding, 0)))
    placed = placed.withColumn("all", F.sum("n").over(W.partitionBy(*group)))
    wanted = []
    for name, share in shares.items():
        at = (F.col("all") - 1) * share
        index = F.floor(at) if rule == "truncate" else F.bround(at)
        wanted.append(F.min(F.when(F.col("upto") > index, F.col(value))).alias(name))
    return placed.groupBy(*group).agg(*wanted)


def gates(frame: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """One row per failing gate: ``key, gate``. An unknown measure fails."""
    failing = F.array_compact(F.array(*(F.when(F.coalesce(~passed, F.lit(True)), F.lit(name)) for name, passed in checks.items())))
    return frame.select(key, F.explode(failing).alias("gate"))


def assertions(frame: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Named assertions over a table: how many rows break each."""
    counted = frame.agg(*(F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in checks.items()))
    pairs = F.array(*(F.struct(F.lit(n).alias("assertion"), F.col(n).alias("violations")) for n in checks))
    return counted.select(F.explode(pairs).alias("x")).select("x.*")


# -- fixed values: the published definitions of BLEU's 13a tokens and of chrF's word pieces ------------------------
ENTITIES = (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
TOKEN_RULES = (
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "),
    (r"([^0-9])([\.,])", r"\1 \2 "),
    (r"([\.,])([^0-9])", r" \1 \2"),
    (r"([0-9])(-)", r"\1 \2 "),
)
ORDERS, CHARACTER_ORDER, BETA = 4, 6, 2
# --------------------------------------------------------------------------------------------------------------------


def bleu_tokens(text: str, kind: str) -> list[str]:
    """Tokens of the kinds ``13a`` and ``char``."""
    if kind == "char":
        return list("".join(text.split()))
    text = text.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for name, char in ENTITIES:
        text = text.replace(name, char)
    text = f" {text} "
    for pattern, new in TOKEN_RULES:
        text = re.sub(pattern, new, text)
    return text.split()


def word_pieces(text: str) -> list[str]:
    """Words with one punctuation mark at the end, or else at the start, as a piece of its own."""
    out = []
    for word in text.split():
        if len(word) > 1 and word[-1] in string.punctuation:
            out += [word[:-1], word[-1]]
        elif len(word) > 1 and word[0] in string.punctuation:
            out += [word[0], word[1:]]
        else:
            out.append(word)
    return out


def _overlaps(ours: list[str], theirs: list[str], order: int) -> list[int]:
    """Matches, hypothesis and reference totals for n-grams of 1 to ``order``."""
    out = []
    for n in range(1, order + 1):
        a = Counter(zip(*(ours[i:] for i in range(n)), strict=False))
        b = Counter(zip(*(theirs[i:] for i in range(n)), strict=False))
        out += [sum(min(v, b[k]) for k, v in a.items() if k in b), a.total(), b.total()]
    return out


def match_counts(hypothesis: str, reference: str, tokens: str, word_order: int) -> list[int]:
    """Statistics of one pair: BLEU's orders, then chrF's character orders and word orders.

    chrF counts nothing of a hypothesis for an order that the reference has no n-gram of.
    """
    out = _overlaps(bleu_tokens(hypothesis, tokens), bleu_tokens(reference, tokens), ORDERS)
    pairs = [(list("".join(hypothesis.split())), list("".join(reference.split())), CHARACTER_ORDER), (word_pieces(hypothesis), word_pieces(reference), word_order)]
    for ours, theirs, order in pairs:
        stats = _overlaps(ours, theirs, order)
        for n in range(order):
            match, mine, other = stats[3 * n : 3 * n + 3]
            out += [match, mine if other else 0, other]
    return out


def score_columns(word_order: int) -> tuple[Column, Column]:
    """BLEU (exponential smoothing, effective order) and chrF of the summed statistics ``c0, c1, ...``."""
    col = lambda i: F.col(f"c{i}").cast("double")
    smooth, logs, used, live = F.lit(1.0), F.lit(0.0), F.lit(0), F.lit(True)
    for n in range(ORDERS):
        match, total = col(3 * n), col(3 * n + 1)
        live = live & (total > 0)
        smooth = F.when(live & (match == 0), smooth * 2).otherwise(smooth)
        logs = logs + F.when(live, F.log(F.when(match > 0, 100 * match).otherwise(100 / smooth) / F.greatest(total, F.lit(1.0)))).otherwise(0.0)
        used = used + F.when(live, 1).otherwise(0)
    any_match = sum((F.col(f"c{3 * n}") for n in range(1, ORDERS)), F.col("c0")) > 0
    brevity = F.when(col(1) >= col(2), 1.0).otherwise(F.exp(1 - F.try_divide(col(2), col(1))))
    bleu = F.when(any_match, brevity * F.exp(logs / F.greatest(used, F.lit(1)))).otherwise(0.0)
    precision, recall, orders = F.lit(0.0), F.lit(0.0), F.lit(0)
    for n in range(ORDERS, ORDERS + CHARACTER_ORDER + word_order):
        match, mine, other = col(3 * n), col(3 * n + 1), col(3 * n + 2)
        both = (mine > 0) & (other > 0)
        precision = precision + F.when(both, match / F.greatest(mine, F.lit(1.0))).otherwise(0.0)
        recall = recall + F.when(both, match / F.greatest(other, F.lit(1.0))).otherwise(0.0)
        orders = orders + F.when(both, 1).otherwise(0)
    p, r = precision / F.greatest(orders, F.lit(1)), recall / F.greatest(orders, F.lit(1))
    chrf = F.coalesce(F.try_divide(100 * (1 + BETA**2) * p * r, BETA**2 * p + r), F.lit(0.0))
    return bleu, chrf


def corpus_scores(frame: DataFrame, group: str, hypothesis: str, reference: str, *, tokens: str = "13a", word_order: int = 0) -> DataFrame:
    """Corpus BLEU over ``13a`` or ``char`` tokens and chrF (``word_order`` 2 makes it chrF++) by group.

    The n-gram statistics of each row are computed in Arrow batches and summed by the ordinary partial aggregation; the
    scores are expressions over the sums. Null texts count as empty; a group without any match scores 0.
    """
    width = 3 * (ORDERS + CHARACTER_ORDER + word_order)

    @F.pandas_udf("array<long>")
    def counts(ours: pd.Series, theirs: pd.Series) -> pd.Series:
        return pd.Series([match_counts(a or "", b or "", tokens, word_order) for a, b in zip(ours, theirs, strict=True)])

    rows = frame.select(group, counts(F.col(hypothesis), F.col(reference)).alias("c"))
    sums = rows.groupBy(group).agg(F.count("*").alias("records"), *(F.sum(F.col("c")[i]).alias(f"c{i}") for i in range(width)))
    bleu, chrf = score_columns(word_order)
    return sums.select(group, "records", bleu.alias("bleu"), chrf.alias("chrf"))


def scores_of(pairs: list[tuple[str, str]], tokens: str = "13a", word_order: int = 0) -> tuple[float, float]:
    """The same scores of a list of pairs, for comparison."""
    rows = [match_counts(a or "", b or "", tokens, word_order) for a, b in pairs]
    total = [sum(c) for c in zip(*rows, strict=True)]
    smooth, precisions = 1.0, []
    for n in range(ORDERS):
        match, mine = total[3 * n], total[3 * n + 1]
        if not mine:
            break
        if not match:
            smooth *= 2
        precisions.append(100 * match / mine if match else 100 / (smooth * mine))
    bleu = 0.0
    if any(total[3 * n] for n in range(ORDERS)):
        brevity = 1.0 if total[1] >= total[2] else math.exp(1 - total[2] / total[1])
        bleu = brevity * math.exp(sum(map(math.log, precisions)) / len(precisions))
    orders = [total[3 * n : 3 * n + 3] for n in range(ORDERS, len(total) // 3)]
    orders = [(m, h, r) for m, h, r in orders if h and r]
    if not orders:
        return bleu, 0.0
    p, r = sum(m / h for m, h, _ in orders) / len(orders), sum(m / r for m, _, r in orders) / len(orders)
    return bleu, 100 * (1 + BETA**2) * p * r / (BETA**2 * p + r) if p + r else 0.0

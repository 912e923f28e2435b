"""Generation prompts, review batches, decision contracts and attestations: the data side of model calls.

The calls themselves are not made here: their answers are input tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.identity import sha


def render(template: str, fields: dict[str, Column]) -> Column:
    """A template with ``{name}`` replaced by columns; braces in the values stay as they are."""
    out: list[Column] = []
    rest = template
    while rest:
        spots = [(rest.find("{" + n + "}"), n) for n in fields if "{" + n + "}" in rest]
        if not spots:
            out.append(F.lit(rest))
            break
        at, name = min(spots)
        out += [F.lit(rest[:at]), fields[name]]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*out)


def payloads(batched: DataFrame, keys: Sequence[str], order: str, fields: Sequence[str]) -> DataFrame:
    """One JSON request per batch with its items in order. Batches are bounded by construction."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*fields).alias("item"))))
    rows = batched.groupBy(*keys).agg(items.alias("i"))
    body = F.to_json(F.struct(F.transform("i", lambda x: x["item"]).alias("items")), {"ignoreNullFields": "false"})
    return rows.select(*keys, F.size("i").alias("items"), body.alias("payload"))


def batch_plan(batched: DataFrame, keys: Sequence[str], order: str, tokens: str) -> DataFrame:
    """The frozen plan of batches: size, tokens, first and last item, identity of the ordered items."""
    ids = F.array_sort(F.collect_list(F.col(order)))
    return batched.groupBy(*keys).agg(
        F.count("*").alias("items"), F.sum(tokens).alias("tokens"), F.min(order).alias("first_item"), F.max(order).alias("last_item"),
        sha(F.array_join(ids, "\n")).alias("identity"),
    )


def decision_faults(decisions: DataFrame, items: DataFrame, key: str, *, verdicts: Sequence[str], categories: Sequence[str], text: str) -> DataFrame:
    """Faults of review answers against their queue: unknown, repeated, missing, or out of contract.

    ``decisions`` has the key, ``verdict``, ``categories`` and ``evidence``; evidence must stand in the item's ``text``.
    """
    counts = decisions.groupBy(key).agg(
        F.count("*").alias("answers"), F.first("verdict").alias("verdict"), F.first("categories").alias("categories"), F.first("evidence").alias("evidence")
    )
    both = counts.withColumn("_d", F.lit(True)).join(items.select(key, F.col(text).alias("_t")).withColumn("_i", F.lit(True)), key, "full")
    faults = F.array_compact(
        F.array(
            F.when(F.col("_i").isNull(), "unknown"),
            F.when(F.col("_d").isNull(), "missing"),
            F.when(F.col("answers") > 1, "repeated"),
            F.when(~F.col("verdict").isin(*verdicts), "verdict"),
            F.when(F.size(F.array_except(F.coalesce("categories", F.array()), F.array(*map(F.lit, categories)))) > 0, "category"),
            F.when(~F.contains("_t", F.col("evidence")), "evidence"),
        )
    )
    return both.select(key, F.explode(faults).alias("fault"))


def finalize(automatic: Column, rejected: Column, accepted: Column) -> Column:
    """Final verdict: accepted by rule and not rejected by hand, or accepted by hand."""
    no = F.lit(False)
    return (F.coalesce(automatic, no) & ~F.coalesce(rejected, no)) | F.coalesce(accepted, no)


def contiguous(frame: DataFrame, group: Sequence[str], index: str) -> DataFrame:
    """Groups whose checkpoint numbers are not 0 to n - 1."""
    rows = frame.groupBy(*group).agg(F.count("*").alias("n"), F.count_distinct(index).alias("d"), F.min(index).alias("low"), F.max(index).alias("high"))
    return rows.where("n <> d or low <> 0 or high + 1 <> n").select(*group, "n", "low", "high")


def is_prefix(small: DataFrame, large: DataFrame, group: Sequence[str], rank: str, key: str) -> DataFrame:
    """Per group: whether a small run is the exact beginning of a large one."""
    a = small.select(*group, rank, F.col(key).alias("_a"))
    b = large.select(*group, rank, F.col(key).alias("_b"))
    joined = a.join(b, [*group, rank], "left")
    return joined.groupBy(*group).agg(F.count("*").alias("records"), F.bool_and(F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))).alias("prefix"))


def contract_identity(frame: DataFrame, group: Sequence[str], order: str, fields: Sequence[str]) -> DataFrame:
    """Identity of each group's rows, so that runs of different inputs are never mixed.

    A group of any size is digested in 4,096 parts by the hash of its order key, each in order, and the parts' digests
    again: no task gathers a whole group.
    """
    line = F.concat_ws("\t", *fields)
    rows = frame.select(*group, F.substring(sha(F.col(order).cast("string")), 1, 3).alias("_p"), F.struct(F.col(order).alias("o"), line.alias("l")).alias("x"))
    parts = rows.groupBy(*group, "_p").agg(F.count("*").alias("n"), sha(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["l"]), "\n")).alias("d"))
    whole = parts.groupBy(*group).agg(F.sum("n").alias("records"), F.array_sort(F.collect_list(F.concat_ws("=", "_p", "d"))).alias("r"))
    return whole.select(*group, "records", sha(F.array_join("r", "\n")).alias("identity"))

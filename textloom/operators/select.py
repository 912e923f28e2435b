"""Ranked, stratified and budgeted selection. Nothing here depends on partitioning: every rank is a digest with a tie key."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.arrow import map_stream
from textloom.session import write_table


def top_per_group(frame: DataFrame, group: Sequence[str], order: Sequence[Column | str], size: int | Column, rank: str = "rank") -> DataFrame:
    """The first ``size`` rows of every group, with their rank from 1. The limit is pushed below the shuffle."""
    ranked = frame.withColumn(rank, F.row_number().over(W.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col(rank) <= size)


def bottom_k(frame: DataFrame, order: Sequence[Column | str], size: int) -> DataFrame:
    """The ``size`` least rows; a top-k per partition and one merge, no sort of the whole."""
    return frame.orderBy(*order).limit(size)


def ranked(frame: DataFrame, group: str, order: Sequence[str], name: str = "position") -> DataFrame:
    """Position of every row in its group's order from 0, for groups of any size.

    A window over a whole group would sort it in one task. Here rows are range-partitioned by group and order and kept
    as a table, numbered inside their partition, and shifted by what earlier partitions hold of the group: a table of
    at most partitions times groups rows.
    """
    rows = frame.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id())
    kept = write_table(rows, "ranked").frame
    sizes = kept.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shifts = sizes.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = F.row_number().over(W.partitionBy("_part", group).orderBy(*order)) - 1
    numbered = kept.withColumn("_inside", inside)
    joined = numbered.join(shifts, numbered[group].eqNullSafe(F.col("_g")) & (numbered["_part"] == F.col("_p")))
    return joined.withColumn(name, F.col("_inside") + F.col("_shift")).drop("_part", "_inside", "_g", "_p", "_shift")


def interleave(frame: DataFrame, stratum: str, rank: Column, strata_rank: Column, turns: int) -> DataFrame:
    """Round-robin order over strata, in closed form: position inside the stratum, then the stratum's own rank.

    Adds ``turn`` and ``stratum_rank``; only the first ``turns`` rows of a stratum are kept, which is cut off before
    the shuffle.
    """
    taken = frame.withColumn("turn", F.row_number().over(W.partitionBy(stratum).orderBy(rank))).where(F.col("turn") <= turns)
    return taken.withColumn("stratum_rank", strata_rank)


def exact_or_near_first(frame: DataFrame, near: str, exact: str, order: str) -> DataFrame:
    """First row of every near identity wins; the others are exact copies of the winner or near ones. Adds ``duplicate``.

    The winners are found by aggregation with partial results, and joined back: a near identity that a third of all
    rows share is one partial row per partition and a join that adaptive execution may split.
    """
    winners = frame.groupBy(F.col(near).alias("_near")).agg(F.min(F.struct(F.col(order).alias("o"), F.col(exact).alias("e"))).alias("_first"))
    rows = frame.join(winners, F.col(near) == F.col("_near"))
    label = F.when(F.col(order) == F.col("_first.o"), F.lit(None)).when(F.col("_first.e") == F.col(exact), F.lit("exact_duplicate")).otherwise("near_duplicate")
    return rows.withColumn("duplicate", label).drop("_near", "_first")


def greedy_disjoint(frame: DataFrame, key: str, rank: Column, claims: Column, *, used: DataFrame | None = None, max_rounds: int = 500) -> DataFrame:
    """Rows taken in the order of ``rank``, each unless an earlier taken row holds one of its claims: the frame's taken rows.

    The scan is sequential by definition, its result is not: a row that is first at all of its claims is taken, whatever
    holds a claim of a taken row is out, and the rest goes on the same way. With ranks that are digests a few rounds
    suffice, each a table of keys and claims. ``used`` (``claim``) is taken beforehand; null claims bind nothing, and a row without
    any claim is taken. Ranks are distinct; ``key`` is unique.
    """
    rows = write_table(frame.withColumn("_rank", rank).withColumn("_claims", F.array_distinct(F.array_compact(claims))), "ranked").frame
    spread = rows.select(F.col(key).alias("k"), F.col("_rank").alias("r"), F.explode_outer("_claims").alias("claim"))
    free = spread.where("claim is null").select("k")
    open_ = spread.where("claim is not null")
    if used is not None:
        barred = open_.join(used.select("claim").distinct(), "claim", "left_semi").select("k").distinct()
        open_ = open_.join(barred, "k", "left_anti")
    open_, taken = write_table(open_, "open"), [write_table(free, "taken")]
    for _ in range(max_rounds):
        if open_.frame.limit(1).count() == 0:
            break
        first = open_.frame.groupBy("claim").agg(F.min("r").alias("first"))
        won = open_.frame.join(first, "claim").groupBy("k").agg(F.bool_and(F.col("r") == F.col("first")).alias("won")).where("won").select("k")
        won = write_table(won, "taken")
        taken.append(won)
        held = open_.frame.join(won.frame, "k", "left_semi").select("claim").distinct()
        out = open_.frame.join(held, "claim", "left_semi").select("k").distinct()
        rest = write_table(open_.frame.join(out, "k", "left_anti"), "open")
        open_.drop()
        open_ = rest
    else:
        raise RuntimeError("the selection did not settle")
    keys = taken[0].frame
    for part in taken[1:]:
        keys = keys.unionByName(part.frame)
    return rows.join(keys.withColumnRenamed("k", key), key, "left_semi").drop("_rank", "_claims")


def capped_shares(counts: dict[str, int], ceilings: dict[str, float]) -> dict[str, int]:
    """Rows to keep of each class so that capped classes meet their share of the final total.

    Classes without a ceiling are kept whole. The caps bind each other through the total, so they are lowered together
    until none moves: a fixed point.
    """
    keep = dict(counts)
    while True:
        moved = False
        for name, ceiling in ceilings.items():
            others = sum(n for k, n in keep.items() if k != name)
            most = math.floor(ceiling * others / (1 - ceiling)) if ceiling < 1 else counts.get(name, 0)
            if keep.get(name, 0) > most:
                keep[name] = most
                moved = True
        if not moved:
            return keep


def with_ceilings(frame: DataFrame, kind: str, order: Sequence[Column | str], ceilings: dict[str, float]) -> DataFrame:
    """Rows kept under share ceilings by class, the first by ``order``.

    The driver gets one number for each capped class and one for all others together, however many classes there are.
    """
    capped = F.when(F.col(kind).isin(*ceilings), F.col(kind)) if ceilings else F.lit(None).cast("string")
    counts = {r[0]: r[1] for r in frame.groupBy(capped.alias("c")).agg(F.count("*").alias("n")).collect()}
    keep = capped_shares(counts, ceilings)
    limit = F.lit(None).cast("long")
    for name in ceilings:
        limit = F.when(F.col(kind) == name, F.lit(keep.get(name, 0))).otherwise(limit)
    own, others = frame.where(F.col(kind).isin(*ceilings)), frame.where(~F.coalesce(F.col(kind).isin(*ceilings), F.lit(False)))
    return top_per_group(own, [kind], order, limit).drop("rank").unionByName(others)


def _fold(frame: DataFrame, group: str, order: Sequence[str], value: str, start: Callable, step: Callable, mark: str) -> DataFrame:
    """Run a fold over each group's rows in order and add what it says of each row as ``mark``.

    Rows are brought together by group and sorted by Spark, which spills; the fold then reads each partition as a
    stream and holds only its own state, so a group of any size passes through without being gathered in memory.
    """
    schema = T.StructType([*frame.schema.fields, T.StructField(mark, T.LongType())])
    sorted_rows = frame.repartition(group).sortWithinPartitions(group, *order)

    def run(batches):
        current, state, first = None, None, True
        for batch in batches:
            names = batch.schema.names
            out = []
            for g, v in zip(batch.column(names.index(group)).to_pylist(), batch.column(names.index(value)).to_pylist(), strict=True):
                if first or g != current:
                    current, state, first = g, start(), False
                state, said = step(state, v)
                out.append(said)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*names, mark])

    return map_stream(sorted_rows, run, schema)


def greedy_fill(frame: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """Rows taken in order while they fit a budget per group; a row that does not fit is skipped and the next tried."""

    def step(left: int, n: int | None) -> tuple[int, int]:
        return (left - n, 1) if n is not None and n <= left else (left, 0)

    return _fold(frame.where(F.col(size) <= budget), group, [order], size, lambda: budget, step, "taken").where("taken = 1").drop("taken")


def token_batches(frame: DataFrame, group: str, order: str, tokens: str, *, most_rows: int, most_tokens: int) -> DataFrame:
    """Batch number of every row: a new batch where the row would break a cap. A running sum with resets. Adds ``batch``."""

    def step(state: tuple[int, int, int], n: int | None) -> tuple[tuple[int, int, int], int]:
        batch, held, total = state
        n = n or 0
        if held and (held == most_rows or total + n > most_tokens):
            batch, held, total = batch + 1, 0, 0
        return (batch, held + 1, total + n), batch

    return _fold(frame, group, [order], tokens, lambda: (0, 0, 0), step, "batch")


def smooth_shares(weights: dict[str, int], exposures: int) -> dict[str, int]:
    """How often each name is drawn by smooth weighted round robin in so many draws."""
    total = sum(weights.values())
    current, drawn = dict.fromkeys(weights, 0), dict.fromkeys(weights, 0)
    for _ in range(exposures % total if total else 0):
        for name, weight in weights.items():
            current[name] += weight
        best = max(weights, key=lambda n: (current[n], -list(weights).index(n)))
        current[best] -= total
        drawn[best] += 1
    return {name: drawn[name] + exposures // total * weight for name, weight in weights.items()}


def length_buckets(frame: DataFrame, order: Sequence[str], length: str, *, batch: int, pool: int, group: str) -> DataFrame:
    """Batches of similar length: rows in order form pools of ``pool`` batches, which are sorted by length and cut again."""
    rows = ranked(frame, group, order).withColumn("pool", F.floor(F.col("position") / (batch * pool)).cast("int")).drop("position")
    inside = F.row_number().over(W.partitionBy(group, "pool").orderBy(length, *order)) - 1
    return rows.withColumn("batch", F.floor(inside / batch).cast("int"))

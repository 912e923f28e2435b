"""A resumable sampler in closed form: weighted turns over routes, and inside a route its records epoch after epoch.

Any stretch of draws is computed from its first number alone, so the state to resume from is that number and the identity
of what is drawn from. Nothing is replayed, and no order of a route is held by the driver.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.identity import seeded
from textloom.operators.select import ranked
from textloom.session import write_table


def turns(weights: Mapping[str, int]) -> list[str]:
    """One cycle of smooth weighted turns: each route gains its weight, the richest - the first among equals - is drawn and pays the sum."""
    if not weights or any(w < 1 for w in weights.values()):
        raise ValueError("weights are whole and positive")
    shared = reduce(gcd, weights.values())
    weights = {name: w // shared for name, w in weights.items()}
    total, score, order = sum(weights.values()), dict.fromkeys(weights, 0), list(weights)
    cycle = []
    for _ in range(total):
        for name in order:
            score[name] += weights[name]
        best = max(order, key=lambda n: (score[n], -order.index(n)))
        score[best] -= total
        cycle.append(best)
    return cycle


@dataclass(frozen=True)
class SamplerState:
    """Where a sampler stands: what it draws from, and how many draws were made."""

    identity: str
    drawn: int = 0

    def advanced(self, count: int) -> SamplerState:
        return SamplerState(self.identity, self.drawn + count)

    def resumed(self, identity: str) -> SamplerState:
        """The same state, if it belongs to the sampler of this identity."""
        if identity != self.identity:
            raise ValueError("the state belongs to another sampler")
        return self


def sampler_identity(selection_sha256: str, weights: Mapping[str, int], seed: str) -> str:
    """Identity of a sampler: its records, its weights in their order, and its seed."""
    return hashlib.sha256(json.dumps([selection_sha256, list(weights.items()), seed], ensure_ascii=False).encode()).hexdigest()


def draws(records: DataFrame, *, route: str, key: str, weights: Mapping[str, int], seed: str, start: int, count: int) -> DataFrame:
    """Draws ``start`` to ``start + count - 1``: ``draw, route, epoch, place, key``.

    In every epoch a route's records are taken in an order of their own, by digest. Only the epochs that the stretch
    touches are ordered, as groups of any size. A route without records gives no draws; a null key or route is no record.
    """
    spark = records.sparkSession
    cycle = turns(weights)
    seen: dict[str, int] = {}
    slots = []
    for i, name in enumerate(cycle):
        slots.append((i, name, seen.get(name, 0), cycle.count(name)))
        seen[name] = seen.get(name, 0) + 1
    table = spark.createDataFrame(slots, "slot int, route string, before int, times int")
    line = spark.range(start, start + count).select(F.col("id").alias("draw"), (F.col("id") % len(cycle)).cast("int").alias("slot"), F.floor(F.col("id") / len(cycle)).alias("cycle"))
    turn = line.join(F.broadcast(table), "slot").withColumn("nth", F.col("cycle") * F.col("times") + F.col("before"))
    rows = records.where(F.col(key).isNotNull() & F.col(route).isNotNull()).select(F.col(route).alias("route"), F.col(key).alias("key"))
    sizes = rows.groupBy("route").agg(F.count("*").alias("n"))
    turn = turn.join(sizes, "route").withColumn("epoch", F.floor(F.col("nth") / F.col("n"))).withColumn("place", F.col("nth") % F.col("n"))
    turn = write_table(turn.select("draw", "route", "epoch", "place"), "draws").frame
    touched = turn.select("route", "epoch").distinct()
    group = F.concat_ws("\x1f", "route", "epoch")
    ordered = rows.join(touched, "route").withColumn("g", group).withColumn("digest", seeded(seed, F.col("epoch").cast("string"), F.col("key").cast("string")))
    placed = ranked(ordered, "g", ["digest", "key"], "at")
    met = turn.withColumn("g", group).join(placed.select("g", F.col("at").alias("place"), "key"), ["g", "place"])
    return met.select("draw", "route", "epoch", "place", F.col("key").alias(key))


def bucketed(drawn: DataFrame, length: Column, *, batch: int, pool: int) -> DataFrame:
    """Batches of similar length: each ``pool`` batches of draws are ordered by length and cut again. Adds ``batch``.

    Batch numbers follow from draw numbers, so a resumed run asks for the draws of the pools it still needs and skips the
    batches it has made.
    """
    from pyspark.sql import Window as W

    rows = drawn.withColumn("pool", F.floor(F.col("draw") / (batch * pool)))
    inside = F.row_number().over(W.partitionBy("pool").orderBy(length, "route", "epoch", "place", "draw")) - 1  # a pool is bounded
    return rows.withColumn("batch", F.col("pool") * pool + F.floor(inside / batch)).drop("pool")

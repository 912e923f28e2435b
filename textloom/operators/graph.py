"""Connected components of a bipartite record-entity graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from textloom.session import Table, write_table


def components(edges: DataFrame, record: str, entity: str, *, max_rounds: int = 200) -> DataFrame:
    """Label every entity with the smallest entity of its component.

    ``edges`` ties records to entities; two entities belong together if one record holds both, and so on through
    further records. Rounds of minimum-label propagation run entity -> record -> entity, each round followed by a
    pointer jump (an entity takes the label of its label), so a chain of length n settles in about log n rounds.
    Both directions are hash aggregations with map-side combine, so a record tied to very many entities, or an entity
    held by very many records, is never gathered in one task. Every round is cut by a table in the shared folder.

    Returns ``entity, component``. Null records or entities tie nothing and give no row; repeated edges count once;
    an empty input gives an empty result. Extra columns are ignored.
    """
    links = edges.where(F.col(record).isNotNull() & F.col(entity).isNotNull()).select(
        F.col(record).alias("r"), F.col(entity).alias("e")
    )
    # Records with one entity tie nothing: they are left out of the rounds and joined back as singletons.
    kept = write_table(links.distinct(), "edges")
    spread = kept.frame.groupBy("r").agg(F.min("e").alias("lo"), F.max("e").alias("hi")).where("lo <> hi").select("r")
    active = write_table(kept.frame.join(spread, "r", "left_semi"), "active")
    labels = write_table(active.frame.select("e").distinct().withColumn("l", F.col("e")), "labels")
    for _ in range(max_rounds):
        by_record = active.frame.join(labels.frame, "e").groupBy("r").agg(F.min("l").alias("m"))
        by_entity = active.frame.join(by_record, "r").groupBy("e").agg(F.min("m").alias("m"))
        moved = labels.frame.join(by_entity, "e", "left").select(
            "e", F.least("l", F.coalesce("m", "l")).alias("l"), F.col("l").alias("was")
        )
        step = write_table(moved, "step")
        up = step.frame.select(F.col("e").alias("l"), F.col("l").alias("up"))
        jumped = step.frame.join(up, "l", "left").select("e", F.least("l", F.coalesce("up", "l")).alias("l"), "was")
        seen = Observation()  # counted while the labels are written; counted twice by a task that runs again, but never none for some
        new = write_table(jumped.observe(seen, F.count_if(F.col("l") != F.col("was")).alias("changed")), "labels")
        step.drop()
        labels.drop()
        labels = Table(new.spark, new.frame.select("e", "l"), new.path)
        if not seen.get.get("changed", 0):
            break
    else:
        raise RuntimeError("label propagation did not settle")
    singles = kept.frame.select("e").distinct().join(labels.frame.select("e"), "e", "left_anti")
    return labels.frame.unionByName(singles.withColumn("l", F.col("e"))).select(
        F.col("e").alias("entity"), F.col("l").alias("component")
    )

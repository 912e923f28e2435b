"""Splits that keep related records together.

Records and entities (alignment keys, sample groups) form a bipartite graph; minimum-label propagation gives every key
the smallest key of its component. Components, not records, are then given a split: greedily from large to small, each
where it lowers the deviation of the splits' label counts from their targets most. A bounded number of giants goes
first; what they leave open is shared out to cells of bounded size, which are filled in parallel by the same rule.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.graph import components
from textloom.session import write_table

#: A component with this share of all records or more is a giant; there can be no more than 1 / GIANT of them.
GIANT = 0.005
#: Components of a cell, on average.
CELL = 20_000


def blank_free(column: str | Column) -> Column:
    """A key without surrounding blanks, in lower case; nothing left is no key."""
    return F.nullif(F.lower(F.regexp_replace(F.col(column) if isinstance(column, str) else column, r"(?U)^\s+|\s+$", "")), F.lit(""))


def split_name(column: str | Column) -> Column:
    """A split in one spelling: train, dev or test; dev, valid and validation are one; anything else stays as it is."""
    name = blank_free(column)
    return F.when(name.isin("valid", "validation"), F.lit("dev")).otherwise(name)


def key_components(records: DataFrame, *, group: str, key: str) -> DataFrame:
    """``alignment_key, component_key`` of every key that a group ties; keys compare by ``blank_free``."""
    tied = records.select(F.col(group).alias("g"), blank_free(key).alias("k"))
    return components(tied, "g", "k").select(F.col("entity").alias("alignment_key"), F.col("component").alias("component_key"))


def crossing_keys(locales: DataFrame, samples: DataFrame) -> DataFrame:
    """Keys whose component shows two splits or more.

    ``locales`` has ``alignment_key, split``; ``samples`` has ``group, alignment_key``. Null and blank keys, groups and
    splits tie and show nothing; repeated rows count once; an empty table gives no rows.
    """
    shown = locales.select(blank_free("alignment_key").alias("alignment_key"), split_name("split").alias("split"))
    shown = shown.where("alignment_key is not null and split is not null").groupBy("alignment_key").agg(
        F.min("split").alias("low"), F.max("split").alias("high")
    )
    tied = key_components(samples, group="group", key="alignment_key")
    rows = tied.join(shown, "alignment_key", "full").withColumn("component_key", F.coalesce("component_key", "alignment_key"))
    bad = rows.groupBy("component_key").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high")
    return rows.join(bad.select("component_key"), "component_key", "left_semi").select("alignment_key", "component_key")


class Greedy:
    """Components placed one after another, each where it lowers the squared deviation from the targets most.

    ``open`` holds what each split still wants of each label. Taking ``n`` of a label where ``w`` are wanted changes
    the squared deviation by ``n * n - 2 * n * w``; deviations count relative to the label's total, so rare labels are
    kept as well as frequent ones.
    """

    def __init__(self, names: list[str], wanted: dict[tuple[str, str | None], float], totals: dict[str | None, float]):
        self.names, self.open = names, dict(wanted)
        self.weight = {label: 1 / max(total, 1e-9) for label, total in totals.items()}

    def place(self, counts: dict[str | None, int]) -> str:
        def cost(name: str) -> float:
            return sum((n * n - 2 * n * self.open.get((name, label), 0.0)) * self.weight.get(label, 1.0) for label, n in counts.items())

        name = min(self.names, key=lambda x: (cost(x), self.names.index(x)))
        for label, n in counts.items():
            self.open[name, label] = self.open.get((name, label), 0.0) - n
        return name


def assign_splits(labelled: DataFrame, targets: DataFrame) -> DataFrame:
    """Give every component a split so that each split has its share of ``targets`` of every label, as nearly as whole components allow.

    ``labelled`` has ``component, label, records`` (how many records of a label a component has); ``targets`` has
    ``split, share``. Giants are placed first, with all their labels; their number is bounded by 1 / ``GIANT``, so they
    may pass the driver, as do the totals of the labels, a small set such as languages. The other components are dealt to cells by a hash; a cell takes
    of what is still open of a label the part that it holds of the label, and places its components from large to small.
    No task holds more than a cell.

    Returns ``component, split``. Null components have no row; a null label is a label; equal sizes are taken in the
    order of a hash, then of the component itself; an empty table gives no rows.
    """
    kind = labelled.schema["component"].dataType.simpleString()
    sums = labelled.where("component is not null").groupBy("component", "label").agg(F.sum("records").alias("records"))
    sums = write_table(sums, "labelled").frame
    wanted = [(r.split, float(r.share)) for r in targets.select(split_name("split").alias("split"), "share").orderBy(F.desc("share"), "split").collect()]
    if not wanted:
        raise ValueError("no split targets")
    names, whole = [name for name, _ in wanted], sum(share for _, share in wanted)
    sizes = sums.groupBy("component").agg(F.sum("records").alias("size"))
    total, count = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    labels = {r.label: r.records for r in sums.groupBy("label").agg(F.sum("records").alias("records")).collect()}
    first = Greedy(names, {(n, label): share / whole * r for n, share in wanted for label, r in labels.items()}, labels)
    big = sizes.where(F.col("size") >= GIANT * total)
    giants: dict = {}
    for r in sums.join(F.broadcast(big), "component").collect():
        giants.setdefault((-r.size, r.component), {})[r.label] = r.records
    placed = [(component, first.place(counts)) for (_, component), counts in sorted(giants.items())]
    spark = labelled.sparkSession
    done = spark.createDataFrame(placed, f"component {kind}, split string")
    left = {label: max(1e-9, sum(max(0.0, first.open[n, label]) for n in names)) for label in labels}
    share = {(n, label): max(0.0, first.open[n, label]) / left[label] for n in names for label in labels}
    rest = sums.join(F.broadcast(done.select("component")), "component", "left_anti")
    cells = max(1, -(-int(count) // CELL))
    rest = rest.withColumn("rank", F.xxhash64("component")).withColumn("cell", F.pmod(F.xxhash64("rank"), F.lit(cells)))

    def fill(table: pa.Table) -> pa.Table:
        counts: dict = {}
        totals: dict = {}
        for component, label, records, rank in zip(*(table.column(n).to_pylist() for n in ("component", "label", "records", "rank")), strict=True):
            counts.setdefault((rank, component), {})[label] = records
            totals[label] = totals.get(label, 0) + records
        order = sorted(counts, key=lambda x: (-sum(counts[x].values()), x))
        own = Greedy(names, {(n, label): share[n, label] * r for n in names for label, r in totals.items()}, totals)
        given = [own.place(counts[x]) for x in order]
        return pa.table({"component": pa.array([c for _, c in order], table.schema.field("component").type), "split": pa.array(given, pa.string())})

    dealt = rest.groupBy("cell").applyInArrow(fill, f"component {kind}, split string")
    return dealt.unionByName(done)


def split_shares(labelled: DataFrame, given: DataFrame, targets: DataFrame) -> DataFrame:
    """How near the splits come to their targets: ``split, label, records, share, target, deviation``.

    ``share`` is the split's part of the label's records; a row with a null label and ``whole`` true is about all records.
    """
    rows = labelled.where("component is not null").join(given, "component")
    sums = rows.groupBy("split", "label").agg(F.sum("records").alias("records"))
    all_ = sums.groupBy("split").agg(F.sum("records").alias("records")).select("split", F.lit(None).cast("string").alias("label"), "records", F.lit(True).alias("whole"))
    both = sums.withColumn("whole", F.lit(False)).unionByName(all_)
    total = both.groupBy(F.col("label").alias("of"), F.col("whole").alias("all")).agg(F.sum("records").alias("total"))
    joined = both.join(total, F.col("label").eqNullSafe(F.col("of")) & (F.col("whole") == F.col("all")))
    wanted = targets.select(split_name("split").alias("split"), F.col("share").alias("wanted"))
    scale = wanted.agg(F.sum("wanted").alias("scale"))
    wanted = wanted.crossJoin(F.broadcast(scale)).select("split", (F.col("wanted") / F.col("scale")).alias("target"))  # one row beside few
    part = F.col("records") / F.col("total")
    return joined.join(wanted, "split", "left").select("split", "label", "whole", "records", part.alias("share"), "target", (part - F.col("target")).alias("deviation"))

"""Same or near-same records across splits.

Records are brought to a canonical form and hashed without letter case, punctuation and white space; the hashes of
evaluation records are joined with those of training records, and the matches are counted by split and source. Texts
that differ in a letter have different hashes: forms, one for each distinct text, therefore also meet in an exact
similarity join over their rarest pieces, which loses no pair, and are labelled apart.
"""

from __future__ import annotations

from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.arrow import map_batches
from textloom.llm.canonical import skeleton
from textloom.llm.splits import split_name
from textloom.operators.dedup import linked_classes
from textloom.operators.setjoin import count_table, parity_sketch, piece_hashes, pieces, similar_pairs
from textloom.session import write_table

__all__ = ["overlap_form", "loose_hash", "pieces", "piece_hashes", "parity_sketch", "matched_texts", "split_overlaps", "overlap_report"]

#: Least similarity, in hundredths.
SIMILAR = 82
#: Kinds of match.
KINDS = ("same", "loose", "near")


def overlap_form(text: str) -> str:
    """Comparison form: consistent characters, lower case, single spaces."""
    return " ".join(skeleton(text).lower().split())


def loose_hash(form: str) -> bytes:
    """Hash of the letters and digits alone; of the form itself if there are none."""
    return blake2b(("".join(c for c in form if c.isalnum()) or form).encode(), digest_size=16).digest()


def matched_texts(texts: DataFrame) -> DataFrame:
    """Evaluation and training forms that match: ``held_h, train_h, match, similar``.

    ``texts`` has distinct ``h`` (hash of the form), ``form``, ``loose``, ``train`` and ``held`` (whether any record of
    the form is in training or in evaluation). ``match`` is ``same`` for one form, ``loose`` for forms with the same
    letters and digits, ``near`` for the others; ``similar`` says whether the similarity is at least ``SIMILAR``, which
    short forms with the same letters need not reach.
    """
    held, train = texts.where("held"), texts.where("train")
    equal = held.select(F.col("h").alias("held_h"), "loose").join(train.select(F.col("h").alias("train_h"), "loose"), "loose")
    near = similar_pairs(held, train, count_table(texts.select("form")), similar=SIMILAR)
    ends = equal.select("held_h", "train_h", F.lit(True).alias("hashed"), (F.col("held_h") == F.col("train_h")).alias("similar"))
    ends = ends.unionByName(near.select(F.col("left_h").alias("held_h"), F.col("right_h").alias("train_h"), F.lit(False).alias("hashed"), F.lit(True).alias("similar")))
    both = ends.groupBy("held_h", "train_h").agg(F.bool_or("hashed").alias("hashed"), F.bool_or("similar").alias("similar"))
    kind = F.when(F.col("held_h") == F.col("train_h"), "same").when(F.col("hashed"), "loose").otherwise("near")
    return both.select("held_h", "train_h", kind.alias("match"), "similar")


def entry_forms(entries: DataFrame, *, key: str, text: str, splits: str) -> tuple[DataFrame, DataFrame]:
    """Entries of training or evaluation with the hash of their form, and the distinct forms: ``k, h, train, held`` and ``h, form, loose, train, held``."""

    def forms(batch: pa.RecordBatch) -> dict[str, list]:
        keys, texts, train, held = (c.to_pylist() for c in batch.columns)
        done = [overlap_form(t) for t in texts]
        return {
            "k": keys,
            "form": done,
            "h": [blake2b(f.encode(), digest_size=16).digest() for f in done],
            "loose": [loose_hash(f) for f in done],
            "train": train,
            "held": held,
        }

    names = F.transform(F.coalesce(splits, F.array()), split_name)
    kind = entries.schema[key].dataType.simpleString()
    rows = entries.where(F.col(text).isNotNull()).select(
        F.col(key).alias("k"),
        F.col(text).alias("x"),
        F.coalesce(F.exists(names, lambda s: s == "train"), F.lit(False)).alias("train"),
        F.coalesce(F.exists(names, lambda s: s.isin("dev", "test")), F.lit(False)).alias("held"),
    )
    formed = map_batches(rows.where("train or held"), forms, f"k {kind}, form string, h binary, loose binary, train boolean, held boolean")
    records = write_table(formed.where("form <> ''"), "entries").frame
    texts = write_table(
        records.groupBy("h").agg(
            F.any_value("form").alias("form"), F.any_value("loose").alias("loose"), F.bool_or("train").alias("train"), F.bool_or("held").alias("held")
        ),
        "forms",
    ).frame
    return records.select("k", "h", "train", "held").distinct(), texts


def split_overlaps(entries: DataFrame, *, key: str, text: str, splits: str) -> DataFrame:
    """Pairs of a training and an evaluation record whose texts are the same or nearly so, smaller key first.

    Returns ``left_id, right_id, match, similar`` (see ``matched_texts``). Null and empty texts overlap with nothing; a record that lists both sides is paired with itself; redelivered rows
    count once; an empty table gives no pairs. Records with one form meet as one text: only forms are compared, and
    the copies of a form are put back at the end.
    """

    slim, texts = entry_forms(entries, key=key, text=text, splits=splits)
    matched = matched_texts(texts)
    held = slim.where("held").select(F.col("k").alias("i"), F.col("h").alias("held_h"), F.col("train").alias("both"))
    train = slim.where("train").select(F.col("k").alias("j"), F.col("h").alias("train_h"))
    pairs = matched.join(held, "held_h").join(train, "train_h").where("i <> j or both")
    pairs = pairs.groupBy(F.least("i", "j").alias("left_id"), F.greatest("i", "j").alias("right_id"))
    return pairs.agg(F.max("match").alias("match"), F.bool_or("similar").alias("similar"))


def overlap_classes(entries: DataFrame, *, key: str, text: str, splits: str) -> DataFrame:
    """Entries whose text matches one on the other side, one row each, without pairs: ``key, class_id, links, copies``.

    ``links`` counts the different forms an entry's form matches, ``copies`` the entries of its own form; ``class_id`` is
    the smallest entry of all forms tied by matches. A form that stands on both sides is a class even without links.
    """
    slim, texts = entry_forms(entries, key=key, text=text, splits=splits)
    slim = write_table(slim, "slim").frame
    matched = write_table(matched_texts(texts), "matched").frame
    sizes = slim.groupBy("h").agg(F.min("k").alias("first"), F.count_distinct("k").alias("copies"))
    sizes = write_table(sizes, "sizes").frame
    pairs = matched.where("held_h <> train_h").select(F.least("held_h", "train_h").alias("x"), F.greatest("held_h", "train_h").alias("y")).distinct()
    named = lambda name, as_: sizes.select(F.col("h").alias(name), F.col("first").alias(as_))
    ends = pairs.join(named("x", "a"), "x").join(named("y", "b"), "y").select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"))
    hit = matched.select(F.col("held_h").alias("h")).unionByName(matched.select(F.col("train_h").alias("h"))).distinct()
    nodes = sizes.join(hit, "h")
    classes = linked_classes(write_table(ends, "ends").frame, nodes.select("first"), "first")
    rows = slim.join(nodes, "h").join(classes, "first")
    return rows.select(F.col("k").alias(key), "class_id", "links", "copies").distinct()


def overlap_report(pairs: DataFrame, entries: DataFrame, *, key: str, splits: str, source: str, groups: str, samples: DataFrame) -> DataFrame:
    """Overlapping entries by split, by source of the entry, and by source of its sample groups.

    Returns ``side`` (entry or group), ``split, source, entries, pairs``: the distinct entries of a split and source that
    overlap, and the pair ends they make up, of which ``same``, ``loose`` and ``near`` by the kind of match.
    """
    count = [F.count("*").alias("pairs"), *(F.count_if(F.col("match") == kind).alias(kind) for kind in KINDS)]
    ends = pairs.select(F.col("left_id").alias("k"), "match").unionAll(pairs.where("left_id <> right_id").select(F.col("right_id").alias("k"), "match"))
    ends = ends.groupBy("k").agg(*count)
    once = entries.select(F.col(key).alias("k"), F.col(source).alias("source"), F.col(splits).alias("s"), F.col(groups).alias("g")).dropDuplicates(["k"])
    hit = ends.join(once, "k").withColumn("split", F.explode(F.array_distinct(F.transform(F.coalesce("s", F.array()), split_name))))
    total = [F.count("*").alias("entries"), *(F.sum(name).alias(name) for name in ("pairs", *KINDS))]
    own = hit.groupBy("split", "source").agg(*total)
    of = samples.select(F.col("sample_group_id").alias("group"), F.col("source_id").alias("source")).distinct()
    through = hit.select("k", "pairs", *KINDS, "split", F.explode("g").alias("group")).join(of, "group").drop("group").distinct()
    through = through.groupBy("split", "source").agg(*total)
    columns = ["side", "split", "source", "entries", "pairs", *KINDS]
    return own.withColumn("side", F.lit("entry")).select(columns).unionByName(through.withColumn("side", F.lit("group")).select(columns))

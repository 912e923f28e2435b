"""Exact and near duplicates, leakage and contamination over short texts."""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from hashlib import blake2b, sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions import text as X
from textloom.functions.arrow import map_stream
from textloom.functions.identity import sha
from textloom.operators.graph import components
from textloom.session import write_table


def identity(text: Column) -> Column:
    """Exact identity: composed, single spaces, lower case."""
    return sha(F.lower(X.collapse(text)))


def near_identity(text: Column) -> Column:
    """Near identity: lower case without punctuation, symbols and separators."""
    return sha(F.regexp_replace(F.lower(text), f"[\\p{{P}}\\p{{S}}\\p{{Z}}{X.WHITE}]", ""))


@F.pandas_udf(T.StringType())
def near_form(texts: pd.Series) -> pd.Series:
    """Composed text, case folded, with single spaces: the form whose trigrams are compared."""
    return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFC", t).casefold().split()))


def collisions(frame: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """For each named key: how many stand more than once, and how many rows those have beyond the first. One shuffle for all keys."""
    pairs = F.array(*(F.struct(F.lit(name).alias("field"), key.alias("key")) for name, key in keys.items()))
    counts = frame.select(F.explode(pairs).alias("x")).groupBy("x.field", "x.key").agg(F.count("*").alias("n"))
    return counts.groupBy("field").agg(
        F.count_if(F.col("n") > 1).alias("keys"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).alias("surplus")
    )


def trigrams(text: Column) -> Column:
    """Distinct three-character pieces of ``^text$``."""
    marked = F.concat(F.lit("^"), text, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(marked) - 2), lambda i: F.substr(marked, i, F.lit(3))))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets; two empty sets are equal."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def band_pairs(frame: DataFrame, key: str, block: list[str], text: str, *, similarity: float = 0.82, bands: int = 60, rows: int = 8) -> DataFrame:
    """Pairs of at least a similarity, found through MinHash bands inside a block and compared exactly.

    ``bands * rows`` minima are taken in one array pass per batch; a band is one 64-bit key, so candidates meet in an
    equi-join that AQE may split. ``text`` must be distinct per block: exact copies belong to classes, not to pairs.
    At 0.82 a pair is missed with a probability of (1 - 0.82^8)^60 < 2e-6, and at 0.5 one in five is compared; the
    join of ``setjoin`` misses none.
    """
    odd = (np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

    @F.pandas_udf("array<long>")
    def keys(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            codes = np.frombuffer(f"^{t}$".encode("utf-32-le"), np.uint32).astype(np.uint64)
            if len(codes) < 3:
                out.append([])
                continue
            grams = np.unique((codes[:-2] << np.uint64(42)) | (codes[1:-1] << np.uint64(21)) | codes[2:])
            mixed = (grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            spread = mixed[None, :] * odd[:, None]
            least = (spread ^ (spread >> np.uint64(32))).min(axis=1).reshape(bands, rows)
            folded = (least * odd[:rows][None, :]).sum(axis=1) + np.arange(bands, dtype=np.uint64) * np.uint64(0x94D049BB133111EB)
            out.append(folded.view(np.int64).tolist())
        return pd.Series(out)

    banded = frame.select(F.col(key).alias("k"), *block, F.explode(keys(text)).alias("band"))
    same = ["band", *block]
    met = banded.alias("a").join(banded.alias("b"), [F.col(f"a.{c}") == F.col(f"b.{c}") for c in same] + [F.col("a.k") < F.col("b.k")])
    pairs = met.select(F.col("a.k").alias("left_id"), F.col("b.k").alias("right_id")).distinct()
    sets = frame.select(F.col(key).alias("k"), trigrams(F.col(text)).alias("g"))
    full = pairs.join(sets.select(F.col("k").alias("left_id"), F.col("g").alias("x")), "left_id").join(
        sets.select(F.col("k").alias("right_id"), F.col("g").alias("y")), "right_id"
    )
    return full.withColumn("similarity", jaccard(F.col("x"), F.col("y"))).where(F.col("similarity") >= similarity).select("left_id", "right_id", "similarity")


def linked_classes(pairs: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Every node with the smallest node it is linked to, and its number of links."""
    # A pair ties its right node to the record named by its left one, which holds that one as well.
    edges = pairs.select(F.col("left_id").alias("r"), F.col("right_id").alias("e")).unionByName(pairs.select(F.col("left_id").alias("r"), F.col("left_id").alias("e")).distinct())
    classes = components(edges, "r", "e")
    ends = pairs.select(F.col("left_id").alias("e")).unionByName(pairs.select(F.col("right_id").alias("e")))
    links = ends.groupBy("e").agg(F.count("*").alias("links"))
    rows = nodes.select(F.col(key).alias("e")).join(classes.withColumnRenamed("entity", "e"), "e", "left").join(links, "e", "left")
    return rows.select(F.col("e").alias(key), F.coalesce("component", "e").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


@lru_cache(maxsize=1 << 17)
def _placed(shingle: str, bins: int, key: bytes) -> tuple[int, int]:
    """Bin and rest of a shingle's keyed 128-bit hash; texts share most of their shingles, so the latest are kept."""
    rest, bin_ = divmod(int.from_bytes(blake2b(shingle.encode(), digest_size=16, key=key).digest(), "big"), bins)
    return bin_, rest


def one_permutation_minhash(text: str, bins: int = 32, width: int = 5, most: int | None = None, key: bytes = b"") -> list[int]:
    """Least keyed 128-bit hash of all shingles in each bin; -1 for an empty bin.

    With ``most`` at most so many evenly spaced shingles are hashed, as the reference does for its short segments (512).
    An insertion moves all those places, so in longer texts near copies are lost.
    """
    body = " ".join(text.split())
    total = max(0, len(body) - width + 1)
    if most is None or total <= most:
        places = range(total)
    else:
        places = sorted({int(i * (total / most)) for i in range(most)})
    least = [-1] * bins
    for shingle in {body[at : at + width] for at in places}:
        bin_, rest = _placed(shingle, bins, key)
        if least[bin_] < 0 or rest < least[bin_]:
            least[bin_] = rest
    return least


def minhash_similarity(a: list[int], b: list[int]) -> float:
    """Equal bins over bins filled on either side; 1 if all are empty."""
    filled = [(x, y) for x, y in zip(a, b, strict=True) if x >= 0 or y >= 0]
    return sum(x == y for x, y in filled) / len(filled) if filled else 1.0


#: What an empty bin is packed as.
EMPTY = (1 << 128) - 1


def pack_minhash(signature: list[int]) -> bytes:
    """A signature as 16 bytes a bin."""
    return b"".join((EMPTY if v < 0 else v).to_bytes(16, "big") for v in signature)


def packed_signatures(texts: list[str | None], bins: int = 32, key: bytes = b"") -> list[bytes]:
    """Packed signatures over all five-character shingles of many texts; a null text is as an empty one.

    Texts share most of their shingles: each distinct one of a batch is hashed once, and the least hash of every bin is
    found by its rank among them. The number of bins is a power of two.
    """
    if bins < 2 or bins & (bins - 1):
        raise ValueError("the number of bins is a power of two")
    out: list[bytes] = []
    bodies = [" ".join((t or "").split()) for t in texts]
    low = 0
    while low < len(bodies):
        high, held = low, 0
        while high < len(bodies) and (high == low or held + len(bodies[high]) <= 1 << 21):
            held += len(bodies[high])
            high += 1
        out += _signatures(bodies[low:high], bins, key)
        low = high
    return out


def _signatures(bodies: list[str], bins: int, key: bytes) -> list[bytes]:
    sizes = np.array([len(b) for b in bodies])
    whole = "".join(bodies)
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(bodies)), sizes)
    at = np.flatnonzero(owner[:-4] == owner[4:]) if len(owner) > 4 else np.zeros(0, np.int64)
    best = np.full(len(bodies) * bins, -1, np.int64)
    table = np.full((1, 16), 255, np.uint8)
    if len(at):
        left = codes[at] | (codes[at + 1] << np.uint64(21)) | (codes[at + 2] << np.uint64(42))
        right = codes[at + 3] | (codes[at + 4] << np.uint64(21))
        mixed = (left ^ (left >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + (right ^ (right >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        _, first, inverse = np.unique(mixed ^ (mixed >> np.uint64(32)), return_index=True, return_inverse=True)
        if not (np.array_equal(left[first][inverse], left) and np.array_equal(right[first][inverse], right)):  # two shingles of one mix
            _, first, inverse = np.unique(np.stack([left, right], axis=1), axis=0, return_index=True, return_inverse=True)
        digests = b"".join([blake2b(whole[i : i + 5].encode("utf-8", "surrogatepass"), digest_size=16, key=key).digest() for i in at[first].tolist()])
        high, low = np.frombuffer(digests, ">u8").astype(np.uint64).reshape(-1, 2).T
        shift = np.uint64(bins.bit_length() - 1)
        place = (low & np.uint64(bins - 1)).astype(np.int64)
        high, low = high >> shift, (low >> shift) | (high << (np.uint64(64) - shift))
        order = np.lexsort((low, high))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        rests = np.stack([high[order], low[order]], axis=1).astype(">u8")
        table = np.concatenate([rests.view(np.uint8).reshape(-1, 16), table])
        cell = owner[at] * bins + place[inverse]
        best[:] = len(order)
        np.minimum.at(best, cell, rank[inverse])
    packed = table[best].reshape(len(bodies), bins * 16)
    return [row.tobytes() for row in packed]


def packed_similarity(a: bytes, b: bytes) -> float:
    """``minhash_similarity`` of packed signatures of one length."""
    if len(a) != len(b) or len(a) % 16:
        raise ValueError("signatures of different lengths")
    x, y = np.frombuffer(a, np.uint8).reshape(-1, 16), np.frombuffer(b, np.uint8).reshape(-1, 16)
    empty_x, empty_y = (x == 255).all(axis=1), (y == 255).all(axis=1)
    filled = ~(empty_x & empty_y)
    equal = (x == y).all(axis=1) & ~empty_x
    return float(equal.sum() / filled.sum()) if filled.any() else 1.0


def bucket_keys(signature: list[int], bands: int) -> list[int]:
    """For each band of a signature the first 96 bits of the digest of its bins."""
    rows = len(signature) // bands
    return [int.from_bytes(sha256(",".join(map(str, signature[i * rows : (i + 1) * rows])).encode()).digest()[:12], "big") for i in range(bands)]


def greedy_near_duplicates(frame: DataFrame, key: str, block: str, text: str, *, bands: int = 4, rows: int = 8, similarity: float = 0.90) -> DataFrame:
    """First-wins deduplication in key order: exact copies first, then the owner of any of a row's buckets.

    A row that is dropped owns no bucket and no text. The decision on a row depends only on rows it shares a bucket or
    text with, directly or through others; so the fold runs inside connected components of the bucket graph and gives
    the result of one pass over everything. Returns ``key, block, verdict`` (kept, exact or near).
    """

    width = 16 * rows  # bytes of a band

    @F.pandas_udf("binary")
    def signature(texts: pd.Series) -> pd.Series:
        return pd.Series(packed_signatures(texts.tolist()))

    signed = frame.where(F.col(text).isNotNull()).select(
        F.col(key).alias("k"), F.col(block).alias("b"), sha(F.col(text)).alias("exact"), signature(F.col(text)).alias("sig")
    )
    parts = F.array(*(F.unhex(F.sha2(F.concat(F.encode(F.concat_ws(",", F.col("b"), F.lit(str(i))), "UTF-8"), F.substring("sig", i * width + 1, width)), 256)) for i in range(bands)))
    signed = signed.withColumn("buckets", parts)
    firsts = signed.groupBy("b", "exact").agg(F.min("k").alias("k"), F.any_value("sig").alias("sig"), F.any_value("buckets").alias("buckets"))
    firsts = write_table(firsts, "firsts").frame  # read twice; signatures are the costly part
    edges = firsts.select(F.explode("buckets").alias("r"), "k")
    placed = firsts.join(components(edges, "r", "k"), firsts["k"] == F.col("entity")).select("k", "b", "exact", "sig", "buckets", "component")

    def fold(batches):
        current, owners = None, {}
        for batch in batches:
            verdicts = []
            for sig, keys, component in zip(*(batch.column(batch.schema.names.index(n)).to_pylist() for n in ("sig", "buckets", "component")), strict=True):
                if component != current:
                    current, owners = component, {}
                if any(packed_similarity(sig, owners[x]) >= similarity for x in keys if x in owners):
                    verdicts.append("near")
                    continue
                for x in keys:
                    owners.setdefault(x, sig)
                verdicts.append("kept")
            first, b, exact = (batch.column(batch.schema.names.index(n)) for n in ("k", "b", "exact"))
            yield pa.RecordBatch.from_arrays([first, b, exact, pa.array(verdicts, pa.string())], names=["first", "b", "exact", "verdict"])

    kind = frame.schema[key].dataType.simpleString()
    kinds = f"first {kind}, b {frame.schema[block].dataType.simpleString()}, exact string, verdict string"
    # Spark brings a component together and sorts it, which spills; the fold reads it as a stream and holds the owners alone.
    judged = map_stream(placed.repartition("component").sortWithinPartitions("component", "k"), fold, kinds)
    # A later copy of a kept text is exact; one of a dropped text meets the same owner as that did.
    rows_all = signed.select("k", "b", "exact").join(judged, ["b", "exact"])
    verdict = F.when(F.col("k") == F.col("first"), F.col("verdict")).when(F.col("verdict") == "kept", F.lit("exact")).otherwise(F.lit("near"))
    return rows_all.select(F.col("k").alias(key), F.col("b").alias(block), verdict.alias("verdict"))


def crossing_texts(frame: DataFrame, text: Column, language: str, split: Column) -> DataFrame:
    """Texts that stand in more than one split, by language: ``language, text_digest, splits, records``."""
    rows = frame.select(F.col(language).alias("language"), text.alias("text_digest"), split.alias("split")).where("split is not null")
    grouped = rows.groupBy("language", "text_digest").agg(F.array_sort(F.collect_set("split")).alias("s"), F.count("*").alias("records"))
    return grouped.where(F.size("s") > 1).select("language", "text_digest", F.array_join("s", ",").alias("splits"), "records")


def first_per(frame: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key by an order; the limit of one is pushed below the shuffle."""
    return frame.withColumn("n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("n = 1").drop("n")

"""Exact similarity join of short texts over their sets of three-character pieces.

Two sets with a Jaccard similarity of at least ``t`` share one of the first ``n - ceil(t * n) + 1`` pieces in any common
order, and with pieces ordered from rare to frequent few other pairs do. The order comes from one merged table of counts
of bounded size; it decides only how many candidates there are, never which pairs are found. Sizes, positions and the
parity sketch of each set rule out most candidates inside the equi-join on the piece; the rest are compared exactly.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.arrow import map_batches, map_stream
from textloom.operators.merge import merge_rounds, partitions

#: Counters of the table that orders the pieces.
COUNTERS = 1 << 20
#: Texts, and their characters, whose pieces are taken at once.
TEXTS, CHARACTERS = 2048, 1 << 21
#: 64-bit words of the parity sketch of a set.
WORDS = 8


def pieces(form: str) -> set[str]:
    """Three-character pieces of a text between its marks of start and end."""
    marked = f"^{form}$"
    return {marked[i : i + 3] for i in range(len(marked) - 2)}


def _mixed(packed: np.ndarray) -> np.ndarray:
    packed = (packed ^ (packed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    packed = (packed ^ (packed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return packed ^ (packed >> np.uint64(31))


def piece_hashes(form: str) -> np.ndarray:
    """Distinct hashes of the pieces of one text."""
    return batch_pieces([form])[1]


def batch_pieces(forms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the pieces of many texts at once, with the number of the text each belongs to, in its order."""
    sizes = np.array([len(f) + 2 for f in forms])
    codes = np.frombuffer("".join(f"^{f}$" for f in forms).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(forms)), sizes)
    inside = np.flatnonzero(owner[:-2] == owner[2:])
    packed = (codes[inside] << np.uint64(42)) | (codes[inside + 1] << np.uint64(21)) | codes[inside + 2]
    owner, hashes = owner[inside], _mixed(packed)
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    return owner[fresh], hashes[fresh]


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most ``TEXTS`` texts and, save for a single longer text, ``CHARACTERS`` characters."""
    ends = np.cumsum([len(x) for x in batch.column(column).to_pylist()])
    low = 0
    while low < batch.num_rows:
        start = ends[low - 1] if low else 0
        high = max(low + 1, min(low + TEXTS, int(np.searchsorted(ends, start + CHARACTERS, side="right"))))
        yield batch.slice(low, high - low)
        low = high


def parity_sketches(owner: np.ndarray, hashes: np.ndarray, count: int) -> np.ndarray:
    """For each of ``count`` texts the parity of the number of its pieces in each of ``64 * WORDS`` cells, as words.

    Two sketches differ in no more cells than their sets differ in pieces.
    """
    cells = 64 * WORDS
    place = (hashes >> np.uint64(20)).astype(np.int64) % cells + owner * cells
    bits = np.bincount(place, minlength=count * cells).astype(np.uint8) & 1
    return np.packbits(bits.reshape(count, cells), axis=1).view(np.int64)


def parity_sketch(hashes: np.ndarray) -> list[int]:
    """The sketch of one text."""
    return parity_sketches(np.zeros(len(hashes), np.int64), hashes, 1)[0].tolist()


def count_table(texts: DataFrame) -> np.ndarray:
    """Counts of hashed pieces over all texts of the one column, added up per partition and then in rounds of bounded fan-in.

    What reaches the driver is one table of ``COUNTERS`` numbers, whatever the corpus holds.
    """

    def count(batches):
        table = np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            for part in _parts(batch, 0):
                _, hashes = batch_pieces(part.column(0).to_pylist())
                np.add.at(table, (hashes & np.uint64(COUNTERS - 1)).astype(np.int64), np.uint32(1))
        number = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({"part": pa.array([number], pa.int32()), "blob": pa.array([zlib.compress(table.tobytes(), 1)], pa.binary())})

    def merge(blobs: list[bytes]) -> bytes:
        total = np.zeros(COUNTERS, np.uint32)
        for blob in blobs:
            total += np.frombuffer(zlib.decompress(blob), np.uint32)
        return zlib.compress(total.tobytes(), 1)

    merged = merge_rounds(map_stream(texts, count, "part int, blob binary"), [], merge, partitions(texts))
    total = np.zeros(COUNTERS, np.uint32)
    for row in merged.toLocalIterator():
        total += np.frombuffer(zlib.decompress(row.blob), np.uint32)
    return total


def similar_pairs(left: DataFrame, right: DataFrame, order: np.ndarray, *, similar: int, both: bool = False, block: str | None = None) -> DataFrame:
    """Pairs of a left and a different right text with a similarity of at least ``similar`` hundredths.

    Either side has distinct ``h`` (a key, the same for the same text) and ``form``. With ``both`` the sides are one
    table and every pair is given once, smaller key first. With ``block`` only texts with the same value of that column
    meet, nulls among themselves. Returns ``left_h, right_h, similarity``. Texts without a
    piece are similar to none.
    """
    spark = left.sparkSession
    sent = spark.sparkContext.broadcast(order)
    words = ", ".join(f"s{i} bigint" for i in range(WORDS))
    kind = left.schema["h"].dataType.simpleString()

    def prefixes(batches):
        for whole in batches:
            for batch in _parts(whole, 1):
                owner, hashes = batch_pieces(batch.column(1).to_pylist())
                words_ = parity_sketches(owner, hashes, batch.num_rows)
                counts = sent.value[(hashes & np.uint64(COUNTERS - 1)).astype(np.int64)]
                order = np.lexsort((hashes, counts, owner))
                owner, hashes = owner[order], hashes[order]
                size = np.bincount(owner, minlength=batch.num_rows)
                at = np.arange(len(owner)) - (np.cumsum(size) - size)[owner]
                keep = at < (size - (similar * size + 99) // 100 + 1)[owner]
                owner, hashes, at = owner[keep], hashes[keep], at[keep]
                arrays = [pa.array(hashes.view(np.int64)), batch.column(0).take(pa.array(owner)), batch.column(2).take(pa.array(owner)), pa.array(size[owner], pa.int32()), pa.array(at, pa.int32())]
                yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(words_[owner, i]) for i in range(WORDS))], names=["piece", "h", "block", "n", "at", *(f"s{i}" for i in range(WORDS))])

    def keys(side: DataFrame) -> DataFrame:
        own = F.coalesce(F.concat(F.lit("="), F.col(block).cast("string")), F.lit("")) if block else F.lit("")
        return map_stream(side.select("h", "form", own.alias("block")), prefixes, f"piece bigint, h {kind}, block string, n int, at int, {words}")

    need = f"ceil({similar} * (x.n + y.n) / {100 + similar})"
    apart = " + ".join(f"bit_count(x.s{i} ^ y.s{i})" for i in range(WORDS))
    met = keys(left).alias("x").join(
        keys(right).alias("y"),
        F.expr(
            f"x.piece = y.piece and x.block = y.block and x.h {'<' if both else '<>'} y.h and x.n * {similar} <= y.n * 100 and y.n * {similar} <= x.n * 100"
            f" and 1 + least(x.n - x.at - 1, y.n - y.at - 1) >= {need} and {apart} <= x.n + y.n - 2 * {need}"
        ),
    )
    return compared(met.select(F.col("x.h").alias("left_h"), F.col("y.h").alias("right_h")).distinct(), left, right, similar=similar)


def compared(pairs: DataFrame, left: DataFrame, right: DataFrame, *, similar: int) -> DataFrame:
    """Pairs whose texts, compared exactly, are at least so similar."""
    full = pairs.join(left.select(F.col("h").alias("left_h"), F.col("form").alias("a")), "left_h")
    full = full.join(right.select(F.col("h").alias("right_h"), F.col("form").alias("b")), "right_h").select("left_h", "right_h", "a", "b")
    kind = pairs.schema["left_h"].dataType.simpleString()

    def compare(batch: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {"left_h": [], "right_h": [], "similarity": []}
        for i, j, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x, y = pieces(a), pieces(b)
            shared = len(x & y)
            if shared and 100 * shared >= similar * (len(x) + len(y) - shared):
                for name, value in zip(out, (i, j, shared / (len(x) + len(y) - shared)), strict=True):
                    out[name].append(value)
        return out

    return map_batches(full, compare, f"left_h {kind}, right_h {kind}, similarity double")

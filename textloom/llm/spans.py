"""Long exact spans shared between records.

Every stretch of ``span`` characters is represented by windows of ``GRAM`` characters: of the rolling hashes of
``span - GRAM + 1`` neighbouring windows the least is selected, so two texts that share a stretch of at least ``span``
characters select the same window inside it. A first pass over the texts keeps the selected windows - hash, text and
place - as a table. Count-min sketches of its partitions are merged: a window's slice of the sketch is named by the high
bits of its hash, its counters in the slice by the low bits; counters stop at two, all the filter asks for, so they
never underestimate "more than once". The merged sketch is a table of slices, as many as the windows need, and never
passes the driver. A second pass joins windows with their slice and keeps those estimated as repeated - none that is
repeated gets lost; these are grouped exactly, and the surroundings of those that two texts hold are compared
character by character.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.arrow import map_batches, map_stream
from textloom.operators.graph import components
from textloom.operators.merge import merge_rounds, partitions
from textloom.session import write_table

#: Characters of a window.
GRAM = 64
#: Counters of each of the two rows of a slice, as a power of two, and windows expected in a slice: four counters a window.
CELLS, PER_SLICE = 20, 1 << 18
#: Windows of a partition that are counted at once.
HELD = 1 << 22
#: Places whose surroundings are handed on at once.
OUT = 8192
#: Characters hashed at once.
CHUNK = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[str, np.ndarray] = {}


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < size:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _POWERS[name] = np.multiply.accumulate(table)
    return _POWERS["up"][:size], _POWERS["down"][:size]


def window_hashes(codes: np.ndarray) -> np.ndarray:
    """Hash of every window of ``GRAM`` code points, independent of where it stands."""
    count = len(codes) - GRAM + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(codes))
    sums = np.empty(len(codes) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    return _mix((sums[GRAM:] - sums[:-GRAM]) * down[:count])


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours, by prefix and suffix minima of blocks."""
    count = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, _MASK, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:count], ahead[width - 1 : width - 1 + count])


def select_windows(texts: list[str], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Selected windows of many texts: text number, position in it, hash. Texts shorter than ``span`` have none.

    A text beyond ``CHUNK`` is read in pieces that overlap by ``span - 1`` characters: what is selected depends on
    ``span`` neighbouring characters only, so the pieces together select what the whole text would.
    """
    wide = span - GRAM + 1
    numbers, places, hashes = [], [], []
    group: list[tuple[int, int, str]] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if not group:
            return
        sizes = np.array([len(piece) for _, _, piece in group])
        starts = np.concatenate([[0], np.cumsum(sizes)])
        codes = np.frombuffer("".join(piece for _, _, piece in group).encode("utf-32-le", "surrogatepass"), np.uint32)
        marks = window_hashes(codes)
        least = _sliding_least(marks, wide)
        owner = np.repeat(np.arange(len(group)), sizes)[: len(least)]
        inside = np.arange(len(least)) + span <= starts[owner + 1]
        first = np.flatnonzero(inside)
        if len(first):
            values = least[first]
            # A window of neighbours whose least is the one before it adds nothing; otherwise look up where the least stands.
            fresh = np.ones(len(first), bool)
            fresh[1:] = (values[1:] != values[:-1]) | (owner[first[1:]] != owner[first[:-1]]) | (marks[first[:-1]] == values[:-1])
            begin, value = first[fresh], values[fresh]
            grid = marks[begin[:, None] + np.arange(wide)[None, :]] == value[:, None]
            at = begin + np.argmax(grid, axis=1)
            keep = np.unique(at)
            who = np.searchsorted(starts, keep, side="right") - 1
            numbers.append(np.array([i for i, _, _ in group])[who])
            places.append(keep - starts[who] + np.array([offset for _, offset, _ in group])[who])
            hashes.append(marks[keep])
        group.clear()
        held = 0

    for i, text in enumerate(texts):
        if len(text) < span:
            continue
        for offset in range(0, len(text) - span + 1, CHUNK):
            piece = text[offset : offset + CHUNK + span - 1]
            if held + len(piece) > CHUNK:
                flush()
            group.append((i, offset, piece))
            held += len(piece)
    flush()
    if not numbers:  # the overlap of two pieces may select a window twice; callers reduce to distinct rows
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(numbers), np.concatenate(places), np.concatenate(hashes)


def _slices(hashes: np.ndarray, slices: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32)).astype(np.int64)


def _cells(hashes: np.ndarray) -> np.ndarray:
    """The two counters of each window inside its slice: one in either row."""
    mask = np.uint64((1 << CELLS) - 1)
    return np.stack([hashes & mask, ((hashes >> np.uint64(CELLS)) & mask) + (mask + np.uint64(1))]).astype(np.uint32)


def _pack(cells: np.ndarray, again: np.ndarray) -> bytes:
    """Counters that are not zero, as sorted numbers with a last bit for "twice or more"."""
    return zlib.compress(((cells.astype(np.uint32) << np.uint32(1)) | again).astype(np.uint32).tobytes(), 1)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    marked = np.frombuffer(zlib.decompress(blob), np.uint32)
    return marked >> np.uint32(1), (marked & np.uint32(1)).astype(bool)


def merge_blobs(blobs: list[bytes]) -> bytes:
    """Sum of count-min slices whose counters stop at two."""
    count = np.zeros(2 << CELLS, np.uint8)
    for blob in blobs:
        cells, again = _unpack(blob)
        count[cells] = np.minimum(count[cells] + 1 + again, 2)
    cells = np.flatnonzero(count)
    return _pack(cells, count[cells] > 1)


def sketch(windows: DataFrame, slices: int) -> DataFrame:
    """The merged count-min sketch of the ``window`` column: ``slice`` and ``bits``, its counters of two as bits of 64-bit words."""

    def count(batches):
        part = TaskContext.get().partitionId()
        held: list[np.ndarray] = []

        def flush():
            hashes = np.concatenate(held)
            held.clear()
            order = np.argsort(_slices(hashes, slices), kind="stable")
            hashes = hashes[order]
            names, starts = np.unique(_slices(hashes, slices), return_index=True)
            blobs = []
            for low, high in zip(starts, [*starts[1:], len(hashes)], strict=True):
                cells, number = np.unique(_cells(hashes[low:high]), return_counts=True)
                blobs.append(_pack(cells, number > 1))
            return pa.RecordBatch.from_pydict({"slice": pa.array(names, pa.int32()), "part": pa.array([part] * len(names), pa.int32()), "blob": pa.array(blobs, pa.binary())})

        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            if sum(map(len, held)) >= HELD:
                yield flush()
        if sum(map(len, held)):
            yield flush()

    def dense(batch: pa.RecordBatch) -> dict[str, list]:
        words = []
        for blob in batch.column(1).to_pylist():
            cells, again = _unpack(blob)
            bits = np.zeros(2 << CELLS, np.uint8)
            bits[cells[again]] = 1
            words.append(np.packbits(bits, bitorder="little").view(np.int64))
        return {"slice": batch.column(0), "bits": words}

    parts = map_stream(windows.select("window"), count, "slice int, part int, blob binary")
    merged = merge_rounds(parts, ["slice"], merge_blobs, partitions(windows)).select("slice", "blob")
    return map_batches(merged, dense, "slice int, bits array<bigint>")


def _set(bits: str, cell: Column) -> Column:
    return F.getbit(F.get(F.col(bits), F.shiftright(cell, 6).cast("int")), cell.bitwiseAND(F.lit(63)).cast("int")) == 1


def selected_windows(texts: DataFrame, span: int) -> DataFrame:
    """Selected windows of ``texts`` (``same``, the digest of a text, and ``x``, the text): ``window, same, place``.

    A task reads each text once, however many copies of it there are; copies share nothing that their first does not.
    """

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            fresh: dict[bytes, str] = {}
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest not in seen:
                    seen.add(digest)
                    fresh[digest] = text
            names = list(fresh)
            number, place, hashes = select_windows(list(fresh.values()), span)
            same = pa.array(names, pa.binary()).take(pa.array(number, pa.int64()))
            yield pa.RecordBatch.from_pydict({"window": pa.array(hashes.view(np.int64), pa.int64()), "same": same, "place": pa.array(place, pa.int32())})

    return map_stream(texts.select("same", "x"), run, "window bigint, same binary, place int")


def repeated_windows(windows: DataFrame) -> DataFrame:
    """Those of ``windows`` (``window, same, place``) that two different texts hold; each text and place once.

    First the filter: a join with the merged sketch by slice, which keeps all windows that stand more than once and few
    others. Then the exact count. A slice holds as many windows as any other, save for windows that very many texts
    repeat, whose partition adaptive execution splits.
    """
    slices = max(1, -(-windows.count() // PER_SLICE))
    bits = write_table(sketch(windows, slices), "sketch").frame
    name = F.shiftrightunsigned(F.shiftrightunsigned("window", 32) * slices, 32).cast("int")
    low = F.col("window").bitwiseAND(F.lit((1 << CELLS) - 1))
    high = F.shiftrightunsigned("window", CELLS).bitwiseAND(F.lit((1 << CELLS) - 1)) + F.lit(1 << CELLS)
    kept = windows.withColumn("slice", name).join(bits, "slice").where(_set("bits", low) & _set("bits", high)).select("window", "same", "place")
    kept = write_table(kept, "kept").frame
    many = kept.groupBy("window").agg(F.min("same").alias("a"), F.max("same").alias("b")).where("a <> b").select("window")
    return kept.join(many, "window", "left_semi").distinct()


def window_classes(documents: DataFrame, *, key: str, text: str, span: int) -> tuple[DataFrame, DataFrame]:
    """Repeated windows with their surroundings, as classes and their members.

    A member is a place of a window in a text: ``window, class, same, place``. Places with the same surroundings - up to
    ``span - GRAM`` characters to each side - are one class: ``window, class, around, before`` and ``several``, whether
    different texts are in it. However many texts hold a template, its class is compared with the others once.
    """
    rows = documents.where((F.length(text) >= span) & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.unhex(F.md5(text)).alias("same"), F.col(text).alias("x"))
    windows = write_table(selected_windows(rows, span), "windows").frame
    repeated = write_table(repeated_windows(windows), "repeated").frame
    # The text of each digest that is asked for is read from one of its copies, by its key: copies do not travel.
    wanted = repeated.groupBy("same").agg(F.collect_list(F.struct("window", "place")).alias("at"))
    first = rows.select("k", "same").groupBy("same").agg(F.min("k").alias("k"))
    wanted = wanted.join(first, "same")
    side = span - GRAM

    schema = pa.schema([("window", pa.int64()), ("same", pa.binary()), ("place", pa.int32()), ("around", pa.string()), ("before", pa.int32())])

    def cut(batches):
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
            rows.clear()
            return out

        for whole in batches:
            for digest, body, at in zip(*(c.to_pylist() for c in whole.columns), strict=True):
                for spot in at:
                    place = spot["place"]
                    rows.append((spot["window"], digest, place, body[max(0, place - side) : place + GRAM + side], min(place, side)))
                    if len(rows) == OUT:
                        yield batch()
        if rows:
            yield batch()

    held = wanted.join(rows, ["k", "same"]).select("same", "x", "at")
    around = map_stream(held, cut, "window bigint, same binary, place int, around string, before int")
    around = write_table(around.withColumn("class", F.unhex(F.md5(F.concat_ws("|", "before", "around")))), "around").frame
    classes = around.groupBy("window", "class").agg(
        F.any_value("around").alias("around"), F.any_value("before").alias("before"), (F.min("same") < F.max("same")).alias("several")
    )
    return write_table(classes, "classes").frame, around.select("window", "class", "same", "place").distinct()


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    if a == b:
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def shared_stretches(classes: DataFrame, span: int) -> DataFrame:
    """Stretches of at least ``span`` characters around a window that two of its classes share: ``window, left, right, ahead, size``.

    ``ahead`` of the characters stand before the window. A class that several texts share is paired with itself.
    """
    left, right = classes.alias("x"), classes.alias("y")
    met = left.join(right, F.expr("x.window = y.window and x.class < y.class")).select(
        F.col("x.window").alias("window"), F.col("x.class").alias("left"), F.col("y.class").alias("right"),
        F.col("x.around").alias("a"), F.col("y.around").alias("b"), F.col("x.before").alias("m"), F.col("y.before").alias("n"),
    )

    def compare(batch: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in ("window", "left", "right", "ahead", "size")}
        for window, lhs, rhs, a, b, m, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            after = _common(a[m:], b[n:])
            if after < GRAM:
                continue
            ahead = _common(a[:m][::-1], b[:n][::-1])
            if ahead + after >= span:
                for name, value in zip(out, (window, lhs, rhs, ahead, ahead + after), strict=True):
                    out[name].append(value)
        return out

    across = map_batches(met, compare, "window bigint, left binary, right binary, ahead int, size int")
    own = classes.where(F.col("several") & (F.length("around") >= span))
    within = own.select("window", F.col("class").alias("left"), F.col("class").alias("right"), F.col("before").alias("ahead"), F.length("around").alias("size"))
    return across.unionByName(within)


def span_pairs(documents: DataFrame, *, key: str, text: str, span: int = 200) -> DataFrame:
    """Pairs of different records that share a stretch of at least ``span`` code points, smaller key first.

    Null texts, those shorter than ``span`` and records without a key share nothing; a record delivered twice counts once;
    an empty table gives no pairs. Classes of surroundings are compared, not records; the records of two classes that share a stretch are put
    back at the end, and so are exact copies.
    """
    classes, members = window_classes(documents, key=key, text=text, span=span)
    members = write_table(members, "members").frame
    found = shared_stretches(classes, span).select("window", "left", "right").distinct()
    lhs = members.select("window", F.col("class").alias("left"), F.col("same").alias("a")).distinct()
    rhs = members.select("window", F.col("class").alias("right"), F.col("same").alias("b")).distinct()
    texts = found.join(lhs, ["window", "left"]).join(rhs, ["window", "right"]).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    records = documents.where((F.length(text) >= span) & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.unhex(F.md5(text)).alias("same")).distinct()
    across = texts.join(records.select(F.col("k").alias("i"), F.col("same").alias("a")), "a")
    across = across.join(records.select(F.col("k").alias("j"), F.col("same").alias("b")), "b").select("i", "j")
    copied = records.groupBy("same").count().where(F.col("count") > 1).select("same")
    copies = records.join(copied, "same", "left_semi")
    within = copies.select(F.col("k").alias("i"), "same").join(copies.select(F.col("k").alias("j"), "same"), "same").where("i < j")
    pairs = across.unionByName(within.select("i", "j")).where("i <> j")
    return pairs.select(F.least("i", "j").alias(f"left_{key}"), F.greatest("i", "j").alias(f"right_{key}")).distinct()


def span_classes(documents: DataFrame, *, key: str, text: str, span: int = 200) -> DataFrame:
    """Records that share a stretch of at least ``span`` code points, one row each, without pairs: ``key, class_id, copies, stretches``.

    ``class_id`` is the smallest record of all tied by shared stretches, ``copies`` the number of records with the same
    text, ``stretches`` that of the places in the text around which another text agrees. A class of surroundings ties its
    texts through itself and two classes that share a stretch through one text of each, so nothing grows with pairs.
    """
    classes, members = window_classes(documents, key=key, text=text, span=span)
    members = write_table(members, "members").frame
    found = write_table(shared_stretches(classes, span).select("window", "left", "right").distinct(), "stretches").frame
    sides = found.select("window", F.col("left").alias("class")).unionByName(found.select("window", F.col("right").alias("class"))).distinct()
    held = write_table(members.join(sides, ["window", "class"]), "held").frame
    one = held.groupBy("window", "class").agg(F.min("same").alias("same"))
    met = found.where("left <> right").join(one.select("window", F.col("class").alias("left"), F.col("same").alias("a")), ["window", "left"])
    met = met.join(one.select("window", F.col("class").alias("right"), F.col("same").alias("b")), ["window", "right"])
    across = met.select(F.concat("left", "right", F.hex("window").cast("binary")).alias("r"), F.explode(F.array("a", "b")).alias("e"))
    tied = held.select(F.concat("class", F.hex("window").cast("binary")).alias("r"), F.col("same").alias("e")).unionByName(across)
    label = components(tied, "r", "e")
    places = held.groupBy("same").agg(F.count_distinct("place").alias("stretches"))
    records = documents.where((F.length(text) >= span) & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.unhex(F.md5(text)).alias("same")).distinct()
    copies = records.groupBy("same").agg(F.count("*").alias("copies"))
    rows = records.join(copies, "same").join(label.withColumnRenamed("entity", "same"), "same", "left").join(places, "same", "left")
    rows = write_table(rows.where("copies > 1 or component is not null").withColumn("component", F.coalesce("component", "same")), "rows").frame
    firsts = rows.groupBy("component").agg(F.min("k").alias("class_id"))
    return rows.join(firsts, "component").select(F.col("k").alias(key), "class_id", "copies", F.coalesce("stretches", F.lit(0)).alias("stretches"))


def shared_shares(documents: DataFrame, *, key: str, text: str, span: int = 200) -> DataFrame:
    """For every record how many of its code points stand, in stretches of at least ``span``, in another record too.

    Returns the key, ``characters``, ``shared`` and ``share``; null and empty texts have 0 of 0 and a null share. Records
    without a key count for nothing and give no row; an empty table gives none. A class
    of surroundings has few different stretches, however many texts are in it, and only those meet its members. The
    stretches of a text are merged per text from distinct rows, whose number is bounded by the text's own length and
    not by the number of records it shares them with.
    """
    classes, members = window_classes(documents, key=key, text=text, span=span)
    found = write_table(shared_stretches(classes, span), "stretches").frame
    ends = found.select("window", F.col("left").alias("class"), "ahead", "size").unionByName(found.select("window", F.col("right").alias("class"), "ahead", "size")).distinct()
    pieces = ends.join(members, ["window", "class"]).select("same", (F.col("place") - F.col("ahead")).alias("a"), (F.col("place") - F.col("ahead") + F.col("size")).alias("b"))
    pieces = pieces.groupBy("same", "a").agg(F.max("b").alias("b"))
    merged = pieces.groupBy("same").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("s"))
    covered = merged.select(
        "same",
        F.expr(
            "aggregate(s, named_struct('end', 0, 'sum', 0), (acc, x) -> named_struct('end', greatest(acc.end, x.b),"
            " 'sum', acc.sum + greatest(0, x.b - greatest(acc.end, x.a))), acc -> acc.sum)"
        ).alias("part"),
    )
    rows = documents.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.coalesce(F.length(text), F.lit(0)).alias("characters"), F.unhex(F.md5(text)).alias("same")).distinct()
    copies = rows.where(F.col("characters") >= span).groupBy("same").agg(F.count("*").alias("copies"))
    joined = rows.join(copies, "same", "left").join(covered, "same", "left")
    shared = F.when(F.col("copies") > 1, F.col("characters")).otherwise(F.coalesce("part", F.lit(0)))
    return joined.select(
        F.col("k").alias(key), "characters", shared.alias("shared"), F.try_divide(shared.cast("double"), F.col("characters")).alias("share")
    )

"""Evaluation passages leaking into training text: Wu-Manber multi-pattern search.

A document holds at least half of an item in one unbroken stretch exactly if it holds one of the item's blocks whole
and the match around that block grows to half of the item: with blocks of a quarter, laid end to end, every stretch of
half the item covers at least one of them. The blocks of all items are the patterns of Wu-Manber searches, one for each
class of block lengths, so a short item does not shorten the steps for long ones. A search's shift table, over hashed
pieces of a few characters, skips positions at which no pattern can end; positions with shift zero look up the patterns
whose key part ends in that piece, and direct comparison, then extension to both sides, confirms.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.arrow import map_batches
from textloom.llm.canonical import skeleton
from textloom.session import write_table

#: Least characters of a piece of the shift table; more items need longer pieces, or every piece would stand in some item.
PIECE = 3
#: Entries of a shift table, as a power of two.
TABLE = 20
#: Share of an item's letters and digits that must stand in one stretch.
HALF = 0.5
#: Letters of the items searched at once. Their forms and tables, some hundred bytes a letter at most, are what a task
#: holds; a larger item set is searched block by block.
LETTERS = 4_000_000

_DROP = re.compile(r"[\W_]+")


def strip_form(text: str) -> str:
    """Letters and digits alone, in the comparison form, in lower case."""
    return _DROP.sub("", skeleton(text).lower())


@dataclass
class WuManber:
    """Search tables over patterns of similar length: blocks of ``(form, start, size)``."""

    blocks: list[tuple[str, int, int]]
    key: int = 0
    piece: int = PIECE
    shift: bytearray = field(default_factory=bytearray)
    buckets: dict[str, list[tuple[str, str, int]]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.key = key = min(size for _, _, size in self.blocks)
        self.piece = piece = min(key, max(PIECE, round(math.log(sum(size for _, _, size in self.blocks), 12))))
        jump = min(key - piece + 1, 255)
        self.shift = shift = bytearray([jump]) * (1 << TABLE)
        mask = (1 << TABLE) - 1
        for form, start, size in self.blocks:
            block = form[start : start + size]
            for end in range(piece, key + 1):
                cell = hash(block[end - piece : end]) & mask
                shift[cell] = min(shift[cell], key - end)
            self.buckets.setdefault(block[key - piece : key], []).append((block, form, start))

    def search(self, text: str, need: dict[str, int], found: set[str]) -> None:
        """Add the forms of which ``text`` holds a long enough stretch to ``found``."""
        shift, mask, key, piece, size = self.shift, (1 << TABLE) - 1, self.key, self.piece, len(text)
        at = key
        while at <= size:
            last = text[at - piece : at]
            step = shift[hash(last) & mask]
            if step:
                at += step
                continue
            start = at - key
            for block, form, offset in self.buckets.get(last, ()):
                if form not in found and text.startswith(block, start) and _grows(text, start, form, offset, len(block), need[form]):
                    found.add(form)
            at += 1


def _grows(text: str, start: int, form: str, offset: int, size: int, need: int) -> bool:
    left = 0
    while left < offset and left < start and text[start - left - 1] == form[offset - left - 1]:
        left += 1
    right, a, b = 0, start + size, offset + size
    while a + right < len(text) and b + right < len(form) and text[a + right] == form[b + right]:
        right += 1
    return left + size + right >= need


class Search:
    """All searches over a set of items; ``items`` maps a comparison form to its item ids."""

    def __init__(self, items: dict[str, list], share: float = HALF):
        self.need = {form: -int(-len(form) * share // 1) for form in items}
        self.short: dict[str, list[str]] = {}
        classes: dict[int, list[tuple[str, int, int]]] = {}
        for form, need in self.need.items():
            size = (need + 1) // 2
            if size < PIECE:  # too short for the tables: its half-length stretches are looked for one by one
                self.short[form] = [form[i : i + need] for i in range(len(form) - need + 1)] if need else []
            else:
                classes.setdefault(size.bit_length(), []).extend((form, start, size) for start in range(0, len(form) - size + 1, size))
        self.tables = [WuManber(blocks) for _, blocks in sorted(classes.items())]

    def search(self, text: str) -> set[str]:
        """Forms of the items of which ``text``, a comparison form, holds a long enough stretch."""
        found = {form for form, parts in self.short.items() if any(p in text for p in parts)}
        for table in self.tables:
            table.search(text, self.need, found)
        return found


_LATEST: dict[str, Search] = {}


def _tables(name: str, sent: Broadcast) -> Search:
    """The searches of a block of items, built once in a worker process."""
    if name not in _LATEST:
        _LATEST.clear()
        _LATEST[name] = Search(sent.value)
    return _LATEST[name]


def _blocks(forms: DataFrame) -> Iterator[dict[str, list]]:
    """Items by form, ``LETTERS`` at once; the driver holds one block."""
    block: dict[str, list] = {}
    held = 0
    for row in forms.toLocalIterator():
        if held + len(row.form) > LETTERS and block:
            yield block
            block, held = {}, 0
        block.setdefault(row.form, []).extend(row.ids)
        held += len(row.form)
    if block:
        yield block


def leaks(documents: DataFrame, items: DataFrame, *, key: str, text: str, item: str, passage: str) -> DataFrame:
    """Pairs of a document and an item of which the document holds an unbroken stretch of at least half.

    The comparison forms of the items are made and reduced on the cluster and kept as a table; blocks of bounded size go
    from it to the tasks, one after another. Every document is read whole in one narrow pass without a shuffle for each
    block; where there is more than one, its pairs are written before the next is fetched. Null, empty and letterless
    texts and passages match nothing; items with the same comparison form are each a match; repeated rows of a
    document or an item give one pair; an empty table gives no pairs.
    """
    kinds = documents.schema[key].dataType.simpleString(), items.schema[item].dataType.simpleString()

    def formed(batch: pa.RecordBatch) -> dict[str, list]:
        return {"i": batch.column(0), "form": [strip_form(p) for p in batch.column(1).to_pylist()]}

    stated = items.where(F.col(passage).isNotNull()).select(F.col(item).alias("i"), F.col(passage).alias("p"))
    forms = map_batches(stated, formed, f"i {kinds[1]}, form string").where("form <> ''")
    forms = write_table(forms.groupBy("form").agg(F.array_sort(F.collect_set("i")).alias("ids")), "items").frame
    rows = documents.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("x"))
    blocks = _blocks(forms)
    found, block, sent = None, next(blocks, {}), None
    while True:
        following = next(blocks, None)
        part, sent = _search(rows if block else rows.limit(0), block, kinds)
        if following is not None or found is not None:
            part = write_table(part, "leaks").frame
            sent.unpersist()
        found = part if found is None else found.unionByName(part)
        if following is None:
            break
        block = following
    return found.distinct().select(F.col("k").alias(key), F.col("i").alias(item))


def _search(rows: DataFrame, block: dict[str, list], kinds: tuple[str, str]) -> tuple[DataFrame, Broadcast]:
    sent = rows.sparkSession.sparkContext.broadcast(block)
    name = uuid.uuid4().hex

    def scan(batch: pa.RecordBatch) -> dict[str, list]:
        search, ids = _tables(name, sent), sent.value
        keys, texts = (c.to_pylist() for c in batch.columns)
        out: dict[str, list] = {"k": [], "i": []}
        for k, x in zip(keys, texts, strict=True):
            for form in search.search(strip_form(x)):
                out["k"].extend([k] * len(ids[form]))
                out["i"].extend(ids[form])
        return out

    return map_batches(rows, scan, f"k {kinds[0]}, i {kinds[1]}"), sent

"""Encoding of a corpus with a public byte-level BPE vocabulary.

Ordinary text goes through the pre-split pattern and the merges in native code. A long stretch the pattern does not
split - a page without spaces, a run of one symbol - costs more than linear time as one piece, so it is encoded as a
tree: the leaves, cut anywhere between two characters, in parallel; then neighbours are joined bottom-up by re-encoding
a window of tokens around the join, growing until its first token agrees with the left side and its last with the
right. A sequence of tokens is the encoding of its bytes if every two neighbours are the encoding of theirs, so the
joined sequence is exact.
"""

from __future__ import annotations

import base64
import os
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.arrow import map_batches

#: Folder of the vocabulary files.
TOKENIZERS = os.environ.get("TEXTLOOM_TOKENIZERS", "/opt/tokenizers")
#: The published pre-split pattern of the 50k byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters from which on an unsplit stretch is encoded as a tree, bytes of a leaf, tokens of the first window.
LONG, LEAF, WINDOW = 1024, 1024, 8
#: Threads that encode leaves.
THREADS = 2


@lru_cache(maxsize=4)
def encoder(path: str):
    """The tokenizer of a rank file, without special tokens: their strings are ordinary text."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _patterns():
    import regex

    runs = "|".join(f"{kind}{{{LONG}}}" for kind in (r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}]", r"\s"))
    return regex.compile(PATTERN), regex.compile(runs)


def join(enc, left: list[int], right: list[int]) -> list[int]:
    """The encoding of two encoded neighbours' bytes."""
    if not left or not right:
        return left + right
    size = WINDOW
    while True:
        a, b = left[-size:], right[:size]
        middle = enc._encode_single_piece(enc.decode_bytes(a + b))
        if (size >= len(left) or middle[0] == a[0]) and (size >= len(right) or middle[-1] == b[-1]):
            return left[: -len(a)] + middle + right[len(b) :]
        size *= 2


def encode_tree(enc, data: bytes) -> list[int]:
    """The encoding of one unsplit stretch, from leaves encoded in parallel and joined pairwise."""
    cuts = [0]
    while cuts[-1] + LEAF < len(data):
        cut = cuts[-1] + LEAF
        while cut < len(data) and data[cut] & 0xC0 == 0x80:
            cut += 1
        cuts.append(cut)
    leaves = [data[a:b] for a, b in zip(cuts, [*cuts[1:], len(data)], strict=True)]
    if len(leaves) > 16:
        with ThreadPoolExecutor(THREADS) as pool:
            level = list(pool.map(enc._encode_single_piece, leaves))
    else:
        level = [enc._encode_single_piece(x) for x in leaves]
    while len(level) > 1:
        paired = [join(enc, a, b) for a, b in zip(level[::2], level[1::2], strict=False)]
        level = paired + level[len(paired) * 2 :]
    return level[0]


def encode(enc, text: str | None) -> np.ndarray:
    """Ids of a text; null and empty texts have none."""
    if not text:
        return np.zeros(0, np.int32)
    if len(text) >= LONG:
        split, runs = _patterns()
        if runs.search(text):
            ids: list[int] = []
            for piece in split.findall(text):
                ids += encode_tree(enc, piece.encode()) if len(piece) >= LONG else enc._encode_single_piece(piece.encode())
            return np.array(ids, np.int32)
    return enc.encode_to_numpy(text).astype(np.int32)


def encode_corpus(documents: DataFrame, *, key: str, text: str, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """``key`` and ``ids`` of every row, in one narrow pass.

    Null, empty and blank-free texts alike: a null or empty text gives an empty list, any other the ids of its whole
    length; repeated rows stay repeated; an empty table gives no rows. The vocabulary file is read once by each
    worker.
    """
    path = os.path.join(TOKENIZERS, vocabulary)

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        enc = encoder(path)
        parts = [encode(enc, t) for t in batch.column(1).to_pylist()]
        ends = np.zeros(len(parts) + 1, np.int32)
        np.cumsum([len(p) for p in parts], out=ends[1:])
        values = pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32))
        kind = pa.list_(pa.field("element", pa.int32(), nullable=True))
        return {"k": batch.column(0), "ids": pa.ListArray.from_arrays(pa.array(ends), values).cast(kind)}

    kind = documents.schema[key].dataType.simpleString()
    rows = documents.select(F.col(key).alias("k"), F.col(text).alias("x"))
    return map_batches(rows, work, f"k {kind}, ids array<int>").withColumnRenamed("k", key)

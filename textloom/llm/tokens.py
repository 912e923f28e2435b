"""Token budget: how many tokens a text has under an existing vocabulary, without producing them.

The vocabulary is a double-array trie over characters. Texts are cut into normalised segments (white space becomes the
word mark, runs of one script stay together); equal segments of a batch are measured once. All segments of a batch walk
the trie together: one array step per depth finds every piece that starts at any position. Count-only Viterbi then runs
over all segments in step, position by position - a long segment by itself - and keeps for each end only the best score and its number of pieces.

The public vocabularies at hand carry merge ranks and no unigram scores. Scores are therefore those of Zipf's law over
the ranks, log p = -log(rank + 1) - log(sum of 1 / rank), which needs no training and no counts of the corpus.
"""

from __future__ import annotations

import math
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.arrow import map_batches
from textloom.llm.encoding import TOKENIZERS

#: The mark that takes the place of white space.
MARK = "▁"
#: Segments of up to this many characters are walked in step; longer ones one by one.
STEP = 64
#: Longest piece.
DEPTH = 16
_SPLIT = r"\s*(?:\p{Latin}+|\p{Han}+|\p{Hangul}+|[\p{Hiragana}\p{Katakana}ー]+|\p{N}|\p{L}+|[^\s\p{L}\p{N}]+)|\s+"


class DoubleArrayTrie:
    """Pieces with scores in two arrays: the child of state ``s`` by character code ``c`` is ``base[s] + c`` if ``check`` of it is ``s``."""

    def __init__(self, pieces: dict[str, float]):
        chars = sorted({c for p in pieces for c in p})
        self.codes = np.zeros(0x110000, np.int32)
        for code, char in enumerate(chars, 1):
            self.codes[ord(char)] = code
        tree: dict = {}
        for piece, score in pieces.items():
            node = tree
            for char in piece:
                node = node.setdefault(int(self.codes[ord(char)]), {})
            node[0] = score
        self.kinds = len(chars)
        size = 4 * sum(map(len, pieces)) + 4 * self.kinds + 64
        self.base = np.zeros(size, np.int32)
        self.check = np.full(size, -1, np.int32)
        self.score = np.full(size, -np.inf)
        taken = np.zeros(size, bool)
        taken[0] = True
        self.check[0] = 0
        queue, spare, top = [(0, tree)], np.arange(1, size), 0
        for turn, (state, node) in enumerate(queue):
            if 0 in node:
                self.score[state] = node.pop(0)
            if not node:
                continue
            codes = np.array(sorted(node), np.int64)
            # Try the first free places for the first child, many at once; all children must be free.
            if turn % 64 == 0:
                spare = np.flatnonzero(~taken[: top + 2 * self.kinds + 64])
            at, wide = 0, 64
            while True:
                starts = spare[at : at + wide] - codes[0]
                fits = (starts > 0) & ~taken[np.minimum(starts[:, None] + codes[None, :], size - 1)].any(axis=1)
                if fits.any():
                    start = int(starts[np.argmax(fits)])
                    break
                at, wide = at + wide, wide * 2
            self.base[state] = start
            taken[start + codes] = True
            top = max(top, start + int(codes[-1]))
            for code in codes.tolist():
                self.check[start + code] = state
                queue.append((start + code, node[code]))
        end = top + self.kinds + 2
        self.base, self.check, self.score = self.base[:end], self.check[:end], self.score[:end]

    def edges(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and score of every piece that stands in ``codes``; ``left`` is how far each position may reach."""
        starts, sizes, scores = [], [], []
        at = np.flatnonzero(codes > 0)
        state = np.zeros(len(at), np.int32)
        for depth in range(1, DEPTH + 1):
            reach = left[at] >= depth
            at, state = at[reach], state[reach]
            if not len(at):
                break
            code = codes[at + depth - 1]
            child = self.base[state] + code
            good = (self.check[child] == state) & (code > 0) & (self.base[state] > 0)
            at, state = at[good], child[good]
            value = self.score[state]
            ends = value > -np.inf
            starts.append(at[ends])
            sizes.append(np.full(int(ends.sum()), depth, np.int64))
            scores.append(value[ends])
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return np.concatenate(starts), np.concatenate(sizes), np.concatenate(scores)


def zipf_scores(count: int) -> list[float]:
    """Log-probabilities of ``count`` ranks under Zipf's law."""
    total = math.log(sum(1 / r for r in range(1, count + 1)))
    return [-math.log(r) - total for r in range(1, count + 1)]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[DoubleArrayTrie, float]:
    """The trie of a piece model and the score of one fallback byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    ranked = sorted(plain, key=lambda i: (model.get_score(i) < -1e6, -model.get_score(i)))
    scores = zipf_scores(len(ranked))
    trie = DoubleArrayTrie({model.id_to_piece(i): s for i, s in zip(ranked, scores, strict=True)})
    return trie, scores[-1]


@lru_cache(maxsize=1)
def _splitter():
    import regex

    return regex.compile(_SPLIT)


def segments(text: str) -> list[str]:
    """Normalised segments of a text, the first with the word mark that a text begins with."""
    found = _splitter().findall(text if text[0].isspace() else " " + text)
    out = []
    for x in found:
        if x[0].isspace():
            bare = x.lstrip()
            x = MARK * (len(x) - len(bare)) + bare
        out.append(x)
    return out


def count_pieces(trie: DoubleArrayTrie, fallback: float, parts: list[str]) -> np.ndarray:
    """Number of pieces on the best path of each segment, however long it is."""
    sizes = np.array([len(p) for p in parts], np.int64)
    out = np.zeros(len(parts), np.int64)
    short = np.flatnonzero(sizes <= STEP)
    if len(short):
        out[short] = _in_step(trie, fallback, [parts[i] for i in short])
    for i in np.flatnonzero(sizes > STEP):
        out[i] = _alone(trie, fallback, parts[i])
    return out


def _points(trie: DoubleArrayTrie, text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _alone(trie: DoubleArrayTrie, fallback: float, part: str) -> int:
    """The same for one long segment: piece lengths and scores by position, then one step a character."""
    points = _points(trie, part)
    best = [-math.inf] * (len(points) + 1)
    count = [0] * (len(points) + 1)
    best[0] = 0.0
    for low in range(0, len(points), 1 << 16):  # edges of a stretch at a time; a piece may reach beyond it
        high = min(len(points), low + (1 << 16))
        codes = trie.codes[points[low : min(len(points), high + DEPTH)]]
        start, width, score = trie.edges(codes, len(codes) - np.arange(len(codes)))
        order = np.argsort(start, kind="stable")
        start, width, score = start[order].tolist(), width[order].tolist(), score[order].astype(np.float64).tolist()
        bounds = np.searchsorted(start, np.arange(high - low + 1)).tolist()
        bytes_ = (1 + (points[low:high] > 0x7F) + (points[low:high] > 0x7FF) + (points[low:high] > 0xFFFF)).tolist()
        for i in range(high - low):
            at, here, n, single = low + i, best[low + i], count[low + i], False
            for e in range(bounds[i], bounds[i + 1]):
                single |= width[e] == 1
                to = at + width[e]
                if here + score[e] > best[to]:
                    best[to], count[to] = here + score[e], n + 1
            if not single and here + fallback * bytes_[i] > best[at + 1]:
                best[at + 1], count[at + 1] = here + fallback * bytes_[i], n + bytes_[i]
    return count[-1]


def _in_step(trie: DoubleArrayTrie, fallback: float, parts: list[str]) -> np.ndarray:
    size = np.array([len(p) for p in parts])
    begin = np.concatenate([[0], np.cumsum(size)])[:-1]
    points = _points(trie, "".join(parts))
    owner = np.repeat(np.arange(len(parts)), size)
    place = np.arange(len(points)) - begin[owner]
    start, width, score = trie.edges(trie.codes[points], size[owner] - place)
    # Characters without a piece of their own fall back to their bytes.
    alone = np.ones(len(points), bool)
    alone[start[width == 1]] = False
    lone = np.flatnonzero(alone)
    spend = 1 + (points[lone] > 0x7F) + (points[lone] > 0x7FF) + (points[lone] > 0xFFFF)
    cost = np.concatenate([np.ones(len(start), np.int64), spend])
    score = np.concatenate([score, fallback * spend])
    start = np.concatenate([start, lone])
    width = np.concatenate([width, np.ones(len(lone), np.int64)])
    order = np.argsort(place[start], kind="stable")
    start, width, score, cost = start[order], width[order], score[order], cost[order]
    bounds = np.searchsorted(place[start], np.arange(int(size.max()) + 1))
    # One node more than characters in each segment: node = position + number of the segment.
    source = start + owner[start]
    target = source + width
    best = np.full(len(points) + len(parts), -np.inf)
    count = np.zeros(len(best), np.int64)
    best[begin + np.arange(len(parts))] = 0
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        s, t = source[a:b], target[a:b]
        value = best[s] + score[a:b]
        better = value > best[t]
        t, s = t[better], s[better]
        best[t] = value[better]
        count[t] = count[s] + cost[a:b][better]
    return count[begin + size + np.arange(len(parts))]


def estimate(trie: DoubleArrayTrie, fallback: float, texts: list[str | None]) -> list[int]:
    """Estimated tokens of each text; null and empty texts have none."""
    seen: dict[str, int] = {}
    numbers: list[list[int]] = [[seen.setdefault(s, len(seen)) for s in segments(t)] if t else [] for t in texts]
    counts = count_pieces(trie, fallback, list(seen))
    return [int(counts[n].sum()) if n else 0 for n in numbers]


def estimate_tokens(frame: DataFrame, *, text: str, keep: list[str], model: str = "piece_bpe_32k.model") -> DataFrame:
    """The ``keep`` columns and ``tokens``, the estimated number of tokens of column ``text``, in one narrow pass.

    Null and empty texts have 0; whole texts are measured, however long; repeated rows stay repeated; an empty table
    gives no rows. The trie is built once on the driver - its size is that of the vocabulary - and sent to the tasks.
    """
    trie, fallback = vocabulary(os.path.join(TOKENIZERS, model))
    sent = frame.sparkSession.sparkContext.broadcast((trie, fallback))

    def work(batch: pa.RecordBatch) -> dict[str, list]:
        names = batch.schema.names
        out = {n: batch.column(i) for i, n in enumerate(names[:-1])}
        return out | {"tokens": estimate(*sent.value, batch.column(len(names) - 1).to_pylist())}

    types = ", ".join(f"`{k}` {frame.schema[k].dataType.simpleString()}" for k in keep)
    return map_batches(frame.select(*keep, F.col(text).alias("__text")), work, f"{types}, tokens bigint")


def token_budget(records: DataFrame) -> DataFrame:
    """Totals by source, by language, by domain and by all three, of ``record_table, source, language, domain, tokens, stated``.

    One aggregation over grouping sets, with partial sums before the shuffle, so a source with a third of all rows adds
    one row per partition. Returns ``slice`` (the name of the grouping), the keys (null where not grouped by),
    ``records, tokens, stated_tokens`` and ``unstated_records``.
    """
    keys = ["record_table", "source", "language", "domain"]
    sets = [["record_table", "source"], ["record_table", "language"], ["record_table", "domain"], keys]
    named = F.expr(
        "case grouping_id(record_table, source, language, domain) when 3 then 'source' when 5 then 'language' when 6 then 'domain' else 'source_language_domain' end"
    )
    grouped = records.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys])
    return grouped.agg(
        named.alias("slice"),
        F.count("*").alias("records"),
        F.sum("tokens").alias("tokens"),
        F.sum("stated").alias("stated_tokens"),
        F.sum(F.when(F.col("stated").isNull(), 1).otherwise(0)).alias("unstated_records"),
    )

"""Token counts (operator 7): trie-shared dynamic programming.

A document's tokens are counted under a unigram segmentation over the pieces of
a public vocabulary: each pre-token (a white-space word with the word mark in
front) takes the best-scoring way to write it as pieces; a character that no
piece covers is one token at a fixed low score. A piece's score is -log(1 + its
place in the vocabulary), an ordinary Zipf prior: no tokenizer is trained.

The distinct pre-tokens of a batch are put into a trie, and the best score and
token count of each trie node are computed once, level by level with numpy: a
prefix that many words share is worked out once. The counts at terminal nodes
are kept per worker (at most ``CACHE_WORDS``; when full the cache starts anew),
so a word costs its computation about once per worker. Words of over
``LONG_WORD`` characters (whole sentences, in scripts without spaces) are cut where
no piece can span, that is between two characters that no piece holds side by side:
the best ways to write the parts make up the best way to write the word. The parts go
to the trie like words; a part that is still longer has no such place, shares
nothing, and runs the recurrence alone. No shuffle; only the path of the vocabulary
travels.

Ties in score go to fewer tokens, then to the longest last piece.

Defined results: null, empty and blank texts have 0 tokens; rows are counted one
by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

MARK = "▁"
UNKNOWN = -30.0
CACHE_WORDS = 1_000_000
BATCH_WORDS = 200_000
LONG_WORD = 64
_BASE = np.uint64(0x9E3779B97F4A7C15)


def scores_of(pieces: list[str]) -> dict[str, float]:
    """Piece -> score, by its place."""
    out: dict[str, float] = {}
    for i, p in enumerate(pieces):
        out.setdefault(p, -math.log(i + 2.0))
    return out


def piece_list(model: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model file, in order."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size())
            if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]


class Counter:
    """Token counts of words, by a trie over those not seen yet."""

    def __init__(self, scores: dict[str, float]):
        scores = {p: s for p, s in scores.items() if p}
        self.scores, self.longest = scores, max(map(len, scores), default=1)
        hashes = {n: {} for n in range(1, self.longest + 1)}
        for p, s in scores.items():
            hashes[len(p)][self._hash(p)] = s
        self.tables = {}
        for n, table in hashes.items():
            if table:
                keys = np.array(sorted(table), np.uint64)
                self.tables[n] = keys, np.array([table[int(k)] for k in keys])
        self.seen: dict[str, int] = {}
        self.parts: dict[str, int] = {}
        self.joined = {p[i:i + 2] for p in scores for i in range(len(p) - 1)}

    @staticmethod
    def _hash(s: str) -> int:
        """Polynomial in the code points, so that a suffix's hash follows from two prefixes'."""
        h = 0
        for c in s:
            h = (h * int(_BASE) + ord(c) * ord(c) + 0x51ED270B * ord(c) + 1) & (1 << 64) - 1
        return h

    def _count(self, words: list[str]) -> np.ndarray:
        """Insert sorted distinct words in a trie and run the recurrence level by level."""
        lengths = np.array([len(w) for w in words], np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        counts = np.zeros(len(words), np.int64)
        # per level: the node of each word's prefix, and per node: hash, best score, tokens
        node = np.zeros(len(words), np.int64)
        levels = [(node, np.zeros(1, np.uint64), np.zeros(1), np.zeros(1, np.int64))]
        power = [np.uint64(1)]
        alive = np.arange(len(words))
        for depth in range(1, int(lengths.max(initial=0)) + 1):
            power.append(np.uint64(int(power[-1]) * int(_BASE) & (1 << 64) - 1))
            alive = alive[lengths[alive] >= depth]
            c = codes[start[alive] + depth - 1]
            parent = levels[-1][0][alive]
            # children: distinct (parent, character); words are sorted, so equal prefixes are neighbours
            new = np.ones(len(alive), bool)
            new[1:] = (parent[1:] != parent[:-1]) | (c[1:] != c[:-1])
            at = np.cumsum(new) - 1
            first = alive[new]
            own = np.full(len(words), -1, np.int64)
            own[alive] = at
            h = levels[-1][1][parent[new]] * _BASE + c[new] * c[new] + np.uint64(0x51ED270B) * c[new] + np.uint64(1)
            up = levels[-1][0][first]
            best, tokens = levels[-1][2][up] + UNKNOWN, levels[-1][3][up] + 1
            for n in range(1, min(depth, self.longest) + 1):
                if n not in self.tables:
                    continue
                keys, values = self.tables[n]
                back = levels[depth - n]
                up = back[0][first]
                suffix = h - back[1][up] * power[n]
                i = np.searchsorted(keys, suffix)
                i[i == len(keys)] = 0
                hit = keys[i] == suffix
                s, t = back[2][up] + values[i], back[3][up] + 1
                better = hit & ((s > best + 1e-9) | ((s > best - 1e-9) & (t <= tokens)))
                best, tokens = np.where(better, s, best), np.where(better, t, tokens)
            levels.append((own, h, best, tokens))
            if depth > self.longest:
                levels[depth - self.longest - 1] = None  # no piece reaches back so far
            ends = alive[lengths[alive] == depth]
            counts[ends] = tokens[own[ends]]
        return counts

    def cut(self, text: str) -> list[str]:
        """The parts of a text between places that no piece spans."""
        joined, at, out = self.joined, 0, []
        for i in range(1, len(text)):
            if text[i - 1:i + 1] not in joined:
                out.append(text[at:i])
                at = i
        return [*out, text[at:]]

    def _alone(self, word: str) -> int:
        best = deque([(0.0, 0)], self.longest)  # no piece reaches back further
        for end in range(1, len(word) + 1):
            s, t = best[-1][0] + UNKNOWN, best[-1][1] + 1
            for n in range(1, min(end, self.longest) + 1):
                piece = self.scores.get(word[end - n:end])
                if piece is not None:
                    s2, t2 = best[-n][0] + piece, best[-n][1] + 1
                    if s2 > s + 1e-9 or (s2 > s - 1e-9 and t2 <= t):
                        s, t = s2, t2
            best.append((s, t))
        return best[-1][1]

    def _learn_parts(self, parts: set[str]) -> None:
        """Counts of parts as they stand, without the word mark."""
        if len(self.parts) + len(parts) > CACHE_WORDS:
            self.parts.clear()
        new = parts.difference(self.parts)
        self.parts.update((p, self._alone(p)) for p in new if len(p) > LONG_WORD)
        todo = sorted(p for p in new if len(p) <= LONG_WORD)
        for at in range(0, len(todo), BATCH_WORDS):
            part = todo[at:at + BATCH_WORDS]
            self.parts.update(zip(part, self._count(part).tolist()))

    def learn(self, words: set[str]) -> None:
        if len(self.seen) + len(words) > CACHE_WORDS:
            self.seen.clear()
        new = words.difference(self.seen)
        cut = {w: self.cut(MARK + w) for w in new if len(w) > LONG_WORD}
        if cut:
            self._learn_parts(set(itertools.chain.from_iterable(cut.values())))
            self.seen.update((w, sum(map(self.parts.__getitem__, parts))) for w, parts in cut.items())
        todo = sorted(w for w in new if len(w) <= LONG_WORD)
        for at in range(0, len(todo), BATCH_WORDS):
            part = todo[at:at + BATCH_WORDS]
            self.seen.update(zip(part, self._count([MARK + w for w in part]).tolist()))


@functools.lru_cache(maxsize=2)
def _counter(model: str) -> Counter:
    return Counter(scores_of(piece_list(model)))


def token_counts(df: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_pretokens, n_tokens; one row per input row. ``model``: path of
    a sentencepiece model file, the same on every executor."""
    def run(batches):
        counter = _counter(model)
        for batch in text_slices(batches, 1, 1 << 23):
            split = [(t or "").split() for t in batch.column(1).to_pylist()]
            counter.learn(set(itertools.chain.from_iterable(split)))
            get = counter.seen.__getitem__
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(w) for w in split], pa.int64()),
                pa.array([sum(map(get, w)) for w in split], pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long")

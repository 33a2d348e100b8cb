"""Whole-text encoding with the tokenizers library, at the cost of its distinct
pieces: a pre-tokenizer never joins text across a white-space boundary, so a
text is cut there, each distinct chunk is encoded once as long as it is in use,
and the ids are concatenated. Where a cut could be unsafe (other white space
beside it) the whole text is encoded directly. The ids equal those of one call on
the whole text; the strings of special tokens are ordinary text.

Two generations of chunks are kept: what is used moves to the young one; when that
is full it becomes the old one, and what was not used since is forgotten. A corpus
with ever new words thus keeps its frequent ones, in bounded memory.

A new chunk that is plain letters with closing marks needs no pre-tokenizer: it is
one or two pre-tokens, which go to the library's model itself."""

from __future__ import annotations

import functools
import os
import re
import sys
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks of a generation, and the characters of one that is kept.
GENERATION, CACHE_CHARS = 350_000, 40
_RUNS = re.compile(r"[ \t\n\r\f\v]*[^ \t\n\r\f\v]+|[ \t\n\r\f\v]+\Z")
#: Letters whose case and composed form are the same rule everywhere, then ASCII marks other than the apostrophe.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


#: What a sign in front of a chunk says about the text before it.
_BEFORE = {"\0": "\n", "\1": ""}


def _byte_letters() -> dict[int, str]:
    """Byte -> the letter that byte-level vocabularies write for it: itself where it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(prints)]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}


class Chunks:
    """A cache of two generations; values are ids, or None where a cut would be unsafe."""

    def __init__(self):
        self.young: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}

    def ids(self, keys: list[str], encode) -> list[bytes | None]:
        """Ids of distinct chunks; ``encode`` is asked for those that are not known."""
        young, unknown = self.young, object()
        out = [young.get(k, unknown) for k in keys]
        late = [i for i, b in enumerate(out) if b is unknown]
        if late:
            for i in late:
                out[i] = self.old.get(keys[i], unknown)
            new = [i for i in late if out[i] is unknown]
            for i, b in zip(new, encode([keys[i] for i in new])):
                out[i] = b
            young.update((keys[i], out[i]) for i in late if len(keys[i]) <= CACHE_CHARS)
            if len(young) > GENERATION:
                self.old, self.young = young, {}
        return out


class Encoder:
    """``drops_space``: the tokenizer ignores white space and case (word BPE);
    else a chunk keeps the white space before it (byte BPE)."""

    def __init__(self, path: str, drops_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core only
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.drops_space = drops_space
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.words, self.runs = Chunks(), Chunks()
        self.letters = _byte_letters()
        self.marks: dict[str, bytes] = {}

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, f"<u{self.width}").tobytes()

    def _direct(self, texts: list[str]) -> list[bytes]:
        return [self.pack(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pre_token(self, text: str, before: str = "") -> bytes:
        """Ids of a text that is one pre-token, after a letter of the vocabulary's own."""
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(self.letters)
        ids = array(self.code, [t.id for t in self.model.tokenize(before + text)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _mark(self, text: str) -> bytes:
        if len(self.marks) > 1000:
            self.marks.clear()
        if text not in self.marks:
            self.marks[text] = self._pre_token("", self.letters[10]) if text == "\n" else self._pre_token(text)
        return self.marks[text]

    def _known(self, word: str) -> bytes | None:
        """Ids of a word that was met without marks."""
        return self.words.young.get(word) or self.words.old.get(word)

    def _plain(self, before: str, key: str) -> bytes | None:
        """Ids of a chunk of plain letters and marks after a space, a line break or nothing; None: another chunk."""
        found = _PLAIN.fullmatch(key)
        if not found:
            return None
        word, marks = found.groups()
        if self.drops_space:
            word = word.lower()
            ids = word != key and self._known(word) or self._pre_token(word)
        elif before == " ":
            ids = marks and self._known(word) or self._pre_token(word, self.letters[32])
        else:  # a line break is a match of its own
            ids = (self._mark(before) if before else b"") + self._pre_token(word)
        return ids + self._mark(marks) if marks else ids

    def _chunks(self, keys: list[str]) -> list[bytes | None]:
        """Ids of words as they follow a space, a line break (written as a NUL in front) or nothing (a 1 in front)."""
        out: list[bytes | None] = []
        rest = []
        for i, key in enumerate(keys):
            before, word = (_BEFORE[key[0]], key[1:]) if key[:1] in _BEFORE else (" ", key)
            empty = not word and (self.drops_space or not before)
            ids = b"" if empty else self._plain(before, word)
            out.append(ids)
            if ids is None and (self.drops_space or self._safe(word)):
                rest.append((i, key if self.drops_space else before + word))
        for (i, _), ids in zip(rest, self._direct([t for _, t in rest])):
            out[i] = ids
        return out

    def _runs_as_they_stand(self, keys: list[str]) -> list[bytes | None]:
        """Ids of runs as they stand: white space, if any, and a word."""
        good = [i for i, k in enumerate(keys) if self._safe(k.lstrip(" \t\n\r\f\v"))]
        out: list[bytes | None] = [None] * len(keys)
        for i, ids in zip(good, self._direct([keys[i] for i in good])):
            out[i] = ids
        return out

    @staticmethod
    def _safe(word: str) -> bool:
        """Other white space at its ends could belong to the neighbours."""
        return bool(word) and word == word.strip() and "\0" not in word

    def _put_together(self, cache: Chunks, split: pa.ListArray, encode) -> list[bytes | None]:
        """Ids of each list of chunks: the distinct chunks are looked up, their ids dealt out by place. None where a
        chunk is unsafe."""
        coded = split.flatten().dictionary_encode()
        values = cache.ids(coded.dictionary.to_pylist(), encode)
        bad = np.array([v is None for v in values], bool)
        values = [v or b"" for v in values]
        size = np.fromiter(map(len, values), np.int64, len(values)) // self.width
        start, flat = np.cumsum(size) - size, np.frombuffer(b"".join(values), f"<u{self.width}")
        word = coded.indices.to_numpy()
        lengths = size[word]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = flat[np.repeat(start[word] - ends[:-1], lengths) + np.arange(ends[-1])].tobytes()
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])
        spoiled = np.concatenate([[0], np.cumsum(bad[word])])[bounds]
        cuts = (ends[bounds] * self.width).tolist()
        return [None if x else ids[a:b] for a, b, x in zip(cuts, cuts[1:], np.diff(spoiled).tolist())]

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids of each text (none of them null) as little-endian integers of ``width`` bytes."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        # signs that mark what stands before a chunk must not stand in a text
        odd = pc.or_(pc.match_substring(texts, "\0"), pc.match_substring(texts, "\1"))
        body = pc.if_else(odd, "", texts)
        if self.drops_space:
            out = self._put_together(self.words, pc.split_pattern(pc.replace_substring(body, "\n", " "), " "), self._chunks)
        else:
            marked = pc.replace_substring(pc.binary_join_element_wise("\1", body, ""), "\n", " \0")
            out = self._put_together(self.words, pc.split_pattern(marked, " "), self._chunks)
        rest = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
        rest += [i for i, b in enumerate(out) if b is None]
        if rest:
            left = texts.take(pa.array(rest)).to_pylist()
            ids = [None] * len(left)
            if not self.drops_space:  # cut in general runs
                ids = self._put_together(self.runs, pa.array([_RUNS.findall(t) for t in left], pa.list_(pa.string())), self._runs_as_they_stand)
            whole = [j for j, b in enumerate(ids) if b is None]
            for j, b in zip(whole, self._direct([left[j] for j in whole]) if whole else []):
                ids[j] = b
            for i, b in zip(rest, ids):
                out[i] = b
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str, drops_space: bool) -> Encoder:
    return Encoder(path, drops_space)

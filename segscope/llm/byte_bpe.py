"""Byte-level BPE encoding and decoding (operator 11) with the tiktoken library.

The merges come from a local rank file; every match of the split pattern is
merged separately, and special tokens do not exist, so their strings are
ordinary text. Ids travel as little-endian unsigned 32-bit integers in one
binary value a text; decoding joins the raw bytes of the ids, so that a cut
inside a character is no error.

Long texts are cut before they are encoded, where a match is known to end:

* after a letter or digit that a space, line break or ordinary punctuation mark
  follows: each alternative of the pattern that reaches the letter ends there,
  and none looks back;
* at the start of a run of white space, and one character before its end where
  something follows it: a long run is a single match by itself, and goes to the
  merges without the pattern, whose matcher would overflow its stack on it.

A single match (a word of a million letters) is never cut: the library merges it
in n log n time. What a call holds is bounded by the longest match.

Defined results: null and empty texts have no ids and decode to no bytes; rows
are encoded one by one, so repeated rows repeat; a null id stays null; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_slices

#: Characters of a piece, and of a run of white space that is taken out as a match of its own.
PIECE_CHARS, RUN_CHARS = 1 << 16, 1 << 10
#: White space as the library's pattern knows it: without the separators 1C-1F that Python adds.
_WHITE = r"[^\S\x1c-\x1f]"
_LONG_RUN = re.compile(_WHITE + "{%d,}" % RUN_CHARS)
#: A letter or digit (of the basic plane, whose classes are old and stable), then a mark or space that is neither.
_SAFE = re.compile("(?<=[^\\W_\U00010000-\U0010ffff])(?=[ \t\n\r.,;:!?()、。，])")


def pieces(text: str, size: int | None = None) -> Iterator[tuple[str, bool]]:
    """(piece, is it one match) of a text, cut where matches end."""
    size = size or PIECE_CHARS
    at = 0
    if len(text) > size:
        for run in _LONG_RUN.finditer(text):
            yield from _cut(text, at, run.start(), size)
            at = run.end() if run.end() == len(text) else run.end() - 1
            yield text[run.start():at], True
    yield from _cut(text, at, len(text), size)


def _cut(text: str, at: int, end: int, size: int) -> Iterator[tuple[str, bool]]:
    while end - at > size:
        found = _SAFE.search(text, at + size, end)
        if not found:
            break
        yield text[at:found.start()], False
        at = found.start()
    if at < end:
        yield text[at:end], False


class Codec:
    """Encoding and decoding by one rank file."""

    def __init__(self, rank_file: str, pattern: str):
        import base64

        import tiktoken
        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.library = tiktoken.Encoding(rank_file, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> bytes:
        out = []
        for piece, single in pieces(text or ""):
            ids = self.library._encode_single_piece(piece) if single else self.library.encode_to_numpy(piece)
            out.append(np.asarray(ids, "<u4").tobytes())
        return b"".join(out)

    def decode(self, ids: bytes | None) -> bytes:
        return self.library.decode_bytes(np.frombuffer(ids or b"", "<u4").tolist())


@functools.lru_cache(maxsize=2)
def codec(rank_file: str, pattern: str) -> Codec:
    return Codec(rank_file, pattern)


def _each_row(df: DataFrame, convert, column: str) -> DataFrame:
    """doc_id, ``column``: a binary value for each value of the second column."""
    def run(batches):
        for batch in text_slices(batches, 1):
            values = [convert(v) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.binary())], ["doc_id", column])

    return df.mapInArrow(run, f"doc_id long, {column} binary")


def encode_texts(df: DataFrame, rank_file: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids; one row per input row. The rank file has the same path on every executor."""
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return _each_row(rows, lambda t: codec(rank_file, pattern).encode(t), "ids")


def decode_ids(df: DataFrame, rank_file: str, pattern: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id, bytes: the raw bytes of each row's ids."""
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).alias("ids"))
    return _each_row(rows, lambda b: codec(rank_file, pattern).decode(b), "bytes")


def round_trip(df: DataFrame, rank_file: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids, bytes: encoded, and the ids decoded again, in one pass."""
    def run(batches):
        own = codec(rank_file, pattern)
        for batch in text_slices(batches, 1):
            ids = [own.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()),
                                              pa.array(map(own.decode, ids), pa.binary())], ["doc_id", "ids", "bytes"])

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, bytes binary")


def n_tokens(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")

"""Packing (operator 6): power-of-two decomposition.

A document of N ids is cut into pieces whose lengths are powers of two: as many
of ``max_len`` as fit, then one for each binary digit of the rest, longest
first. Each piece is a sequence of its own, at offset 0, so no sequence crosses
documents and none needs padding. Pieces of one length share a bucket (a folder
of the output), from which a trainer draws batches of one shape.

Pieces are written once, bucket by bucket, and numbered by where they stand in
the written files: tokens are never shuffled, and a re-run task cannot number
them anew. Sequence ids run from 0 through the buckets without gaps.

Defined results: a null or empty text is one piece with the end id; a null id
stays null; repeated ids are cut separately; an empty table gives no pieces;
other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_path, text_slices
from .tokens import encoder

BROADCAST_FILES = 100_000  # beyond, the join shuffles
PIECE = "doc_id long, start long, length int, doc_tokens long, width int, ids binary, ids_crc32 long"


def cuts(n: int, max_len: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    out = [(at, max_len) for at in range(0, n - max_len + 1, max_len)]
    at, size = n // max_len * max_len, max_len >> 1
    while size:
        if n & size:
            out.append((at, size))
            at += size
        size >>= 1
    return out


def cut_documents(df: DataFrame, tokenizer: str, end_id: int, max_len: int = 1024, doc_id: str = "doc_id",
                  text: str = "text", drops_space: bool = False) -> DataFrame:
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def pieces(batches):
        enc = encoder(tokenizer, drops_space)
        end, w = enc.pack([end_id]), enc.width
        for batch in text_slices(batches, 1, 1 << 22):
            out = []
            for i, b in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1))):
                b += end
                n = len(b) // w
                wide = b if w == 4 else np.frombuffer(b, "<u2").astype("<u4").tobytes()
                out += [(i, at, size, n, w, b[at * w:(at + size) * w], zlib.crc32(wide[at * 4:(at + size) * 4]))
                        for at, size in cuts(n, max_len)]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                                 [x.split()[0] for x in PIECE.split(", ")])

    return rows.mapInArrow(pieces, PIECE)


def pack_documents(df: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the buckets under ``path`` and return the sequences read back:
    doc_id, start, length, doc_tokens, width, ids (little-endian, ``width``
    bytes each), ids_crc32 (unsigned crc32 of the ids as little-endian u32),
    sequence_id, offset."""
    spark = df.sparkSession
    path = path or shared_path(spark, "packed")
    pieces = cut_documents(df, **options)
    pieces.write.option("compression", "zstd").partitionBy("length").parquet(path)
    schema = pieces.select(*[c for c in pieces.columns if c != "length"], "length").schema
    stored = spark.read.schema(schema).parquet(path).select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    # one row per written file: the sequences in all files before it
    counts = stored.groupBy("length", "_file").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("length", "_file").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    few = base.count() <= BROADCAST_FILES
    return stored.join(F.broadcast(base) if few else base, "_file").select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "doc_tokens", "width", "ids", "ids_crc32",
        (F.col("_base") + F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


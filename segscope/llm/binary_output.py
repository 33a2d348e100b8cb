"""Token-ID / binary output (operator 5): length-delimited binary records and a
separate offset index for shuffled reads.

Record: u64 length of the payload, u32 masked crc32 of those 8 bytes, payload,
u32 masked crc32 of the payload, one byte 0x0A; all little-endian. Payload: u8
flags (1: the id is null, 2: ids take 4 bytes, else 2), i64 document id, ids.
A checksum is masked by rotating it 15 bits to the right and adding a constant,
so that a crc over bytes that hold crcs stays useful.

Files are in ascending id order, across files by their number. They are written
through Spark's own file writer (the bytes of a record are one line of the text
sink), so any store that Spark writes to serves, and a lost task is written anew
without leaving half a file behind. The index has, for each record, its file,
byte offset, byte length, id, tokens, and the tokens before it in the file;
``files`` has the tokens before each file. A shard is read whole by one task:
``records_per_file`` and the number of partitions bound it.

Defined results: null and empty texts are records with the end id alone; a null
id comes first and is flagged; repeated ids are separate records, ordered by
text; an empty table gives no records; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import text_slices
from .tokens import encoder

MASK_DELTA = 0xA282EAD8
HEAD, LENGTH, FRAME = struct.Struct("<Bq"), struct.Struct("<Q"), 8 + 4 + 4 + 1
INDEX = ("file string, file_no int, part_no int, offset long, bytes long, doc_id long, n_tokens long, "
         "start_in_file long, ids_crc32 long")


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    payload = HEAD.pack((doc_id is None) | (width == 4) << 1, doc_id or 0) + ids
    size = LENGTH.pack(len(payload))
    return b"".join((size, struct.pack("<I", masked_crc(size)), payload, struct.pack("<I", masked_crc(payload)), b"\n"))


def frames(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, bytes, payload) of each record; a wrong checksum is an error."""
    at = 0
    while at < len(content):
        size = content[at:at + 8]
        (n,) = LENGTH.unpack(size)
        if struct.pack("<I", masked_crc(size)) != content[at + 8:at + 12]:
            raise ValueError(f"length checksum at byte {at}")
        payload = content[at + 12:at + 12 + n]
        if struct.pack("<I", masked_crc(payload)) != content[at + 12 + n:at + 16 + n]:
            raise ValueError(f"payload checksum at byte {at}")
        yield at, n + FRAME, payload
        at += n + FRAME


def payload_ids(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc_id = HEAD.unpack_from(payload)
    return None if flags & 1 else doc_id, np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=HEAD.size)


def write_records(df: DataFrame, path: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text",
                  drops_space: bool = True, shards: int | None = None, records_per_file: int = 50_000) -> None:
    """Encode every text, append ``end_id``, and write the records under ``path``."""
    spark = df.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def records(batches):
        enc = encoder(tokenizer, drops_space)
        end = enc.pack([end_id])
        for batch in text_slices(batches, 1, 1 << 22):
            ids = enc.encode(batch.column(1))
            # one byte fewer: the text sink ends each line with 0x0A
            yield pa.RecordBatch.from_arrays([pa.array(
                [frame(i, b + end, enc.width)[:-1] for i, b in zip(batch.column(0).to_pylist(), ids)], pa.binary())], ["value"])

    lines = rows.mapInArrow(records, "value binary").select(F.col("value").cast("string"))
    lines.write.option("lineSep", "\n").option("maxRecordsPerFile", records_per_file).text(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Read all files under ``path``, check every checksum, and return one row
    per record: the offset index and the crc32 of its ids as u32."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(
        F.col("path").alias("file"), F.regexp_extract("path", r"part-(\d+)-", 1).cast("int").alias("file_no"),
        F.regexp_extract("path", r"-c(\d+)[^/-]*$", 1).cast("int").alias("part_no"), "content")

    def parse(batches):
        for batch in batches:
            for name, no, part, content in zip(*(batch.column(i) for i in range(4))):
                head, before, rows = (name.as_py(), no.as_py(), part.as_py()), 0, []
                for at, size, payload in frames(content.as_py()):
                    doc_id, ids = payload_ids(payload)
                    rows.append((*head, at, size, doc_id, len(ids), before, zlib.crc32(ids.astype("<u4").tobytes())))
                    before += len(ids)
                if rows:
                    kinds = (pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 6)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                     [x.split()[0] for x in INDEX.split(", ")])

    return files.mapInArrow(parse, INDEX)


def file_starts(index: DataFrame) -> DataFrame:
    """file, file_start: tokens in all files before it. One row per file meets in the window."""
    totals = index.groupBy("file", "file_no", "part_no").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file_no", "part_no", "file").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("file_start"))


def read_record(content: bytes, offset: int) -> tuple[int | None, np.ndarray]:
    """(id, token ids) of the record at ``offset`` of a file's bytes: the shuffled read."""
    (n,) = LENGTH.unpack_from(content, offset)
    payload = content[offset + 12:offset + 12 + n]
    if struct.pack("<I", masked_crc(payload)) != content[offset + 12 + n:offset + 16 + n]:
        raise ValueError(f"payload checksum at byte {offset}")
    return payload_ids(payload)

"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: Words are maximal runs of characters other than space, tab, newline, vertical tab, form feed and return.
SPACES = " \t\n\x0b\f\r"
SPACE_RE = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that all executors see."""
    return f"{checkpoint_dir(spark).rstrip('/')}/segscope-llm-{name}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, and each
    row is computed once however often it is used."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables of one job in the shared folder, gone when the job's result is written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n = spark, shared_path(spark, name), 0

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, which: int | None = None) -> None:
        """Delete the whole, or the table that was saved as number ``which``."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path if which is None else f"{self.path}/{which}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """Array of the words of a text; null and blank texts: empty."""
    body = F.btrim(F.coalesce(c, F.lit("")), F.lit(SPACES))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, SPACE_RE))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, remainder 2 by 4: rows that no model learns from. A null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def slices(batches, rows: int = 512):
    """Arrow batches in smaller pieces, so that what a task derives from one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_slices(batches, column: int, most_bytes: int = 1 << 21, rows: int = 2048):
    """Arrow batches cut so that the texts of a piece have about ``most_bytes``; one longer text stands alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        at = total = 0
        for i, n in enumerate(sizes):
            if i > at and (total + n > most_bytes or i - at >= rows):
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += n
        if at < len(sizes):
            yield batch.slice(at)

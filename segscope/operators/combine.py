"""Joins, set operations, consolidation, relabelling.

``join_small`` attaches a per-key table to rows. It gives no hint: Spark
broadcasts a side whose measured bytes are under the session's threshold, else
it shuffles, and adaptive execution splits skewed keys. Tables of one row per group
go through ``per_group`` first: the few groups of a large table would else be the
few keys of a shuffle, and a task would hold all rows of a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Values of a table of groups that is broadcast.
BROADCAST_VALUES = 1 << 20


def per_group(table: DataFrame) -> DataFrame:
    """A table of one row per group, worked out and counted: to be broadcast while it has at most ``BROADCAST_VALUES``
    values, else to be shuffled (with that many groups no few keys hold the rows)."""
    table = cut_lineage(table)
    return F.broadcast(table) if table.count() * len(table.columns) <= BROADCAST_VALUES else table


def join_small(big: DataFrame, small: DataFrame, on, how: str = "left") -> DataFrame:
    """Attach a per-key table to rows."""
    return big.join(small, on, how)


def attach(df: DataFrame, result: DataFrame, key, cols: list[str]) -> DataFrame:
    """Attach result columns (labels, coordinates) to source rows by key —
    never by position."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.join(result.select(*keys, *cols), keys, "inner")


def relabel(df: DataFrame, overrides: DataFrame, key: str, auto: str, manual: str,
            out: str = "cluster_final") -> DataFrame:
    """A reviewer's manual cluster overrides the automatic one."""
    o = overrides.select(key, F.col(manual).alias("_manual"))
    return (df.join(o, key, "left")
              .withColumn(out, F.coalesce(F.col("_manual"), F.col(auto).cast("string")))
              .withColumnRenamed("_manual", manual))


SOURCE_ORDER = ("numeric", "text", "mixed")


def consolidate(drop_prefixes=("tsne_",), **results: DataFrame) -> DataFrame:
    """K1: stack the segmentation results by column name, tag each with its
    source, drop the t-SNE-style projection columns, missing -> NULL, and put
    ``source`` first."""
    frames = []
    for name in SOURCE_ORDER + tuple(k for k in results if k not in SOURCE_ORDER):
        df = results.get(name)
        if df is None:
            continue
        df = df.drop(*[c for c in df.columns if c.startswith(tuple(drop_prefixes))])
        frames.append(df.withColumn("source", F.lit(name)))
    if not frames:
        raise ValueError("nothing to consolidate")
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.select("source", *[c for c in stacked.columns if c != "source"])


def extract_set(df: DataFrame, col: str, pattern: str = r"id=['\"](.*?)['\"]", out: str = "value") -> DataFrame:
    """K2: every capture of ``pattern`` in the column, as a distinct set."""
    return (df.select(F.explode(F.regexp_extract_all(F.col(col), F.lit(pattern), 1)).alias(out))
              .distinct())


def compare_sets(a: DataFrame, b: DataFrame, col: str = "value") -> DataFrame:
    """K3: values in both, only left, only right (tagged), one row per value."""
    left = a.select(F.col(col).alias("value")).distinct().withColumn("_l", F.lit(True))
    right = b.select(F.col(col).alias("value")).distinct().withColumn("_r", F.lit(True))
    j = left.join(right, "value", "full")
    side = (F.when(F.col("_l") & F.col("_r"), F.lit("both"))
             .when(F.col("_l"), F.lit("left_only")).otherwise(F.lit("right_only")))
    return j.select("value", side.alias("side"))

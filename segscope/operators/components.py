"""Connected components of a distributed edge list: alternating large-star and
small-star rounds, each an aggregate with map-side combine and a join, until the
edges no longer change; the number of rounds grows with the logarithm of the
longest path. Nothing but two numbers per round reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _state(edges: DataFrame, by: list[str]) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*by, "u", "v"))).first())


def _with_least(pairs: DataFrame, by: list[str]) -> DataFrame:
    """u, v, m: the least of u and its partners v."""
    least = pairs.groupBy(*by, "u").agg(F.min("v").alias("m"))
    return pairs.join(least, [*by, "u"]).withColumn("m", F.least("u", "m"))


def components(edges: DataFrame, cut=cut_lineage, by: list[str] = ()) -> DataFrame:
    """Edges (u, v) of long nodes -> (node, root), root being the least node of
    the component; nodes without edges are not listed. ``cut`` stores a round.
    With columns ``by`` each of their values is a graph of its own."""
    by = list(by)
    now = cut(edges.where("u <> v").select(*by, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(now, by)
    while state[0]:
        both = now.unionByName(now.select(*by, F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, by).where("v > u").select(*by, F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _with_least(large, by)
        small = small.select(*by, F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                                    F.struct("u", F.col("m").alias("v")))).alias("e")).select(*by, "e.*")
        now = cut(small.where("u <> v").distinct())
        before, state = state, _state(now, by)
        if state == before:
            break
    return now.select(*by, F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(*by, F.col("v").alias("node"), F.col("v").alias("root"))).distinct()

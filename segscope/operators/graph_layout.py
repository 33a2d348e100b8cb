"""Fuzzy neighbour weights and coordinates of the neighbour graph.

*Weights* (P3). For each row, rho is the distance to its nearest other vector (0 if all
its neighbours are copies) and sigma solves sum(exp(-max(0, d - rho) / sigma)) = log2(k)
over its k neighbours, by a fixed number of halvings of one bracket, inside the row. The
two directions of a pair are joined as a + b - ab: one aggregate per pair.

*Coordinates* (P2). The leading eigenvectors of the symmetrically normalised weights,
without the trivial one (the square roots of the degrees, which is projected out), by
block power iteration: a round is a join of the edges with the vectors and a sum per row;
then the block is orthogonalised with its small Gram matrix (d x d sums, d the number of
coordinates and a few more). The iteration works on (1 + matrix) / 2, whose leading
vectors are the same and whose values are not negative. It ends when the residual of the
wanted vectors is at most ``tol``, or after ``rounds``. The sign of a coordinate is fixed:
its largest entry by size is positive (the least id on ties). Rows without an edge get 0.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, cut_lineage

HALVINGS = 60


def fuzzy_directed(near: DataFrame) -> DataFrame:
    """Id, neighbor, rho, sigma, weight from (id, rank, neighbor, dist)."""
    rows = near.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("dist", "neighbor"))).alias("near"))  # k a row
    away = F.filter("near", lambda e: e["dist"] > 0)
    rows = rows.withColumn("rho", F.coalesce(F.array_min(F.transform(away, lambda e: e["dist"])), F.lit(0.0)))
    beyond = F.transform("near", lambda e: F.greatest(F.lit(0.0), e["dist"] - F.col("rho")))
    rows = rows.withColumn("_d", beyond).withColumn("_want", F.log2(F.size("near").cast("double")))
    mass = lambda s: F.aggregate("_d", F.lit(0.0), lambda acc, d: acc + F.exp(-d / s))
    # the sum grows with sigma from the number of zeros to k; the bracket reaches where it must be
    top = F.greatest(F.array_max("_d"), F.lit(1e-12)) * 1000.0
    start = F.struct(F.lit(0.0).alias("lo"), top.alias("hi"))

    def halve(acc, _):
        mid = (acc["lo"] + acc["hi"]) / 2
        low = mass(mid) < F.col("_want")
        return F.struct(F.when(low, mid).otherwise(acc["lo"]).alias("lo"), F.when(low, acc["hi"]).otherwise(mid).alias("hi"))

    rows = rows.withColumn("sigma", F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halve, lambda a: (a["lo"] + a["hi"]) / 2))
    out = rows.select("id", "rho", "sigma", F.explode("near").alias("e"))
    weight = F.exp(-F.greatest(F.lit(0.0), F.col("e.dist") - F.col("rho")) / F.col("sigma"))
    return out.select("id", F.col("e.neighbor").alias("neighbor"), "rho", "sigma", weight.alias("weight"))


def fuzzy_graph(near: DataFrame) -> DataFrame:
    """U, v, weight with u < v, the two directions joined as a + b - ab (a missing direction is 0)."""
    d = fuzzy_directed(near)
    forth = F.col("id") < F.col("neighbor")
    pairs = d.groupBy(F.least("id", "neighbor").alias("u"), F.greatest("id", "neighbor").alias("v")).agg(
        F.coalesce(F.max(F.when(forth, F.col("weight"))), F.lit(0.0)).alias("a"), F.coalesce(F.max(F.when(~forth, F.col("weight"))), F.lit(0.0)).alias("b"))
    return pairs.select("u", "v", (F.col("a") + F.col("b") - F.col("a") * F.col("b")).alias("weight"))


def _gram(df: DataFrame, left: list[str], right: list[str]) -> np.ndarray:
    sums = df.agg(*[F.sum(F.col(a) * F.col(b)) for a in left for b in right]).first()
    return np.array([0.0 if s is None else s for s in sums]).reshape(len(left), len(right))


def _turned(cols: list[str], m: np.ndarray, names: list[str]) -> list:
    """Linear combinations of columns: one per column of ``m``."""
    return [reduce(lambda a, b: a + b, [F.col(c) * F.lit(float(x)) for c, x in zip(cols, m[:, j])]).alias(n) for j, n in enumerate(names)]


def spectral_layout(nodes: DataFrame, graph: DataFrame, dim: int = 2, rounds: int = 60, tol: float = 1e-4, prefix: str = "p2_",
                    seed: int = 42) -> tuple[DataFrame, dict]:
    """(id, coordinates of unit length, {values: of the matrix, residual, rounds}). ``nodes`` has one column id."""
    scratch = Scratch(nodes.sparkSession, "layout")
    d = dim + 3
    names = [f"_y{i}" for i in range(d)]
    both = graph.select("u", "v", "weight").unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "weight"))
    degree = both.groupBy("u").agg(F.sum("weight").alias("degree"))
    of = lambda c: degree.select(F.col("u").alias(c), F.col("degree").alias(f"d{c}")).hint("merge")
    edges = scratch.save(both.join(of("u"), "u").join(of("v"), "v").select("u", "v", (F.col("weight") / F.sqrt(F.col("du") * F.col("dv"))).alias("a")))
    # starts from the ids: the same however the rows are dealt
    unit = lambda i: F.pmod(F.xxhash64("u", F.lit(seed + i)), F.lit(1 << 30)) / float(1 << 30) - 0.5
    y = scratch.save(degree.select("u", F.sqrt("degree").alias("t"), *[unit(i).alias(n) for i, n in enumerate(names)]))
    length = y.agg(F.sum(F.col("t") * F.col("t"))).first()[0]
    if length is None:
        scratch.drop()
        return nodes.select("id", *[F.lit(0.0).alias(f"{prefix}{i + 1}") for i in range(dim)]), {"values": [], "residual": 0.0, "rounds": 0}

    def orthonormal(v):
        """Without the trivial vector, and with a Gram matrix of ones; directions that vanish become 0."""
        along = _gram(v, ["t"], names)[0] / length
        v = v.select("u", "t", *[(F.col(n) - F.lit(float(c)) * F.col("t")).alias(n) for n, c in zip(names, along)])
        w, q = np.linalg.eigh(_gram(v, names, names))
        scale = np.where(w > 1e-12 * max(w.max(), 1e-300), 1 / np.sqrt(np.maximum(w, 1e-300)), 0.0)
        return v.select("u", "t", *_turned(names, q * scale, names))

    done = 0
    while True:
        done += 1
        y = scratch.save(orthonormal(y))
        # both sides are dealt by node: a table of all nodes is sent to no one, however few bytes it has
        ends = y.select(F.col("u").alias("v"), *names).hint("merge")
        z = edges.join(ends, "v").groupBy("u").agg(*[F.sum(F.col("a") * F.col(n)).alias(f"_z{i}") for i, n in enumerate(names)])
        j = scratch.save(y.join(z.hint("merge"), "u"))
        zs = [f"_z{i}" for i in range(d)]
        # the block's own small problem: values of the matrix on it, largest first
        small = _gram(j, names, zs)
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        second = _gram(j, zs, zs)
        # |A y - value y| of each turned vector, from the two small matrices
        residual = [float(np.sqrt(max(0.0, t @ second @ t - x * x))) for x, t in zip(values, turn.T)][:dim]
        if max(residual) <= tol or done >= rounds:
            break
        y = j.select("u", "t", *[((F.col(n) + F.col(f"_z{i}")) / 2).alias(n) for i, n in enumerate(names)])
    out = j.select("u", *_turned(names, turn[:, :dim], [f"{prefix}{i + 1}" for i in range(dim)]))
    cols = [f"{prefix}{i + 1}" for i in range(dim)]
    # entries of one size up to rounding count as equal, so that the sign does not hang on the order of sums
    largest = out.agg(*[F.max_by(F.col(c), F.struct(F.round(F.abs(c), 9), -F.col("u"))).alias(c) for c in cols]).first()
    out = out.select(F.col("u").alias("id"), *[(F.col(c) * (-1.0 if largest[c] < 0 else 1.0)).alias(c) for c in cols])
    out = cut_lineage(nodes.select("id").join(out.hint("merge"), "id", "left").select("id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in cols]))
    scratch.drop()
    return out, {"values": values[:dim].tolist(), "residual": max(residual), "rounds": done}

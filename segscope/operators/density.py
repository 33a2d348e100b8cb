"""F6 (re-aimed), F9: density clustering without pairs of rows.

The reference's density clustering works from each row's nearest neighbours,
i.e. from pairs of rows. Here density is measured on a grid instead:

1. features are standardised (E1) and each row falls in a cell of side
   ``cell`` (in standard deviations);
2. cells holding at least ``min_samples`` rows are dense (a grouped count with
   map-side combine: a hot cell costs one counter, not one task);
3. dense cells that share a face (one step along one feature: d links per cell,
   for any number of features) are linked, and clusters are the connected
   components, found in logarithmically many rounds (reliable checkpoint each);
4. components with fewer than ``min_cluster_size`` rows, and rows in sparse
   cells, are noise (-1). Cluster ids are 0.. in the order of the components'
   smallest cell, coordinates compared as numbers.

This is DBSCAN-like density clustering on grid cells, not the library's
single-linkage hierarchy; it needs no neighbour search and scales with the
number of non-empty cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .combine import join_small
from .components import components
from .features import standardize
from .rank import ranked


def grid_cells(df: DataFrame, features: list[str], cell: float = 0.5) -> DataFrame:
    """Rows with their cell (array<long>) on standardised features; rows with a
    missing feature get no cell (noise)."""
    z = standardize(df, features, suffix="_z")
    coords = [F.floor(F.col(f + "_z") / F.lit(float(cell))).cast("long") for f in features]
    any_null = None
    for f in features:
        c = F.col(f + "_z").isNull()
        any_null = c if any_null is None else (any_null | c)
    return z.withColumn("_cell", F.when(~any_null, F.array(*coords))).drop(*[f + "_z" for f in features])


def _roots(dense: DataFrame, dim: int) -> DataFrame:
    """dense: (_cell, _in) -> (_cell, _in, root): root = number of the smallest
    cell, in numeric order of the coordinates, reachable through dense cells
    that share a face."""
    axes = [f"_c{i}" for i in range(dim)]
    numbered = dense.withColumns({a: F.get("_cell", F.lit(i)) for i, a in enumerate(axes)})
    numbered = cut_lineage(ranked(numbered, [(a, True) for a in axes]).select("_cell", "_in", F.col("_rank").cast("long").alias("_id")))
    steps = F.array(*[F.array(*[F.lit(int(i == j)).cast("long") for j in range(dim)]) for i in range(dim)])
    onward = numbered.select(F.col("_id").alias("u"), F.col("_cell").alias("_from"), F.explode(steps).alias("_o"))
    onward = onward.select("u", F.zip_with("_from", "_o", lambda a, b: a + b).alias("_cell"))
    roots = components(onward.join(numbered.select("_cell", F.col("_id").alias("v")), "_cell").select("u", "v"))
    return numbered.join(roots, F.col("_id") == F.col("node"), "left").select("_cell", "_in", F.coalesce("root", "_id").alias("root"))


def density_cluster(df: DataFrame, features: list[str], cell: float = 0.5, min_samples: int = 5,
                    min_cluster_size: int = 5, out: str = "cluster_num") -> DataFrame:
    """grid density clustering; adds ``out`` (int, -1 = noise)."""
    if not features:
        raise ValueError("grid density clustering needs a feature")
    g = grid_cells(df, features, cell)
    cells = g.filter(F.col("_cell").isNotNull()).groupBy("_cell").agg(F.count(F.lit(1)).alias("_in"))
    comps = cut_lineage(_roots(cells.filter(F.col("_in") >= min_samples), len(features)))
    kept = comps.groupBy("root").agg(F.sum("_in").alias("_size")).filter(F.col("_size") >= min_cluster_size).select("root")
    ids = ranked(kept, [("root", True)]).select("root", (F.col("_rank") - 1).cast("int").alias("_cid"))
    cell_ids = comps.join(ids, "root").select("_cell", "_cid")
    res = join_small(g, cell_ids, "_cell", "left")
    return res.withColumn(out, F.coalesce(F.col("_cid"), F.lit(-1))).drop("_cell", "_cid")

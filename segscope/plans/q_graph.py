"""Registered queries: neighbours, density hierarchy and neighbour-graph coordinates (F6a-F6e, G5, P2, P3).

Binding: ``embeddings`` (``vec_id``, 64 dimensions). The neighbour queries with SQL look into all cells, so that their
answer is exact and can be compared; the others run with the index's own probes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rnd
from ..operators import forest as FO
from ..operators import graph_layout as GL
from ..operators import neighbors as N
from ..session import cut_lineage
from .sqlbits import R

K, CORE, CELLS = 10, 5, 16


def _emb(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet")


def _ids(spark, d):
    return _emb(spark, d).select(F.col("vec_id").cast("long").alias("id"))


def _exact(spark, d):
    return cut_lineage(N.knn(_emb(spark, d), "embedding", "vec_id", K, cells=CELLS, probe=2 * CELLS))


def _indexed(spark, d):
    return cut_lineage(N.knn(_emb(spark, d), "embedding", "vec_id", K))


def neighbors(spark, d):
    """F6a by the index: what its probes find."""
    return N.knn(_emb(spark, d), "embedding", "vec_id", K).select("id", "rank", "neighbor", rnd("dist", 6).alias("dist"))


def neighbors_all_cells(spark, d):
    """F6a with every cell looked into."""
    return _exact(spark, d).select("id", "rank", rnd("dist", 6).alias("dist"))


_NEAR = f"""e AS (SELECT CAST(vec_id AS BIGINT) AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
near AS (SELECT a.id, b.id AS neighbor, list_distance(a.x, b.x) AS dist, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.x, b.x), b.id) AS rank
  FROM e a JOIN e b ON a.id <> b.id QUALIFY rank <= {K})"""
SQL_NEIGHBORS = f"WITH {_NEAR} SELECT id, CAST(rank AS INT) AS rank, {R('dist', 6)} AS dist FROM near"


def _mutual(near):
    return N.mutual_reachability(near, N.core_distances(near, CORE))


def mutual_reachability(spark, d):
    """Neighbour pairs with the largest of their distance and core distances."""
    return _mutual(_exact(spark, d)).select("u", "v", rnd("w", 6).alias("w"))


_MUTUAL = f"""{_NEAR},
core AS (SELECT id, max(dist) AS core FROM near WHERE rank <= {CORE} GROUP BY 1),
edges AS (SELECT least(id, neighbor) AS u, greatest(id, neighbor) AS v, min(dist) AS dist FROM near GROUP BY 1, 2),
mutual AS (SELECT u, v, greatest(dist, a.core, b.core) AS w FROM edges JOIN core a ON u = a.id JOIN core b ON v = b.id)"""
SQL_MUTUAL = f"WITH {_MUTUAL} SELECT u, v, {R('w', 6)} AS w FROM mutual"


def spanning_forest(spark, d):
    """F6e: edges and weight of the forest. (Equal weights allow several forests of one weight.)"""
    f = FO.spanning_forest(_mutual(_exact(spark, d)))
    return f.agg(F.count(F.lit(1)).alias("n_edges"), rnd(F.sum("w"), 4).alias("weight"))


# one edge after the other in the order of the weights: it is taken if its ends have not the same mark
_KRUSKAL = f"""{_MUTUAL},
nodes AS (SELECT id, row_number() OVER (ORDER BY id) AS no FROM e),
ordered AS (SELECT a.no AS a, b.no AS b, u, v, w, row_number() OVER (ORDER BY w, u, v) AS i FROM mutual JOIN nodes a ON u = a.id JOIN nodes b ON v = b.id),
steps AS (SELECT 0::BIGINT AS i, range(0, (SELECT count(*) + 1 FROM nodes)) AS mark, 0 AS n, 0.0::DOUBLE AS weight
  UNION ALL SELECT s.i + 1, CASE WHEN mark[a + 1] = mark[b + 1] THEN mark ELSE list_transform(mark, lambda m: CASE WHEN m = mark[b + 1] THEN mark[a + 1] ELSE m END) END,
    n + CASE WHEN mark[a + 1] = mark[b + 1] THEN 0 ELSE 1 END, weight + CASE WHEN mark[a + 1] = mark[b + 1] THEN 0 ELSE w END
  FROM steps s JOIN ordered o ON o.i = s.i + 1)"""
SQL_FOREST = f"WITH RECURSIVE {_KRUSKAL} SELECT n::BIGINT AS n_edges, {R('weight', 4)} AS weight FROM steps ORDER BY i DESC LIMIT 1"


def _threshold(near):
    """The middle of the core distances."""
    return N.core_distances(near, CORE).agg(F.percentile("core", 0.5)).first()[0]


def density_cut(spark, d):
    """Flat clusters at the median core distance."""
    near = _exact(spark, d)
    return FO.density_cut(_ids(spark, d), _mutual(near), _threshold(near), CORE).select("id", "cluster_num")


SQL_DENSITY_CUT = f"""WITH RECURSIVE {_MUTUAL},
eps AS (SELECT quantile_cont(core, 0.5) AS eps FROM core),
link AS (SELECT u AS a, v AS b FROM mutual, eps WHERE w <= eps UNION ALL SELECT v, u FROM mutual, eps WHERE w <= eps),
reach(a, b) AS (SELECT id, id FROM e UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a AS id, min(b) AS root FROM reach GROUP BY 1),
kept AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS no FROM (SELECT root FROM comp GROUP BY 1 HAVING count(*) >= {CORE}))
SELECT id, CAST(coalesce(no, -1) AS INT) AS cluster_num FROM comp LEFT JOIN kept USING (root)"""


def density_hierarchy(spark, d):
    """F6d: clusters chosen from the hierarchy of a ladder of 16 thresholds."""
    forest = FO.spanning_forest(_mutual(_indexed(spark, d)))
    return FO.select_eom(*FO.density_tree(_ids(spark, d), forest, 16), CORE)[0]


def forest_validity(spark, d):
    """The given labels judged by the forest."""
    e = _emb(spark, d)
    labels = e.select(F.col("vec_id").cast("long").alias("id"), F.col("label").alias("cluster_num"))
    v = FO.validity(labels, FO.spanning_forest(_mutual(_indexed(spark, d))))
    return v.select("cluster_num", "n", rnd("sparseness", 6).alias("sparseness"), rnd("separation", 6).alias("separation"), rnd("validity", 6).alias("validity"))


def fuzzy_graph(spark, d):
    """The joined weights of all neighbour pairs."""
    return GL.fuzzy_graph(_exact(spark, d)).select("u", "v", rnd("weight", 6).alias("weight"))


SQL_FUZZY = f"""WITH RECURSIVE {_NEAR},
rows AS (SELECT id, list(dist ORDER BY rank) AS ds, coalesce(min(dist) FILTER (dist > 0), 0.0) AS rho, log2(count(*)) AS want FROM near GROUP BY 1),
halves AS (SELECT id, ds, rho, want, 0 AS step, 0.0::DOUBLE AS lo, greatest(list_max(ds) - rho, 1e-12) * 1000 AS hi FROM rows
  UNION ALL SELECT id, ds, rho, want, step + 1, CASE WHEN mass < want THEN s ELSE lo END, CASE WHEN mass < want THEN hi ELSE s END
  FROM (SELECT *, (lo + hi) / 2 AS s, list_sum(list_transform(ds, lambda x: exp(-greatest(0.0, x - rho) / ((lo + hi) / 2)))) AS mass FROM halves WHERE step < {GL.HALVINGS})),
solved AS (SELECT id, rho, (lo + hi) / 2 AS sigma FROM halves WHERE step = {GL.HALVINGS}),
directed AS (SELECT n.id, n.neighbor, exp(-greatest(0.0, dist - rho) / sigma) AS weight FROM near n JOIN solved USING (id)),
pairs AS (SELECT least(id, neighbor) AS u, greatest(id, neighbor) AS v, coalesce(max(weight) FILTER (id < neighbor), 0) AS a,
  coalesce(max(weight) FILTER (id > neighbor), 0) AS b FROM directed GROUP BY 1, 2)
SELECT u, v, {R('a + b - a * b', 6)} AS weight FROM pairs"""


def neighbor_layout(spark, d):
    """Two coordinates from the neighbour graph."""
    out, _ = GL.spectral_layout(_ids(spark, d), GL.fuzzy_graph(_indexed(spark, d)), 2)
    return out.select("id", rnd("p2_1", 6).alias("p2_1"), rnd("p2_2", 6).alias("p2_2"))


QUERIES = {
    "neighbors": (neighbors, None), "neighbors_all_cells": (neighbors_all_cells, SQL_NEIGHBORS),
    "mutual_reachability": (mutual_reachability, SQL_MUTUAL), "spanning_forest": (spanning_forest, SQL_FOREST),
    "density_cut": (density_cut, SQL_DENSITY_CUT), "density_hierarchy": (density_hierarchy, None),
    "forest_validity": (forest_validity, None), "fuzzy_graph": (fuzzy_graph, SQL_FUZZY), "neighbor_layout": (neighbor_layout, None),
}

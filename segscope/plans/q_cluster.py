"""Registered queries: clustering (F), quality (G), projection (P), the
segmentation plans, streaming KPIs (D6) and I/O (A).

Bindings: ``embeddings`` (64-dim vectors, ``label`` as the cluster and the
source of the initial centroids); ``part`` numeric features; ``documents``
for the text path; ``orders`` (all four semantic types) for the mixed path;
``events`` as a file stream.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from ..functions.columns import rnd
from ..operators import clean as C
from ..operators import cluster as CL
from ..operators import features as FE
from ..operators import project as PJ
from ..operators import quality as Q
from ..sources import io as IO
from ..streaming import kpis as S
from . import segmentation as SEG
from .sqlbits import EXACT, R


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _emb(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", "label", "embedding")


_E_SQL = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS (SELECT vec_id, label, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM e)"""


def assign_nearest(spark, d):
    e = _emb(spark, d)
    cents = CL.centroids_of(e, "embedding", "label")
    a = CL.assign(e, "embedding", cents, "cluster", dist_out="dist")
    return a.select("vec_id", "cluster", rnd("dist", 6).alias("dist"))


_ASSIGN1 = """c1 AS (SELECT label AS cl, i, AVG(v) AS m FROM u GROUP BY label, i),
d1 AS (SELECT u.vec_id, c1.cl, SUM((u.v - c1.m) * (u.v - c1.m)) AS d2 FROM u JOIN c1 USING (i) GROUP BY u.vec_id, c1.cl),
a1 AS (SELECT vec_id, CAST(ARG_MIN(cl, (d2, cl)) AS INTEGER) AS cluster, MIN(d2) AS dist FROM d1 GROUP BY vec_id)"""
SQL_ASSIGN_NEAREST = f"WITH {_E_SQL}, {_ASSIGN1} SELECT vec_id, cluster, {R('dist', 6)} AS dist FROM a1"


def lloyd_2steps(spark, d):
    e = _emb(spark, d)
    cents = CL.centroids_of(e, "embedding", "label")
    _, c2 = CL.lloyd_step(e, "embedding", cents)
    a2 = CL.assign(e, "embedding", c2, "cluster", dist_out="dist")
    return a2.select("vec_id", "cluster", rnd("dist", 6).alias("dist"))


SQL_LLOYD_2STEPS = f"""WITH {_E_SQL}, {_ASSIGN1},
c2 AS (SELECT a1.cluster AS cl, u.i, AVG(u.v) AS m FROM u JOIN a1 USING (vec_id) GROUP BY a1.cluster, u.i),
d2 AS (SELECT u.vec_id, c2.cl, SUM((u.v - c2.m) * (u.v - c2.m)) AS d2 FROM u JOIN c2 USING (i) GROUP BY u.vec_id, c2.cl)
SELECT vec_id, CAST(ARG_MIN(cl, (d2, cl)) AS INTEGER) AS cluster, {R('MIN(d2)', 6)} AS dist FROM d2 GROUP BY vec_id"""


def silhouette(spark, d):
    s = Q.silhouette(_emb(spark, d), "embedding", "label")
    return s.select("n", rnd("silhouette", 6).alias("silhouette"))


SQL_SILHOUETTE = f"""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND CAST(label AS VARCHAR) <> '-1'),
pd AS (SELECT a.vec_id, a.label AS la, b.label AS lb, list_distance(a.x, b.x) * list_distance(a.x, b.x) AS d2
       FROM e a JOIN e b ON a.vec_id <> b.vec_id),
m AS (SELECT vec_id, la, lb, AVG(d2) AS md FROM pd GROUP BY vec_id, la, lb),
ab AS (SELECT vec_id, MAX(CASE WHEN la = lb THEN md END) AS a, MIN(CASE WHEN la <> lb THEN md END) AS b FROM m GROUP BY vec_id),
s AS (SELECT CASE WHEN a IS NULL THEN 0.0 WHEN GREATEST(a, b) > 0 THEN (b - a) / GREATEST(a, b) ELSE 0.0 END AS s FROM ab)
SELECT COUNT(*) AS n, {R('AVG(s)', 6)} AS silhouette FROM s"""


def calinski_harabasz(spark, d):
    c = Q.calinski_harabasz(_emb(spark, d), "embedding", "label")
    return c.select("n", rnd("calinski_harabasz", 6).alias("calinski_harabasz"))


SQL_CALINSKI_HARABASZ = f"""WITH {_E_SQL},
c AS (SELECT label, i, AVG(v) AS m, COUNT(*) AS n FROM u GROUP BY label, i),
g AS (SELECT i, AVG(v) AS mu FROM u GROUP BY i),
w AS (SELECT SUM((u.v - c.m) * (u.v - c.m)) AS w FROM u JOIN c USING (label, i)),
b AS (SELECT SUM(c.n * (c.m - g.mu) * (c.m - g.mu)) AS b FROM c JOIN g USING (i)),
k AS (SELECT COUNT(DISTINCT label) AS k, COUNT(*) AS n FROM e)
SELECT k.n AS n, {R('b.b * (k.n - k.k) / (w.w * (k.k - 1))', 6)} AS calinski_harabasz FROM w, b, k"""


def davies_bouldin(spark, d):
    x = Q.davies_bouldin(_emb(spark, d), "embedding", "label")
    return x.select(rnd("davies_bouldin", 6).alias("davies_bouldin"), rnd("negated", 6).alias("negated"))


SQL_DAVIES_BOULDIN = f"""WITH {_E_SQL},
c AS (SELECT label, i, AVG(v) AS m FROM u GROUP BY label, i),
dist AS (SELECT u.vec_id, u.label, SQRT(SUM((u.v - c.m) * (u.v - c.m))) AS d FROM u JOIN c USING (label, i) GROUP BY u.vec_id, u.label),
s AS (SELECT label, AVG(d) AS s FROM dist GROUP BY label),
mm AS (SELECT c1.label AS l1, c2.label AS l2, SQRT(SUM((c1.m - c2.m) * (c1.m - c2.m))) AS m
       FROM c c1 JOIN c c2 ON c1.i = c2.i AND c1.label <> c2.label GROUP BY c1.label, c2.label),
r AS (SELECT mm.l1, MAX(CASE WHEN mm.m > 0 THEN (s1.s + s2.s) / mm.m ELSE 0 END) AS r
      FROM mm JOIN s s1 ON s1.label = mm.l1 JOIN s s2 ON s2.label = mm.l2 GROUP BY mm.l1)
SELECT {R('AVG(r)', 6)} AS davies_bouldin, {R('-AVG(r)', 6)} AS negated FROM r"""


def cluster_centres(spark, d):
    e = _emb(spark, d).select("label", F.col("embedding")[0].cast("double").alias("x1"),
                              F.col("embedding")[1].cast("double").alias("x2"))
    c = PJ.cluster_centres(e, "label", ["x1", "x2"])
    return c.select("label", rnd("x1", 6).alias("x1"), rnd("x2", 6).alias("x2"))


SQL_CLUSTER_CENTRES = f"""SELECT label, {R('QUANTILE_CONT(CAST(embedding[1] AS DOUBLE), 0.5)', 6)} AS x1,
  {R('QUANTILE_CONT(CAST(embedding[2] AS DOUBLE), 0.5)', 6)} AS x2 FROM embeddings WHERE label IS NOT NULL GROUP BY label"""


_LSEG = """CASE WHEN l_returnflag = 'A' THEN -1 WHEN l_returnflag = 'N' THEN 0 ELSE 1 END"""


def _lseg(spark, d):
    li = _t(spark, d, "lineitem")
    return li.select(F.when(F.col("l_returnflag") == "A", -1).when(F.col("l_returnflag") == "N", 0)
                     .otherwise(1).alias("cluster"))


def cluster_summary(spark, d):
    return CL.cluster_summary(_lseg(spark, d), "cluster")


SQL_CLUSTER_SUMMARY = f"""WITH s AS (SELECT {_LSEG} AS cluster FROM lineitem)
SELECT COUNT(DISTINCT CASE WHEN cluster <> -1 THEN cluster END) AS n_clusters,
  COUNT(CASE WHEN cluster = -1 THEN 1 END) AS noise_points,
  {R('AVG(CASE WHEN cluster = -1 THEN 1.0 ELSE 0.0 END) * 100', 6)} AS noise_pct FROM s"""


def summary_lines(spark, d):
    return CL.summary_lines(CL.cluster_summary(_lseg(spark, d), "cluster"))


SQL_SUMMARY_LINES = f"""WITH s AS (SELECT {_LSEG} AS cluster FROM lineitem),
t AS (SELECT COUNT(DISTINCT CASE WHEN cluster <> -1 THEN cluster END) AS n_clusters,
  COUNT(CASE WHEN cluster = -1 THEN 1 END) AS noise_points,
  {R('AVG(CASE WHEN cluster = -1 THEN 1.0 ELSE 0.0 END) * 100', 6)} AS noise_pct FROM s)
SELECT 1 AS ord, printf('clusters: %d', n_clusters) AS line FROM t
UNION ALL SELECT 2, printf('noise points: %d (%.1f%%)', noise_points, noise_pct) FROM t
UNION ALL SELECT 3, 'silhouette: N/A' FROM t"""


def _part_vec(spark, d):
    p = _t(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    z = FE.standardize(p, ["p_size", "p_retailprice"], suffix="_z")
    return VectorAssembler(inputCols=["p_size_z", "p_retailprice_z"], outputCol="features").transform(z)


def kmeans_sweep(spark, d):
    s = CL.k_sweep(_part_vec(spark, d), "features", range(2, 11), seed=42, metrics="all")
    return s.select("k", *[rnd(c, 6).alias(c) for c in s.columns if c != "k"])


def best_k_silhouette(spark, d):
    return CL.best_k_silhouette(CL.k_sweep(_part_vec(spark, d), "features", range(2, 11), seed=42))


def best_k_vote(spark, d):
    v = _part_vec(spark, d)
    return CL.best_k_vote(CL.k_sweep(v, "features", range(2, 11), seed=42, metrics="all"), v.count())


def kmeans_part(spark, d):
    lab, _ = CL.kmeans(_part_vec(spark, d), "features", 4, seed=42, n_init=3)
    return lab.select("p_partkey", "cluster")


def project_pca(spark, d):
    p = PJ.project(_emb(spark, d), "embedding", 2, prefix="p2_")
    return p.select("vec_id", "label", rnd("p2_1", 6).alias("p2_1"), rnd("p2_2", 6).alias("p2_2"))


def projection_table(spark, d):
    p = PJ.project(_emb(spark, d), "embedding", 3, prefix="p3_")
    return PJ.projection_table(p, 3, "label", ["vec_id"], prefix="p3_")


def text_segmentation(spark, d):
    r = SEG.text_segmentation(_t(spark, d, "documents"), "doc_id", ["text"], 2, 10)
    return r["result"].select("doc_id", "lang", "cluster_text", rnd("tsne_1", 6).alias("tsne_1"),
                              rnd("tsne_2", 6).alias("tsne_2"))


def numeric_segmentation(spark, d):
    r = SEG.numeric_segmentation(_t(spark, d, "part"), "p_partkey", ["p_size", "p_retailprice"], cell=0.25)
    return r["result"].select("p_partkey", "cluster_num")


def mixed_cluster(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus", "o_orderdate")
    types = {"o_totalprice": C.NUMERIC, "o_orderpriority": C.CATEGORICAL, "o_orderstatus": C.CATEGORICAL,
             "o_orderdate": C.DATE}
    r = SEG.mixed_cluster(o, "o_orderkey", types)
    return r["result"].select("o_orderkey", "cluster_mixed")


def _orders_mixed(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus", "o_orderdate")
    types = {"o_totalprice": C.NUMERIC, "o_orderpriority": C.CATEGORICAL, "o_orderstatus": C.CATEGORICAL,
             "o_orderdate": C.DATE}
    return o, types


def autoencoder_codes(spark, d):
    from ..operators.encoder import encode, fit_autoencoder
    o, types = _orders_mixed(spark, d)
    feats = SEG.mixed_features(o, "o_orderkey", types)
    model = fit_autoencoder(feats, "features", dim=32, epochs=50, batch=256, seed=42)
    enc = encode(feats, "features", model)
    return enc.select("o_orderkey", F.transform("encoded", lambda v: F.round(v, 6)).alias("code"))


def density_cluster(spark, d):
    from ..operators.density import density_cluster as dc
    p = _t(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    return dc(p, ["p_size", "p_retailprice"], cell=0.25, min_samples=5, min_cluster_size=5).select("p_partkey", "cluster_num")


SQL_DENSITY_CLUSTER = """
WITH RECURSIVE z AS (SELECT p_partkey, CAST(FLOOR((p_size - (SELECT AVG(p_size) FROM part)) / (SELECT STDDEV_POP(p_size) FROM part) / 0.25) AS BIGINT) AS x,
    CAST(FLOOR((p_retailprice - (SELECT AVG(p_retailprice) FROM part)) / (SELECT STDDEV_POP(p_retailprice) FROM part) / 0.25) AS BIGINT) AS y FROM part),
dense AS (SELECT x, y, COUNT(*) AS n, ROW_NUMBER() OVER (ORDER BY x, y) AS id FROM z GROUP BY x, y HAVING COUNT(*) >= 5),
step AS (SELECT a.id AS a, b.id AS b FROM dense a JOIN dense b ON ABS(a.x - b.x) + ABS(a.y - b.y) = 1),
reach(a, b) AS (SELECT id, id FROM dense UNION SELECT r.a, s.b FROM reach r JOIN step s ON r.b = s.a),
comp AS (SELECT a AS id, MIN(b) AS root FROM reach GROUP BY a),
kept AS (SELECT root, ROW_NUMBER() OVER (ORDER BY root) - 1 AS cid FROM comp JOIN dense USING (id) GROUP BY root HAVING SUM(n) >= 5)
SELECT p_partkey, CAST(COALESCE(cid, -1) AS INT) AS cluster_num FROM z LEFT JOIN dense USING (x, y) LEFT JOIN comp USING (id) LEFT JOIN kept USING (root)"""


def pca_axes(spark, d):
    """Variance of each axis and their covariance; on two features the axes
    are the principal ones just when these are the eigenvalues and 0."""
    p = FE.standardize(_t(spark, d, "part").select("p_size", "p_retailprice", (F.col("p_size") * F.col("p_retailprice")).alias("w")),
                       ["p_size", "w"], suffix="_z")
    v = VectorAssembler(inputCols=["p_size_z", "w_z"], outputCol="features").transform(p)
    x = PJ.project(v, "features", 2, prefix="a")
    return x.agg(rnd(F.var_pop("a1"), 6).alias("var_1"), rnd(F.var_pop("a2"), 6).alias("var_2"),
                 F.abs(rnd(F.covar_pop("a1", "a2"), 6)).alias("covariance"))


SQL_PCA_AXES = f"""WITH c AS (SELECT ABS(CORR(p_size, p_size * p_retailprice)) AS r FROM part)
SELECT {R('1 + r', 6)} AS var_1, {R('1 - r', 6)} AS var_2, 0.0::DOUBLE AS covariance FROM c"""


def density_summary(spark, d):
    from ..operators.density import density_cluster as dc
    p = _t(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    return CL.cluster_summary(dc(p, ["p_size", "p_retailprice"], cell=0.25, min_samples=5, min_cluster_size=5),
                              "cluster_num")


def _kpi_events(df):
    committed = (F.when(F.col("event_type") == "purchase", F.col("value") * 1.2)
                  .when(F.col("event_type") == "error", F.lit(0.0)).otherwise(F.col("value")))
    return df.select(F.col("value").alias("initial"), committed.alias("committed"))


def kpis_stream(spark, d):
    schema = _t(spark, d, "events").schema
    stream = S.file_stream(spark, d, "events.parquet", schema)
    res = S.kpis_stream(_kpi_events(stream), "initial", "committed")
    out = S.run_available(spark, res)
    return out.select("n_rows", "total_initial", "total_committed", rnd("mean_rate", 6).alias("mean_rate"),
                      "total_gap", "n_over")


_COMM = "CASE WHEN event_type = 'purchase' THEN value * 1.2 WHEN event_type = 'error' THEN 0.0 ELSE value END"
_I, _C = f"COALESCE({EXACT('value')}, 0)", f"COALESCE({EXACT(_COMM)}, 0)"
_RATE = f"(CASE WHEN {_I} > 0 THEN CAST({_C} AS DOUBLE) / CAST({_I} AS DOUBLE) * 100.0 ELSE 0.0 END)"
SQL_KPIS_STREAM = (f"SELECT COUNT(*) AS n_rows, CAST(SUM({_I}) AS DOUBLE) AS total_initial, "
                   f"CAST(SUM({_C}) AS DOUBLE) AS total_committed, "
                   f"{R(f'AVG(CASE WHEN {_I} > 0 THEN {_RATE} END)', 6)} AS mean_rate, "
                   f"CAST(SUM({_C} - {_I}) AS DOUBLE) AS total_gap, COUNT(CASE WHEN {_RATE} > 100 THEN 1 END) AS n_over "
                   f"FROM events")


def read_formats(spark, d):
    part = _t(spark, d, "part")
    out = None
    for fmt in ("csv", "json", "parquet"):
        path = IO.scratch_path(spark, f"part_{fmt}")
        IO.write_table(part, path, fmt)
        back = IO.read_table(spark, path, fmt)
        row = back.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("p_size").cast("long").alias("sum_size"),
                       F.count_distinct("p_name").alias("n_names")).withColumn("format", F.lit(fmt)) \
                  .withColumn("n_cols", F.lit(len(back.columns)))
        out = row if out is None else out.unionByName(row)
    return out


SQL_READ_FORMATS = " UNION ALL ".join(
    f"SELECT '{f}' AS format, COUNT(*) AS n_rows, CAST(SUM(p_size) AS BIGINT) AS sum_size, "
    f"COUNT(DISTINCT p_name) AS n_names, 6 AS n_cols FROM part" for f in ("csv", "json", "parquet"))


def book(spark, d):
    base = IO.scratch_path(spark, "book")
    IO.write_table(_t(spark, d, "region"), f"{base}/region.csv", "csv")
    IO.write_table(_t(spark, d, "nation"), f"{base}/nation.parquet", "parquet")
    b = IO.read_book(spark, base)
    rows = [b[name].agg(F.count(F.lit(1)).alias("n_rows")).withColumn("sheet", F.lit(name)) for name in sorted(b)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


SQL_BOOK = "SELECT 'nation' AS sheet, COUNT(*) AS n_rows FROM nation UNION ALL SELECT 'region', COUNT(*) FROM region"


QUERIES = {
    "assign_nearest": (assign_nearest, SQL_ASSIGN_NEAREST),
    "lloyd_2steps": (lloyd_2steps, SQL_LLOYD_2STEPS),
    "silhouette": (silhouette, SQL_SILHOUETTE),
    "calinski_harabasz": (calinski_harabasz, SQL_CALINSKI_HARABASZ),
    "davies_bouldin": (davies_bouldin, SQL_DAVIES_BOULDIN),
    "cluster_centres": (cluster_centres, SQL_CLUSTER_CENTRES),
    "cluster_summary": (cluster_summary, SQL_CLUSTER_SUMMARY),
    "summary_lines": (summary_lines, SQL_SUMMARY_LINES),
    "kmeans_sweep": (kmeans_sweep, None),
    "best_k_silhouette": (best_k_silhouette, None),
    "best_k_vote": (best_k_vote, None),
    "kmeans_part": (kmeans_part, None),
    "project_pca": (project_pca, None),
    "projection_table": (projection_table, None),
    "text_segmentation": (text_segmentation, None),
    "numeric_segmentation": (numeric_segmentation, None),
    "mixed_cluster": (mixed_cluster, None),
    "autoencoder_codes": (autoencoder_codes, None),
    "density_cluster": (density_cluster, SQL_DENSITY_CLUSTER),
    "pca_axes": (pca_axes, SQL_PCA_AXES),
    "density_summary": (density_summary, None),
    "kpis_stream": (kpis_stream, SQL_KPIS_STREAM),
    "read_formats": (read_formats, SQL_READ_FORMATS),
    "book": (book, SQL_BOOK),
}

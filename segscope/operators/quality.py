"""Cluster quality without pairwise distances.

Every score here is linear in the rows. A fitted set of per-cluster
aggregates (count, centroid, mean squared norm: k x d numbers, the model)
replaces the pairs:

* mean squared distance of x to the points of cluster C
  = ||x||^2 - 2 x.mu_C + mean_{y in C} ||y||^2,
  which gives the silhouette with squared Euclidean distance (own cluster
  without the point itself, singletons score 0, noise excluded);
* Calinski-Harabasz from the within and between dispersions;
* Davies-Bouldin from the mean distance of each cluster to its centroid and
  the centroid distances (k x k, computed from the model).

The silhouette with plain Euclidean distance has no such decomposition; it
needs every pair of points, so it is not offered.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def as_array(df: DataFrame, col: str, out: str = "_x") -> DataFrame:
    """Feature column as array<double> (vectors and float arrays accepted)."""
    dt = df.schema[col].dataType
    c = vector_to_array(F.col(col)) if isinstance(dt, VectorUDT) else F.col(col).cast("array<double>")
    return df.withColumn(out, c)


def _dot(x: Column, c: Column) -> Column:
    return F.aggregate(F.zip_with(x, c, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


def _sq(x: Column) -> Column:
    return F.aggregate(F.transform(x, lambda a: a * a), F.lit(0.0), lambda acc, v: acc + v)


def to_vector(df: DataFrame, col: str, out: str = "_v") -> DataFrame:
    """Feature column as an ML vector (arrays are converted; sparse vectors stay sparse)."""
    dt = df.schema[col].dataType
    c = F.col(col) if isinstance(dt, VectorUDT) else array_to_vector(F.col(col).cast("array<double>"))
    return df.withColumn(out, c)


def centroid_table(df: DataFrame, v: str, label: str) -> DataFrame:
    """Per cluster: n, centroid (array<double>) and mean squared norm, from
    vector summaries (partial aggregation, sparse-aware). Sum of squared norms
    = sum over dimensions of the squared column L2 norms."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), Summarizer.mean(F.col(v)).alias("_m"),
                              Summarizer.normL2(F.col(v)).alias("_l2"))
    l2 = vector_to_array("_l2")
    return g.select(label, "n", vector_to_array("_m").alias("centroid"),
                    (F.aggregate(F.transform(l2, lambda a: a * a), F.lit(0.0), lambda acc, x: acc + x)
                     / F.col("n")).alias("q"))


def fit_centroids(df: DataFrame, x: str, label: str) -> list[dict]:
    """Per cluster: label, n, centroid (list), mean squared norm; ordered by
    label. This is the fitted model itself (k x d numbers), read on the driver;
    scores that need sums only work on ``centroid_table``."""
    rows = centroid_table(to_vector(df, x), "_v", label).orderBy(label).collect()
    return [dict(label=r[label], n=r["n"], q=r["q"], centroid=list(r["centroid"])) for r in rows]


def _prep(df, features, label, noise):
    d = df.filter(F.col(label).isNotNull())
    if noise is not None:
        d = d.filter(F.col(label).cast("string") != F.lit(str(noise)))
    return to_vector(d, features)


def _one_row(spark, **vals) -> DataFrame:
    from pyspark.sql.types import DoubleType, LongType, StructField, StructType
    fields = [StructField(k, LongType() if isinstance(v, int) else DoubleType(), True) for k, v in vals.items()]
    return spark.createDataFrame([tuple(vals.values())], StructType(fields))


def silhouette(df: DataFrame, features: str, label: str, noise=-1) -> DataFrame:
    """Mean silhouette with squared Euclidean distance (own cluster without
    the point, singletons 0, noise excluded); NULL with < 2 clusters. Spark
    ML's evaluator computes exactly this from per-cluster sums, in the JVM."""
    d = _prep(df, features, label, noise)
    if not isinstance(d.schema[label].dataType, NumericType):
        from .features import label_mapping
        codes = label_mapping(d, label).select(F.col("value").alias("_value"), F.col("code").cast("double").alias("_lab"))
        d = d.join(codes, F.col(label).cast("string") == F.col("_value")).drop("_value")
    else:
        d = d.withColumn("_lab", F.col(label).cast("double"))
    lab = "_lab"
    st = d.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(lab).alias("k")).first()
    if st["k"] < 2:
        return _one_row(df.sparkSession, n=int(st["n"]), silhouette=None)
    ev = ClusteringEvaluator(featuresCol="_v", predictionCol=lab, metricName="silhouette",
                             distanceMeasure="squaredEuclidean")
    return _one_row(df.sparkSession, n=int(st["n"]), silhouette=float(ev.evaluate(d)))


def calinski_harabasz(df: DataFrame, features: str, label: str, noise=None) -> DataFrame:
    """(B / (k-1)) / (W / (n-k)); 1.0 when W = 0; NULL with < 2 clusters.
    W = sum_c n_c (q_c - ||mu_c||^2), B = sum_c n_c ||mu_c||^2 - n ||mu||^2:
    sums over the per-cluster table, which stays distributed for any k."""
    d = _prep(df, features, label, noise)
    sq = _sq(F.col("centroid"))
    s = centroid_table(d, "_v", label).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * sq).alias("b"),
                                           F.sum(F.col("n") * (F.col("q") - sq)).alias("w")).first()
    k, n = s["k"], s["n"] or 0
    if k < 2:
        return _one_row(df.sparkSession, n=int(n), calinski_harabasz=None)
    mu = d.agg(Summarizer.mean(F.col("_v")).alias("m")).first()["m"].toArray()
    B, W = max(0.0, s["b"] - n * float((mu ** 2).sum())), s["w"]
    ch = 1.0 if W <= 0 else B * (n - k) / (W * (k - 1))
    return _one_row(df.sparkSession, n=int(n), calinski_harabasz=float(ch))


def davies_bouldin(df: DataFrame, features: str, label: str, noise=None) -> DataFrame:
    """Mean over clusters of max_j (s_i + s_j) / ||mu_i - mu_j||, s = mean
    Euclidean distance to the own centroid (0 when centroids coincide).
    ``negated`` is the value used in the vote. The centroid table (k rows) is
    joined to the points; the k x k step runs on the model, row by row."""
    d = _prep(df, features, label, noise)
    t = centroid_table(d, "_v", label)
    k = t.count()
    if k < 2:
        return _one_row(df.sparkSession, davies_bouldin=None, negated=None)
    j = d.select(label, vector_to_array("_v").alias("_x")).join(t.select(label, "centroid"), label)
    dist = F.sqrt(F.aggregate(F.zip_with("_x", "centroid", lambda a, b: (a - b) * (a - b)), F.lit(0.0),
                              lambda acc, v: acc + v))
    s_rows = j.groupBy(label).agg(F.avg(dist).alias("s")).join(t.select(label, "centroid"), label).orderBy(label).collect()
    S = np.array([r["s"] for r in s_rows])
    C = np.array([list(r["centroid"]) for r in s_rows])
    worst = []
    for i in range(len(S)):
        m = np.sqrt(((C - C[i]) ** 2).sum(-1))
        r = np.where(m > 0, (S + S[i]) / np.where(m > 0, m, 1.0), 0.0)
        r[i] = -np.inf
        worst.append(r.max())
    db = float(np.mean(worst))
    return _one_row(df.sparkSession, davies_bouldin=db, negated=-db)


def scores(df: DataFrame, features: str, label: str) -> dict:
    """The three scores as plain numbers (for a k sweep)."""
    s = silhouette(df, features, label, noise=None).first()["silhouette"]
    ch = calinski_harabasz(df, features, label).first()["calinski_harabasz"]
    db = davies_bouldin(df, features, label).first()["davies_bouldin"]
    return {"silhouette": s, "calinski_harabasz": ch, "davies_bouldin": db,
            "neg_davies_bouldin": None if db is None or (isinstance(db, float) and math.isnan(db)) else -db}

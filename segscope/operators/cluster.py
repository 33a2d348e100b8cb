"""K-means, nearest-centroid assignment, k sweeps and the
choice of k, and cluster summaries.

A single k-means is Spark ML's (k-means|| initialisation, distributed Lloyd
steps); a sweep over k runs all its models together (``sweep``). Centroids are model state: at most k x d numbers, collected and reused as
literal arrays, so assignment is a narrow projection (no join, no pairs).
"""

from __future__ import annotations

import numpy as np

from pyspark.ml.clustering import KMeans
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import rnd
from .rank import ranked
from .quality import as_array, fit_centroids
from .sweep import DENSE_WIDTH, _nearness, blocks, sweep

UNCLASSIFIED = "unclassified"


def kmeans(df: DataFrame, features: str, k: int, seed: int = 42, n_init: int = 1, max_iter: int = 300,
           out: str = "cluster", tol: float = 1e-4):
    """best of ``n_init`` seeded runs by training cost; returns
    (labelled DataFrame, model). The fitted model is reused, never refitted."""
    best = None
    for i in range(max(1, n_init)):
        km = KMeans(k=k, seed=seed + i, maxIter=max_iter, tol=tol, featuresCol=features, predictionCol=out)
        m = km.fit(df)
        cost = m.summary.trainingCost
        if best is None or cost < best[0]:
            best = (cost, m)
    model = best[1]
    return model.transform(df), model


def _assign_fn(centroids, x_col: str, out: str, dist_out: str | None):
    C = np.asarray(centroids, dtype=np.float64)

    def run(batches):
        import pyarrow as pa
        for b in batches:
            if b.num_rows == 0:
                continue
            xs = b.column(b.schema.get_field_index(x_col))
            X = np.asarray(xs.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(b.num_rows, -1)
            D = np.stack([((X - c) ** 2).sum(1) for c in C], axis=1)
            lab = D.argmin(1).astype(np.int32)  # ties -> lowest index
            arrays = [b.column(i) for i in range(b.num_columns) if b.schema.names[i] != x_col]
            names = [n for n in b.schema.names if n != x_col]
            arrays.append(pa.array(lab))
            names.append(out)
            if dist_out:
                arrays.append(pa.array(D.min(1)))
                names.append(dist_out)
            yield pa.RecordBatch.from_arrays(arrays, names=names)
    return run


def _assign_wide_fn(centroids, x_col: str, out: str, dist_out: str | None):
    """The same for wide ML vectors, which are not written out."""
    C = np.asarray(centroids, dtype=np.float64)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        m, constant = _nearness(C)
        for b in batches:
            x = b.column(b.schema.get_field_index(x_col))
            size = pc.if_else(pc.equal(x.field("type"), 0), x.field("size"), pc.list_value_length(x.field("values")))
            fits = pc.and_(x.is_valid(), pc.fill_null(pc.equal(size, C.shape[1]), False)).to_numpy(zero_copy_only=False)
            lab, dist = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            parts = [(p.dot(m) + constant, p.squares) for p in blocks([b.filter(pa.array(fits))], x_col, C.shape[1], 1024)]
            if parts:
                lab[fits] = np.concatenate([d.argmin(1) for d, _ in parts])  # ties -> lowest index
                dist[fits] = np.concatenate([np.maximum(d.min(1) + q, 0.0) for d, q in parts])
            arrays, names = [*b.columns, pa.array(lab, mask=~fits)], [*b.schema.names, out]
            if dist_out:
                arrays.append(pa.array(dist, mask=~fits))
                names.append(dist_out)
            yield pa.RecordBatch.from_arrays(arrays, names=names)
    return run


def assign(df: DataFrame, features: str, centroids: list[list[float]], out: str = "cluster",
           dist_out: str | None = None) -> DataFrame:
    """nearest centroid (squared Euclidean; ties -> lowest index). The
    centroids (k x d, bounded model state) travel with the task closure; each
    Arrow batch is a numpy block, so there is no join and no pair."""
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType
    if isinstance(df.schema[features].dataType, VectorUDT) and len(centroids[0]) > DENSE_WIDTH:
        new = [StructField(out, IntegerType()), *([StructField(dist_out, DoubleType())] if dist_out else [])]
        return df.mapInArrow(_assign_wide_fn(centroids, features, out, dist_out), StructType([*df.schema.fields, *new]))
    d = as_array(df, features)
    if d.schema["_x"].dataType.containsNull:
        d = d.withColumn("_x", F.transform("_x", lambda v: F.coalesce(v, F.lit(0.0))))
    # a missing vector, or one of another length, gets no label
    fits = F.coalesce(F.size("_x") == len(centroids[0]), F.lit(False))
    d = d.withColumn("_fits", fits).withColumn("_x", F.when(fits, F.col("_x")).otherwise(F.array_repeat(F.lit(0.0), len(centroids[0]))))
    fields = [f for f in d.schema.fields if f.name != "_x"] + [StructField(out, IntegerType(), False)]
    if dist_out:
        fields.append(StructField(dist_out, DoubleType(), False))
    a = d.mapInArrow(_assign_fn(centroids, "_x", out, dist_out), StructType(fields))
    return a.withColumns({c: F.when(F.col("_fits"), F.col(c)) for c in (out, dist_out) if c}).drop("_fits")


def centroids_of(df: DataFrame, features: str, label: str) -> list[list[float]]:
    """Mean vector per label, ordered by label (bounded model state)."""
    m = fit_centroids(as_array(df, features), "_x", label)
    return [c["centroid"] for c in m]


def lloyd_step(df: DataFrame, features: str, centroids: list[list[float]], out: str = "cluster"):
    """One Lloyd iteration: assign, then the new centroids (empty clusters keep
    their old centroid). Returns (assigned DataFrame, new centroids)."""
    a = assign(df, features, centroids, out)
    model = {m["label"]: m["centroid"] for m in fit_centroids(as_array(a.filter(F.col(out).isNotNull()), features), "_x", out)}
    new = [model.get(i, c) for i, c in enumerate(centroids)]
    return a, new


def k_sweep(df: DataFrame, features: str, ks, seed: int = 42, n_init: int = 1, metrics: str = "silhouette") -> DataFrame:
    """for each k, SSE (training cost) and scores. ``metrics`` is
    'silhouette' (text path) or 'all' (silhouette, Calinski-Harabasz, negated
    Davies-Bouldin: mixed path). All models advance together (``sweep``)."""
    return sweep_models(df, features, ks, seed, n_init, metrics)[0]


def sweep_models(df: DataFrame, features: str, ks, seed: int = 42, n_init: int = 1, metrics: str = "silhouette"):
    """F3 with the fitted centroids: (table of scores, {k: centroids}). With 'all', k is from 2 to n - 1."""
    if metrics == "all":
        ks = [k for k in ks if k >= 2]
    best, n = sweep(df, features, ks, seed, n_init)
    if metrics == "all":
        best = {k: m for k, m in best.items() if k <= n - 1}
    rows = []
    for k, m in sorted(best.items()):
        if k < 2 or n < k:
            m.scores["silhouette"] = -1.0
        rows.append((k, m.sse, *[m.scores[c] for c in (_METRICS if metrics == "all" else _METRICS[:1])]))
    schema = "k int, sse double, silhouette double" + (", calinski_harabasz double, neg_davies_bouldin double" if metrics == "all" else "")
    return df.sparkSession.createDataFrame(rows, schema), {k: m.centroids.tolist() for k, m in best.items()}


def best_k_silhouette(sweep: DataFrame, min_k: int = 2) -> DataFrame:
    """the k with the highest silhouette above -1 (first on ties); when no
    score beats -1, max(min_k, 2)."""
    cand = sweep.filter(F.col("silhouette") > -1)
    best = cand.agg(F.min_by("k", F.struct((-F.col("silhouette")).alias("s"), F.col("k"))).alias("k"))
    return best.select(F.coalesce(F.col("k"), F.lit(max(min_k, 2))).alias("best_k"))


_METRICS = ["silhouette", "calinski_harabasz", "neg_davies_bouldin"]


def best_k_vote(sweep: DataFrame, n_rows: int | None = None) -> DataFrame:
    """each metric votes for its best k (first k on ties); the k with most
    votes wins, ties going to the earliest metric's vote; 2 when nothing
    voted; 1 when n_rows <= 2."""
    if n_rows is not None and min(100, n_rows - 1) < 2:
        return sweep.sparkSession.range(1).select(F.lit(1).alias("best_k"))
    votes = None
    for order, m in enumerate(_METRICS):
        v = (sweep.filter(F.col(m).isNotNull())
                  .agg(F.min_by("k", F.struct((-F.col(m)).alias("s"), F.col("k"))).alias("k"))
                  .withColumn("metric_order", F.lit(order)))
        votes = v if votes is None else votes.unionByName(v)
    votes = votes.filter(F.col("k").isNotNull())
    tally = votes.groupBy("k").agg(F.count(F.lit(1)).alias("votes"), F.min("metric_order").alias("first"))
    best = tally.agg(F.min_by("k", F.struct((-F.col("votes")).alias("v"), F.col("first"))).alias("k"))
    return best.select(F.coalesce(F.col("k"), F.lit(2)).alias("best_k"))


def label_unclassified(df: DataFrame, out: str = "cluster_mixed") -> DataFrame:
    """F8: too few rows for clusters: every row is 'unclassified'."""
    return df.withColumn(out, F.lit(UNCLASSIFIED))


def cluster_summary(df: DataFrame, label: str, noise=-1) -> DataFrame:
    """clusters without noise, noise rows and noise %."""
    is_noise = F.col(label).cast("string") == F.lit(str(noise))
    return df.agg(F.count_distinct(F.when(~is_noise, F.col(label))).alias("n_clusters"),
                  F.count(F.when(is_noise, 1)).alias("noise_points"),
                  rnd(F.avg(F.when(is_noise, 1.0).otherwise(0.0)) * 100, 6).alias("noise_pct"))


def summary_lines(summary: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """human-readable lines; scores show 'N/A' under 2 clusters."""
    s = summary
    if quality is not None:
        from .pareto import zip_rows
        s = zip_rows(summary, quality.select("silhouette"))
    else:
        s = s.withColumn("silhouette", F.lit(None).cast("double"))
    sil = F.when((F.col("n_clusters") >= 2) & F.col("silhouette").isNotNull(),
                 F.format_string("%.3f", F.col("silhouette")))
    rows = F.array(
        F.struct(F.lit(1).alias("ord"), F.format_string("clusters: %d", F.col("n_clusters")).alias("line")),
        F.struct(F.lit(2).alias("ord"), F.format_string("noise points: %d (%.1f%%)", F.col("noise_points"),
                                                         F.col("noise_pct")).alias("line")),
        F.struct(F.lit(3).alias("ord"), F.concat(F.lit("silhouette: "), F.coalesce(sil, F.lit("N/A"))).alias("line")))
    return s.select(F.inline(rows))


def order_clusters(df: DataFrame, label: str) -> DataFrame:
    """ord = numeric order of the cluster labels with noise (-1) last."""
    g = df.select(label).distinct()
    g = g.withColumns({"_noise": F.col(label).cast("long") == -1, "_label": F.col(label).cast("long")})
    r = ranked(g, [("_noise", True), ("_label", True)])
    return r.withColumn("ord", F.col("_rank").cast("int")).drop("_noise", "_label", "_rank", "_n")

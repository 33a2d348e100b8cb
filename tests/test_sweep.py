"""Many k-means models in one scan against single fits and plain loops."""
import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from segscope.operators import cluster as CL
from segscope.operators import quality as Q
from segscope.operators import sweep as S

RNG = np.random.default_rng(3)
ROWS = np.vstack([RNG.normal([0, 0, 0], 1, (60, 3)), RNG.normal([8, 0, 2], 1, (50, 3)), RNG.normal([0, 9, -5], 1, (40, 3))])


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(ROWS)], "id int, x array<double>").repartition(5).cache()


def lloyd(rows, c, max_iter=300, tol=1e-4):
    """One model, row by row."""
    c = c.copy()
    for _ in range(max_iter):
        label = np.array([((r - c) ** 2).sum(1).argmin() for r in rows])
        new = np.array([rows[label == j].mean(0) if (label == j).any() else c[j] for j in range(len(c))])
        moved, c = ((new - c) ** 2).sum(), new
        if moved <= tol * rows.var(0).mean():
            break
    return c, sum(((r - c) ** 2).sum(1).min() for r in rows)


def test_models_together_equal_single_fits(data):
    rows = S.start_rows(data, "x", 3, 42)
    assert len(rows) == len(ROWS)
    models = {(k, i): S.plus_plus(rows, 8, 42 + i)[:k] for k in range(2, 9) for i in range(3)}
    together = S.lloyd_together(data, "x", 3, models)
    assert sorted(together) == sorted(models)
    for key, start in models.items():
        c, cost = lloyd(ROWS, start)
        assert np.allclose(together[key].centroids, c) and together[key].sse == pytest.approx(cost)
    for key in ((2, 0), (5, 1), (8, 2)):
        alone = S.lloyd_together(data, "x", 3, {key: models[key]})[key]
        assert np.allclose(alone.centroids, together[key].centroids) and alone.rounds == together[key].rounds
    assert len({m.rounds for m in together.values()}) > 1  # finished models leave


def test_scores_equal_the_single_scores(data):
    best, n = S.sweep(data, "x", range(2, 7), n_init=3)
    assert n == len(ROWS) and sorted(best) == [2, 3, 4, 5, 6]
    for k in (2, 3, 6):
        lab = CL.assign(data, "x", best[k].centroids.tolist())
        assert best[k].scores["silhouette"] == pytest.approx(Q.silhouette(lab, "x", "cluster", noise=None).first()["silhouette"])
        assert best[k].scores["calinski_harabasz"] == pytest.approx(Q.calinski_harabasz(lab, "x", "cluster").first()["calinski_harabasz"])
        assert best[k].scores["neg_davies_bouldin"] == pytest.approx(Q.davies_bouldin(lab, "x", "cluster").first()["negated"])
    assert CL.best_k_vote(CL.k_sweep(data, "x", range(2, 7), n_init=3, metrics="all"), n).first()["best_k"] == 3


def test_cost_is_near_that_of_the_single_k_means(data):
    best, _ = S.sweep(data, "x", range(2, 7), n_init=5)
    for k in (2, 3, 5):
        _, model = CL.kmeans(data.withColumn("v", array_to_vector("x")), "v", k, n_init=5)
        assert best[k].sse <= 1.1 * model.summary.trainingCost


def test_sparse_and_wide_vectors(data, spark):
    dense, _ = S.sweep(data, "x", [2, 4], n_init=2)
    vectors = data.select(array_to_vector("x").alias("x"))
    same, _ = S.sweep(vectors, "x", [2, 4], n_init=2)
    from pyspark.ml.linalg import SparseVector, VectorUDT
    from pyspark.sql.types import StructField, StructType
    wide = [SparseVector(1000, {7 * j: float(v) for j, v in enumerate(r)}) for r in ROWS]
    sparse = spark.createDataFrame([(v,) for v in wide], StructType([StructField("x", VectorUDT())])).repartition(4)
    rows = S.start_rows(sparse, "x", 1000, 42)
    got = S.lloyd_together(sparse, "x", 1000, {(3, 0): S.plus_plus(rows, 3, 1)})[3, 0]
    c, cost = lloyd(ROWS, S.plus_plus(rows, 3, 1)[:, [0, 7, 14]])
    assert np.allclose(got.centroids[:, [0, 7, 14]], c) and got.sse == pytest.approx(cost)
    for k in (2, 4):  # other starts, as a vector hashes otherwise than an array
        assert dense[k].sse == pytest.approx(same[k].sse, rel=0.2)


def test_blocks_by_place_and_written_out(monkeypatch):
    m, label = RNG.normal(size=(9, 4)), RNG.integers(0, 4, (30, 2))
    full = np.where(RNG.random((30, 9)) < 0.3, RNG.normal(size=(30, 9)), 0.0)
    start = np.concatenate([[0], np.cumsum((full != 0).sum(1))])
    place, value = np.nonzero(full)[1], full[full != 0]
    for width in (1, 256):
        monkeypatch.setattr(S, "DENSE_WIDTH", width)
        x = S.Block(start, place, value, 9)
        assert (x.dense is None) == (width == 1)
        assert np.allclose(x.dot(m), full @ m) and np.allclose(x.squares, (full ** 2).sum(1))
        assert np.allclose(x.add(label, 4), [sum(full[i] for i in range(30) for s in range(2) if label[i, s] == g) for g in range(4)])


def test_waves_give_the_same(data, monkeypatch):
    whole, _ = S.sweep(data, "x", range(1, 6), n_init=2)
    monkeypatch.setattr(S, "WAVE_NUMBERS", 20)
    parts, _ = S.sweep(data, "x", range(1, 6), n_init=2)
    for k in whole:
        assert np.allclose(whole[k].centroids, parts[k].centroids)


def test_repeated_missing_and_few_rows(spark):
    rows = [(i, [1.0, 2.0]) for i in range(50)] + [(60, None), (61, [5.0, 5.0]), (62, None), (63, [5.0, 6.0])]
    df = spark.createDataFrame(rows, "id int, x array<double>")
    best, n = S.sweep(df, "x", range(1, 6))
    assert n == 52 and len(best[5].centroids) == 3 and best[5].sse == pytest.approx(0) and best[2].sse == pytest.approx(0.5)
    assert best[2].scores["silhouette"] > 0.9
    one, _ = S.sweep(spark.createDataFrame([(1, [3.0])] * 4, "id int, x array<double>"), "x", [2])
    assert one[2].scores["silhouette"] is None and one[2].sse == 0
    assert S.sweep(df.limit(0), "x", [2, 3]) == ({}, 0)
    few = {r["k"]: r["silhouette"] for r in CL.k_sweep(df.where(F.col("id") > 60), "x", range(1, 4)).collect()}
    assert few[1] == -1.0 and few[3] == -1.0 and few[2] == pytest.approx(0.0)


def test_nothing_is_left_behind(spark, data):
    from segscope.session import checkpoint_dir
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(checkpoint_dir(spark))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    S.sweep(data, "x", [2])
    assert not [f for f in fs.listStatus(path) if "k-sweep" in f.getPath().getName()]

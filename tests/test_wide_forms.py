"""Subspace axes, dictionaries as tables, estimated types, pages by key, sketch quantiles."""
import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from segscope.operators import clean as C
from segscope.operators import features as FE
from segscope.operators import profile as H
from segscope.operators import project as PJ
from segscope.operators import quality as Q
from segscope.operators import stats as ST
from segscope.operators import view as V

RNG = np.random.default_rng(2)


def test_subspace_axes_are_those_of_full_pca(spark):
    """64 dimensions: variance within 1 % of full PCA, and the same coordinates up to that."""
    x = RNG.normal(size=(600, 64)) * np.concatenate([[5, 4], np.linspace(2, 0.5, 62)]) @ np.linalg.qr(RNG.normal(size=(64, 64)))[0] + 3
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, x array<double>").repartition(4)
    _, axes, values = PJ.subspace_axes(df, "x", 3)
    want = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1][:3]
    assert np.all(values >= 0.99 * want) and np.all(values <= want * (1 + 1e-9))
    assert np.allclose(axes.T @ axes, np.eye(3), atol=1e-9)
    a = PJ.project(df, "x", 2, method="random_pca").orderBy("id").collect()
    b = PJ.project(df, "x", 2).orderBy("id").collect()
    assert abs(np.corrcoef([r["p2_1"] for r in a], [r["p2_1"] for r in b])[0, 1]) > 0.999
    assert np.var([r["p2_1"] for r in a]) == pytest.approx(values[0], rel=1e-6)


def test_subspace_axes_of_the_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    x = np.array([r["embedding"] for r in df.collect()], float)
    _, _, values = PJ.subspace_axes(df, "embedding", 2)
    assert values.sum() >= 0.99 * np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1][:2].sum()


def test_subspace_on_sparse_vectors(spark):
    from pyspark.ml.linalg import SparseVector, VectorUDT
    from pyspark.sql.types import LongType, StructField, StructType
    dense = np.where(RNG.random((200, 500)) < 0.02, RNG.random((200, 500)), 0.0)
    dense[:, 7] += 3 * RNG.random(200)
    rows = [(i, SparseVector(500, [(j, v) for j, v in enumerate(r) if v])) for i, r in enumerate(dense.tolist())]
    df = spark.createDataFrame([*rows, (999, None)], StructType([StructField("id", LongType()), StructField("v", VectorUDT())])).repartition(3)
    mean, axes, values = PJ.subspace_axes(df, "v", 2)
    want = np.linalg.eigvalsh(np.cov(dense.T, bias=True))[::-1][:2]
    assert np.allclose(mean, dense.mean(0)) and values[0] == pytest.approx(want[0], rel=0.01) and axes[7, 0] > 0.9
    got = {r["id"]: r["p2_1"] for r in PJ.project(df, "v", 2, method="random_pca").collect()}
    assert got[999] is None and got[0] == pytest.approx(float((dense[0] - mean) @ axes[:, 0]))


def test_one_hot_and_silhouette_without_collected_dictionaries(spark):
    df = spark.createDataFrame([(1, "b", "x"), (2, None, "y"), (3, "a", None), (4, "c", "x")], "id int, p string, q string")
    got = {r["id"]: r["o"] for r in FE.one_hot_vectors(df, ["p", "q"], "o").withColumn("o", vector_to_array("o")).collect()}
    assert got == {1: [0, 1, 0, 1, 0], 2: [0, 0, 0, 0, 1], 3: [1, 0, 0, 0, 0], 4: [0, 0, 1, 1, 0]}
    empty = FE.one_hot_vectors(df.withColumn("p", F.lit(None).cast("string")), ["p"], "o").withColumn("o", vector_to_array("o"))
    assert all(r["o"] == [0.0] for r in empty.collect())
    pts = spark.createDataFrame([("one", [0.0, 0.0]), ("one", [0.0, 1.0]), ("two", [5.0, 5.0]), ("two", [5.0, 6.0]), (None, [9.0, 9.0])], "label string, x array<double>")
    want = sum(1 - 1 / b for b in (55.5, 45.5, 45.5, 55.5)) / 4
    assert Q.silhouette(pts, "x", "label").first()["silhouette"] == pytest.approx(want)


def test_types_near_the_limit_are_counted(spark):
    rows = [(f"{i % 99}", f"{i % 101}", f"{i}", f"{i % 3}", None) for i in range(1000)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string")
    assert [r["type"] for r in C.detect_types(df).orderBy("pos").collect()] == [C.CATEGORICAL, C.TEXT, C.TEXT, C.CATEGORICAL, C.CATEGORICAL]
    assert [r["type"] for r in C.detect_types(df.limit(0)).orderBy("pos").collect()] == [C.TEXT] * 5
    vary = H.varying_columns(df.withColumn("k", F.lit(1)), counted=True)
    assert {r["column"]: r["n_distinct"] for r in vary.collect()} == {"a": 99, "b": 101, "c": 1000, "d": 3}
    assert [r["column"] for r in H.varying_columns(df).collect()] == ["a", "b", "c", "d"]


@pytest.mark.parametrize("first_up", [True, False])
def test_pages_by_key_walk_through_all_rows(spark, first_up):
    rows = [(i, None if i % 7 == 0 else i % 5) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, g int").repartition(4)
    want = [r["id"] for r in df.orderBy(F.col("g").asc() if first_up else F.col("g").desc(), "id").collect()]
    seen, after = [], None
    while True:
        page = V.page_after(df, [("g", first_up)], ["id"], after, 7).collect()
        if not page:
            break
        seen += [r["id"] for r in page]
        after = page[-1].asDict()
    assert seen == want


@pytest.mark.parametrize("n", [1, 2, 3, 6, 10, 1999, 20_000])
def test_quantiles_of_every_size(spark, n):
    """Around and far beyond the sketch's accuracy; groups, ties, missing values, infinities."""
    v = np.round(RNG.normal(size=n), 2 if n % 2 else 9)
    rows = [(i % 3 if i % 11 else None, None if i % 17 == 5 else float("nan") if i % 17 == 6 else float(x)) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(3)
    probs = {"a": 0.0, "q1": 0.25, "m": 0.5, "q9": 0.999, "z": 1.0}
    got = {r["g"]: [r[p] for p in probs] for r in ST.group_quantiles(df, ["g"], "v", probs).collect()}
    want = {}
    for g in {g for g, _ in rows}:
        mine = [x for h, x in rows if h == g and x is not None and x == x]
        if mine:
            want[g] = [float(np.quantile(mine, q)) for q in probs.values()]
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g], abs=1e-12) for g in got)


def test_quantiles_of_infinities_and_constants(spark):
    df = spark.createDataFrame([(float("inf"), 4.0)] * 3 + [(1.0, 4.0)] * 4 + [(float("-inf"), None)], "a double, b double")
    assert ST.column_quantiles(df, ["a", "b"], 0.5) == {"a": 1.0, "b": 4.0}
    assert ST.column_quantiles(df.limit(0), ["a"], 0.5) == {"a": None} and ST.column_quantiles(df, [], 0.5) == {}

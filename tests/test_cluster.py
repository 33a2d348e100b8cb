import pytest
from pyspark.ml.feature import VectorAssembler

from segscope.operators import cluster as CL
from segscope.operators import quality as Q


@pytest.fixture(scope="module")
def blobs(spark):
    rows = [(1, 0.0, 0.0, 0), (2, 0.0, 1.0, 0), (3, 5.0, 5.0, 1), (4, 5.0, 6.0, 1)]
    d = spark.createDataFrame(rows, "id int, a double, b double, label int")
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(d)


def test_scores(blobs):
    # squared Euclidean silhouette: a = 1; b = 55.5 or 45.5 per point
    s = Q.silhouette(blobs, "features", "label").first()["silhouette"]
    expect = sum(1 - 1 / b for b in (55.5, 45.5, 45.5, 55.5)) / 4
    assert s == pytest.approx(expect)
    assert Q.calinski_harabasz(blobs, "features", "label").first()["calinski_harabasz"] == pytest.approx(100.0)
    assert Q.davies_bouldin(blobs, "features", "label").first()["davies_bouldin"] == pytest.approx(0.141421, abs=1e-6)


def test_single_cluster_scores_missing(spark, blobs):
    one = blobs.filter("label = 0")
    assert Q.silhouette(one, "features", "label").first()["silhouette"] is None


def test_kmeans_recovers_blobs(blobs):
    lab, model = CL.kmeans(blobs, "features", 2, seed=42, n_init=2)
    got = {r["id"]: r["cluster"] for r in lab.collect()}
    assert got[1] == got[2] and got[3] == got[4] and got[1] != got[3]


def test_assign_and_lloyd(blobs):
    a = CL.assign(blobs, "features", [[0.0, 0.5], [5.0, 5.5]], dist_out="d")
    assert {r["id"]: r["cluster"] for r in a.collect()} == {1: 0, 2: 0, 3: 1, 4: 1}
    _, new = CL.lloyd_step(blobs, "features", [[0.0, 0.0], [5.0, 5.0]])
    assert new == [[0.0, 0.5], [5.0, 5.5]]


def _sweep(spark, s, c, d):
    return spark.createDataFrame([(2, 1.0, s[0], c[0], d[0]), (3, 1.0, s[1], c[1], d[1]), (4, 1.0, s[2], c[2], d[2])],
                                 "k int, sse double, silhouette double, calinski_harabasz double, neg_davies_bouldin double")


def test_best_k_vote(spark):
    sw = _sweep(spark, [0.9, 0.5, 0.1], [1.0, 9.0, 2.0], [-5.0, -1.0, -3.0])  # best at 2, 3, 3
    assert CL.best_k_vote(sw).first()["best_k"] == 3
    sw = _sweep(spark, [0.9, 0.5, 0.1], [1.0, 9.0, 2.0], [-5.0, -3.0, -1.0])  # best at 2, 3, 4 -> first metric
    assert CL.best_k_vote(sw).first()["best_k"] == 2
    assert CL.best_k_vote(sw, n_rows=2).first()["best_k"] == 1


def test_best_k_silhouette(spark):
    sw = _sweep(spark, [0.4, 0.6, 0.6], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0])
    assert CL.best_k_silhouette(sw).first()["best_k"] == 3
    sw = _sweep(spark, [-1.0, -1.0, -1.0], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0])
    assert CL.best_k_silhouette(sw, 3).first()["best_k"] == 3


def test_density_cluster_recovers_blobs(spark):
    import numpy as np
    from collections import Counter
    from segscope.operators.density import density_cluster
    rng = np.random.default_rng(0)
    pts = np.vstack([rng.normal([0, 0], 0.3, size=(150, 2)), rng.normal([6, 6], 0.3, size=(150, 2))])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "id int, x double, y double")
    got = {r["id"]: r["cluster_num"] for r in density_cluster(df, ["x", "y"], 0.25, 3, 20).collect()}
    a = Counter(got[i] for i in range(150)).most_common(1)[0]
    b = Counter(got[i] for i in range(150, 300)).most_common(1)[0]
    assert a[0] != b[0] and a[0] >= 0 and b[0] >= 0
    assert a[1] >= 135 and b[1] >= 135


def test_autoencoder_loss_falls(spark):
    import numpy as np
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F
    from segscope.operators.encoder import encode, fit_autoencoder
    rng = np.random.default_rng(1)
    base = rng.normal(size=(400, 2))
    X = np.hstack([base, base @ rng.normal(size=(2, 6))]) + 0.01 * rng.normal(size=(400, 8))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(X)], "id int, x array<double>")
    df = df.withColumn("features", array_to_vector("x")).repartition(4)
    m = fit_autoencoder(df, "features", dim=2, epochs=8, batch=32, lr=1e-2)
    assert m["dim"] == 2 and m["history"][-1] < m["history"][0]
    enc = encode(df, "features", m)
    assert enc.count() == 400 and len(enc.first()["encoded"]) == 2


def test_density_long_line_and_ten_features(spark):
    from segscope.operators.density import density_cluster
    line = spark.range(2000 * 5).selectExpr("id", "cast(id div 5 as double) as x", "0.0 + (id % 2) as y")
    got = density_cluster(line, ["x"], cell=1.7320508 / 2000 * 2, min_samples=2, min_cluster_size=5)
    assert got.select("cluster_num").distinct().count() == 1
    many = spark.range(400).selectExpr("id", *[f"cast((id % 2) * 50 + rand({i}) * 0.01 as double) as f{i}" for i in range(10)])
    got = density_cluster(many, [f"f{i}" for i in range(10)], cell=1.0, min_samples=3, min_cluster_size=20)
    assert got.groupBy((got.id % 2).alias("g")).agg({"cluster_num": "max"}).distinct().count() == 2


def test_sweep_has_one_cluster_and_missing_vectors_have_no_label(spark):
    from segscope.operators.cluster import assign, k_sweep
    df = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(30)], "id int, x array<double>")
    rows = {r["k"]: r for r in k_sweep(_vec(df), "v", range(1, 4)).collect()}
    assert sorted(rows) == [1, 2, 3] and rows[1]["silhouette"] == -1.0 and abs(rows[1]["sse"] - 20.0) < 1e-9
    odd = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [5.0, 5.0]), (4, [1.0])], "id int, x array<double>")
    got = {r["id"]: (r["cluster"], r["dist"]) for r in assign(odd, "x", [[0.0, 0.0], [5.0, 4.0]], dist_out="dist").collect()}
    assert got == {1: (0, 0.0), 2: (None, None), 3: (1, 1.0), 4: (None, None)}


def _vec(df):
    from pyspark.ml.functions import array_to_vector
    return df.withColumn("v", array_to_vector("x"))


def test_mixed_features_take_bad_numbers_and_dates(spark):
    from segscope.operators import clean as C
    from segscope.plans.segmentation import mixed_features
    df = spark.createDataFrame([(1, "3.5", "2024-01-01"), (2, "x", "not a date"), (3, None, None), (4, "1.5", "2024-02-30")],
                               "id int, n string, d string")
    got = mixed_features(df, "id", {"n": C.NUMERIC, "d": C.DATE}).collect()
    assert len(got) == 4 and all(len(r["features"]) == 5 for r in got)


def test_registered_feature_type(spark):
    from pyspark.sql import functions as F
    from segscope.operators import clean as C
    from segscope.plans import segmentation as S
    df = spark.createDataFrame([(1, "abc", 2.0), (2, None, 4.0)], "id int, code string, n double")
    S.register_type("length", lambda d, c: (d.withColumn(f"_{c}_len", F.coalesce(F.length(c), F.lit(0)).cast("double")), [f"_{c}_len"]))
    try:
        got = {r["id"]: r["features"].toArray().tolist() for r in S.mixed_features(df, "id", {"code": "length", "n": C.NUMERIC}).collect()}
    finally:
        S.unregister_type("length")
    assert got == {1: [3.0, -1.0], 2: [0.0, 1.0]}


def test_mixed_cluster_query_sweeps_as_the_operator_does(spark, monkeypatch):
    import inspect
    from segscope.plans import q_cluster
    from segscope.plans import segmentation as SEG
    signature, seen = inspect.signature(SEG.mixed_cluster), []

    def spy(df, *args, **options):
        call = signature.bind(df, *args, **options)
        call.apply_defaults()
        seen.append((call.arguments["k_max"], call.arguments["n_init"]))
        return {"result": df.withColumn("cluster_mixed", df[args[0]])}

    monkeypatch.setattr(SEG, "mixed_cluster", spy)
    q_cluster.mixed_cluster(spark, "/root/testdata/sf0.001")
    assert seen == [(100, 10)]

"""Pareto family on the literal fixture (cluster A: 50, 10; cluster B: 30, 10)."""
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from segscope.operators import pareto as P
from segscope.operators.rank import average_rank


@pytest.fixture(scope="module")
def data(spark):
    rows = [(1, "A", Decimal("50.00")), (2, "A", Decimal("10.00")), (3, "B", Decimal("30.00")), (4, "B", Decimal("10.00"))]
    return spark.createDataFrame(rows, "id int, cluster string, value decimal(18,2)")


@pytest.fixture(scope="module")
def p(data):
    return P.pareto(data, "value", "id").persist()


def test_running_share(p):
    got = [(r["id"], r["rank"], r["cum_pct"]) for r in p.orderBy("rank").collect()]
    assert got == [(1, 1, 50.0), (3, 2, 80.0), (2, 3, 90.0), (4, 4, 100.0)]


def test_key_items(p):
    assert P.key_items(p, 80).count() == 2
    assert [r["id"] for r in P.key_items(p, 40).collect()] == [1]


def test_gini(p):
    r = P.gini(p, "value").first()
    assert r["gini"] == pytest.approx(0.35) and r["gini_band"] == "moderate"


def test_outliers(p):
    r = P.outlier_summary(p, "value").first()
    assert (r["q1"], r["q3"], r["lower_bound"], r["upper_bound"]) == (10.0, 35.0, -27.5, 72.5)
    assert r["n_outliers"] == 0 and P.iqr_outliers(p, "value").count() == 0


def test_stability(p):
    prof = {r["cluster"]: r["cv"] for r in P.cluster_profile(p, "cluster", "value").collect()}
    assert prof == {"A": 94.27, "B": 70.7}
    r = P.cluster_stability(p, "cluster", "value").first()
    assert round(r["stability_score"], 6) == 0.833335
    assert r["most_stable"] == "B" and r["least_stable"] == "A"


def test_one_cluster_stability(spark):
    d = spark.createDataFrame([(1, "A", Decimal("50")), (2, "A", Decimal("10"))], "id int, cluster string, value decimal(18,2)")
    assert P.cluster_stability(P.pareto(d, "value", "id"), "cluster", "value").first()["stability_score"] == 0.0


def test_compare(p):
    rows = {r["cluster"]: r for r in P.compare_clusters(p, "cluster", "value").collect()}
    assert (rows["A"]["contribution_pct"], rows["B"]["contribution_pct"]) == (60.0, 40.0)
    assert (rows["A"]["efficiency"], rows["B"]["efficiency"]) == (30.0, 20.0)
    assert (rows["A"]["rank_by_total"], rows["B"]["rank_by_total"]) == (1.0, 2.0)
    assert (rows["A"]["std"], rows["B"]["std"]) == (28.28, 14.14)


def test_potential(p):
    r = P.improvement_potential(p, "value").first()
    assert r["low_count"] == 1 and r["low_share_pct"] == 10.0
    assert r["target"] == 20.0 and r["potential_gain"] == 10.0 and r["potential_gain_pct"] == 10.0
    g, o, st = P.gini(p, "value"), P.outlier_summary(p, "value"), P.cluster_stability(p, "cluster", "value")
    recs = P.recommendations(g, o, P.improvement_potential(p, "value"), st).collect()
    assert all(r["type"] != "performance gap" for r in recs)  # needs > 10


def test_average_rank(spark):
    d = spark.createDataFrame([(1, 4.0), (2, 1.0), (3, 4.0), (4, 2.0)], "id int, v double")
    got = {r["id"]: r["r"] for r in average_rank(d, "v", "r", ["id"]).collect()}
    assert got == {1: 1.5, 2: 4.0, 3: 1.5, 4: 3.0}


def test_no_positive_value(spark):
    d = spark.createDataFrame([(1, "A", Decimal("-5")), (2, "A", Decimal("0"))], "id int, cluster string, value decimal(18,2)")
    assert P.pareto(d, "value", "id").count() == 0


def test_select_clusters(data):
    assert P.select_clusters(data, "cluster", ["all"]).count() == 4
    assert P.select_clusters(data, "cluster", ["B"]).count() == 2
    assert P.select_clusters(data, "cluster", []).count() == 4

"""The scale forms must equal the plain forms they replace."""
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from segscope.operators.rank import ranked, top_n, window_ranked
from segscope.operators.stats import exact_quantile


@pytest.mark.parametrize("seed", [1, 2])
def test_ranked_equals_window(spark, seed):
    rnd = random.Random(seed)
    # a hot value holding a third of the rows, plus decimals and ties
    rows = [(i, Decimal(rnd.choice(["7.00"] * 3 + [f"{rnd.randint(1, 500)}.{rnd.randint(0, 99):02d}"] * 6)))
            for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, v decimal(18,2)")
    order = [("v", False), ("id", True)]
    a = ranked(df, order, "v", n_ranges=7).select("id", "_rank", "_cum", "_n", "_total")
    b = window_ranked(df, order, "v").select("id", "_rank", "_cum", "_n", "_total")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_ranked_double_running_sum(spark):
    df = spark.range(2000).select(F.col("id"), (F.col("id") % 37 * 1.5).alias("v"))
    a = ranked(df, [("v", True), ("id", True)], "v", n_ranges=5).orderBy("_rank").collect()
    xs = sorted((r["v"], r["id"]) for r in df.collect())
    assert [r["id"] for r in a] == [i for _, i in xs]
    assert a[-1]["_cum"] == pytest.approx(sum(v for v, _ in xs))


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_exact_quantile(spark, q):
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.normal(size=5000), np.full(2000, 1.5)])
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    assert exact_quantile(df, "v", q) == pytest.approx(float(np.quantile(vals, q)), abs=1e-12)


def test_exact_quantile_of_heavy_ties(spark):
    """Two heavy neighbours of the target rank: values 0/1 and 1..50 (the shape of a quantity column)."""
    df = spark.range(300_000).select((F.col("id") % 2).alias("a"), (F.col("id") % 50 + 1).alias("b"))
    assert exact_quantile(df, "a", 0.5) == 0.5
    assert exact_quantile(df, "b", 0.5) == 25.5
    assert exact_quantile(df.where("a > 5"), "a", 0.5) is None


def test_top_n_salted_equals_plain(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.col("id").alias("k"),
                                  ((F.col("id") * 7919) % 1000).cast("double").alias("s"))
    a = top_n(df, "s", 5, by=["g"], tiebreak=["k"], salt=8).select("g", "k", "_rn")
    w = Window.partitionBy("g").orderBy(F.col("s").desc(), "k")
    b = df.withColumn("_rn", F.row_number().over(w)).filter("_rn <= 5").select("g", "k", "_rn")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("rows_per_bucket", ["97", "1000000"])
def test_group_quantiles_equal_percentile(spark, rows_per_bucket):
    from segscope.operators.stats import group_quantiles
    rng = np.random.default_rng(5)
    rows = [(None if g == 3 else int(g), float(v)) for g, v in zip(rng.choice([0, 1, 1, 1, 2, 3], 4000), rng.normal(size=4000).round(2))]
    df = spark.createDataFrame(rows + [(0, None), (7, None), (1, float("nan"))], "g int, v double")
    probs = {"q1": 0.25, "med": 0.5, "q3": 0.75, "top": 1.0}
    spark.conf.set("segscope.rank.rowsPerBucket", rows_per_bucket)
    try:
        a = {r["g"]: r for r in group_quantiles(df, ["g"], "v", probs).collect()}
    finally:
        spark.conf.unset("segscope.rank.rowsPerBucket")
    b = {r["g"]: r for r in df.where("v is not null and not isnan(v)").groupBy("g").agg(
        *[F.percentile("v", p).alias(k) for k, p in probs.items()]).collect()}
    assert set(a) == set(b) == {0, 1, 2, None}
    for g in b:
        for k in probs:
            assert a[g][k] == pytest.approx(b[g][k], abs=1e-12)


def test_ranked_wide_decimals_text_and_nan(spark):
    df = spark.range(700).select("id", (F.col("id") % 13 * 12345678901 - 7).cast("decimal(28,2)").alias("d"),
                                 F.when(F.col("id") % 9 > 0, F.concat(F.lit("k"), F.col("id") % 21)).alias("t"),
                                 F.when(F.col("id") % 7 == 0, F.lit(float("nan"))).when(F.col("id") % 5 > 0, F.col("id") % 11 * 1.0).alias("x"))
    for first, asc in (("d", False), ("d", True), ("t", True), ("t", False), ("x", True), ("x", False)):
        order = [(first, asc), ("id", True)]
        a = ranked(df, order, "d", n_ranges=6).select("id", "_rank", "_cum")
        b = window_ranked(df, order, "d").select("id", "_rank", F.col("_cum").cast("decimal(38,2)").alias("_cum"))
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty(), (first, asc)

from pyspark.sql import functions as F

from segscope.operators import profile as H
from segscope.operators.stats import feature_quantiles


def _rows(spark):
    return spark.range(4000).select("id", F.when(F.col("id") % 10 > 0, F.col("id") % 2).alias("g"), (F.col("id") * 7 % 1009).cast("double").alias("x"))


def _no_shuffle_of_rows(spark, make):
    """The rows meet the table of groups where they are, whatever the session's threshold."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = make()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        return out.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_quantiles_of_few_groups_move_no_rows(spark):
    rows = _no_shuffle_of_rows(spark, lambda: feature_quantiles(_rows(spark), ["g"], ["x"], {"m": 0.5}))
    want = _rows(spark).groupBy("g").agg(F.percentile("x", 0.5).alias("m")).collect()
    assert sorted((str(r["g"]), r["m"]) for r in rows) == sorted((str(r["g"]), r["m"]) for r in want)


def test_box_stats_of_few_groups_move_no_rows(spark):
    long = H.feature_long(_rows(spark).where("g is not null"), "g", ["x"], key=["id"])
    rows = _no_shuffle_of_rows(spark, lambda: H.box_stats(long, "g"))
    assert sorted(r["g"] for r in rows) == [0, 1]
    assert all(r["n_outliers"] == 0 for r in rows)

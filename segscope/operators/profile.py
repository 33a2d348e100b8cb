"""Segment profiles.

All profiles are grouped aggregates (partial aggregation before the shuffle,
so a hot cluster does not land whole in one task). Per-cluster tables are
small by construction (one row per cluster); where they are joined back to
rows, ``join_small`` checks their size before broadcasting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import noise_last, rnd
from .combine import join_small, per_group
from .rank import ranked
from .stats import feature_quantiles, group_quantiles


def _num(c):
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v), v)


def cluster_stats(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """H1: per cluster, for each feature: mean, median, sample std, non-missing
    count; plus the cluster's share of rows in % (1 dp)."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for f in features:
        aggs += [F.avg(_num(f)).alias(f"{f}_mean"),
                 F.stddev_samp(_num(f)).alias(f"{f}_std"), F.count(_num(f)).alias(f"{f}_count")]
    base = df.filter(F.col(label).isNotNull())
    g = base.groupBy(label).agg(*aggs)
    medians = feature_quantiles(base, [label], features, {"m": 0.5}).groupBy(label).agg(
        *[F.max(F.when(F.col("feature") == f, F.col("m"))).alias(f"{f}_median") for f in features])
    g = join_small(g, medians, [label], "left")
    g = g.withColumn("percentage", rnd(F.col("_rows") / g.agg(F.sum("_rows")).scalar() * 100, 1))
    return g.drop("_rows")


def cluster_sizes(df: DataFrame, label: str) -> DataFrame:
    """H3: count and % per cluster; ``ord`` = numeric order with noise (-1) last."""
    g = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    g = g.withColumn("pct", rnd(F.col("count") / g.agg(F.sum("count")).scalar() * 100, 2))
    g = g.withColumn("_noise", noise_last(label)).withColumn("_label", F.col(label).cast("long"))
    r = ranked(g, [("_noise", True), ("_label", True)])
    return r.withColumn("ord", F.col("_rank").cast("int")).drop("_noise", "_label", "_rank", "_n")


def cluster_share(df: DataFrame, label: str) -> DataFrame:
    """H4: normalised counts per cluster."""
    g = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    return g.withColumn("share", rnd(F.col("count") / g.agg(F.sum("count")).scalar(), 6))


def category_share(df: DataFrame, label: str, cluster, col: str, count_missing: bool = False,
                   missing: str = "NaN_Category") -> DataFrame:
    """H6: distribution (%) of ``col`` inside one cluster; missing values are a
    bucket of their own when ``count_missing``, else dropped."""
    d = df.filter(F.col(label) == F.lit(cluster))
    v = F.col(col).cast("string")
    if count_missing:
        d = d.select(F.coalesce(v, F.lit(missing)).alias(col))
    else:
        d = d.select(v.alias(col)).filter(F.col(col).isNotNull())
    g = d.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    return g.withColumn("pct", rnd(F.col("count") / g.agg(F.sum("count")).scalar() * 100, 6))


def feature_long(df: DataFrame, label: str, features: list[str], key: list[str] | None = None) -> DataFrame:
    """H7: long form (key..., label, feature, value)."""
    ids = (key or []) + [label]
    d = df.select(*ids, *[_num(f).alias(f) for f in features])
    return d.unpivot(ids, features, "feature", "value")


def box_stats(long: DataFrame, label: str, k: float = 1.5) -> DataFrame:
    """H8: per (cluster, feature): quartiles (linear), whiskers = extreme values
    inside [q1 - k*iqr, q3 + k*iqr], and the number of points outside."""
    keys = [label, "feature"]
    q = group_quantiles(long, keys, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    q = q.withColumn("_lo", F.col("q1") - k * (F.col("q3") - F.col("q1"))) \
         .withColumn("_hi", F.col("q3") + k * (F.col("q3") - F.col("q1")))
    j = join_small(long.filter(F.col("value").isNotNull()), per_group(q), keys, "inner")
    inside = (F.col("value") >= F.col("_lo")) & (F.col("value") <= F.col("_hi"))
    return (j.groupBy(*keys)
             .agg(F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
                  F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
                  F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
                  F.count(F.when(~inside, 1)).alias("n_outliers")))


def box_outliers(long: DataFrame, label: str, k: float = 1.5) -> DataFrame:
    """H8: the rows outside the whiskers of their (cluster, feature)."""
    keys = [label, "feature"]
    q = group_quantiles(long, keys, "value", {"_q1": 0.25, "_q3": 0.75})
    reach = k * (F.col("_q3") - F.col("_q1"))
    j = join_small(long.filter(F.col("value").isNotNull()), per_group(q), keys, "inner")
    return j.filter((F.col("value") < F.col("_q1") - reach) | (F.col("value") > F.col("_q3") + reach)).drop("_q1", "_q3")


def feature_importance(stats: DataFrame, label: str, features: list[str], n: int = 10,
                       noise=-1) -> DataFrame:
    """H9: for each feature, std of the cluster means / mean of the cluster
    stds (noise excluded); 0 when the mean std <= 1e-9; top n, missing last."""
    s = stats.filter(F.col(label).cast("string") != F.lit(str(noise)))
    aggs = []
    for f in features:
        ms = F.avg(f"{f}_std")
        aggs.append(F.when(ms > 1e-9, F.stddev_samp(f"{f}_mean") / ms).when(ms.isNotNull(), F.lit(0.0))
                    .alias(f))
    wide = s.agg(*aggs)
    long = wide.unpivot([], features, "feature", "importance")
    w = Window.orderBy(F.col("importance").desc_nulls_last(), F.col("feature"))
    return long.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def cluster_cards(df: DataFrame, label: str) -> DataFrame:
    """Per cluster: mean and count of each numeric column, count of the others."""
    from pyspark.sql.types import NumericType
    aggs = [F.count(F.lit(1)).alias("rows")]
    for fld in df.schema.fields:
        if fld.name == label:
            continue
        if isinstance(fld.dataType, NumericType):
            aggs += [F.avg(_num(fld.name)).alias(f"{fld.name}_mean"), F.count(_num(fld.name)).alias(f"{fld.name}_count")]
        else:
            aggs.append(F.count(fld.name).alias(f"{fld.name}_count"))
    return df.filter(F.col(label).isNotNull()).groupBy(label).agg(*aggs)


def varying_columns(df: DataFrame, exclude: list[str] | None = None, counted: bool = False) -> DataFrame:
    """Columns with more than one distinct value (parallel-coordinates axes):
    least and greatest value differ. ``counted`` adds how many, which is a distinct
    count of those columns."""
    ex = set(exclude or [])
    cols = [(i, c) for i, c in enumerate(x for x in df.columns if x not in ex)]
    ends = df.agg(*[(F.min(c) != F.max(c)).alias(f"v{i}") for i, c in cols]).first() if cols else {}
    kept = [(i, c) for i, c in cols if ends[f"v{i}"]]
    spark = df.sparkSession
    if not counted or not kept:
        return spark.createDataFrame(kept, "pos int, column string") if not counted else spark.createDataFrame([], "pos int, column string, n_distinct long")
    one = df.agg(*[F.count_distinct(F.col(c)).alias(f"d{i}") for i, c in kept])
    rows = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(c).alias("column"), F.col(f"d{i}").alias("n_distinct")) for i, c in kept])
    return one.select(F.inline(rows))


def cluster_index(df: DataFrame, label: str, n: int = 10) -> DataFrame:
    """Position of each cluster in the numeric order, modulo n (palette
    index); noise (-1) gets NULL."""
    g = df.filter(F.col(label).isNotNull()).select(label).distinct()
    reg = g.filter(F.col(label).cast("long") != -1)
    reg = ranked(reg.withColumn("_label", F.col(label).cast("long")), [("_label", True)])
    reg = reg.select(label, ((F.col("_rank") - 1) % n).cast("int").alias("palette_index"))
    noise = g.filter(F.col(label).cast("long") == -1).withColumn("palette_index", F.lit(None).cast("int"))
    return reg.unionByName(noise)

"""Exact quantiles through mergeable sketches, one algorithm for every size.

1. One aggregate per group holds a sketch per feature (``percentile_approx``; partial
   sketches are merged, so a hot group is no single task) and gives, for each quantile, two
   values of the data that bracket it: their ranks are off by at most ``1 / ACCURACY`` of the
   rows, and the marks keep twice that distance.
2. A second aggregate over the rows counts what lies below each bracket and keeps the values
   next to it; a third counts, by value, the rows inside brackets alone, about
   ``4 / ACCURACY`` of them. The ranks inside follow from running counts, and each quantile
   is read off the one or two values at its positions.

Nothing is sorted but the few distinct values inside a bracket. Linear interpolation
between the two neighbouring order statistics (pandas / DuckDB rule). NULL groups are groups;
NULL and NaN values are skipped; a group without values has no row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .combine import per_group

ACCURACY = 2000


def feature_quantiles(df: DataFrame, keys: list[str], features: list[str], probs: dict[str, float],
                      name: str = "feature") -> DataFrame:
    """keys..., ``name`` (the feature), one column per quantile."""
    if not features:
        return df.limit(0).select(*keys, F.lit("").alias(name), *[F.lit(0.0).alias(p) for p in probs])
    ids, values = [f"_g{i}" for i in range(len(keys))] or ["_g"], [f"_f{j}" for j in range(len(features))]
    qs = [float(q) for q in probs.values()]
    which = [(j, i) for j in range(len(features)) for i in range(len(qs))]
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    rows = df.select(*([F.col(k).alias(i) for k, i in zip(keys, ids)] or [F.lit(0).alias("_g")]), *[number(f).alias(v) for f, v in zip(features, values)])
    marks = [min(1.0, max(0.0, q + side / ACCURACY)) for q in qs for side in (-2, 2)]
    sketched = rows.groupBy(*ids).agg(*[F.percentile_approx(v, marks, ACCURACY).alias(f"_m{j}") for j, v in enumerate(values)],
                                      *[F.count(v).alias(f"_n{j}") for j, v in enumerate(values)])
    # used twice below: worked out once; a row per group
    sketched = per_group(sketched.select(*[F.col(i).alias(f"{i}b") for i in ids], *[f"_n{j}" for j in range(len(values))], *[
        F.col(f"_m{j}")[2 * i + side].alias(f"_{end}{j}_{i}") for j, i in which for side, end in enumerate(("lo", "hi"))]))
    match = lambda a, b: reduce(lambda x, y: x & y, [F.col(a(i)).eqNullSafe(F.col(b(i))) for i in ids])
    placed = rows.join(sketched, match(lambda i: i, lambda i: f"{i}b"))
    lo, hi, v = (lambda j, i: F.col(f"_lo{j}_{i}")), (lambda j, i: F.col(f"_hi{j}_{i}")), (lambda j: F.col(f"_f{j}"))
    aggs = []
    for j, i in which:
        aggs += [F.count(F.when(v(j) < lo(j, i), 1)).alias(f"_b{j}_{i}"), F.max(F.when(v(j) < lo(j, i), v(j))).alias(f"_p{j}_{i}"),
                 F.min(F.when(v(j) > hi(j, i), v(j))).alias(f"_x{j}_{i}")]
    around = placed.groupBy(*ids).agg(*[F.max(f"_n{j}").alias(f"_n{j}") for j in range(len(values))], *aggs)
    around = per_group(around.select(*[F.col(i).alias(f"{i}a") for i in ids], F.inline(F.array(*[F.struct(
        F.lit(j).alias("ja"), F.lit(i).alias("ia"), F.col(f"_n{j}").alias("n"), F.col(f"_b{j}_{i}").alias("below"),
        F.col(f"_p{j}_{i}").alias("before"), F.col(f"_x{j}_{i}").alias("after")) for j, i in which]))).where("n > 0"))
    within = {(j, i): v(j).between(lo(j, i), hi(j, i)) for j, i in which}
    inside = placed.where(reduce(lambda a, b: a | b, within.values())).select(*ids, F.inline(F.array(*[
        F.struct(F.lit(j).alias("j"), F.lit(i).alias("i"), F.when(w, v(j)).alias("v")) for (j, i), w in within.items()])))
    inside = inside.where("v is not null").groupBy(*ids, "j", "i", "v").agg(F.count(F.lit(1)).alias("c"))
    running = F.sum("c").over(Window.partitionBy(*ids, "j", "i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("c").over(Window.partitionBy(*ids, "j", "i"))
    inside = inside.withColumns({"upto": running, "total": total})
    found = inside.join(around, match(lambda i: i, lambda i: f"{i}a") & (F.col("j") == F.col("ja")) & (F.col("i") == F.col("ia")))
    at = F.element_at(F.array(*[F.lit(q) for q in qs]), F.col("i") + 1) * (F.col("n") - 1)
    # the positions a value holds, and the ones right before and after the bracket
    def value(position):
        from_, to = F.col("below") + F.col("upto") - F.col("c"), F.col("below") + F.col("upto")
        return F.max(F.when((from_ <= position) & (position < to), F.col("v")).when(position == F.col("below") - 1, F.col("before"))
                     .when(position == F.col("below") + F.col("total"), F.col("after")))
    found = found.groupBy(*ids, "j", "i").agg(value(F.floor(at)).alias("low"), value(F.ceil(at)).alias("high"), F.max(at - F.floor(at)).alias("part"))
    # a sketch that broke its bound must not give a wrong figure
    sure = lambda c: F.coalesce(F.col(c), F.raise_error(F.lit("quantile outside its bracket")).cast("double"))
    result = sure("low") + (sure("high") - sure("low")) * F.col("part")
    wide = found.groupBy(*ids, "j").agg(*[F.max(F.when(F.col("i") == i, result)).alias(p) for i, p in enumerate(probs)])
    feature = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("j") + 1)
    return wide.select(*[F.col(i).alias(k) for k, i in zip(keys, ids)], feature.alias(name), *probs)


def group_quantiles(df: DataFrame, keys: list[str], col: str, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles of one column per group."""
    return feature_quantiles(df, keys, [col], probs, "_which").drop("_which")


def column_quantiles(df: DataFrame, cols: list[str], q: float) -> dict[str, float | None]:
    """Exact q-quantile of each column (None without values); one row per column reaches the driver."""
    rows = {r["feature"]: r["q"] for r in feature_quantiles(df, [], cols, {"q": q}).collect()} if cols else {}
    return {c: rows.get(c) for c in cols}


def exact_quantile(df: DataFrame, col: str, q: float) -> float | None:
    """Exact q-quantile of a column (NULL and NaN skipped), None if empty."""
    return column_quantiles(df, [col], q)[col]

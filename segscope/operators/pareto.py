"""Pareto and concentration analysis.

One ranked table (``pareto``) feeds every insight: it is ordered by value
descending then by the key, cut into ranges by ``ranked`` (no single-task
window), and carries the running sum, the row count and the total. Global
quantiles are read off the ranks, so they need no value map in one task.
Insights that are a handful of scalars are computed as one-row DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from functools import reduce

from ..functions.columns import literal_rows, nan_to_null, ratio_pct, rnd
from .combine import join_small
from .rank import average_rank, ranked
from .stats import group_quantiles


def zip_rows(*frames: DataFrame) -> DataFrame:
    """Side by side combination of one-row frames with distinct columns:
    stacked by name, then one global aggregate keeps each column's value.
    (No join: combining single rows needs no pairing.)"""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def select_clusters(df: DataFrame, cluster_col: str | None, clusters=None) -> DataFrame:
    """Keep the listed clusters; None, empty or containing 'all' keeps all."""
    if cluster_col is None or not clusters or "all" in [str(c) for c in clusters]:
        return df
    return df.filter(F.col(cluster_col).isin(list(clusters)))


def positive_only(df: DataFrame, value: str) -> DataFrame:
    """Non-missing (NaN counts as missing) and strictly positive."""
    v = F.col(value)
    return df.filter(nan_to_null(v) > 0) if dict(df.dtypes)[value] in ("double", "float") else df.filter(v > 0)


def pareto(df: DataFrame, value: str, key, cluster_col: str | None = None, clusters=None,
           n_ranges: int | None = None) -> DataFrame:
    """Rows sorted by value descending (ties by ``key``), with rank (1..n),
    cum_value, cum_pct and item_pct (both % rounded to 2), n_items, total_value."""
    d = positive_only(select_clusters(df, cluster_col, clusters), value)
    order = [(value, False)] + [(k, True) for k in _keys(key)]
    r = ranked(d, order, value=value, n_ranges=n_ranges)
    return (r.withColumnRenamed("_rank", "rank")
             .withColumnRenamed("_cum", "cum_value")
             .withColumnRenamed("_n", "n_items")
             .withColumnRenamed("_total", "total_value")
             .withColumn("cum_pct", ratio_pct("cum_value", "total_value"))
             .withColumn("item_pct", ratio_pct(value, "total_value")))


def key_items(p: DataFrame, threshold: float = 80.0) -> DataFrame:
    """cum_pct <= threshold; the first row when none qualifies (same set:
    the running share is non-decreasing, so if any row passes, row 1 does)."""
    return p.filter((F.col("cum_pct") <= F.lit(float(threshold))) | (F.col("rank") == 1))


def pareto_summary(p: DataFrame, value: str, threshold: float = 80.0) -> DataFrame:
    """One row — items, key items, their sum and share, total, mean."""
    is_key = (F.col("cum_pct") <= F.lit(float(threshold))) | (F.col("rank") == 1)
    s = p.agg(F.count(F.lit(1)).alias("n_items"),
              F.count(F.when(is_key, 1)).alias("n_key"),
              F.sum(F.when(is_key, F.col(value))).alias("_ks"),
              F.sum(F.col(value)).alias("_tot"))
    return s.select(
        "n_items", "n_key",
        F.lit(float(threshold)).alias("threshold"),
        F.col("_ks").cast("double").alias("key_sum"),
        ratio_pct("_ks", "_tot", 1).alias("key_share_pct"),
        F.col("_tot").cast("double").alias("total_value"),
        rnd(F.col("_tot").cast("double") / F.col("n_items"), 6).alias("mean_value"),
        ratio_pct("n_key", "n_items", 1).alias("key_items_pct"))


def gini_band(g) -> "F.Column":
    """Bands at 0.3, 0.5 and 0.7."""
    g = F.col(g) if isinstance(g, str) else g
    return (F.when(g < 0.3, F.lit("low")).when(g < 0.5, F.lit("moderate"))
             .when(g < 0.7, F.lit("high")).when(g.isNotNull(), F.lit("very high")))


def gini(p: DataFrame, value: str) -> DataFrame:
    """I4: (n + 1 - 2 * sum(cumsum ascending) / total) / n. The sum of the
    ascending running sums equals sum(x * descending rank), so it is a single
    aggregate over the ranked table."""
    s = p.agg(F.count(F.lit(1)).alias("n"),
              F.sum(F.col(value) * F.col("rank")).alias("_sxr"),
              F.sum(F.col(value)).alias("_tot"))
    g = (F.col("n") + 1 - 2 * F.col("_sxr").cast("double") / F.col("_tot").cast("double")) / F.col("n")
    return s.select("n", rnd(g, 6).alias("gini")).withColumn("gini_band", gini_band("gini"))


def _quantile_parts(value: str, probs: dict[str, float]):
    """Aggregates picking the two neighbouring rows of each quantile position,
    and the expressions that interpolate them (DuckDB / linear rule)."""
    n = F.col("n_items")
    v = F.col(value).cast("double")
    aggs, fin = [], []
    for name, q in probs.items():
        h = (n - 1) * F.lit(float(q))
        lo_rank = n - F.floor(h)
        hi_rank = F.greatest(lo_rank - 1, F.lit(1))
        aggs += [F.max(F.when(F.col("rank") == lo_rank, v)).alias(f"_{name}_lo"),
                 F.max(F.when(F.col("rank") == hi_rank, v)).alias(f"_{name}_hi"),
                 F.max(h - F.floor(h)).alias(f"_{name}_d")]
        fin.append((F.col(f"_{name}_lo") + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")) * F.col(f"_{name}_d")).alias(name))
    return aggs, fin


def quantiles(p: DataFrame, value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolation quantiles of ``value`` over the ranked table.
    Position h = (n-1)q in ascending order; ascending index j is descending rank
    n - j. Only the two neighbouring rows per quantile are read."""
    aggs, fin = _quantile_parts(value, probs)
    lows = [F.col("n_items") - F.floor((F.col("n_items") - 1) * F.lit(float(q))) for q in probs.values()]
    near = reduce(lambda a, b: a | b, [(F.col("rank") == r) | (F.col("rank") == F.greatest(r - 1, F.lit(1))) for r in lows])
    return p.filter(near).agg(*aggs).select(*fin)


def _bounds(p: DataFrame, value: str, k: float):
    q = quantiles(p, value, {"q1": 0.25, "q3": 0.75}).first()
    q1, q3 = q["q1"], q["q3"]
    if q1 is None:
        return None, None, None, None
    iqr = q3 - q1
    return q1, q3, q1 - k * iqr, q3 + k * iqr


def iqr_outliers(p: DataFrame, value: str, k: float = 1.5) -> DataFrame:
    """I6 rows: values strictly outside [Q1 - k*IQR, Q3 + k*IQR], with the side."""
    q1, q3, lo, hi = _bounds(p, value, k)
    if q1 is None:
        return p.limit(0).withColumn("side", F.lit(None).cast("string"))
    v = F.col(value).cast("double")
    return (p.filter((v < lo) | (v > hi))
             .withColumn("side", F.when(v > hi, F.lit("upper")).otherwise(F.lit("lower"))))


def outlier_summary(p: DataFrame, value: str, k: float = 1.5) -> DataFrame:
    """I6 summary: quartiles, bounds, count, %, upper/lower counts, impact %."""
    q1, q3, lo, hi = _bounds(p, value, k)
    v = F.col(value).cast("double")
    if q1 is None:
        lo = hi = q1 = q3 = float("nan")
    out_c = (v < F.lit(lo)) | (v > F.lit(hi))
    s = p.agg(F.count(F.lit(1)).alias("n"),
              F.count(F.when(out_c, 1)).alias("n_outliers"),
              F.count(F.when(v > F.lit(hi), 1)).alias("n_upper"),
              F.count(F.when(v < F.lit(lo), 1)).alias("n_lower"),
              F.sum(F.when(out_c, F.col(value))).alias("_os"),
              F.sum(F.col(value)).alias("_tot"))
    return s.select(rnd(F.lit(q1), 6).alias("q1"), rnd(F.lit(q3), 6).alias("q3"),
                    rnd(F.lit(lo), 6).alias("lower_bound"), rnd(F.lit(hi), 6).alias("upper_bound"),
                    "n_outliers", ratio_pct("n_outliers", "n", 6).alias("outlier_pct"),
                    "n_upper", "n_lower",
                    F.coalesce(ratio_pct("_os", "_tot", 6), F.lit(0.0)).alias("impact_pct"))


def cluster_profile(p: DataFrame, cluster: str, value: str) -> DataFrame:
    """I7 per cluster: count, mean, std, min, max (2 dp), cv = std/mean*100 on
    the rounded figures (2 dp). Missing cluster keys are dropped."""
    v = F.col(value).cast("double")
    g = (p.filter(F.col(cluster).isNotNull()).groupBy(cluster)
          .agg(F.count(F.lit(1)).alias("count"), F.avg(v).alias("_m"), F.stddev_samp(v).alias("_s"),
               F.min(v).alias("_lo"), F.max(v).alias("_hi")))
    g = g.select(cluster, "count", rnd("_m").alias("mean"), rnd("_s").alias("std"),
                 rnd("_lo").alias("min"), rnd("_hi").alias("max"))
    return g.withColumn("cv", rnd(F.when(F.col("mean") != 0, F.col("std") / F.col("mean") * 100)))


def cluster_stability(p: DataFrame, cluster: str, value: str) -> DataFrame:
    """I7 summary: score = max(0, 1 - std(cv)/100), 0 when fewer than two CVs;
    most / least stable cluster (smallest / largest cv; ties -> smaller key)."""
    prof = cluster_profile(p, cluster, value).filter(F.col("cv").isNotNull())
    s = prof.agg(F.stddev_samp("cv").alias("_sd"), F.count(F.lit(1)).alias("n_clusters"),
                 F.min(F.struct(F.col("cv").alias("a"), F.col(cluster).alias("k"))).alias("_lo"),
                 F.min(F.struct((-F.col("cv")).alias("a"), F.col(cluster).alias("k"))).alias("_hi"))
    score = F.when(F.col("n_clusters") >= 2, F.greatest(F.lit(0.0), 1 - F.col("_sd") / 100)).otherwise(F.lit(0.0))
    return s.select("n_clusters", rnd(score, 6).alias("stability_score"),
                    F.col("_lo")["k"].alias("most_stable"), F.col("_hi")["k"].alias("least_stable"))


def improvement_potential(p: DataFrame, value: str) -> DataFrame:
    """I8: rows from position int(0.8 n) of the descending order; their count,
    share %, mean; target = median of all values; gain if each low row reached
    the target, and the gain as % of the total."""
    qa, qf = _quantile_parts(value, {"median": 0.5})
    low = F.col("rank") > F.floor(F.col("n_items") * 0.8)
    s = p.agg(F.count(F.when(low, 1)).alias("low_count"),
              F.sum(F.when(low, F.col(value))).alias("_ls"),
              F.sum(F.col(value)).alias("_tot"), *qa)
    s = s.select("*", *qf)
    gain = F.col("low_count") * F.col("median") - F.coalesce(F.col("_ls").cast("double"), F.lit(0.0))
    return s.select("low_count",
                    F.coalesce(ratio_pct("_ls", "_tot", 6), F.lit(0.0)).alias("low_share_pct"),
                    rnd(F.col("_ls").cast("double") / F.col("low_count"), 6).alias("low_mean"),
                    rnd("median", 6).alias("target"),
                    rnd(gain, 6).alias("potential_gain"),
                    rnd(gain / F.col("_tot").cast("double") * 100, 6).alias("potential_gain_pct"))


def compare_clusters(p: DataFrame, cluster: str, value: str) -> DataFrame:
    """I9 per cluster: count, total, mean, median, std (2 dp), contribution %
    from the rounded totals, efficiency = total / count (2 dp), and average
    ranks (descending) by total and by efficiency."""
    v = F.col(value).cast("double")
    base = p.filter(F.col(cluster).isNotNull())
    g = (base.groupBy(cluster)
             .agg(F.count(F.lit(1)).alias("count"), F.sum(F.col(value)).alias("_t"), F.avg(v).alias("_m"),
                  F.stddev_samp(v).alias("_s")))
    g = join_small(g, group_quantiles(base, [cluster], value, {"_md": 0.5}), [cluster], "left")
    g = g.select(cluster, "count", rnd("_t").alias("total"), rnd("_m").alias("mean"),
                 rnd("_md").alias("median"), rnd("_s").alias("std"))
    g = g.withColumn("_all", g.agg(F.sum("total")).scalar())
    g = (g.withColumn("contribution_pct", ratio_pct("total", "_all"))
          .withColumn("efficiency", rnd(F.col("total") / F.col("count"))).drop("_all"))
    g = average_rank(g, "total", "rank_by_total", [cluster])
    return average_rank(g, "efficiency", "rank_by_efficiency", [cluster])


# Recommendation texts (ours; the decision rules are the reference's).
def recommendations(gini_df: DataFrame, outliers_df: DataFrame, potential_df: DataFrame,
                    stability_df: DataFrame, threshold: float = 80.0) -> DataFrame:
    """Gini > 0.6; upper outliers > 0; gain % > 10; stability < 0.7."""
    one = zip_rows(gini_df.select("gini"), outliers_df.select("n_upper", "impact_pct"),
                   potential_df.select("low_count", "potential_gain_pct"),
                   stability_df.select("stability_score", F.col("least_stable").cast("string")))
    rec = literal_rows(
        ["ord", "on", "type", "priority", "title", "description", "action"],
        [F.lit(1), F.col("gini") > 0.6, F.lit("concentration"), F.lit("high"), F.lit("Value sits in few items"),
         F.format_string(f"Gini %.2f: the top {threshold:g}%% of items carry most of the value", F.col("gini")),
         F.lit("List the key items and name an owner for each")],
        [F.lit(2), F.col("n_upper") > 0, F.lit("outliers"), F.lit("medium"), F.lit("Values far from the rest"),
         F.format_string("%d exceptional items carry %.1f%% of the total", F.col("n_upper"), F.col("impact_pct")),
         F.lit("Trace each of them back to its source rows")],
        [F.lit(3), F.col("potential_gain_pct") > 10, F.lit("performance gap"), F.lit("high"),
         F.lit("Low values could rise"),
         F.format_string("%d items lag behind; estimated gap %.1f%%", F.col("low_count"), F.col("potential_gain_pct")),
         F.lit("Compare the low half with the median item")],
        [F.lit(4), F.col("stability_score") < 0.7, F.lit("clusters"), F.lit("medium"), F.lit("Clusters differ in spread"),
         F.format_string("Stability %.2f; cluster %s varies most", F.col("stability_score"), F.col("least_stable")),
         F.lit("Split the widest cluster or check its inputs")])
    return (one.select(F.inline(rec)).filter(F.col("on")).drop("on"))


def pareto_rule(p: DataFrame) -> DataFrame:
    """Share of items with cum_pct <= 80; respected when <= 25 %."""
    s = p.agg(F.count(F.when(F.col("cum_pct") <= 80, 1)).alias("n_80"), F.count(F.lit(1)).alias("n"))
    pct = ratio_pct("n_80", "n", 1)
    return s.select("n_80", pct.alias("items_pct"), (pct <= 25).alias("respected"))


def concentration_verdict(summary: DataFrame) -> DataFrame:
    """Very strong when key share >= 80 and key items <= 20 % of all;
    strong when >= 70; else balanced."""
    share = F.col("key_sum") / F.col("total_value") * 100
    frac = F.col("n_key") / F.col("n_items")
    v = (F.when((share >= 80) & (frac <= 0.2), F.lit("very strong"))
          .when(share >= 70, F.lit("strong")).otherwise(F.lit("balanced")))
    return summary.select("n_key", "n_items", v.alias("verdict"))


def quick_advice(summary: DataFrame) -> DataFrame:
    """Focus (>= 80), key first (>= 60), else balanced."""
    share = F.col("key_sum") / F.col("total_value") * 100
    v = (F.when(share >= 80, F.lit("focus on the key items"))
          .when(share >= 60, F.lit("key items first, then widen")).otherwise(F.lit("work on several fronts")))
    return summary.select("n_key", v.alias("advice"))


def action_plan(recs: DataFrame) -> DataFrame:
    """Priority 1 for high, 2 for medium, with a timeline and resources."""
    hi = F.col("priority") == "high"
    return (recs.filter(F.col("priority").isin("high", "medium"))
                .select(F.when(hi, 1).otherwise(2).alias("priority"), "action",
                        F.when(hi, F.lit("first quarter")).otherwise(F.lit("second quarter")).alias("timeline"),
                        F.when(hi, F.lit("named owner")).otherwise(F.lit("existing staff")).alias("resources"),
                        F.when(hi, F.lit("gap to the median item")).otherwise(F.lit("spread inside clusters")).alias("kpi"),
                        "ord"))


def monitor_kpis(gini_df: DataFrame, summary: DataFrame, stability_df: DataFrame,
                 outliers_df: DataFrame, threshold: float = 80.0) -> DataFrame:
    """Four KPI rows (name, value, target, frequency)."""
    one = zip_rows(gini_df.select("gini"), summary.select("key_sum", "total_value"),
                   stability_df.select("stability_score"), outliers_df.select("n_outliers"))
    rows = literal_rows(
        ["ord", "name", "value", "target", "frequency"],
        [F.lit(1), F.lit("concentration index"), F.format_string("%.6f", F.col("gini")),
         F.lit("above 0.6 is concentrated"), F.lit("monthly")],
        [F.lit(2), F.lit("top items contribution"),
         F.format_string("%.1f%%", F.col("key_sum") / F.col("total_value") * 100),
         F.lit(f"keep > {threshold:g}%"), F.lit("weekly")],
        [F.lit(3), F.lit("cluster stability"), F.format_string("%.6f", F.col("stability_score")),
         F.lit("keep > 0.7"), F.lit("monthly")],
        [F.lit(4), F.lit("exceptional items"), F.col("n_outliers").cast("string"),
         F.lit("recount every month"), F.lit("monthly")])
    return one.select(F.inline(rows))


def potential_chart_data(potential: DataFrame) -> DataFrame:
    """Current share, target share and gain (percent)."""
    cur = 100 - F.col("low_share_pct")
    rows = literal_rows(["ord", "category", "pct"],
                        [F.lit(1), F.lit("current"), cur],
                        [F.lit(2), F.lit("target"), cur + F.col("potential_gain_pct")],
                        [F.lit(3), F.lit("gain"), F.col("potential_gain_pct")])
    return potential.select(F.inline(rows)).withColumn("pct", rnd("pct", 6))


def comparison_chart_data(compare: DataFrame, cluster: str) -> DataFrame:
    """Contribution and efficiency series per cluster."""
    return compare.select(cluster, "contribution_pct", "efficiency")


def pareto_chart_data(p: DataFrame, value: str, label_col: str | None = None, n: int = 100,
                      threshold: float = 80.0) -> DataFrame:
    """C11: the first n elements (a top-n report), with a label (first 20
    characters + '...', or 'item i'), and the in-threshold flag."""
    top = p.filter(F.col("rank") <= n)
    if label_col:
        s = F.col(label_col).cast("string")
        label = F.when(F.length(s) > 20, F.concat(F.substring(s, 1, 20), F.lit("..."))).otherwise(s)
    else:
        label = F.concat(F.lit("item "), F.col("rank").cast("string"))
    return top.select("rank", label.alias("label"), F.col(value).cast("double").alias("value"),
                      F.col("cum_pct"), (F.col("cum_pct") <= F.lit(float(threshold))).alias("in_threshold"))


def flagged_in_chart(chart: DataFrame) -> DataFrame:
    """C11: how many elements of the chart lie inside the threshold."""
    return chart.agg(F.count(F.lit(1)).alias("n_shown"), F.count(F.when(F.col("in_threshold"), 1)).alias("n_flagged"))


def pareto_options(df: DataFrame, cluster: str) -> DataFrame:
    """The pick-lists of the Pareto page as rows (list, value): clusters,
    numeric variables (without the cluster column) and display columns."""
    from .clean import numeric_columns
    names = [("variable", c) for c in numeric_columns(df, [cluster])] + [("display", c) for c in df.columns]
    rows = F.array(*[F.struct(F.lit(k).alias("list"), F.lit(v).alias("value")) for k, v in names])
    lists = df.limit(1).select(F.inline(rows))
    return cluster_options(df, cluster).select(F.lit("cluster").alias("list"), "value").unionByName(lists)


def chart_ticks(chart: DataFrame, ticks: int = 20) -> DataFrame:
    """Every max(1, m // ticks)-th element of the chart rows (m rows);
    tick text cut to 10 characters + '...'."""
    c = chart.withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy()))  # <= n rows
    step = F.greatest(F.lit(1), F.floor(F.col("_m") / ticks))
    lab = F.when(F.length("label") > 10, F.concat(F.substring("label", 1, 10), F.lit("..."))).otherwise(F.col("label"))
    return c.filter(((F.col("rank") - 1) % step) == 0).select("rank", lab.alias("tick"))


def cluster_options(df: DataFrame, cluster: str) -> DataFrame:
    """Cluster pick-list with counts, 'all' first (ord 0)."""
    g = df.filter(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    g = g.select(F.col(cluster).cast("string").alias("value"),
                 F.format_string("cluster %s (%d)", F.col(cluster).cast("string"), F.col("n")).alias("label"),
                 F.lit(1).alias("ord"), "n")
    tot = df.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("all").alias("value"), F.format_string("all (%d)", F.col("n")).alias("label"), F.lit(0).alias("ord"), "n")
    return tot.unionByName(g)

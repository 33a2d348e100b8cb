"""Registered queries that compare contents: insights and whole reports on a skewed amount (so that every rule
fires), written reports read back value by value, features of the mixed matrix, cards, projections.

Binding: ``customer`` with value = (hundreds of the balance) to the fourth power; ``orders`` for the mixed matrix;
``embeddings`` and ``part`` for vectors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from ..functions.columns import rnd
from ..operators import cluster as CL
from ..operators import features as FE
from ..operators import indicators as ind
from ..operators import pareto as P
from ..operators import project as PJ
from ..operators import quality as Q
from ..operators import view as V
from ..sources import io as IO
from . import segmentation as SEG
from .q_cluster import SQL_SILHOUETTE, _orders_mixed
from .q_pareto import _ALL_INSIGHTS_SQL, _CMP_SQL, _KEY, _P_COLS, _P_OUT_SQL, _P_SQL, _Q_SQL, SQL_OUTLIER_SUMMARY, THRESHOLD
from .sqlbits import MONEY, PCT, R


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---------------------------------------------------------------- insights where every rule has rows
def _skewed(spark, d):
    f = F.floor(F.col("c_acctbal") / 100)
    return _t(spark, d, "customer").select("c_custkey", "c_nationkey", "c_name", (f * f * f * f * F.signum("c_acctbal")).cast(DecimalType(18, 2)).alias("value"))


_F = "FLOOR(c_acctbal / 100)"
_MONEY, _POWER = f"{MONEY('c_acctbal')} AS value", f"CAST({_F} * {_F} * {_F} * {_F} * SIGN(c_acctbal) AS DECIMAL(18,2)) AS value"


def _on_skewed(sql: str) -> str:
    return sql.replace(_MONEY, _POWER)


def _ranked(spark, d):
    return P.pareto(_skewed(spark, d), "value", "c_custkey", cluster_col="c_nationkey")


def iqr_outliers_skewed(spark, d):
    """Rows outside the whiskers, of which this amount has many."""
    return P.iqr_outliers(_ranked(spark, d), "value").select(
        *_P_COLS, F.col("value").cast("double").alias("value"), F.col("cum_value").cast("double").alias("cum_value"), "side")


SQL_IQR_SKEWED = _on_skewed(f"""WITH {_P_SQL}, {_Q_SQL}
SELECT {_P_OUT_SQL}, CASE WHEN CAST(value AS DOUBLE) > hi THEN 'upper' ELSE 'lower' END AS side
FROM pp, b WHERE CAST(value AS DOUBLE) < lo OR CAST(value AS DOUBLE) > hi""")


def outlier_summary_skewed(spark, d):
    return P.outlier_summary(_ranked(spark, d), "value")


def _recommended(spark, d):
    p = _ranked(spark, d)
    return P.recommendations(P.gini(p, "value"), P.outlier_summary(p, "value"), P.improvement_potential(p, "value"),
                             P.cluster_stability(p, "c_nationkey", "value"), THRESHOLD)


def recommendation_texts(spark, d):
    """I10 with its descriptions."""
    return _recommended(spark, d).select("ord", "type", "priority", "title", "description", "action")


_TEXTS = f"""impact AS (SELECT COALESCE({PCT('SUM(CASE WHEN CAST(value AS DOUBLE) < lo OR CAST(value AS DOUBLE) > hi THEN value END)', 'SUM(value)', 6)}, 0.0) AS impact_pct FROM pp, b),
told AS (SELECT ord, type, priority, title, CASE ord
    WHEN 1 THEN printf('Gini %.2f: the top {THRESHOLD:g}%% of items carry most of the value', g.gini)
    WHEN 2 THEN printf('%d exceptional items carry %.1f%% of the total', o.n_upper, impact.impact_pct)
    WHEN 3 THEN printf('%d items lag behind; estimated gap %.1f%%', pot.low_count, pot.potential_gain_pct)
    ELSE printf('Stability %.2f; cluster %s varies most', stab.stability_score, stab.least_stable::VARCHAR) END AS description, action
  FROM rec, g, o, pot, stab, impact)"""
SQL_RECOMMENDATION_TEXTS = _on_skewed(f"WITH {_ALL_INSIGHTS_SQL}, {_TEXTS} SELECT * FROM told")


# ---------------------------------------------------------------- a whole report, written and read back
def _facts(part: str, df: DataFrame, key, number=None, text=None) -> DataFrame:
    """Long form of one part: part, key, number, words."""
    return df.select(F.lit(part).alias("part"), F.col(key).cast("string").alias("key") if isinstance(key, str) else key.alias("key"),
                     (F.col(number).cast("double") if number else F.lit(None).cast("double")).alias("number"),
                     (F.col(text).cast("string") if text else F.lit(None).cast("string")).alias("words"))


def pareto_report_contents(spark, d):
    """Values of every part of the report; the written ones are read back."""
    r = SEG.pareto_report(_skewed(spark, d), "value", "c_custkey", "c_nationkey")
    csv, book = (IO.scratch_path(spark, x) for x in ("report-csv", "report-book"))
    IO.write_pareto_csv(csv, r["summary"], r["key_items"], r["pareto"])
    IO.write_pareto_report(book, r["summary"], r["recommendations"], r["key_items"], r["monitor"])
    read = lambda base, name, fmt: IO.read_table(spark, f"{base}/{name}", fmt)
    one = F.lit("all")
    parts = [
        _facts("csv/full", read(csv, "full", "csv").withColumn("c_custkey", F.col("c_custkey").cast("long")), "c_custkey", "cum_pct"),
        _facts("csv/key_items", read(csv, "key_items", "csv").withColumn("c_custkey", F.col("c_custkey").cast("long")), "c_custkey", "value"),
        _facts("csv/summary", read(csv, "summary", "csv"), one, "key_share_pct"),
        _facts("report/summary", read(book, "summary", "parquet"), one, "key_sum"),
        _facts("report/recommendations", read(book, "recommendations", "parquet"), "title", None, "description"),
        _facts("report/key_items", read(book, "key_items", "parquet"), "c_custkey", "rank"),
        _facts("report/kpis", read(book, "kpis", "parquet"), "name", None, "value"),
        _facts("gini", r["gini"], "gini_band", "gini"), _facts("outliers", r["outliers"], one, "n_upper"),
        _facts("outlier_rows", r["outlier_rows"], "c_custkey", "value", "side"), _facts("stability", r["stability"], one, "stability_score"),
        _facts("stability_by_cluster", r["stability_by_cluster"], "c_nationkey", "cv"), _facts("potential", r["potential"], one, "potential_gain"),
        _facts("comparison", r["comparison"], "c_nationkey", "rank_by_total"), _facts("rule", r["rule"], one, "items_pct"),
        _facts("verdict", r["verdict"], one, "n_key", "verdict"), _facts("advice", r["advice"], one, "n_key", "advice"),
        _facts("action_plan", r["action_plan"], "action", "priority", "timeline"), _facts("chart", r["chart"], "rank", "cum_pct"),
        _facts("potential_chart", r["potential_chart"], "category", "pct"), _facts("comparison_chart", r["comparison_chart"], "c_nationkey", "efficiency"),
    ]
    return reduce(DataFrame.unionByName, parts)


def _fact_sql(part, source, key="'all'", number="NULL", words="NULL"):
    return f"SELECT '{part}' AS part, CAST({key} AS VARCHAR) AS key, CAST({number} AS DOUBLE) AS number, CAST({words} AS VARCHAR) AS words FROM {source}"


_SHARE = "CAST(key_sum AS DOUBLE) / CAST(total_value AS DOUBLE) * 100"
_VERDICT = f"CASE WHEN {_SHARE} >= 80 AND n_key / CAST(n_items AS DOUBLE) <= 0.2 THEN 'very strong' WHEN {_SHARE} >= 70 THEN 'strong' ELSE 'balanced' END"
_ADVICE = f"CASE WHEN {_SHARE} >= 80 THEN 'focus on the key items' WHEN {_SHARE} >= 60 THEN 'key items first, then widen' ELSE 'work on several fronts' END"
SQL_REPORT_CONTENTS = _on_skewed(f"WITH {_ALL_INSIGHTS_SQL}, {_TEXTS}, {_CMP_SQL} " + " UNION ALL ".join([
    _fact_sql("csv/full", "pp", "c_custkey", "cum_pct"), _fact_sql("csv/key_items", f"pp WHERE {_KEY}", "c_custkey", "value"),
    _fact_sql("csv/summary", "summ", number=PCT("key_sum", "total_value", 1)), _fact_sql("report/summary", "summ", number="key_sum"),
    _fact_sql("report/recommendations", "told", "title", words="description"), _fact_sql("report/key_items", f"pp WHERE {_KEY}", "c_custkey", "rank"),
    _fact_sql("report/kpis", "g", "'concentration index'", words="printf('%.6f', gini)"),
    _fact_sql("report/kpis", "summ", "'top items contribution'", words=f"printf('%.1f%%', {_SHARE})"),
    _fact_sql("report/kpis", "stab", "'cluster stability'", words="printf('%.6f', stability_score)"),
    _fact_sql("report/kpis", "o", "'exceptional items'", words="n_outliers"),
    _fact_sql("gini", "g", "CASE WHEN gini < 0.3 THEN 'low' WHEN gini < 0.5 THEN 'moderate' WHEN gini < 0.7 THEN 'high' ELSE 'very high' END", "gini"),
    _fact_sql("outliers", "o", number="n_upper"),
    _fact_sql("outlier_rows", "pp, b WHERE CAST(value AS DOUBLE) < lo OR CAST(value AS DOUBLE) > hi", "c_custkey", "value",
              "CASE WHEN CAST(value AS DOUBLE) > hi THEN 'upper' ELSE 'lower' END"),
    _fact_sql("stability", "stab", number="stability_score"), _fact_sql("stability_by_cluster", "prof", "c_nationkey", "cv"),
    _fact_sql("potential", "pot", number="potential_gain"), _fact_sql("comparison", "cmp", "c_nationkey", "rank_by_total"),
    _fact_sql("rule", "pp", number=PCT("COUNT(CASE WHEN cum_pct <= 80 THEN 1 END)", "COUNT(*)", 1)),
    _fact_sql("verdict", "summ", number="n_key", words=_VERDICT), _fact_sql("advice", "summ", number="n_key", words=_ADVICE),
    _fact_sql("action_plan", "rec WHERE priority IN ('high', 'medium')", "action", "CASE WHEN priority = 'high' THEN 1 ELSE 2 END",
              "CASE WHEN priority = 'high' THEN 'first quarter' ELSE 'second quarter' END"),
    _fact_sql("chart", "pp WHERE rank <= 100", "rank", "cum_pct"),
    _fact_sql("potential_chart", "pot", "'current'", R("100 - low_share_pct", 6)),
    _fact_sql("potential_chart", "pot", "'target'", R("100 - low_share_pct + potential_gain_pct", 6)),
    _fact_sql("potential_chart", "pot", "'gain'", R("potential_gain_pct", 6)), _fact_sql("comparison_chart", "cmp", "c_nationkey", "efficiency")]))


# ---------------------------------------------------------------- other contents
def summary_lines_scored(spark, d):
    """F10 where the silhouette is known."""
    e = _t(spark, d, "embeddings").select("label", "embedding")
    return CL.summary_lines(CL.cluster_summary(e, "label"), Q.silhouette(e, "embedding", "label"))


SQL_LINES_SCORED = f"""WITH score AS ({SQL_SILHOUETTE}), t AS (SELECT COUNT(DISTINCT label) FILTER (label <> -1) AS k, COUNT(*) FILTER (label = -1) AS noise,
  {R('AVG(CASE WHEN label = -1 THEN 1.0 ELSE 0.0 END) * 100', 6)} AS pct FROM embeddings)
SELECT 1 AS ord, printf('clusters: %d', k) AS line FROM t UNION ALL SELECT 2, printf('noise points: %d (%.1f%%)', noise, pct) FROM t
UNION ALL SELECT 3, printf('silhouette: %.3f', silhouette) FROM score"""


def consolidated_export(spark, d):
    """A10, K1: two segmentations stacked, written, read back."""
    c = _t(spark, d, "customer")
    numeric = c.select("c_custkey", (F.col("c_nationkey") % 3).alias("cluster_num"), F.lit(0.5).alias("tsne_1"))
    mixed = c.select("c_custkey", F.concat(F.lit("m"), F.col("c_nationkey") % 2).alias("cluster_mixed"))
    path = IO.scratch_path(spark, "consolidated")
    IO.export_consolidated(path, numeric=numeric, mixed=mixed)
    back = IO.read_table(spark, path, "csv")
    return back.select("source", F.col("c_custkey").cast("long").alias("c_custkey"), F.col("cluster_num").cast("int").alias("cluster_num"), "cluster_mixed")


SQL_CONSOLIDATED = """SELECT 'numeric' AS source, c_custkey, CAST(c_nationkey % 3 AS INT) AS cluster_num, NULL::VARCHAR AS cluster_mixed FROM customer
UNION ALL SELECT 'mixed', c_custkey, NULL, 'm' || (c_nationkey % 2) FROM customer"""


def kpi_cards(spark, d):
    """The figures of the order KPIs as cards show them."""
    o = _t(spark, d, "orders").select(F.col("o_totalprice").alias("initial"), F.col("o_totalprice").alias("committed"))
    k = ind.kpis(o, "initial", "committed")
    return V.format_view(k.select("total_initial", "mean_rate"), ["total_initial"], ["mean_rate"])


SQL_KPI_CARDS = f"SELECT format('{{:,.2f}}', CAST(SUM({MONEY('o_totalprice')}) AS DOUBLE)) AS total_initial, '100.0%' AS mean_rate FROM orders"


def assembled(spark, d):
    """A number and a precomputed vector side by side."""
    e = _t(spark, d, "embeddings").select("vec_id", F.col("label").cast("double").alias("label_number"), "embedding")
    out = FE.assemble(e, ["label_number", "embedding"], array_cols=["embedding"]).withColumn("x", vector_to_array("features"))
    total = F.aggregate("x", F.lit(0.0), lambda acc, v: acc + v * v)
    return out.select("vec_id", F.size("x").alias("width"), F.col("x")[0].alias("first"), rnd(total, 4).alias("squares"))


SQL_ASSEMBLED = f"""WITH e AS (SELECT vec_id, CAST(label AS DOUBLE) AS n, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)
SELECT vec_id, CAST(len(x) + 1 AS INT) AS width, n AS first, {R('n * n + list_sum(list_transform(x, lambda v: v * v))', 4)} AS squares FROM e"""


def mixed_matrix(spark, d):
    """Every column of the mixed matrix: rows with a value, its sum and its sum of squares."""
    o, types = _orders_mixed(spark, d)
    m = SEG.mixed_features(o, "o_orderkey", types).select(F.posexplode(vector_to_array("features")).alias("place", "v"))
    return m.groupBy("place").agg(F.count(F.when(F.col("v") != 0, 1)).alias("n"), rnd(F.sum("v"), 3).alias("total"), rnd(F.sum(F.col("v") * F.col("v")), 3).alias("squares"))


SQL_MIXED_MATRIX = f"""WITH z AS (SELECT (o_totalprice - AVG(o_totalprice) OVER ()) / STDDEV_POP(o_totalprice) OVER () AS price, o_orderpriority AS p, o_orderstatus AS s, o_orderdate AS t FROM orders),
cats AS (SELECT 'p' AS c, p AS v FROM z UNION SELECT 's', s FROM z),
slots AS (SELECT c, v, row_number() OVER (ORDER BY c, v) AS place FROM cats),
hot AS (SELECT place, 1.0 AS x FROM z JOIN slots ON (c = 'p' AND v = p) UNION ALL SELECT place, 1.0 FROM z JOIN slots ON (c = 's' AND v = s)),
rest AS (SELECT (SELECT COUNT(*) FROM slots) + i AS place, x FROM (SELECT unnest([1, 2, 3, 4]) AS i,
  unnest([year(t), month(t), day(t), (isodow(t) - 1)])::DOUBLE AS x FROM z)),
every AS (SELECT 0 AS place, price AS x FROM z UNION ALL SELECT * FROM hot UNION ALL SELECT * FROM rest)
SELECT CAST(place AS INT) AS place, COUNT(*) FILTER (x <> 0) AS n, {R('SUM(x)', 3)} AS total, {R('SUM(x * x)', 3)} AS squares FROM every GROUP BY 1"""


def projection_axes(spark, d):
    """P5 and P1 on two standardised features, whose axes are the diagonals."""
    p = _t(spark, d, "part").select("p_partkey", "p_brand", "p_size", (F.col("p_size") * F.col("p_retailprice")).alias("w"))
    z = FE.standardize(p, ["p_size", "w"])
    x = PJ.project(FE.assemble(z, ["p_size", "w"]), "features", 2)
    t = PJ.projection_table(x, 2, "p_brand", ["p_partkey"])
    return t.select("p_partkey", "p_brand", rnd("p2_1", 6).alias("p2_1"), rnd(F.abs("p2_2"), 6).alias("p2_2"))


SQL_PROJECTION_AXES = f"""WITH p AS (SELECT p_partkey, p_brand, p_size::DOUBLE AS a, p_size * p_retailprice AS b FROM part),
z AS (SELECT p_partkey, p_brand, (a - AVG(a) OVER ()) / STDDEV_POP(a) OVER () AS a, (b - AVG(b) OVER ()) / STDDEV_POP(b) OVER () AS b FROM p)
SELECT p_partkey, p_brand, {R('(a + b) / sqrt(2)', 6)} AS p2_1, {R('abs(a - b) / sqrt(2)', 6)} AS p2_2 FROM z"""


def custom_type(spark, d):
    """A type of one's own (the length of a text) in the mixed matrix."""
    c = _t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    SEG.register_type("length", lambda df, col: (df.withColumn(f"_{col}_len", F.coalesce(F.length(col), F.lit(0)).cast("double")), [f"_{col}_len"]))
    try:
        m = SEG.mixed_features(c, "c_custkey", {"c_name": "length", "c_acctbal": "numeric"})
    finally:
        SEG.unregister_type("length")
    x = m.withColumn("x", vector_to_array("features"))
    return x.select("c_custkey", F.col("x")[0].alias("name_length"), rnd(F.col("x")[1], 6).alias("balance"))


SQL_CUSTOM_TYPE = f"""SELECT c_custkey, length(c_name)::DOUBLE AS name_length,
  {R('(c_acctbal - AVG(c_acctbal) OVER ()) / STDDEV_POP(c_acctbal) OVER ()', 6)} AS balance FROM customer"""


def mixed_vectors(spark, d):
    """A number and a precomputed vector as types of the mixed matrix."""
    e = _t(spark, d, "embeddings").select("vec_id", F.col("label").cast("double").alias("n"), "embedding")
    x = SEG.mixed_features(e, "vec_id", {"n": "numeric", "embedding": "vector"}).withColumn("x", vector_to_array("features"))
    return x.select("vec_id", F.size("x").alias("width"), rnd(F.col("x")[0], 6).alias("first"), rnd(F.element_at("x", -1), 6).alias("last"))


SQL_MIXED_VECTORS = f"""SELECT vec_id, CAST(len(embedding) + 1 AS INT) AS width,
  {R('(label - AVG(label) OVER ()) / STDDEV_POP(label) OVER ()', 6)} AS first, {R('CAST(embedding[-1] AS DOUBLE)', 6)} AS last FROM embeddings"""


QUERIES = {
    "mixed_vectors": (mixed_vectors, SQL_MIXED_VECTORS),
    "iqr_outliers_skewed": (iqr_outliers_skewed, SQL_IQR_SKEWED), "outlier_summary_skewed": (outlier_summary_skewed, _on_skewed(SQL_OUTLIER_SUMMARY)),
    "recommendation_texts": (recommendation_texts, SQL_RECOMMENDATION_TEXTS), "pareto_report_contents": (pareto_report_contents, SQL_REPORT_CONTENTS),
    "summary_lines_scored": (summary_lines_scored, SQL_LINES_SCORED), "consolidated_export": (consolidated_export, SQL_CONSOLIDATED),
    "kpi_cards": (kpi_cards, SQL_KPI_CARDS), "assembled": (assembled, SQL_ASSEMBLED), "mixed_matrix": (mixed_matrix, SQL_MIXED_MATRIX),
    "projection_axes": (projection_axes, SQL_PROJECTION_AXES), "custom_type": (custom_type, SQL_CUSTOM_TYPE),
}

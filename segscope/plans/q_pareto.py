"""Registered queries: indicators, KPIs and the Pareto family (D, I, C11-C12, H5).

Bindings: ``customer`` — value = c_acctbal as money, item key c_custkey,
cluster c_nationkey (122 non-positive balances at sf 0.01 are dropped by C2).
``lineitem`` — initial = l_extendedprice, committed = price·(1−discount)·(1+tax)
in DECIMAL rounded to 2. ``orders`` — left join of the per-order sum of lines.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from ..operators import indicators as ind
from ..functions.columns import rnd
from ..operators import pareto as P
from ..session import cut_lineage
from .sqlbits import EXACT, MONEY, PCT, R

THRESHOLD = 80.0
LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---------------------------------------------------------------- bases
def _lines(spark, d):
    li = _t(spark, d, "lineitem")
    committed = F.round(F.col("l_extendedprice").cast(DecimalType(18, 2))
                        * (1 - F.col("l_discount").cast(DecimalType(4, 2)))
                        * (1 + F.col("l_tax").cast(DecimalType(4, 2))), 2).cast(DecimalType(18, 2))
    return li.select(*LINE_KEYS, "l_extendedprice", committed.alias("committed"))


_LINES_SQL = """lines AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice,
         CAST(ROUND(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))
              * (1 + CAST(l_tax AS DECIMAL(4,2))), 2) AS DECIMAL(18,2)) AS committed
  FROM lineitem)"""


def _orders(spark, d):
    o = _t(spark, d, "orders")
    li = _lines(spark, d).groupBy("l_orderkey").agg(F.sum("committed").alias("committed"))
    return o.join(li, o.o_orderkey == li.l_orderkey, "left").select("o_orderkey", "o_totalprice", "committed")


_ORDERS_SQL = _LINES_SQL + """,
orders_c AS (
  SELECT o.o_orderkey, o.o_totalprice, s.committed
  FROM orders o LEFT JOIN (SELECT l_orderkey, SUM(committed) AS committed FROM lines GROUP BY l_orderkey) s
    ON o.o_orderkey = s.l_orderkey)"""


def _indicator_sql(initial: str, committed: str) -> str:
    i, c = MONEY(initial), f"COALESCE({MONEY(committed)}, 0)"
    i = f"COALESCE({i}, 0)"
    rate = f"(CASE WHEN {i} > 0 THEN CAST({c} AS DOUBLE) / CAST({i} AS DOUBLE) * 100.0 ELSE 0.0 END)"
    return (f"CAST({c} - {i} AS DOUBLE) AS commit_gap, {R(rate, 6)} AS commit_rate, "
            f"CASE WHEN {rate} < 100 THEN 'under' WHEN {rate} = 100 THEN 'on' ELSE 'over' END AS commit_status, "
            f"({c} - {i}) < 0 AS flag_negative_gap, {rate} > 100 AS flag_over_rate")


def indicators_line(spark, d):
    x = ind.flag_rows(ind.indicators(_lines(spark, d), "l_extendedprice", "committed"))
    return x.select(*LINE_KEYS, F.col("commit_gap").cast("double").alias("commit_gap"),
                    rnd("commit_rate", 6).alias("commit_rate"), "commit_status",
                    "flag_negative_gap", "flag_over_rate")


SQL_INDICATORS_LINE = f"WITH {_LINES_SQL} SELECT {', '.join(LINE_KEYS)}, " \
                      f"{_indicator_sql('l_extendedprice', 'committed')} FROM lines"


def indicators_order(spark, d):
    x = ind.flag_rows(ind.indicators(_orders(spark, d), "o_totalprice", "committed"))
    return x.select("o_orderkey", F.col("commit_gap").cast("double").alias("commit_gap"),
                    rnd("commit_rate", 6).alias("commit_rate"), "commit_status",
                    "flag_negative_gap", "flag_over_rate")


SQL_INDICATORS_ORDER = f"WITH {_ORDERS_SQL} SELECT o_orderkey, " \
                       f"{_indicator_sql('o_totalprice', 'committed')} FROM orders_c"


def _kpi_sql(initial: str, committed: str, src: str) -> str:
    i, c = f"COALESCE({EXACT(initial)}, 0)", f"COALESCE({EXACT(committed)}, 0)"
    rate = f"(CASE WHEN {i} > 0 THEN CAST({c} AS DOUBLE) / CAST({i} AS DOUBLE) * 100.0 ELSE 0.0 END)"
    return (f"SELECT COUNT(*) AS n_rows, CAST(SUM({i}) AS DOUBLE) AS total_initial, "
            f"CAST(SUM({c}) AS DOUBLE) AS total_committed, "
            f"{R(f'AVG(CASE WHEN {i} > 0 THEN {rate} END)', 6)} AS mean_rate, "
            f"CAST(SUM({c} - {i}) AS DOUBLE) AS total_gap, COUNT(CASE WHEN {rate} > 100 THEN 1 END) AS n_over "
            f"FROM {src}")


def _kpis_out(k):
    return k.select("n_rows", "total_initial", "total_committed", rnd("mean_rate", 6).alias("mean_rate"),
                    "total_gap", "n_over")


def kpis_line(spark, d):
    return _kpis_out(ind.kpis(_lines(spark, d), "l_extendedprice", "committed"))


SQL_KPIS_LINE = f"WITH {_LINES_SQL} " + _kpi_sql("l_extendedprice", "committed", "lines")


def kpis_order(spark, d):
    return _kpis_out(ind.kpis(_orders(spark, d), "o_totalprice", "committed"))


SQL_KPIS_ORDER = f"WITH {_ORDERS_SQL} " + _kpi_sql("o_totalprice", "committed", "orders_c")


# ---------------------------------------------------------------- Pareto
def _cust(spark, d):
    c = _t(spark, d, "customer")
    return c.select("c_custkey", "c_nationkey", "c_name", ind.money(c, "c_acctbal").alias("value"))


def _pareto(spark, d, clusters=None):
    return P.pareto(_cust(spark, d), "value", "c_custkey", cluster_col="c_nationkey", clusters=clusters)


_P_SQL = f"""base AS (SELECT c_custkey, c_nationkey, c_name, {MONEY('c_acctbal')} AS value FROM customer),
pos AS (SELECT * FROM base WHERE value > 0),
p AS (
  SELECT *, ROW_NUMBER() OVER (ORDER BY value DESC, c_custkey) AS rank,
         SUM(value) OVER (ORDER BY value DESC, c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_value,
         COUNT(*) OVER () AS n_items, SUM(value) OVER () AS total_value
  FROM pos),
pp AS (SELECT *, {PCT('cum_value', 'total_value')} AS cum_pct, {PCT('value', 'total_value')} AS item_pct FROM p)"""

_P_COLS = ["c_custkey", "c_nationkey", "rank", "cum_pct", "item_pct"]


def _p_out(p):
    return p.select(*_P_COLS, F.col("value").cast("double").alias("value"),
                    F.col("cum_value").cast("double").alias("cum_value"))


_P_OUT_SQL = ", ".join(_P_COLS) + ", CAST(value AS DOUBLE) AS value, CAST(cum_value AS DOUBLE) AS cum_value"


def pareto(spark, d):
    return _p_out(_pareto(spark, d))


SQL_PARETO = f"WITH {_P_SQL} SELECT {_P_OUT_SQL} FROM pp"


def key_items(spark, d):
    return _p_out(P.key_items(_pareto(spark, d), THRESHOLD))


SQL_KEY_ITEMS = f"WITH {_P_SQL} SELECT {_P_OUT_SQL} FROM pp WHERE cum_pct <= {THRESHOLD} OR rank = 1"

SELECTED = [3, 7, 11, 19]


def pareto_selected(spark, d):
    return _p_out(_pareto(spark, d, clusters=SELECTED))


SQL_PARETO_SELECTED = SQL_PARETO.replace(
    "pos AS (SELECT * FROM base WHERE value > 0)",
    f"pos AS (SELECT * FROM base WHERE value > 0 AND c_nationkey IN ({', '.join(map(str, SELECTED))}))")


def pareto_summary(spark, d):
    return P.pareto_summary(_pareto(spark, d), "value", THRESHOLD)


_KEY = f"(cum_pct <= {THRESHOLD} OR rank = 1)"
SQL_PARETO_SUMMARY = f"""WITH {_P_SQL}, s AS (
  SELECT COUNT(*) AS n_items, COUNT(CASE WHEN {_KEY} THEN 1 END) AS n_key,
         SUM(CASE WHEN {_KEY} THEN value END) AS ks, SUM(value) AS tot FROM pp)
SELECT n_items, n_key, {THRESHOLD} AS threshold, CAST(ks AS DOUBLE) AS key_sum, {PCT('ks', 'tot', 1)} AS key_share_pct,
       CAST(tot AS DOUBLE) AS total_value, {R('CAST(tot AS DOUBLE) / n_items', 6)} AS mean_value,
       {PCT('n_key', 'n_items', 1)} AS key_items_pct FROM s"""


def gini(spark, d):
    return P.gini(_pareto(spark, d), "value")


_GINI_EXPR = "(n + 1 - 2 * CAST(sxr AS DOUBLE) / CAST(tot AS DOUBLE)) / n"
SQL_GINI = f"""WITH {_P_SQL}, s AS (SELECT COUNT(*) AS n, SUM(value * rank) AS sxr, SUM(value) AS tot FROM pp),
g AS (SELECT n, {R(_GINI_EXPR, 6)} AS gini FROM s)
SELECT n, gini, CASE WHEN gini < 0.3 THEN 'low' WHEN gini < 0.5 THEN 'moderate' WHEN gini < 0.7 THEN 'high'
  WHEN gini IS NOT NULL THEN 'very high' END AS gini_band FROM g"""

_Q_SQL = """q AS (SELECT QUANTILE_CONT(CAST(value AS DOUBLE), 0.25) AS q1, QUANTILE_CONT(CAST(value AS DOUBLE), 0.75) AS q3 FROM pp),
b AS (SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)"""


def iqr_outliers(spark, d):
    return P.iqr_outliers(_pareto(spark, d), "value").select(
        *_P_COLS, F.col("value").cast("double").alias("value"),
        F.col("cum_value").cast("double").alias("cum_value"), "side")


SQL_IQR_OUTLIERS = f"""WITH {_P_SQL}, {_Q_SQL}
SELECT {_P_OUT_SQL}, CASE WHEN CAST(value AS DOUBLE) > hi THEN 'upper' ELSE 'lower' END AS side
FROM pp, b WHERE CAST(value AS DOUBLE) < lo OR CAST(value AS DOUBLE) > hi"""


def outlier_summary(spark, d):
    return P.outlier_summary(_pareto(spark, d), "value")


SQL_OUTLIER_SUMMARY = f"""WITH {_P_SQL}, {_Q_SQL}, s AS (
  SELECT COUNT(*) AS n, COUNT(CASE WHEN v < lo OR v > hi THEN 1 END) AS n_outliers,
         COUNT(CASE WHEN v > hi THEN 1 END) AS n_upper, COUNT(CASE WHEN v < lo THEN 1 END) AS n_lower,
         SUM(CASE WHEN v < lo OR v > hi THEN value END) AS os, SUM(value) AS tot, MAX(q1) AS q1, MAX(q3) AS q3,
         MAX(lo) AS lo, MAX(hi) AS hi
  FROM (SELECT pp.value, CAST(pp.value AS DOUBLE) AS v, b.* FROM pp, b) x)
SELECT {R('q1', 6)} AS q1, {R('q3', 6)} AS q3, {R('lo', 6)} AS lower_bound, {R('hi', 6)} AS upper_bound,
       n_outliers, {PCT('n_outliers', 'n', 6)} AS outlier_pct, n_upper, n_lower,
       COALESCE({PCT('os', 'tot', 6)}, 0.0) AS impact_pct FROM s"""


def cluster_profile(spark, d):
    return P.cluster_profile(_pareto(spark, d), "c_nationkey", "value")


_PROF_SQL = f"""prof0 AS (
  SELECT c_nationkey, COUNT(*) AS count, {R('AVG(CAST(value AS DOUBLE))')} AS mean,
         {R('STDDEV_SAMP(CAST(value AS DOUBLE))')} AS std, {R('MIN(CAST(value AS DOUBLE))')} AS min,
         {R('MAX(CAST(value AS DOUBLE))')} AS max
  FROM pp WHERE c_nationkey IS NOT NULL GROUP BY c_nationkey),
prof AS (SELECT *, {R('CASE WHEN mean <> 0 THEN std / mean * 100 END')} AS cv FROM prof0)"""
SQL_CLUSTER_PROFILE = f"WITH {_P_SQL}, {_PROF_SQL} SELECT * FROM prof"


def cluster_stability(spark, d):
    return P.cluster_stability(_pareto(spark, d), "c_nationkey", "value")


_STAB_SQL = f"""stab AS (
  SELECT COUNT(*) AS n_clusters,
         {R('CASE WHEN COUNT(*) >= 2 THEN GREATEST(0.0, 1 - STDDEV_SAMP(cv) / 100) ELSE 0.0 END', 6)} AS stability_score,
         ARG_MIN(c_nationkey, (cv, c_nationkey)) AS most_stable,
         ARG_MIN(c_nationkey, (-cv, c_nationkey)) AS least_stable
  FROM prof WHERE cv IS NOT NULL)"""
SQL_CLUSTER_STABILITY = f"WITH {_P_SQL}, {_PROF_SQL}, {_STAB_SQL} SELECT * FROM stab"


def improvement_potential(spark, d):
    return P.improvement_potential(_pareto(spark, d), "value")


_POT_SQL = f"""pot0 AS (
  SELECT COUNT(CASE WHEN rank > FLOOR(n_items * 0.8) THEN 1 END) AS low_count,
         SUM(CASE WHEN rank > FLOOR(n_items * 0.8) THEN value END) AS ls, SUM(value) AS tot,
         QUANTILE_CONT(CAST(value AS DOUBLE), 0.5) AS median FROM pp),
pot AS (
  SELECT low_count, COALESCE({PCT('ls', 'tot', 6)}, 0.0) AS low_share_pct,
         {R('CAST(ls AS DOUBLE) / low_count', 6)} AS low_mean, {R('median', 6)} AS target,
         {R('low_count * median - COALESCE(CAST(ls AS DOUBLE), 0.0)', 6)} AS potential_gain,
         {R('(low_count * median - COALESCE(CAST(ls AS DOUBLE), 0.0)) / CAST(tot AS DOUBLE) * 100', 6)} AS potential_gain_pct
  FROM pot0)"""
SQL_IMPROVEMENT_POTENTIAL = f"WITH {_P_SQL}, {_POT_SQL} SELECT * FROM pot"


def compare_clusters(spark, d):
    return P.compare_clusters(_pareto(spark, d), "c_nationkey", "value")


_CMP_SQL = f"""cmp0 AS (
  SELECT c_nationkey, COUNT(*) AS count, {R('SUM(value)')} AS total, {R('AVG(CAST(value AS DOUBLE))')} AS mean,
         {R('MEDIAN(CAST(value AS DOUBLE))')} AS median, {R('STDDEV_SAMP(CAST(value AS DOUBLE))')} AS std
  FROM pp WHERE c_nationkey IS NOT NULL GROUP BY c_nationkey),
cmp1 AS (SELECT *, {PCT('total', 'SUM(total) OVER ()')} AS contribution_pct, {R('total / count')} AS efficiency FROM cmp0),
cmp AS (SELECT *,
  CAST(RANK() OVER (ORDER BY total DESC) + (COUNT(*) OVER (PARTITION BY total) - 1) / 2.0 AS DOUBLE) AS rank_by_total,
  CAST(RANK() OVER (ORDER BY efficiency DESC) + (COUNT(*) OVER (PARTITION BY efficiency) - 1) / 2.0 AS DOUBLE) AS rank_by_efficiency
  FROM cmp1)"""
SQL_COMPARE_CLUSTERS = f"WITH {_P_SQL}, {_CMP_SQL} SELECT * FROM cmp"


def _insight_frames(spark, d):
    p = cut_lineage(_pareto(spark, d))
    g = P.gini(p, "value")
    o = P.outlier_summary(p, "value")
    pot = P.improvement_potential(p, "value")
    st = P.cluster_stability(p, "c_nationkey", "value")
    summ = P.pareto_summary(p, "value", THRESHOLD)
    return p, g, o, pot, st, summ


def recommendations(spark, d):
    _, g, o, pot, st, _ = _insight_frames(spark, d)
    return P.recommendations(g, o, pot, st, THRESHOLD).select("ord", "type", "priority", "title", "action")


_REC_SQL = f"""one AS (SELECT g.gini, o.n_upper, pot.potential_gain_pct, stab.stability_score
  FROM g, o, pot, stab),
rec AS (
  SELECT 1 AS ord, 'concentration' AS type, 'high' AS priority, 'Value sits in few items' AS title,
         'List the key items and name an owner for each' AS action FROM one WHERE gini > 0.6
  UNION ALL SELECT 2, 'outliers', 'medium', 'Values far from the rest', 'Trace each of them back to its source rows'
         FROM one WHERE n_upper > 0
  UNION ALL SELECT 3, 'performance gap', 'high', 'Low values could rise', 'Compare the low half with the median item'
         FROM one WHERE potential_gain_pct > 10
  UNION ALL SELECT 4, 'clusters', 'medium', 'Clusters differ in spread', 'Split the widest cluster or check its inputs'
         FROM one WHERE stability_score < 0.7)"""
_ALL_INSIGHTS_SQL = f"""{_P_SQL}, {_Q_SQL},
g AS (SELECT {R(_GINI_EXPR, 6)} AS gini FROM (SELECT COUNT(*) AS n, SUM(value * rank) AS sxr, SUM(value) AS tot FROM pp) s),
o AS (SELECT COUNT(CASE WHEN CAST(value AS DOUBLE) < lo OR CAST(value AS DOUBLE) > hi THEN 1 END) AS n_outliers,
             COUNT(CASE WHEN CAST(value AS DOUBLE) > hi THEN 1 END) AS n_upper FROM pp, b),
{_POT_SQL}, {_PROF_SQL}, {_STAB_SQL},
summ AS (SELECT SUM(CASE WHEN {_KEY} THEN value END) AS key_sum, SUM(value) AS total_value,
                COUNT(CASE WHEN {_KEY} THEN 1 END) AS n_key, COUNT(*) AS n_items FROM pp),
{_REC_SQL}"""
SQL_RECOMMENDATIONS = f"WITH {_ALL_INSIGHTS_SQL} SELECT * FROM rec"


def action_plan(spark, d):
    _, g, o, pot, st, _ = _insight_frames(spark, d)
    return P.action_plan(P.recommendations(g, o, pot, st, THRESHOLD))


SQL_ACTION_PLAN = f"""WITH {_ALL_INSIGHTS_SQL}
SELECT CASE WHEN priority = 'high' THEN 1 ELSE 2 END AS priority, action,
  CASE WHEN priority = 'high' THEN 'first quarter' ELSE 'second quarter' END AS timeline,
  CASE WHEN priority = 'high' THEN 'named owner' ELSE 'existing staff' END AS resources,
  CASE WHEN priority = 'high' THEN 'gap to the median item' ELSE 'spread inside clusters' END AS kpi, ord
FROM rec WHERE priority IN ('high', 'medium')"""


def monitor_kpis(spark, d):
    _, g, o, _, st, summ = _insight_frames(spark, d)
    return P.monitor_kpis(g, summ, st, o, THRESHOLD)


SQL_MONITOR_KPIS = f"""WITH {_ALL_INSIGHTS_SQL}
SELECT 1 AS ord, 'concentration index' AS name, printf('%.6f', gini) AS value,
       'above 0.6 is concentrated' AS target, 'monthly' AS frequency FROM g
UNION ALL SELECT 2, 'top items contribution', printf('%.1f%%', CAST(key_sum AS DOUBLE) / CAST(total_value AS DOUBLE) * 100),
       'keep > 80%', 'weekly' FROM summ
UNION ALL SELECT 3, 'cluster stability', printf('%.6f', stability_score), 'keep > 0.7', 'monthly' FROM stab
UNION ALL SELECT 4, 'exceptional items', CAST(n_outliers AS VARCHAR), 'recount every month', 'monthly' FROM o"""


def pareto_rule(spark, d):
    return P.pareto_rule(_pareto(spark, d))


SQL_PARETO_RULE = f"""WITH {_P_SQL}, s AS (SELECT COUNT(CASE WHEN cum_pct <= 80 THEN 1 END) AS n_80, COUNT(*) AS n FROM pp)
SELECT n_80, {PCT('n_80', 'n', 1)} AS items_pct, {PCT('n_80', 'n', 1)} <= 25 AS respected FROM s"""


def concentration_verdict(spark, d):
    return P.concentration_verdict(P.pareto_summary(_pareto(spark, d), "value", THRESHOLD))


SQL_CONCENTRATION_VERDICT = f"""WITH {_ALL_INSIGHTS_SQL}
SELECT n_key, n_items, CASE
  WHEN CAST(key_sum AS DOUBLE) / CAST(total_value AS DOUBLE) * 100 >= 80 AND n_key / n_items <= 0.2 THEN 'very strong'
  WHEN CAST(key_sum AS DOUBLE) / CAST(total_value AS DOUBLE) * 100 >= 70 THEN 'strong' ELSE 'balanced' END AS verdict
FROM summ"""


def quick_advice(spark, d):
    return P.quick_advice(P.pareto_summary(_pareto(spark, d), "value", THRESHOLD))


SQL_QUICK_ADVICE = f"""WITH {_ALL_INSIGHTS_SQL}
SELECT n_key, CASE WHEN CAST(key_sum AS DOUBLE) / CAST(total_value AS DOUBLE) * 100 >= 80 THEN 'focus on the key items'
  WHEN CAST(key_sum AS DOUBLE) / CAST(total_value AS DOUBLE) * 100 >= 60 THEN 'key items first, then widen'
  ELSE 'work on several fronts' END AS advice FROM summ"""


def potential_chart_data(spark, d):
    return P.potential_chart_data(P.improvement_potential(_pareto(spark, d), "value"))


SQL_POTENTIAL_CHART_DATA = f"""WITH {_P_SQL}, {_POT_SQL}
SELECT 1 AS ord, 'current' AS category, {R('100 - low_share_pct', 6)} AS pct FROM pot
UNION ALL SELECT 2, 'target', {R('100 - low_share_pct + potential_gain_pct', 6)} FROM pot
UNION ALL SELECT 3, 'gain', {R('potential_gain_pct', 6)} FROM pot"""


def comparison_chart_data(spark, d):
    return P.comparison_chart_data(P.compare_clusters(_pareto(spark, d), "c_nationkey", "value"), "c_nationkey")


SQL_COMPARISON_CHART_DATA = f"WITH {_P_SQL}, {_CMP_SQL} SELECT c_nationkey, contribution_pct, efficiency FROM cmp"


def pareto_chart_data(spark, d):
    return P.pareto_chart_data(_pareto(spark, d), "value", label_col="c_name", n=100, threshold=THRESHOLD)


_CHART_SQL = f"""chart AS (
  SELECT rank, CASE WHEN LENGTH(c_name) > 20 THEN SUBSTR(c_name, 1, 20) || '...' ELSE c_name END AS label,
         CAST(value AS DOUBLE) AS value, cum_pct, cum_pct <= {THRESHOLD} AS in_threshold
  FROM pp WHERE rank <= 100)"""
SQL_PARETO_CHART_DATA = f"WITH {_P_SQL}, {_CHART_SQL} SELECT * FROM chart"


def chart_ticks(spark, d):
    return P.chart_ticks(pareto_chart_data(spark, d), 20)


SQL_CHART_TICKS = f"""WITH {_P_SQL}, {_CHART_SQL}
SELECT rank, CASE WHEN LENGTH(label) > 10 THEN SUBSTR(label, 1, 10) || '...' ELSE label END AS tick
FROM (SELECT *, COUNT(*) OVER () AS m FROM chart) c
WHERE (rank - 1) % GREATEST(1, FLOOR(m / 20)) = 0"""


def cluster_options(spark, d):
    return P.cluster_options(_cust(spark, d), "c_nationkey")


SQL_CLUSTER_OPTIONS = """SELECT 'all' AS value, printf('all (%d)', COUNT(*)) AS label, 0 AS ord, COUNT(*) AS n FROM customer
UNION ALL
SELECT CAST(c_nationkey AS VARCHAR), printf('cluster %s (%d)', CAST(c_nationkey AS VARCHAR), COUNT(*)), 1, COUNT(*)
FROM customer WHERE c_nationkey IS NOT NULL GROUP BY c_nationkey"""


QUERIES = {
    "indicators_line": (indicators_line, SQL_INDICATORS_LINE),
    "indicators_order": (indicators_order, SQL_INDICATORS_ORDER),
    "kpis_line": (kpis_line, SQL_KPIS_LINE),
    "kpis_order": (kpis_order, SQL_KPIS_ORDER),
    "pareto": (pareto, SQL_PARETO),
    "key_items": (key_items, SQL_KEY_ITEMS),
    "pareto_selected": (pareto_selected, SQL_PARETO_SELECTED),
    "pareto_summary": (pareto_summary, SQL_PARETO_SUMMARY),
    "gini": (gini, SQL_GINI),
    "iqr_outliers": (iqr_outliers, SQL_IQR_OUTLIERS),
    "outlier_summary": (outlier_summary, SQL_OUTLIER_SUMMARY),
    "cluster_profile": (cluster_profile, SQL_CLUSTER_PROFILE),
    "cluster_stability": (cluster_stability, SQL_CLUSTER_STABILITY),
    "improvement_potential": (improvement_potential, SQL_IMPROVEMENT_POTENTIAL),
    "compare_clusters": (compare_clusters, SQL_COMPARE_CLUSTERS),
    "recommendations": (recommendations, SQL_RECOMMENDATIONS),
    "action_plan": (action_plan, SQL_ACTION_PLAN),
    "monitor_kpis": (monitor_kpis, SQL_MONITOR_KPIS),
    "pareto_rule": (pareto_rule, SQL_PARETO_RULE),
    "concentration_verdict": (concentration_verdict, SQL_CONCENTRATION_VERDICT),
    "quick_advice": (quick_advice, SQL_QUICK_ADVICE),
    "potential_chart_data": (potential_chart_data, SQL_POTENTIAL_CHART_DATA),
    "comparison_chart_data": (comparison_chart_data, SQL_COMPARISON_CHART_DATA),
    "pareto_chart_data": (pareto_chart_data, SQL_PARETO_CHART_DATA),
    "chart_ticks": (chart_ticks, SQL_CHART_TICKS),
    "cluster_options": (cluster_options, SQL_CLUSTER_OPTIONS),
}

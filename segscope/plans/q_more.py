"""Registered queries: Pareto on derived amounts, reports written and read
back, pick-lists, choices of k, coercions and row helpers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from ..functions.columns import rnd, to_number, to_ts
from ..operators import clean as C
from ..operators import cluster as CL
from ..operators import combine as CB
from ..operators import indicators as ind
from ..operators import pareto as P
from ..operators import profile as H
from ..operators import view as V
from ..sources import io as IO
from . import segmentation as SEG
from .q_pareto import _LINES_SQL, _lines, _t
from .sqlbits import MONEY, PCT, R


def _ranked_sql(base: str, value: str, keys: str, extra: str = "") -> str:
    over = f"(ORDER BY {value} DESC, {keys} ROWS UNBOUNDED PRECEDING)"
    return (f"SELECT {keys}, {extra}ROW_NUMBER() OVER (ORDER BY {value} DESC, {keys}) AS rank, "
            f"{PCT(f'SUM({value}) OVER {over}', f'SUM({value}) OVER ()')} AS cum_pct FROM {base} WHERE {value} > 0")


def pareto_gap(spark, d):
    """I1 on the library's own DECIMAL(19,2) gap column."""
    x = ind.indicators(_lines(spark, d), "l_extendedprice", "committed")
    return P.pareto(x, "commit_gap", ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "rank", "cum_pct")


_GAP = f"{MONEY('committed')} - {MONEY('l_extendedprice')}"
SQL_PARETO_GAP = f"WITH {_LINES_SQL}, g AS (SELECT l_orderkey, l_linenumber, {_GAP} AS gap FROM lines) " + \
    _ranked_sql("g", "gap", "l_orderkey, l_linenumber")


def pareto_sums(spark, d):
    """I1 on sums per part, DECIMAL(28,2)."""
    sums = _t(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum(F.col("l_extendedprice").cast(DecimalType(18, 2))).alias("amount"))
    return P.pareto(sums, "amount", "l_partkey").select("l_partkey", "rank", "cum_pct")


SQL_PARETO_SUMS = "WITH s AS (SELECT l_partkey, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS amount FROM lineitem GROUP BY 1) " + \
    _ranked_sql("s", "amount", "l_partkey")


# scores per k from lines: k = quantity + 1, the figures are averages and sums of the lines of that quantity
_SWEEP = """sweep AS (SELECT CAST(l_quantity AS INT) + 1 AS k, CAST(AVG(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS silhouette,
  CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS ch, -CAST(SUM(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) AS db FROM lineitem GROUP BY 1)"""


def _sweep(spark, d):
    money = lambda c: F.col(c).cast(DecimalType(18, 2))
    by = _t(spark, d, "lineitem").groupBy((F.col("l_quantity").cast("int") + 1).alias("k"))
    return by.agg(F.avg(money("l_discount")).cast("double").alias("silhouette"), F.sum(money("l_extendedprice")).cast("double").alias("calinski_harabasz"),
                  (-F.sum(money("l_tax")).cast("double")).alias("neg_davies_bouldin"))


def choose_k_silhouette(spark, d):
    return CL.best_k_silhouette(_sweep(spark, d))


SQL_CHOOSE_K_SILHOUETTE = f"WITH {_SWEEP} SELECT k AS best_k FROM sweep ORDER BY silhouette DESC, k LIMIT 1"


def choose_k_vote(spark, d):
    return CL.best_k_vote(_sweep(spark, d))


SQL_CHOOSE_K_VOTE = f"WITH {_SWEEP}, votes AS (" + " UNION ALL ".join(
    f"(SELECT k, {i} AS o FROM sweep ORDER BY {m} DESC, k LIMIT 1)" for i, m in enumerate(("silhouette", "ch", "db"))) + \
    ") SELECT k AS best_k FROM votes GROUP BY k ORDER BY COUNT(*) DESC, MIN(o) LIMIT 1"


def sweep_one_cluster(spark, d):
    """F3 at k = 1: the spread around the mean, silhouette -1."""
    from pyspark.ml.feature import VectorAssembler
    v = VectorAssembler(inputCols=["p_size", "p_retailprice"], outputCol="features").transform(_t(spark, d, "part"))
    return CL.k_sweep(v, "features", range(1, 2)).select("k", rnd("sse", 2).alias("sse"), "silhouette")


SQL_SWEEP_ONE = f"SELECT 1 AS k, {R('COUNT(*) * (VAR_POP(p_size) + VAR_POP(p_retailprice))', 2)} AS sse, -1.0::DOUBLE AS silhouette FROM part"


def unclassified(spark, d):
    """F8: too few rows for clusters, here the totals of the two line states."""
    few = _t(spark, d, "lineitem").groupBy("l_linestatus").agg(F.sum("l_quantity").alias("quantity"))
    out = SEG.mixed_cluster(few, "l_linestatus", {"quantity": C.NUMERIC})["result"]
    return out.select("l_linestatus", "cluster_mixed")


SQL_UNCLASSIFIED = "SELECT DISTINCT l_linestatus, 'unclassified' AS cluster_mixed FROM lineitem"


def deep_page(spark, d):
    """The page of orders that follows the row in the middle of the order."""
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    seen = o.groupBy("o_orderpriority").agg(F.max("o_orderkey").alias("o_orderkey")).orderBy("o_orderpriority").offset(2).first()
    after = {"o_orderpriority": seen["o_orderpriority"], "o_orderkey": seen["o_orderkey"] // 2}
    return V.page_after(o, [("o_orderpriority", False)], ["o_orderkey"], after, 25)


SQL_DEEP_PAGE = """WITH s AS (SELECT o_orderpriority AS p, MAX(o_orderkey) // 2 AS k FROM orders GROUP BY 1 ORDER BY 1 LIMIT 1 OFFSET 2)
SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders, s WHERE o_orderpriority < p OR (o_orderpriority = p AND o_orderkey > k)
ORDER BY o_orderpriority DESC, o_orderkey LIMIT 25"""


def coercions(spark, d):
    """B4, B13 and U2 (``transform``): numbers and dates from text, bad ones missing."""
    def with_text(df, every):
        return df.withColumns({"n": F.when(F.col("o_orderkey") % every == 0, F.lit("n/a")).otherwise(F.concat(F.lit(" "), F.col("o_custkey").cast("string"))),
                               "t": F.when(F.col("o_orderkey") % every == 1, F.lit("soon")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))})
    out = _t(spark, d, "orders").transform(with_text, 5)
    return out.select("o_orderkey", to_number("n").alias("n"), F.to_date(to_ts("t")).cast("string").alias("t"))


SQL_COERCIONS = """SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey::DOUBLE END AS n,
  CASE WHEN o_orderkey % 5 <> 1 THEN strftime(o_orderdate, '%Y-%m-%d') END AS t FROM orders"""


def combined_text(spark, d):
    """Texts joined, blank ones dropped."""
    p = _t(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_brand")).alias("b"),
                                    F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("t"))
    out = V.drop_blank(V.combine_text(p, ["b", "t"]), "text_combined")
    C.assert_not_blank(out, "text_combined")
    return out.select("p_partkey", "text_combined")


SQL_COMBINED_TEXT = """WITH p AS (SELECT p_partkey, concat_ws(' ', CASE WHEN p_size > 10 THEN p_brand END, CASE WHEN p_size % 2 = 0 THEN p_type END) AS text_combined
FROM part) SELECT * FROM p WHERE trim(text_combined) <> ''"""


def attached(spark, d):
    """Labels attached by key, projection columns dropped."""
    c = _t(spark, d, "customer")
    r = c.where("c_nationkey > 3").select("c_custkey", (F.col("c_nationkey") % 3).alias("cluster"), F.lit(0.5).alias("p2_1"), F.lit(0.5).alias("p2_2"))
    return V.drop_projection(CB.attach(c.select("c_custkey", "c_name"), r, "c_custkey", ["cluster", "p2_1", "p2_2"]))


SQL_ATTACHED = "SELECT c_custkey, c_name, c_nationkey % 3 AS cluster FROM customer WHERE c_nationkey > 3"


def stats_display(spark, d):
    """H2: cluster statistics as texts, 'N/A' where a value is missing."""
    p = _t(spark, d, "part").select((F.col("p_partkey") % 4).alias("cluster"), F.when(F.col("p_partkey") % 4 > 0, F.col("p_size")).alias("p_size"))
    s = H.cluster_stats(p, "cluster", ["p_size"]).select("cluster", "p_size_mean", "p_size_median", "p_size_count")
    return V.format_view(s, ["p_size_mean", "p_size_median"], missing="N/A")


SQL_STATS_DISPLAY = """SELECT p_partkey % 4 AS cluster, COALESCE(printf('%.2f', AVG(CASE WHEN p_partkey % 4 > 0 THEN p_size END)), 'N/A') AS p_size_mean,
  COALESCE(printf('%.2f', MEDIAN(CASE WHEN p_partkey % 4 > 0 THEN p_size END)), 'N/A') AS p_size_median,
  COUNT(CASE WHEN p_partkey % 4 > 0 THEN p_size END) AS p_size_count FROM part GROUP BY 1"""


def numeric_and_text_columns(spark, d):
    """Which columns of a table are numeric, which are text."""
    c = _t(spark, d, "customer")
    names = [("numeric", x) for x in C.numeric_columns(c, ["c_nationkey"])] + [("text", x) for x in C.text_columns(c, [])]
    return c.limit(1).select(F.inline(F.array(*[F.struct(F.lit(a).alias("kind"), F.lit(b).alias("column")) for a, b in names])))


SQL_COLUMNS = """SELECT kind, "column" FROM (VALUES ('numeric', 'c_custkey'), ('numeric', 'c_acctbal'), ('text', 'c_name'), ('text', 'c_mktsegment'))
  v(kind, "column") WHERE EXISTS (SELECT 1 FROM customer)"""


def pareto_options(spark, d):
    """Clusters, numeric variables and display columns to choose from."""
    return P.pareto_options(_t(spark, d, "customer"), "c_nationkey")


SQL_PARETO_OPTIONS = """SELECT 'cluster' AS list, 'all' AS value UNION ALL SELECT DISTINCT 'cluster', c_nationkey::VARCHAR FROM customer
UNION ALL SELECT 'variable', unnest(['c_custkey', 'c_acctbal'])
UNION ALL SELECT 'display', unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment'])"""


def box_outliers(spark, d):
    """H8: order totals outside the whiskers of their status."""
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.pow(F.col("o_totalprice"), 4).alias("v"))
    return H.box_outliers(H.feature_long(o, "o_orderstatus", ["v"], ["o_orderkey"]), "o_orderstatus").select("o_orderkey", "o_orderstatus", "feature")


SQL_BOX_OUTLIERS = """WITH o AS (SELECT o_orderkey, o_orderstatus, pow(o_totalprice, 4) AS v FROM orders),
q AS (SELECT o_orderstatus, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM o GROUP BY 1)
SELECT o_orderkey, o.o_orderstatus, 'v' AS feature FROM o JOIN q USING (o_orderstatus) WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)"""


def _report(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("cluster"), F.col("c_acctbal").cast(DecimalType(18, 2)).alias("value"))
    return SEG.pareto_report(c, "value", "c_custkey", "cluster")


def pareto_report(spark, d):
    """The whole report, written and read back: rows per part."""
    r = _report(spark, d)
    csv, book = (IO.scratch_path(spark, x) for x in ("pareto-csv", "pareto-report"))
    IO.write_pareto_csv(csv, r["summary"], r["key_items"], r["pareto"])
    IO.write_pareto_report(book, r["summary"], r["recommendations"], r["key_items"], r["monitor"])
    parts = [(f"csv/{x}", IO.read_table(spark, f"{csv}/{x}", "csv")) for x in ("summary", "key_items", "full")]
    parts += [(f"report/{x}", IO.read_table(spark, f"{book}/{x}", "parquet")) for x in ("summary", "key_items")]
    out = None
    for name, df in parts:
        row = df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("part", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


_CUST = "SELECT c_custkey, CAST(c_acctbal AS DECIMAL(18,2)) AS value FROM customer"
SQL_PARETO_REPORT = f"WITH c AS ({_CUST}), r AS ({_ranked_sql('c', 'value', 'c_custkey')}), " \
    "k AS (SELECT COUNT(*) AS n FROM r WHERE cum_pct <= 80 OR rank = 1) " \
    "SELECT 'csv/summary' AS part, 1 AS n_rows UNION ALL SELECT 'report/summary', 1 UNION ALL SELECT 'csv/full', COUNT(*) FROM r " \
    "UNION ALL SELECT 'csv/key_items', n FROM k UNION ALL SELECT 'report/key_items', n FROM k"


def text_report(spark, d):
    """The text-cluster report, written and read back: documents per cluster folder."""
    from ..operators import text as T
    docs = _t(spark, d, "documents").select("doc_id", "lang", "n_chars")
    path = IO.scratch_path(spark, "text-report")
    stats = T.text_cluster_stats(docs, "lang")
    IO.write_text_report(path, docs.agg(F.count(F.lit(1)).alias("n")), docs, stats, stats.select("lang"), "lang", {"method": "given"})
    return spark.read.parquet(f"{path}/by_cluster").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars"))


SQL_TEXT_REPORT = "SELECT lang, COUNT(*) AS n, SUM(n_chars)::BIGINT AS n_chars FROM documents GROUP BY 1"


def flagged_in_chart(spark, d):
    """C11: elements of the chart inside the threshold."""
    c = _t(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast(DecimalType(18, 2)).alias("value"))
    return P.flagged_in_chart(P.pareto_chart_data(P.pareto(c, "value", "c_custkey"), "value", threshold=5.0))


SQL_FLAGGED = f"WITH c AS ({_CUST}), r AS ({_ranked_sql('c', 'value', 'c_custkey')}) " \
    "SELECT COUNT(*) AS n_shown, COUNT(CASE WHEN cum_pct <= 5 THEN 1 END) AS n_flagged FROM r WHERE rank <= 100"


QUERIES = {
    "pareto_gap": (pareto_gap, SQL_PARETO_GAP), "pareto_sums": (pareto_sums, SQL_PARETO_SUMS),
    "choose_k_silhouette": (choose_k_silhouette, SQL_CHOOSE_K_SILHOUETTE), "choose_k_vote": (choose_k_vote, SQL_CHOOSE_K_VOTE),
    "sweep_one_cluster": (sweep_one_cluster, SQL_SWEEP_ONE), "unclassified": (unclassified, SQL_UNCLASSIFIED),
    "deep_page": (deep_page, SQL_DEEP_PAGE),
    "coercions": (coercions, SQL_COERCIONS), "combined_text": (combined_text, SQL_COMBINED_TEXT),
    "attached": (attached, SQL_ATTACHED), "stats_display": (stats_display, SQL_STATS_DISPLAY),
    "numeric_and_text_columns": (numeric_and_text_columns, SQL_COLUMNS), "pareto_options": (pareto_options, SQL_PARETO_OPTIONS),
    "box_outliers": (box_outliers, SQL_BOX_OUTLIERS), "pareto_report": (pareto_report, SQL_PARETO_REPORT),
    "text_report": (text_report, SQL_TEXT_REPORT), "flagged_in_chart": (flagged_in_chart, SQL_FLAGGED),
}

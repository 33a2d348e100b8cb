"""Registered queries: cleaning and typing (B), views (C, A4, A11) and
features (E1-E5). Bindings from the blueprint: ``customer``, ``part``,
``orders`` and ``lineitem``; gaps and numeric texts are made deterministically
(the whole table is always read)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rnd
from ..operators import clean as C
from ..operators import features as FE
from ..operators import view as V
from .sqlbits import R


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def profile_columns(spark, d):
    return C.profile(_t(spark, d, "customer"))


_CUST_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
_CUST_TYPES = ["bigint", "string", "int", "double", "string"]
_NUM = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def _profile_sql(table, cols, types):
    parts = []
    for i, (c, t) in enumerate(zip(cols, types)):
        if t == "string":
            bad = f"COUNT(CASE WHEN {c} IS NOT NULL AND NOT regexp_matches(trim({c}), '{_NUM}') THEN 1 END)"
            blank = f"COUNT(CASE WHEN trim({c}) = '' THEN 1 END)"
        else:
            bad = blank = "CAST(0 AS BIGINT)"
        parts.append(f"SELECT {i} AS pos, '{c}' AS column, '{t}' AS dtype, COUNT(*) AS n_rows, COUNT({c}) AS n_non_null, "
                     f"COUNT(DISTINCT {c}) AS n_distinct, {bad} AS n_not_numeric, {blank} AS n_blank FROM {table}")
    return " UNION ALL ".join(parts)


SQL_PROFILE_COLUMNS = _profile_sql("customer", _CUST_COLS, _CUST_TYPES)


_PART_COLS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
_PART_TYPES = ["bigint", "string", "string", "string", "int", "double"]


def detect_types(spark, d):
    return C.detect_types(_t(spark, d, "part"))


SQL_DETECT_TYPES = f"""WITH p AS ({_profile_sql('part', _PART_COLS, _PART_TYPES)})
SELECT pos, "column", CASE WHEN dtype IN ('date', 'timestamp', 'timestamp_ntz') THEN 'date'
  WHEN dtype IN ('tinyint', 'smallint', 'int', 'bigint', 'float', 'double', 'boolean') OR dtype LIKE 'decimal%' THEN 'numeric'
  WHEN n_distinct / n_rows < 0.1 THEN 'categorical' ELSE 'text' END AS type FROM p"""

_ORD_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_ORD_TYPES = ["bigint", "bigint", "string", "double", "timestamp_ntz", "string"]


def categorical_candidates(spark, d):
    return C.categorical_candidates(_t(spark, d, "orders"), exclude=["o_orderstatus"])


SQL_CATEGORICAL_CANDIDATES = f"""WITH p AS ({_profile_sql('orders', _ORD_COLS, _ORD_TYPES)})
SELECT pos, "column", n_distinct FROM p WHERE (dtype = 'string' OR n_distinct <= 20) AND "column" <> 'o_orderstatus'"""


def sample_values(spark, d):
    return C.sample_values(_gappy_part(spark, d), ["p_name", "p_type", "p_size_gap", "p_retailprice"], "p_partkey")


def _gappy_part(spark, d):
    p = _t(spark, d, "part")
    return p.withColumn("p_size_gap", F.when(p.p_partkey % 3 != 1, p.p_size))


SQL_SAMPLE_VALUES = """WITH g AS (SELECT *, CASE WHEN p_partkey % 3 <> 1 THEN p_size END AS p_size_gap FROM part)
SELECT 0 AS pos, 'p_name' AS column, COALESCE(SUBSTR(ARG_MIN(p_name, p_partkey) FILTER (WHERE p_name IS NOT NULL), 1, 30), '') AS sample FROM g
UNION ALL SELECT 1, 'p_type', COALESCE(SUBSTR(ARG_MIN(p_type, p_partkey) FILTER (WHERE p_type IS NOT NULL), 1, 30), '') FROM g
UNION ALL SELECT 2, 'p_size_gap', COALESCE(SUBSTR(CAST(ARG_MIN(p_size_gap, p_partkey) FILTER (WHERE p_size_gap IS NOT NULL) AS VARCHAR), 1, 30), '') FROM g
UNION ALL SELECT 3, 'p_retailprice', COALESCE(SUBSTR(CAST(ARG_MIN(p_retailprice, p_partkey) FILTER (WHERE p_retailprice IS NOT NULL) AS VARCHAR), 1, 30), '') FROM g"""


def column_widths(spark, d):
    p = _t(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    return C.column_widths(p)


SQL_COLUMN_WIDTHS = " UNION ALL ".join(
    f"SELECT {i} AS pos, '{c}' AS column, LEAST(GREATEST(COALESCE(MAX(LENGTH(CAST({c} AS VARCHAR))), 0), {len(c)}) + 2, 50) AS width FROM part"
    for i, c in enumerate(["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]))


def _texty_part(spark, d):
    p = _t(spark, d, "part")
    return p.select("p_partkey", F.regexp_replace("p_brand", "Brand#", "").alias("brand_no"), "p_name",
                    F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" ")).alias("size_txt"),
                    F.lit(None).cast("string").alias("empty_col"))


def infer_numeric(spark, d):
    return C.infer_numeric(_texty_part(spark, d).drop("empty_col"))


SQL_INFER_NUMERIC = """SELECT p_partkey, CAST(regexp_replace(p_brand, 'Brand#', '') AS DOUBLE) AS brand_no, trim(p_name) AS p_name,
  CAST(trim(' ' || CAST(p_size AS VARCHAR) || ' ') AS DOUBLE) AS size_txt FROM part"""


def drop_empty(spark, d):
    return C.clean(_texty_part(spark, d))


SQL_DROP_EMPTY = SQL_INFER_NUMERIC


def impute_median(spark, d):
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
                                         F.when(F.col("l_partkey") % 7 != 0, F.col("l_quantity")).alias("q"))
    return C.impute_median(li, ["q"])


SQL_IMPUTE_MEDIAN = """WITH g AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
  CASE WHEN l_partkey % 7 <> 0 THEN l_quantity END AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
  COALESCE(q, (SELECT QUANTILE_CONT(q, 0.5) FROM g)) AS q FROM g"""


def impute_const(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey",
                                      F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("prio"))
    return C.impute_const(o, ["prio"], "missing")


SQL_IMPUTE_CONST = """SELECT o_orderkey, COALESCE(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END, 'missing') AS prio FROM orders"""


def date_parts(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey",
                                      F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate")).alias("dt"))
    return FE.date_parts(o, "dt")


SQL_DATE_PARTS = """WITH g AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate END AS dt FROM orders)
SELECT o_orderkey, dt, COALESCE(year(dt), -1) AS dt_year, COALESCE(month(dt), -1) AS dt_month,
  COALESCE(day(dt), -1) AS dt_day, COALESCE(isodow(dt) - 1, -1) AS dt_weekday FROM g"""


def standardize(spark, d):
    p = _t(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    z = FE.standardize(p, ["p_size", "p_retailprice"], suffix="_z")
    return z.select("p_partkey", rnd("p_size_z", 6).alias("p_size_z"), rnd("p_retailprice_z", 6).alias("p_retailprice_z"))


SQL_STANDARDIZE = f"""SELECT p_partkey,
  {R('(p_size - AVG(p_size) OVER ()) / STDDEV_POP(p_size) OVER ()', 6)} AS p_size_z,
  {R('(p_retailprice - AVG(p_retailprice) OVER ()) / STDDEV_POP(p_retailprice) OVER ()', 6)} AS p_retailprice_z
FROM part"""


def minmax(spark, d):
    p = _t(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    z = FE.minmax(p, ["p_size", "p_retailprice"], suffix="_mm")
    return z.select("p_partkey", rnd("p_size_mm", 6).alias("p_size_mm"), rnd("p_retailprice_mm", 6).alias("p_retailprice_mm"))


SQL_MINMAX = f"""SELECT p_partkey,
  {R('(p_size - MIN(p_size) OVER ()) / (MAX(p_size) OVER () - MIN(p_size) OVER ())', 6)} AS p_size_mm,
  {R('(p_retailprice - MIN(p_retailprice) OVER ()) / (MAX(p_retailprice) OVER () - MIN(p_retailprice) OVER ())', 6)} AS p_retailprice_mm
FROM part"""


def label_encode(spark, d):
    p = _t(spark, d, "part").select("p_partkey", "p_type", "p_brand")
    return FE.label_encode(p, ["p_type", "p_brand"])


SQL_LABEL_ENCODE = """SELECT p_partkey, p_type, p_brand,
  CAST(DENSE_RANK() OVER (ORDER BY p_type) - 1 AS INTEGER) AS p_type_code,
  CAST(DENSE_RANK() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS p_brand_code FROM part"""


def one_hot_long(spark, d):
    return FE.one_hot_long(_t(spark, d, "part"), "p_partkey", ["p_brand", "p_size"])


SQL_ONE_HOT_LONG = """SELECT p_partkey, 'p_brand=' || p_brand AS feature, 1.0 AS value FROM part WHERE p_brand IS NOT NULL
UNION ALL SELECT p_partkey, 'p_size=' || CAST(p_size AS VARCHAR), 1.0 FROM part WHERE p_size IS NOT NULL"""


def table_view(spark, d):
    p = _t(spark, d, "part")
    return V.table_view(p, where=[("p_name", "contains", "Red"), ("p_size", ">", 10)],
                        order_by=[("p_retailprice", False)], key=["p_partkey"], page=2, size=20)


SQL_TABLE_VIEW = """SELECT * FROM part WHERE lower(p_name) LIKE '%red%' AND p_size > 10
ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 40"""


def format_view(spark, d):
    p = _t(spark, d, "part").select("p_partkey", "p_retailprice", (F.col("p_size") * 2.0).alias("share"))
    return V.format_view(p, amounts=["p_retailprice"], pcts=["share"])


SQL_FORMAT_VIEW = """SELECT p_partkey, format('{:,.2f}', p_retailprice) AS p_retailprice,
  printf('%.1f%%', p_size * 2.0) AS share FROM part"""


def short_labels(spark, d):
    doc = _t(spark, d, "documents").select("doc_id", "text")
    return V.short_labels(doc, "text", 20).select("doc_id", "label")


SQL_SHORT_LABELS = """SELECT doc_id, CASE WHEN LENGTH(text) > 20 THEN SUBSTR(text, 1, 20) || '...' ELSE text END AS label FROM documents"""


def preview(spark, d):
    return V.preview(_t(spark, d, "part"), ["p_partkey"], 5)


SQL_PREVIEW = "SELECT * FROM part ORDER BY p_partkey LIMIT 5"


QUERIES = {
    "profile_columns": (profile_columns, SQL_PROFILE_COLUMNS),
    "detect_types": (detect_types, SQL_DETECT_TYPES),
    "categorical_candidates": (categorical_candidates, SQL_CATEGORICAL_CANDIDATES),
    "sample_values": (sample_values, SQL_SAMPLE_VALUES),
    "column_widths": (column_widths, SQL_COLUMN_WIDTHS),
    "infer_numeric": (infer_numeric, SQL_INFER_NUMERIC),
    "drop_empty": (drop_empty, SQL_DROP_EMPTY),
    "impute_median": (impute_median, SQL_IMPUTE_MEDIAN),
    "impute_const": (impute_const, SQL_IMPUTE_CONST),
    "date_parts": (date_parts, SQL_DATE_PARTS),
    "standardize": (standardize, SQL_STANDARDIZE),
    "minmax": (minmax, SQL_MINMAX),
    "label_encode": (label_encode, SQL_LABEL_ENCODE),
    "one_hot_long": (one_hot_long, SQL_ONE_HOT_LONG),
    "table_view": (table_view, SQL_TABLE_VIEW),
    "format_view": (format_view, SQL_FORMAT_VIEW),
    "short_labels": (short_labels, SQL_SHORT_LABELS),
    "preview": (preview, SQL_PREVIEW),
}

"""Registered queries: segment profiles (H1-H11, W5-W6), text (E6-E9,
H12-H15, A7), joins and sets (J, K, F11).

Bindings: ``lineitem`` segmented by return flag (A -> noise -1, N -> 0,
R -> 1); ``part`` by p_size % 4; ``documents`` by language; ``pages`` hrefs;
``labels`` as reviewer overrides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import rnd
from ..functions.text import stop_words
from ..operators import combine as K
from ..operators import profile as H
from ..operators import text as T
from .sqlbits import R


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


LKEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
FEATS = ["l_quantity", "l_extendedprice", "l_discount"]


def _seg_lines(spark, d):
    li = _t(spark, d, "lineitem")
    lab = F.when(F.col("l_returnflag") == "A", -1).when(F.col("l_returnflag") == "N", 0).otherwise(1)
    return li.select(*LKEYS, *FEATS, "l_linestatus", "l_tax", lab.alias("cluster"))


_SEG_SQL = """seg AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice,
  l_discount, l_linestatus, l_tax, CASE WHEN l_returnflag = 'A' THEN -1 WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS cluster
  FROM lineitem)"""


def cluster_stats(spark, d):
    s = H.cluster_stats(_seg_lines(spark, d), "cluster", FEATS)
    cols = [c for c in s.columns if c not in ("cluster", "percentage") and not c.endswith("_count")]
    return s.select("cluster", "percentage", *[c for c in s.columns if c.endswith("_count")],
                    *[rnd(c, 6).alias(c) for c in cols])


def _stats_sql():
    parts = []
    for f in FEATS:
        parts += [f"{R(f'AVG({f})', 6)} AS {f}_mean", f"{R(f'QUANTILE_CONT({f}, 0.5)', 6)} AS {f}_median",
                  f"{R(f'STDDEV_SAMP({f})', 6)} AS {f}_std", f"COUNT({f}) AS {f}_count"]
    return (f"SELECT cluster, {', '.join(parts)}, {R('COUNT(*) / SUM(COUNT(*)) OVER () * 100', 1)} AS percentage "
            f"FROM seg WHERE cluster IS NOT NULL GROUP BY cluster")


SQL_CLUSTER_STATS = f"WITH {_SEG_SQL} {_stats_sql()}"


def cluster_sizes(spark, d):
    return H.cluster_sizes(_seg_lines(spark, d), "cluster")


SQL_CLUSTER_SIZES = f"""WITH {_SEG_SQL}, g AS (SELECT cluster, COUNT(*) AS count FROM seg GROUP BY cluster)
SELECT cluster, count, {R('count / SUM(count) OVER () * 100', 2)} AS pct,
  ROW_NUMBER() OVER (ORDER BY cluster = -1, cluster) AS ord FROM g"""


def cluster_share(spark, d):
    return H.cluster_share(_seg_lines(spark, d), "cluster")


SQL_CLUSTER_SHARE = f"""WITH {_SEG_SQL}, g AS (SELECT cluster, COUNT(*) AS count FROM seg GROUP BY cluster)
SELECT cluster, count, {R('count / SUM(count) OVER ()', 6)} AS share FROM g"""


def cluster_index(spark, d):
    return H.cluster_index(_seg_lines(spark, d), "cluster", 10)


SQL_CLUSTER_INDEX = f"""WITH {_SEG_SQL}, g AS (SELECT DISTINCT cluster FROM seg)
SELECT cluster, CAST((ROW_NUMBER() OVER (ORDER BY cluster) - 1) % 10 AS INTEGER) AS palette_index FROM g WHERE cluster <> -1
UNION ALL SELECT cluster, CAST(NULL AS INTEGER) FROM g WHERE cluster = -1"""


def _part_seg(spark, d):
    p = _t(spark, d, "part")
    return p.select("p_partkey", (F.col("p_size") % 4).alias("cluster"), "p_size", "p_retailprice",
                    F.when(F.col("p_partkey") % 11 != 0, F.col("p_type")).alias("p_type"), "p_brand")


_PART_SEG_SQL = """pseg AS (SELECT p_partkey, p_size % 4 AS cluster, p_size, p_retailprice,
  CASE WHEN p_partkey % 11 <> 0 THEN p_type END AS p_type, p_brand FROM part)"""


def category_share(spark, d):
    return H.category_share(_part_seg(spark, d), "cluster", 2, "p_type", count_missing=True)


SQL_CATEGORY_SHARE = f"""WITH {_PART_SEG_SQL}, g AS (
  SELECT COALESCE(p_type, 'NaN_Category') AS p_type, COUNT(*) AS count FROM pseg WHERE cluster = 2 GROUP BY 1)
SELECT p_type, count, {R('count / SUM(count) OVER () * 100', 6)} AS pct FROM g"""


def category_share_present(spark, d):
    return H.category_share(_part_seg(spark, d), "cluster", 1, "p_type", count_missing=False)


SQL_CATEGORY_SHARE_PRESENT = f"""WITH {_PART_SEG_SQL}, g AS (
  SELECT p_type, COUNT(*) AS count FROM pseg WHERE cluster = 1 AND p_type IS NOT NULL GROUP BY 1)
SELECT p_type, count, {R('count / SUM(count) OVER () * 100', 6)} AS pct FROM g"""


def feature_long(spark, d):
    return H.feature_long(_seg_lines(spark, d), "cluster", FEATS, key=LKEYS)


SQL_FEATURE_LONG = f"""WITH {_SEG_SQL} """ + " UNION ALL ".join(
    f"SELECT {', '.join(LKEYS)}, cluster, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM seg" for f in FEATS)


def box_stats(spark, d):
    b = H.box_stats(H.feature_long(_seg_lines(spark, d), "cluster", FEATS, key=LKEYS), "cluster")
    return b.select("cluster", "feature", *[rnd(c, 6).alias(c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")],
                    "n_outliers")


SQL_BOX_STATS = f"""WITH {_SEG_SQL}, long AS ({SQL_FEATURE_LONG.replace(f'WITH {_SEG_SQL} ', '')}),
q AS (SELECT cluster, feature, QUANTILE_CONT(value, 0.25) AS q1, QUANTILE_CONT(value, 0.5) AS median,
  QUANTILE_CONT(value, 0.75) AS q3 FROM long WHERE value IS NOT NULL GROUP BY cluster, feature),
b AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT b.cluster, b.feature, {R('MAX(b.q1)', 6)} AS q1, {R('MAX(b.median)', 6)} AS median, {R('MAX(b.q3)', 6)} AS q3,
  {R('MIN(CASE WHEN value >= lo AND value <= hi THEN value END)', 6)} AS whisker_low,
  {R('MAX(CASE WHEN value >= lo AND value <= hi THEN value END)', 6)} AS whisker_high,
  COUNT(CASE WHEN NOT (value >= lo AND value <= hi) THEN 1 END) AS n_outliers
FROM long JOIN b USING (cluster, feature) GROUP BY b.cluster, b.feature"""


def feature_importance(spark, d):
    s = H.cluster_stats(_seg_lines(spark, d), "cluster", FEATS)
    return H.feature_importance(s, "cluster", FEATS, 10).withColumn("importance", rnd("importance", 6))


SQL_FEATURE_IMPORTANCE = f"""WITH {_SEG_SQL}, st AS ({_stats_sql().replace('SELECT cluster,', 'SELECT cluster, ' + ', '.join(f'AVG({f}) AS {f}_m, STDDEV_SAMP({f}) AS {f}_s' for f in FEATS) + ',')}),
ns AS (SELECT * FROM st WHERE CAST(cluster AS VARCHAR) <> '-1'),
imp AS (""" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, CASE WHEN AVG({f}_s) > 1e-9 THEN STDDEV_SAMP({f}_m) / AVG({f}_s) "
    f"WHEN AVG({f}_s) IS NOT NULL THEN 0.0 END AS importance FROM ns" for f in FEATS) + f""")
SELECT feature, {R('importance', 6)} AS importance,
  ROW_NUMBER() OVER (ORDER BY importance DESC NULLS LAST, feature) AS rank FROM imp QUALIFY rank <= 10"""


def cluster_cards(spark, d):
    c = H.cluster_cards(_seg_lines(spark, d).select("cluster", *FEATS, "l_linestatus"), "cluster")
    return c.select(*[rnd(x, 6).alias(x) if x.endswith("_mean") else x for x in c.columns])


SQL_CLUSTER_CARDS = f"""WITH {_SEG_SQL} SELECT cluster, COUNT(*) AS rows, """ + ", ".join(
    f"{R(f'AVG({f})', 6)} AS {f}_mean, COUNT({f}) AS {f}_count" for f in FEATS) + \
    ", COUNT(l_linestatus) AS l_linestatus_count FROM seg WHERE cluster IS NOT NULL GROUP BY cluster"


def varying_columns(spark, d):
    return H.varying_columns(_seg_lines(spark, d).select("cluster", *FEATS, "l_linestatus", "l_tax"), exclude=["cluster"], counted=True)


_VAR_COLS = FEATS + ["l_linestatus", "l_tax"]
SQL_VARYING_COLUMNS = f"WITH {_SEG_SQL}, v AS (" + " UNION ALL ".join(
    f"SELECT {i} AS pos, '{c}' AS \"column\", COUNT(DISTINCT {c}) AS n_distinct FROM seg" for i, c in enumerate(_VAR_COLS)) + \
    ") SELECT * FROM v WHERE n_distinct > 1"


# ---------------------------------------------------------------- text
_FR = stop_words("french_custom")
_SW_SQL = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in _FR) + "]"
_TOK_SQL = (r"list_filter(regexp_extract_all(lower(COALESCE(text, '')), '[\p{L}\p{Nl}\p{Nd}\p{M}\p{Pc}]{2,}'), "
            f"lambda x: NOT list_contains({_SW_SQL}, x))")


def _docs(spark, d):
    return _t(spark, d, "documents")


def tokens(spark, d):
    from ..functions.text import tokenize
    x = _docs(spark, d).select("doc_id", tokenize("text", stops=_FR).alias("t"))
    return x.select("doc_id", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


SQL_TOKENS = f"""SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, array_to_string(t, ' ') AS tokens
FROM (SELECT doc_id, {_TOK_SQL} AS t FROM documents)"""

_TC_SQL = f"""toks AS (SELECT doc_id, lang, unnest({_TOK_SQL}) AS term FROM documents),
tc AS (SELECT doc_id, lang, term, COUNT(*) AS tf FROM toks GROUP BY doc_id, lang, term)"""


def vocabulary(spark, d):
    tc = T.term_counts(_docs(spark, d), "doc_id", "text", stops=_FR)
    return T.vocabulary(tc, 10000)


SQL_VOCABULARY = f"""WITH {_TC_SQL}
SELECT term, COUNT(*) AS df, SUM(tf) AS total FROM tc GROUP BY term ORDER BY total DESC, term LIMIT 10000"""


def tfidf_long(spark, d):
    t = T.tfidf_long(_docs(spark, d), "doc_id", "text", 10000, _FR)
    return t.select("doc_id", "term", rnd("tfidf", 6).alias("tfidf"))


SQL_TFIDF_LONG = f"""WITH {_TC_SQL},
voc AS (SELECT term, COUNT(*) AS df, SUM(tf) AS total FROM tc GROUP BY term ORDER BY total DESC, term LIMIT 10000),
n AS (SELECT COUNT(*) AS n FROM documents),
w AS (SELECT tc.doc_id, tc.term, tc.tf * (ln((1 + n.n) / (1 + voc.df)) + 1) AS w FROM tc JOIN voc USING (term), n)
SELECT doc_id, term, {R('w / sqrt(SUM(w * w) OVER (PARTITION BY doc_id))', 6)} AS tfidf FROM w"""


def text_cluster_stats(spark, d):
    return T.text_cluster_stats(_docs(spark, d), "lang")


SQL_TEXT_CLUSTER_STATS = f"""WITH g AS (SELECT lang, COUNT(*) AS n_documents FROM documents WHERE lang IS NOT NULL GROUP BY lang)
SELECT lang, n_documents, {R('n_documents / SUM(n_documents) OVER () * 100', 2)} AS pct,
  printf('%.2f%%', {R('n_documents / SUM(n_documents) OVER () * 100', 2)}) AS pct_text,
  {R('n_documents / SUM(n_documents) OVER ()', 3)} AS density FROM g"""

_KW_SQL = f"""{_TC_SQL},
v0 AS (SELECT lang, term, COUNT(*) AS df, SUM(tf) AS total FROM tc GROUP BY lang, term),
voc AS (SELECT * FROM v0 QUALIFY ROW_NUMBER() OVER (PARTITION BY lang ORDER BY total DESC, term) <= 500),
n AS (SELECT lang, COUNT(*) AS n FROM documents GROUP BY lang),
w AS (SELECT tc.doc_id, tc.lang, tc.term, tc.tf * (ln((1 + n.n) / (1 + voc.df)) + 1) AS w
      FROM tc JOIN voc USING (lang, term) JOIN n USING (lang)),
nw AS (SELECT lang, term, w / sqrt(SUM(w * w) OVER (PARTITION BY lang, doc_id)) AS x FROM w),
sc AS (SELECT lang, term, SUM(x) AS score FROM nw GROUP BY lang, term),
top AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY score DESC, term) AS rank FROM sc QUALIFY rank <= 10)"""


def cluster_keywords(spark, d):
    return T.cluster_keywords(_docs(spark, d), "doc_id", "lang", "text", 10, 500, _FR)


SQL_CLUSTER_KEYWORDS = f"""WITH {_KW_SQL}
SELECT lang, COALESCE(string_agg(term, ', ' ORDER BY rank), 'N/A') AS keywords FROM top GROUP BY lang"""


def keyword_scores(spark, d):
    k = T.keyword_scores(_docs(spark, d), "doc_id", "lang", "text", 10, 500, _FR)
    return k.select("lang", "rank", "term", rnd("score", 6).alias("score"))


SQL_KEYWORD_SCORES = f"WITH {_KW_SQL} SELECT lang, rank, term, {R('score', 6)} AS score FROM top"


def keyword_weights(spark, d):
    k = T.keyword_scores(_docs(spark, d), "doc_id", "lang", "text", 10, 500, _FR)
    return T.keyword_weights(k, "lang").withColumn("weight", rnd("weight", 6))


SQL_KEYWORD_WEIGHTS = f"WITH {_KW_SQL} SELECT term, {R('ARG_MAX(score, lang)', 6)} AS weight FROM top GROUP BY term"


def text_totals(spark, d):
    return T.text_totals(_docs(spark, d), "lang")


SQL_TEXT_TOTALS = "SELECT COUNT(*) AS n_documents, COUNT(DISTINCT lang) AS n_clusters FROM documents"


def text_report_summary(spark, d):
    return T.text_report_summary(_docs(spark, d), "lang", ["text"])


SQL_TEXT_REPORT_SUMMARY = """SELECT 1 AS ord, 'documents' AS metric, CAST(COUNT(*) AS VARCHAR) AS value FROM documents
UNION ALL SELECT 2, 'clusters', CAST(COUNT(DISTINCT lang) AS VARCHAR) FROM documents
UNION ALL SELECT 3, 'columns analysed', 'text' UNION ALL SELECT 4, 'method', 'tf-idf + k-means'"""


# ---------------------------------------------------------------- sets, joins
HREF = r'href="(.*?)"'


def extract_set(spark, d):
    return K.extract_set(_t(spark, d, "pages"), "html", HREF)


SQL_EXTRACT_SET = """SELECT DISTINCT unnest(regexp_extract_all(html, 'href="(.*?)"', 1)) AS value FROM pages"""


def compare_sets(spark, d):
    p = _t(spark, d, "pages")
    a = K.extract_set(p.filter(F.col("url").contains("/en/")), "html", HREF)
    b = K.extract_set(p.filter(F.col("url").contains("/fr/")), "html", HREF)
    return K.compare_sets(a, b)


SQL_COMPARE_SETS = """WITH a AS (SELECT DISTINCT unnest(regexp_extract_all(html, 'href="(.*?)"', 1)) AS value FROM pages WHERE contains(url, '/en/')),
b AS (SELECT DISTINCT unnest(regexp_extract_all(html, 'href="(.*?)"', 1)) AS value FROM pages WHERE contains(url, '/fr/'))
SELECT COALESCE(a.value, b.value) AS value,
  CASE WHEN a.value IS NOT NULL AND b.value IS NOT NULL THEN 'both' WHEN a.value IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS side
FROM a FULL OUTER JOIN b ON a.value = b.value"""


def relabel(spark, d):
    docs = _docs(spark, d).select("doc_id", "lang")
    lab = _t(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("manual"))
    return K.relabel(docs, lab, "doc_id", "lang", "manual")


SQL_RELABEL = """SELECT d.doc_id, d.lang, l.manual, COALESCE(l.manual, d.lang) AS cluster_final
FROM documents d LEFT JOIN (SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END AS manual FROM labels) l
ON d.doc_id = l.doc_id"""


def consolidate(spark, d):
    num = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size", "p_retailprice",
                                      (F.col("p_size") % 3).alias("cluster_num"))
    txt = _docs(spark, d).select(F.col("doc_id").alias("id"), "lang", F.length("text").alias("n_chars_text"),
                                 F.when(F.col("lang") == "en", 0).otherwise(1).alias("cluster_text"),
                                 F.lit(0.5).alias("tsne_x"))
    mix = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster_mixed"),
                                            F.col("embedding")[0].cast("double").alias("p2_x"))
    return K.consolidate(numeric=num, text=txt, mixed=mix)


SQL_CONSOLIDATE = """SELECT 'numeric' AS source, p_partkey AS id, p_size, p_retailprice, p_size % 3 AS cluster_num,
  NULL::VARCHAR AS lang, NULL::INTEGER AS n_chars_text, NULL::INTEGER AS cluster_text, NULL::INTEGER AS cluster_mixed, NULL::DOUBLE AS p2_x FROM part
UNION ALL SELECT 'text', doc_id, NULL, NULL, NULL, lang, length(text), CASE WHEN lang = 'en' THEN 0 ELSE 1 END, NULL, NULL FROM documents
UNION ALL SELECT 'mixed', vec_id, NULL, NULL, NULL, NULL, NULL, NULL, label, CAST(embedding[1] AS DOUBLE) FROM embeddings"""


QUERIES = {
    "cluster_stats": (cluster_stats, SQL_CLUSTER_STATS),
    "cluster_sizes": (cluster_sizes, SQL_CLUSTER_SIZES),
    "cluster_share": (cluster_share, SQL_CLUSTER_SHARE),
    "cluster_index": (cluster_index, SQL_CLUSTER_INDEX),
    "category_share": (category_share, SQL_CATEGORY_SHARE),
    "category_share_present": (category_share_present, SQL_CATEGORY_SHARE_PRESENT),
    "feature_long": (feature_long, SQL_FEATURE_LONG),
    "box_stats": (box_stats, SQL_BOX_STATS),
    "feature_importance": (feature_importance, SQL_FEATURE_IMPORTANCE),
    "cluster_cards": (cluster_cards, SQL_CLUSTER_CARDS),
    "varying_columns": (varying_columns, SQL_VARYING_COLUMNS),
    "tokens": (tokens, SQL_TOKENS),
    "vocabulary": (vocabulary, SQL_VOCABULARY),
    "tfidf_long": (tfidf_long, SQL_TFIDF_LONG),
    "text_cluster_stats": (text_cluster_stats, SQL_TEXT_CLUSTER_STATS),
    "cluster_keywords": (cluster_keywords, SQL_CLUSTER_KEYWORDS),
    "keyword_scores": (keyword_scores, SQL_KEYWORD_SCORES),
    "keyword_weights": (keyword_weights, SQL_KEYWORD_WEIGHTS),
    "text_totals": (text_totals, SQL_TEXT_TOTALS),
    "text_report_summary": (text_report_summary, SQL_TEXT_REPORT_SUMMARY),
    "extract_set": (extract_set, SQL_EXTRACT_SET),
    "compare_sets": (compare_sets, SQL_COMPARE_SETS),
    "relabel": (relabel, SQL_RELABEL),
    "consolidate": (consolidate, SQL_CONSOLIDATE),
}

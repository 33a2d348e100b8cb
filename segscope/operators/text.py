"""Vocabulary, TF-IDF and per-cluster keywords.

TF-IDF follows the usual smooth form: weight = tf * (ln((1+n)/(1+df)) + 1),
then each document is L2-normalised over the kept vocabulary. Term counts are
aggregated per (document, term) with map-side combine, so only distinct pairs
cross the network; the corpus vocabulary of unique documents is counted by batch
without pairs. Vocabularies are bounded by ``max_features`` and joined by
broadcast; per-cluster vocabularies come from a salted two-round top-n so a
hot cluster never sits in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import literal_rows, rnd
from ..functions.text import DEFAULT_TOKEN, split_tokens, stop_words, tokenize
from ..session import Scratch
from .combine import join_small
from .rank import top_n

#: Kept terms up to which a vocabulary is sent to all tasks.
BROADCAST_TERMS = 500_000


def term_counts(df: DataFrame, key: str, text: str, pattern: str = DEFAULT_TOKEN,
                stops: list[str] | None = None, extra: list[str] | None = None) -> DataFrame:
    """(key, extra..., term, tf): raw count of each token in each document."""
    extra = extra or []
    toks = df.select(key, *extra, F.explode(split_tokens(text, pattern)).alias("term"))
    tc = toks.groupBy(key, *extra, "term").agg(F.count(F.lit(1)).alias("tf"))
    if stops:  # on distinct (document, term) pairs; a long IN list becomes a hash set
        tc = tc.filter(~F.col("term").isin(sorted(set(stops))))
    return tc


def vocabulary(tc: DataFrame, max_features: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Terms with document frequency and corpus count; cut to the
    ``max_features`` most frequent (ties by term) overall or per group ``by``."""
    by = by or []
    v = tc.groupBy(*by, "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
    if max_features is None:
        return v
    if not by:
        return most_frequent(v, max_features)
    return top_n(v, "total", max_features, by=by, tiebreak=["term"]).drop("_rn")


def most_frequent(terms: DataFrame, max_features: int) -> DataFrame:
    return terms.orderBy(F.col("total").desc(), F.col("term")).limit(max_features)


def _totals(batches):
    """Kernel: per batch of token lists, the rows that hold a term and how often it comes."""
    for batch in batches:
        tokens = batch.column(0)
        size = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
        words = tokens.flatten().dictionary_encode()
        code = words.indices.to_numpy(zero_copy_only=False).copy()
        end = np.cumsum(size)
        for a, z in zip((end - size).tolist(), end.tolist()):
            code[a:z].sort()
        first = np.empty(len(code), bool)  # of its term in its row
        first[:1] = True
        np.not_equal(code[1:], code[:-1], out=first[1:])
        first[(end - size)[size > 0]] = True
        many = len(words.dictionary)
        yield pa.RecordBatch.from_arrays([words.dictionary, pa.array(np.bincount(code[first], minlength=many)),
                                          pa.array(np.bincount(code, minlength=many))], ["term", "df", "total"])


def corpus_terms(df: DataFrame, key: str, text: str, pattern: str = DEFAULT_TOKEN, stops: list[str] | None = None) -> DataFrame:
    """``vocabulary`` of ``term_counts``, all terms. Where no key comes twice a row is a document, and terms are counted in its
    batch: (document, term) pairs, many times the terms, are neither moved nor sorted."""
    if not df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > 1).isEmpty():
        return vocabulary(term_counts(df, key, text, pattern, stops))
    found = df.select(split_tokens(text, pattern).alias("_tokens")).mapInArrow(_totals, "term string, df long, total long")
    if stops:
        found = found.filter(~F.col("term").isin(sorted(set(stops))))
    return found.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def tfidf_long(df: DataFrame, key: str, text: str, max_features: int | None = 10000,
               stops: list[str] | None = None, pattern: str = DEFAULT_TOKEN, by: list[str] | None = None) -> DataFrame:
    """E9 long form (key, [by...], term, tfidf). With ``by`` the model (n, df,
    vocabulary) is fitted separately inside each group, as a per-cluster
    vectoriser would be."""
    by = by or []
    if stops is None:
        stops = stop_words("french_custom")
    # texts move to their document's task before they are cut into terms, which are many times their size;
    # read twice (vocabulary and weights): the distinct (document, term) counts are
    # stored once in the shared folder, nothing stays cached
    scratch = Scratch(df.sparkSession, "terms")
    placed = df.select(*dict.fromkeys([*by, key, text])).repartition(*by, key)
    tc = scratch.save(term_counts(placed, key, text, pattern, stops, extra=by))
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")) if by else None
    voc = vocabulary(tc, max_features, by)
    if by:
        voc = join_small(voc, n, by, "inner")
        idf = F.log((1 + F.col("_n")) / (1 + F.col("df"))) + 1
    else:
        n_docs = df.agg(F.count(F.lit(1))).scalar()
        idf = F.log((1.0 + n_docs) / (1 + F.col("df"))) + 1
    voc = voc.select(*by, "term", idf.alias("idf"))
    if max_features is not None:  # few: without the count the plan would sort and move all pairs to meet them
        voc = scratch.save(voc)
        voc = F.broadcast(voc) if voc.count() <= BROADCAST_TERMS else voc
    w = join_small(tc, voc, by + ["term"], "inner").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*by, key)))
    return w.select(key, *by, "term", (F.col("w") / norm).alias("tfidf"))


def tfidf_vectors(df: DataFrame, key: str, text: str, max_features: int = 10000,
                  stops: list[str] | None = None, pattern: str = DEFAULT_TOKEN,
                  out: str = "features") -> DataFrame:
    """E9 vector form, all in the JVM: the vocabulary (bounded by
    ``max_features``, same choice as ``vocabulary``) becomes a fixed
    CountVectorizer model, the smooth idf a scaling vector, then L2 norm.
    Vectors stay sparse; documents without kept terms get a zero vector."""
    from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
    from pyspark.ml.linalg import DenseVector
    import math
    if stops is None:
        stops = stop_words("french_custom")
    toks = df.select(key, split_tokens(text, pattern).alias("_tokens"))
    few = most_frequent(corpus_terms(df, key, text, pattern, stops), max_features)
    voc = sorted((r["term"], r["df"]) for r in few.collect())  # <= max_features rows
    n_docs = df.count()
    if not voc:
        raise ValueError("no term left after tokenisation")
    terms = [t for t, _ in voc]
    idf = DenseVector([math.log((1.0 + n_docs) / (1.0 + d)) + 1.0 for _, d in voc])
    cv = CountVectorizerModel.from_vocabulary(terms, inputCol="_tokens", outputCol="_tf")
    d = cv.transform(toks)
    d = ElementwiseProduct(scalingVec=idf, inputCol="_tf", outputCol="_w").transform(d)
    d = Normalizer(p=2.0, inputCol="_w", outputCol=out).transform(d)
    return d.select(key, out)


def text_cluster_stats(df: DataFrame, label: str) -> DataFrame:
    """Documents per cluster, % of all (2 dp), relative density (3 dp)."""
    g = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n_documents"))
    pct = F.col("n_documents") / g.agg(F.sum("n_documents")).scalar() * 100
    return (g.withColumn("pct", rnd(pct, 2))
             .withColumn("pct_text", F.format_string("%.2f%%", rnd(pct, 2)))
             .withColumn("density", rnd(pct / 100, 3)))


def cluster_keywords(df: DataFrame, key: str, label: str, text: str, n: int = 10, max_features: int = 500,
                     stops: list[str] | None = None) -> DataFrame:
    """Per cluster, TF-IDF fitted inside the cluster (vocabulary of the
    ``max_features`` most frequent terms), summed over its documents; the top
    n terms (ties alphabetical) joined with ', '."""
    long = tfidf_long(df, key, text, max_features, stops, by=[label])
    score = long.groupBy(label, "term").agg(F.sum("tfidf").alias("score"))
    top = top_n(score, "score", n, by=[label], tiebreak=["term"])
    kw = top.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("_rn", "term"))).alias("_t"))
    kw = kw.select(label, F.array_join(F.transform("_t", lambda x: x["term"]), ", ").alias("keywords"))
    clusters = df.filter(F.col(label).isNotNull()).select(label).distinct()
    return clusters.join(kw, label, "left").select(label, F.coalesce("keywords", F.lit("N/A")).alias("keywords"))


def keyword_scores(df: DataFrame, key: str, label: str, text: str, n: int = 10, max_features: int = 500,
                   stops: list[str] | None = None) -> DataFrame:
    """The scores behind H13 in long form: (cluster, rank, term, score)."""
    long = tfidf_long(df, key, text, max_features, stops, by=[label])
    score = long.groupBy(label, "term").agg(F.sum("tfidf").alias("score"))
    return top_n(score, "score", n, by=[label], tiebreak=["term"]).withColumnRenamed("_rn", "rank")


def keyword_weights(scores: DataFrame, label: str) -> DataFrame:
    """One weight per word over all clusters; when several clusters share a
    word, the later cluster (largest label) wins, as a dict overwrite would."""
    return scores.groupBy("term").agg(F.max_by("score", F.col(label)).alias("weight"))


def text_totals(df: DataFrame, label: str) -> DataFrame:
    """Documents analysed and distinct clusters."""
    return df.agg(F.count(F.lit(1)).alias("n_documents"), F.count_distinct(label).alias("n_clusters"))


def text_report_summary(df: DataFrame, label: str, cols: list[str], method: str = "tf-idf + k-means") -> DataFrame:
    """The report's summary sheet as (metric, value) rows."""
    one = df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(label).alias("clusters"))
    rows = literal_rows(["ord", "metric", "value"],
                        [F.lit(1), F.lit("documents"), F.col("rows").cast("string")],
                        [F.lit(2), F.lit("clusters"), F.col("clusters").cast("string")],
                        [F.lit(3), F.lit("columns analysed"), F.lit(", ".join(cols))],
                        [F.lit(4), F.lit("method"), F.lit(method)])
    return one.select(F.inline(rows))

"""Quality rules (operator 9): hashed n-gram log-likelihood ratio between a
trusted target and the raw corpus, beside plain rules. DataFrame functions only.

The n-grams are pairs of neighbouring words by their *shape* (runs of small
letters, capitals and digits become a, A and 0; all else stays), hashed into
``BUCKETS`` buckets. Two multinomials are counted over all documents: the raw
corpus, and the target, the documents that ``labels`` call good. A document's
score is the mean over its n-grams of log(target share / raw share), so long and
short texts compare, and each document is kept or not by one fixed threshold:
no sampling, no dependence on order.

Base rules: fewer than ``min_words`` words, or more than half of the words
inside 3-word windows that the text has twice or more, fail at once.

Only the two counts per bucket reach the driver. Per document a task holds that
document's words.

Defined results: null and empty texts have zeros everywhere, score 0 and fail;
a null id has no label; repeated rows are judged one by one; several labels of
one id: good if any says so; no labels at all: every score is 0; an empty table
gives no rows; extra columns stay with ``judge`` and are ignored elsewhere.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, saved, words

BUCKETS = 1 << 14
THRESHOLD = -0.25  # nats per n-gram
MIN_WORDS = 50
RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def with_base(df: DataFrame, text: str = "text") -> DataFrame:
    """Add _w (words) and the base columns, prefixed with _q_."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumns({"_w": words(F.col(text)), "_lines": lines})
    df = df.withColumn("_win", F.when(F.size("_w") >= 3, F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("_w") - 3, F.lit(0))),
        lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))).otherwise(
        F.array().cast("array<bigint>")))
    # windows that stand twice or more: neighbours in sorted order; most texts have none
    df = df.withColumn("_twice", F.when(F.size(F.array_distinct("_win")) < F.size("_win"), F.sort_array(
        F.transform("_win", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    at = lambda k: F.get("_twice", k)["x"]
    found = F.sort_array(F.transform(F.filter("_twice", lambda e, k: F.coalesce(
        ((k > 0) & (F.get("_twice", F.greatest(k - 1, F.lit(0)))["x"] == e["x"])) | (at(k + 1) == e["x"]), F.lit(False))),
        lambda e: e["i"]))
    df = df.withColumn("_found", found)
    # words covered by those windows: a window adds what lies beyond the one before it
    covered = F.aggregate("_found", F.struct(F.lit(0).alias("c"), F.lit(-3).alias("last")), lambda a, x: F.struct(
        (a["c"] + F.least(F.lit(3), x - a["last"])).alias("c"), x.alias("last")), lambda a: a["c"])
    n, repeats = F.size("_w").cast("long"), F.coalesce(covered, F.lit(0)).cast("long")
    df = df.withColumns({
        "_q_n_words": n, "_q_word_chars": F.length(F.concat_ws("", "_w")).cast("long"),
        "_q_n_symbols": F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long"),
        "_q_n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_q_n_repeat_words": repeats})
    return df.withColumn("_q_base_failed", (F.col("_q_n_words") < MIN_WORDS)
                         | (100 * F.col("_q_n_repeat_words") > 50 * F.col("_q_n_words"))).drop("_win", "_twice", "_found", "_lines")


def with_buckets(df: DataFrame, text: str = "text") -> DataFrame:
    """Add _b: the bucket of each n-gram."""
    shape = F.coalesce(F.col(text), F.lit(""))
    for run, to in ((r"\p{Ll}+", "a"), (r"\p{Lu}+", "A"), (r"\p{Nd}+", "0")):
        shape = F.regexp_replace(shape, run, to)
    df = df.withColumn("_s", words(shape))
    pairs = F.zip_with(F.slice("_s", F.lit(1), F.greatest(F.size("_s") - 1, F.lit(0))),
                       F.slice("_s", F.lit(2), F.greatest(F.size("_s") - 1, F.lit(0))),
                       lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(BUCKETS)).cast("short"))
    return df.withColumn("_b", F.when(F.size("_s") < 2, F.array().cast("array<smallint>")).otherwise(pairs)).drop("_s")


def fit(bucketed: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> list[float]:
    """Weight of each bucket from all rows (doc_id, _b) and labels (doc_id, quality); add-one smoothing."""
    good = labels.groupBy("doc_id").agg(F.max("quality").alias("_good")).where("_good = 1")
    marked = bucketed.select(F.col(doc_id).alias("doc_id"), "_b").join(good, "doc_id", "left")
    rows = marked.select(F.explode("_b").alias("b"), F.coalesce("_good", F.lit(0)).alias("g")).groupBy("b").agg(
        F.count(F.lit(1)).alias("raw"), F.sum("g").alias("good")).collect()
    raw, target = [1] * BUCKETS, [1] * BUCKETS
    for r in rows:
        raw[r["b"]] += r["raw"]
        target[r["b"]] += r["good"]
    if sum(target) == BUCKETS:
        return [0.0] * BUCKETS
    shift = math.log(sum(raw)) - math.log(sum(target))
    return [math.log(t) - math.log(r) + shift for t, r in zip(target, raw)]


def score(weights: list[float]) -> Column:
    """Mean weight of the n-grams in _b; 0 without any."""
    table = F.split(F.lit(",".join(f"{w:.7g}" for w in weights)), ",").cast("array<double>")  # folds to a constant
    total = F.aggregate("_b", F.lit(0.0), lambda a, b: a + F.get(table, b.cast("int")))
    return F.when(F.size("_b") > 0, total / F.size("_b")).otherwise(F.lit(0.0))


def _verdict(df: DataFrame, weights: list[float], threshold: float) -> DataFrame:
    df = df.withColumn("_q_score", score(weights))
    return df.withColumn("_q_kept", ~F.col("_q_base_failed") & (F.col("_q_score") >= threshold))


def quality_table(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and the columns of RESULT, one row per input row."""
    rows = with_buckets(with_base(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))).drop("text", "_w")
    rows = saved(rows, "quality")
    out = _verdict(rows, fit(rows, labels), threshold)
    return out.select("doc_id", *[F.col(f"_q_{c}").alias(c) for c in RESULT])


def judge(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` that are kept, with its own columns: texts stay where they are, only buckets move."""
    rows = df.select(F.struct(*df.columns).alias("_row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    scratch = Scratch(df.sparkSession, "quality")
    weights = fit(scratch.save(with_buckets(rows.select("doc_id", "text")).select("doc_id", "_b")), labels)
    scratch.drop()
    out = _verdict(with_buckets(with_base(rows)), weights, threshold)
    # the row number keeps the filter above the arrays, which else are worked out anew in each lambda
    return out.withColumn("_at", F.monotonically_increasing_id()).where("_q_kept and _at >= 0").select("_row.*")

"""Toxicity (operator 2): gradient-boosted trees over dense features, with
isotonic calibration.

Features of a whole text (``FEATURES``): densities of lexicon words and of
lexicon word beginnings, hits close to a second person pronoun, the share of
capitals, of punctuation and of obfuscated words (letters with digits or signs
inside), and the length. The lexicon is learned: words, and word beginnings of
``STEMS`` letters, that stand in at least ``SUPPORT`` of the toxic training texts
(and in ``LEAST_SUPPORT``) and ``ODDS`` times as often there as in the others.

Learning uses at most about ``MAX_TRAIN`` labelled documents, chosen by hash of
their id: a bounded sample, so its label rows may be broadcast. The bound holds for
each class by itself (up to half, and what the other class leaves), so that a rare
class is kept whole; trees and calibration weigh a row by the rows it stands for.
Documents whose
crc32(id) mod 4 is 2 are never learned from; remainder 1 calibrates, 0 and 3
train lexicon and trees. Scoring covers every document; labels, language, source
and id are no inputs of a score.

Defined results: null and empty texts have features of 0 and the score that the
model gives them; a null id is held out; repeated rows are scored one by one;
several labels of one id count as toxic if any is; with too few labels of either
kind (``LEAST``) in a part, every score is the toxic share of the training labels
(0 without labels); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, saved, text_slices

MAX_TRAIN = 40_000
STEMS, SUPPORT, LEAST_SUPPORT, ODDS, LEXICON_SIZE = (4, 5), 0.01, 4, 20.0, 4000
NEAR = 5  # words between a lexicon word and a second person pronoun
LEAST = 10
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deinen ihr euch "
                          "euer sie ti tú usted ustedes vosotros su sus".split())
FEATURES = ("word_density", "stem_density", "word_hits", "stem_hits", "distinct_hits", "densest_window", "second_person_near",
            "second_person", "capitals", "punctuation", "obfuscated", "length")
_WORD = re.compile(r"[^\W\d_]+")
_OBFUSCATED = re.compile(r"[^\W\d_][@$!*0-9]+[^\W\d_]")
_UPPER, _PUNCTUATION = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def features(text: str, words_of: frozenset, stems_of: frozenset) -> list[float]:
    words = _WORD.findall(text.lower())
    n = max(1, len(words))
    hits = [i for i, w in enumerate(words) if w in words_of]
    stems = [i for i, w in enumerate(words) if w[:4] in stems_of or w[:5] in stems_of]
    person = np.array([i for i, w in enumerate(words) if w in SECOND_PERSON], np.int64)
    both = np.array(sorted({*hits, *stems}), np.int64)
    near = densest = 0
    if len(both):
        densest = int(np.max(np.searchsorted(both, both + 50) - np.arange(len(both))))
        if len(person):
            k = np.searchsorted(person, both)
            gap = np.minimum(np.abs(person[np.minimum(k, len(person) - 1)] - both), np.abs(person[np.maximum(k - 1, 0)] - both))
            near = int((gap <= NEAR).sum())
    raw = np.frombuffer(text.encode(), np.uint8)
    size = max(1, len(raw))
    return [1000 * len(hits) / n, 1000 * len(stems) / n, float(len(hits)), float(len(stems)),
            float(len({words[i] for i in both})), float(densest), float(near), 1000 * len(person) / n,
            float(_UPPER[raw].sum()) / size, float(_PUNCTUATION[raw].sum()) / size,
            1000 * len(_OBFUSCATED.findall(text)) / n, float(np.log1p(len(words)))]


def with_features(df: DataFrame, lexicon: tuple[frozenset, frozenset]) -> DataFrame:
    """(doc_id, text) -> doc_id, f."""
    def run(batches):
        for batch in text_slices(batches, 1):
            rows = [features(t or "", *lexicon) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "f"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, f array<double>")


def labelled(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """doc_id, text, toxic, part (0, 1 or 3), weight of at most about ``most`` labelled documents outside the held-out rows.
    Each class is bounded by itself, so that a rare one is kept whole; the weight is how many rows a row stands for."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.where(~held_out(F.col("doc_id")))
    have = {r["toxic"] != 0: r["count"] for r in marks.groupBy("toxic").count().collect()}
    fewer = {c: min(have.get(c, 0), most // 2) for c in (True, False)}
    share = {c: min(1.0, (most - fewer[not c]) / max(1, have.get(c, 0))) for c in (True, False)}
    share = F.when(F.col("toxic") != 0, share[True]).otherwise(share[False])
    marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000).withColumn("weight", 1 / share)
    marks = marks.withColumn("part", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4)
    return docs.join(F.broadcast(marks), "doc_id")  # at most about ``most`` rows of three numbers


def learn_lexicon(train: DataFrame, toxic: int, other: int) -> tuple[frozenset, frozenset]:
    """Words and beginnings of words that mark toxic texts; counted per document, at most LEXICON_SIZE of each."""
    terms = F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+"))
    found = []
    stems = F.concat(*[F.transform(F.filter(terms, lambda w: F.length(w) > n), lambda w: F.substring(w, 1, n)) for n in STEMS])
    for kind in (terms, F.array_distinct(stems)):
        counts = train.select("toxic", F.explode(kind).alias("w")).where("w <> ''").groupBy("w").agg(
            F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n"))
        odds = ((F.col("p") + 0.5) / toxic) / ((F.col("n") + 0.5) / other)
        top = counts.where((F.col("p") >= max(LEAST_SUPPORT, SUPPORT * toxic)) & (odds >= ODDS)).orderBy(F.desc("p"), "w").limit(LEXICON_SIZE)
        found.append(frozenset(r["w"] for r in top.collect()))
    return found[0], found[1]


def toxicity(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3,
             most: int = MAX_TRAIN, trees: int = 20, depth: int = 4) -> DataFrame:
    """doc_id, held_out, score, predicted; one row per input row. ``labels``: doc_id, toxic."""
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = saved(labelled(docs, marks, most), "toxicity-train")
    count = {(r["part"] == 1, r["toxic"]): r["count"] for r in known.groupBy((F.col("part") == 1).alias("part"), "toxic").count().collect()}
    held = held_out(F.col("doc_id")).alias("held_out")
    if min(count.get((c, y), 0) for c in (False, True) for y in (0, 1)) < LEAST:
        weights = {r["toxic"]: r["w"] for r in known.groupBy("toxic").agg(F.sum("weight").alias("w")).collect()}
        share = float(sum(w for y, w in weights.items() if y) / max(1.0, sum(weights.values())))
        scored = docs.select("doc_id", held, F.lit(share).alias("score"))
    else:
        train = known.where("part <> 1")
        lexicon = learn_lexicon(train, count[False, 1], count[False, 0])
        vectors = with_features(known, lexicon).join(known.select("doc_id", "toxic", "part", "weight").distinct(), "doc_id")
        vectors = saved(vectors, "toxicity-features").withColumn("features", array_to_vector("f")).withColumn("label", F.col("toxic").cast("double"))
        model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=7, subsamplingRate=1.0, weightCol="weight").fit(
            vectors.where("part <> 1").select("features", "label", "weight"))
        p = lambda d: model.transform(d).withColumnRenamed("features", "_f").withColumnRenamed("probability", "features")
        curve = IsotonicRegression(featureIndex=1, predictionCol="score", weightCol="weight").fit(
            p(vectors.where("part = 1")).select("features", "label", "weight"))
        every = with_features(docs, lexicon).withColumn("features", array_to_vector("f"))
        scored = curve.transform(p(every)).select("doc_id", held,
                                                  F.least(F.lit(1.0), F.greatest(F.lit(0.0), "score")).alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

"""Toxicity's held-out quality, and the pipeline's stages against brute force."""
import re

from pyspark.sql import functions as F

import corpus_pipeline
from segscope.llm import toxicity
from segscope.llm.common import held_out

D = "/root/testdata/sf0.01"


def test_toxicity_held_out(spark):
    """Learned on the larger table, judged on its held-out labels."""
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(0 <= r["score"] <= 1 for r in rows)
    true, found = (sum(bool(r[c]) for r in rows) for c in ("toxic", "predicted"))
    hit = sum(r["toxic"] and r["predicted"] for r in rows)
    assert hit >= 0.9 * true and hit >= 0.9 * found


def test_toxicity_odd_rows(spark):
    odd = spark.createDataFrame([(1, None, 0.5), (2, "", 0.1), (2, "", 0.1), (None, "text", 0.2), (3, "é" * 5000, 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    rows = toxicity.toxicity(odd, labels).collect()  # too few labels: the toxic share
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert toxicity.toxicity(odd.limit(0), labels.limit(0)).collect() == []
    f = toxicity.features("You IDIOT! st0pid, you.", frozenset({"idiot"}), frozenset({"idiot"}))
    assert len(f) == len(toxicity.FEATURES) and f[2] == f[3] == 1 and f[6] == 1 and f[10] > 0
    assert toxicity.features("", frozenset(), frozenset())[0] == 0.0


def test_held_out_rows(spark):
    import zlib
    rows = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in rows)


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").withColumn("_row", F.lit(1)).withColumn("node", F.lit("x"))
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, D)
        assert out.columns == docs.columns, name
        rows, kept = docs.collect(), {r["doc_id"] for r in out.collect()}
        if name == "quality_rules":  # good documents of 50 words and more stay, labelled junk goes
            assert all(r["doc_id"] in kept for r in rows if labels.get(r["doc_id"]) == 1 and len(r["text"].split()) >= 50)
            assert not any(r["doc_id"] in kept for r in rows if labels.get(r["doc_id"]) == 0)
        if name == "ngram_jaccard":
            sets = [(r["doc_id"], shingles(r["text"], 5)) for r in sorted(rows, key=lambda r: r["doc_id"])]
            root = {d: d for d, _ in sets}

            def find(d, root=root):
                while root[d] != d:
                    d = root[d]
                return d

            for i, (a, x) in enumerate(sets):
                for b, y in sets[:i]:
                    if x and 8 * len(y) <= 10 * len(x) and 8 * len(x) <= 10 * len(y) and 100 * len(x & y) >= 80 * len(x | y):
                        p, q = sorted((find(a), find(b)))
                        root[q] = p
            assert kept == {d for d, _ in sets if find(d) == d}
        docs = spark.createDataFrame(out.collect(), out.schema)
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, D)
    assert packed.select("doc_id").distinct().count() == sizes[-1]


def test_one_of_each_with_repeated_and_null_ids(spark):
    from segscope.llm.ngram_join import one_of_each
    a, b = "alpha beta gamma delta epsilon zeta", "one two three four five six"
    rows = [(1, a), (1, a), (2, a), (None, a), (None, b), (3, ""), (3, None), (4, "x y"), (4, b), (5, b)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, _id string")
    got = sorted(((r["doc_id"], r["text"]) for r in one_of_each(df).collect()), key=str)
    assert got == sorted([(1, a), (3, ""), (3, None), (4, "x y"), (4, b)], key=str)


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, D).collect() == []

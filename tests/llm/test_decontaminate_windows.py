"""Windows are hashed in one step, and as the items' windows are."""
from pyspark.sql import functions as F

from segscope.llm import decontaminate as D


def test_windows_without_lambdas(spark):
    texts = [(1, "a b c d"), (2, "a b"), (3, ""), (4, None), (5, "x")]
    rows = spark.createDataFrame(texts, "doc_id long, text string").select("doc_id", D.plain(F.col("text")).alias("t"))
    got = D._windows(rows, [2, 3], D.PLAIN, "doc_id")
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString().replace("lambdafunction", "lambda")
    want = []
    for i, text in texts:
        words = (text or "").split()
        want += [(i, at, n, words[at:at + n]) for n in (2, 3) for at in range(len(words) - n + 1)]
    spans = spark.createDataFrame(want, "doc_id long, pos int, n int, span array<string>")
    hashed = spans.select("doc_id", "pos", F.when(F.col("n") == 2, D._window_hash(F.col("span"), D.PLAIN, 2)).otherwise(
        D._window_hash(F.col("span"), D.PLAIN, 3)).alias("h"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, hashed.collect())) and len(want) == 6

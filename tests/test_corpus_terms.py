"""Terms counted without (document, term) pairs against the plain form."""
import pytest

from segscope.operators import text as T

TEXTS = [(1, "Alpha beta beta, gamma! x"), (2, None), (3, ""), (4, "beta; ALPHA alpha alpha le avec"), (5, "delta-delta beta"), (None, "beta gamma")]


@pytest.mark.parametrize("more", [[], [(1, "beta omega"), (None, "omega")]])
def test_terms_of_the_corpus_are_those_of_the_pairs(spark, monkeypatch, more):
    df = spark.createDataFrame(TEXTS + more, "id int, t string").repartition(2)
    want = {r["term"]: (r["df"], r["total"]) for r in T.vocabulary(T.term_counts(df, "id", "t", stops=["avec"])).collect()}
    if not more:  # without repeated keys no pairs are made
        def refuse(*a, **k):
            raise AssertionError("pairs")
        monkeypatch.setattr(T, "term_counts", refuse)
    got = {r["term"]: (r["df"], r["total"]) for r in T.corpus_terms(df, "id", "t", stops=["avec"]).collect()}
    assert got == want and got["beta"][1] == (5 if not more else 6) and "avec" not in got

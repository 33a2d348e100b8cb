import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


def test_without_the_training_data_operators(monkeypatch):
    """With the subpackage hidden, every other query is there; the pipeline goes with it."""
    import sys

    whole = set(E.queries())
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("segscope.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "segscope.llm", None)
    rest = set(E.queries())
    assert len(rest) > 90 and not any(q == "pipeline" or q.startswith("op") and q[2].isdigit() for q in rest)
    assert rest < whole or rest == whole and not any(q == "pipeline" for q in whole)
    assert set(E.oracle_sql()) <= rest

import datetime as dt

import pytest
from pyspark.sql import functions as F

from segscope.functions.text import tokenize
from segscope.operators import clean as C
from segscope.operators import combine as K
from segscope.operators import features as FE
from segscope.operators import text as T


def test_date_parts(spark):
    d = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, None)], "id int, d timestamp")
    out = {r["id"]: (r["d_year"], r["d_month"], r["d_day"], r["d_weekday"]) for r in FE.date_parts(d, "d").collect()}
    assert out == {1: (2024, 1, 1, 0), 2: (-1, -1, -1, -1)}


def test_infer_types(spark):
    d = spark.createDataFrame([("1", "1", None), (" 2 ", "x ", None)], "a string, b string, c string")
    out = C.clean(d)
    assert out.columns == ["a", "b"]
    assert dict(out.dtypes) == {"a": "double", "b": "string"}
    assert [r["b"] for r in out.collect()] == ["1", "x"]


def test_tokens(spark):
    d = spark.createDataFrame([("le Étion a bc_1 été",)], "t string")
    assert d.select(tokenize("t").alias("x")).first()["x"] == ["le", "étion", "bc_1", "été"]


def test_tfidf(spark):
    d = spark.createDataFrame([(1, "aa bb aa"), (2, "bb cc")], "id int, t string")
    got = {(r["id"], r["term"]): round(r["tfidf"], 6) for r in T.tfidf_long(d, "id", "t", None, stops=[]).collect()}
    assert got == {(1, "aa"): 0.942156, (1, "bb"): 0.335176, (2, "bb"): 0.579739, (2, "cc"): 0.814802}


def test_standardize_constant_column(spark):
    d = spark.createDataFrame([(1, 5.0), (2, 5.0)], "id int, x double")
    assert [r["x"] for r in FE.standardize(d, ["x"]).collect()] == [0.0, 0.0]
    assert [r["x"] for r in FE.minmax(d, ["x"]).collect()] == [0.0, 0.0]


def test_consolidate(spark):
    a = spark.createDataFrame([(1, 2.0)], "id int, x double")
    b = spark.createDataFrame([(2, 3.0)], "id int, q double")
    out = K.consolidate(numeric=a, text=b)
    assert out.columns == ["source", "id", "x", "q"]
    rows = {r["source"]: r for r in out.collect()}
    assert rows["numeric"]["q"] is None and rows["text"]["x"] is None


def test_validation(spark):
    d = spark.createDataFrame([(1, 2.0)], "id int, x double")
    with pytest.raises(C.ValidationError):
        C.validate(d, ["nope"])
    with pytest.raises(C.ValidationError):
        C.validate(d, ["x"], types={"x": "weird"})

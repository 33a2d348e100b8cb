"""Scalar to vector feature engineering.

Scaling statistics are one aggregate (a fitted model of 2 numbers per column,
collected) applied as literals, so the transform is a narrow projection.
"""

from __future__ import annotations

from pyspark.ml.feature import OneHotEncoder, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rank import ranked


def _num(c):
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v), v)


def standardize(df: DataFrame, cols: list[str], suffix: str = "") -> DataFrame:
    """(x - mean) / population std; a constant column gives 0.
    (``ml.StandardScaler`` uses the sample std, so it is not used.)"""
    st = df.agg(*[F.avg(_num(c)).alias(f"m{i}") for i, c in enumerate(cols)],
                *[F.stddev_pop(_num(c)).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    out = df
    for i, c in enumerate(cols):
        m, s = st[f"m{i}"], st[f"s{i}"]
        z = F.lit(0.0) if not s else (_num(c) - F.lit(m)) / F.lit(s)
        out = out.withColumn(c + suffix, F.when(_num(c).isNotNull(), z))
    return out


def minmax(df: DataFrame, cols: list[str], suffix: str = "") -> DataFrame:
    """(x - min) / (max - min); a constant column gives 0."""
    st = df.agg(*[F.min(_num(c)).alias(f"lo{i}") for i, c in enumerate(cols)],
                *[F.max(_num(c)).alias(f"hi{i}") for i, c in enumerate(cols)]).first()
    out = df
    for i, c in enumerate(cols):
        lo, hi = st[f"lo{i}"], st[f"hi{i}"]
        z = F.lit(0.0) if lo is None or hi == lo else (_num(c) - F.lit(lo)) / F.lit(hi - lo)
        out = out.withColumn(c + suffix, F.when(_num(c).isNotNull(), z))
    return out


def label_mapping(df: DataFrame, col: str, missing: str = "nan") -> DataFrame:
    """E3 mapping: (value, code) — code = position in the sorted distinct values
    of the column as text, missing taken as the text ``missing``. The distinct
    values are ranked by range partitions, not in one task."""
    vals = df.select(F.coalesce(F.col(col).cast("string"), F.lit(missing)).alias("value")).distinct()
    r = ranked(vals, [("value", True)])
    return r.select("value", (F.col("_rank") - 1).cast("int").alias("code"))


def label_encode(df: DataFrame, cols: list[str], missing: str = "nan", suffix: str = "_code") -> DataFrame:
    """Replace each category by its code (joined back on the value)."""
    out = df
    for c in cols:
        m = label_mapping(df, c, missing).withColumnRenamed("value", "_v").withColumnRenamed("code", c + suffix)
        out = (out.withColumn("_v", F.coalesce(F.col(c).cast("string"), F.lit(missing)))
                  .join(m, "_v", "left").drop("_v"))
    return out


def one_hot_long(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """E4 long form: (key, feature, 1.0) per present category; missing -> no row."""
    long = df.select(key, *[F.col(c).cast("string").alias(c) for c in cols]).unpivot([key], cols, "_c", "_v")
    return long.filter(F.col("_v").isNotNull()).select(key, F.concat("_c", F.lit("="), "_v").alias("feature"),
                                                       F.lit(1.0).alias("value"))


def one_hot_vectors(df: DataFrame, cols: list[str], out_col: str = "onehot") -> DataFrame:
    """E4 vector form: categories in alphabetical order, missing -> all zeros.
    The dictionary of a column is a table (``label_mapping``) that is joined;
    only its size reaches the driver."""
    idx = [f"_{c}_idx" for c in cols]
    vec = [f"_{c}_oh" for c in cols]
    d = df
    for c, i in zip(cols, idx):
        codes = label_mapping(df.where(F.col(c).isNotNull()), c).select(F.col("value").alias(f"{i}_v"), F.col("code").alias(i))
        size = codes.count()
        # an index of ``size`` is unknown to the encoder, whose slot for it is dropped
        nominal = {"ml_attr": {"type": "nominal", "name": i, "num_vals": max(size, 1)}}
        d = d.join(codes, F.col(c).cast("string") == F.col(f"{i}_v"), "left").drop(f"{i}_v")
        d = d.withColumn(i, F.coalesce(F.col(i), F.lit(max(size, 1))).cast("double").alias(i, metadata=nominal))
    oh = OneHotEncoder(inputCols=idx, outputCols=vec, dropLast=True, handleInvalid="keep")
    d = oh.fit(d).transform(d)
    d = VectorAssembler(inputCols=vec, outputCol=out_col).transform(d)
    return d.drop(*idx, *vec)


def date_parts(df: DataFrame, col: str, prefix: str | None = None) -> DataFrame:
    """E5: year, month, day, weekday (Monday = 0); missing -> -1 each."""
    p = prefix or col
    c = F.col(col)
    return (df.withColumn(f"{p}_year", F.coalesce(F.year(c), F.lit(-1)))
              .withColumn(f"{p}_month", F.coalesce(F.month(c), F.lit(-1)))
              .withColumn(f"{p}_day", F.coalesce(F.dayofmonth(c), F.lit(-1)))
              .withColumn(f"{p}_weekday", F.coalesce(F.weekday(c), F.lit(-1))))


def embedding_vectors(df: DataFrame, col: str, out: str) -> DataFrame:
    """A precomputed ``array<float>`` as a vector column of known length (that of the first row that has one;
    another length is an error)."""
    first = df.where(F.col(col).isNotNull()).select(F.size(col).alias("n")).first()
    d = df.withColumn(out, array_to_vector(F.col(col).cast("array<double>")))
    return VectorSizeHint(inputCol=out, size=first["n"] if first else 0, handleInvalid="error").transform(d)


def assemble(df: DataFrame, cols: list[str], out_col: str = "features", array_cols: list[str] | None = None) -> DataFrame:
    """Concatenate numeric columns, vector columns and precomputed
    ``array<float>`` embeddings (as vectors) in the given order."""
    d = df
    inputs = []
    for c in cols:
        if array_cols and c in array_cols:
            d = embedding_vectors(d, c, f"_{c}_vec")
            inputs.append(f"_{c}_vec")
        else:
            inputs.append(c)
    d = VectorAssembler(inputCols=inputs, outputCol=out_col, handleInvalid="keep").transform(d)
    return d.drop(*[i for i in inputs if i.startswith("_") and i.endswith("_vec")])

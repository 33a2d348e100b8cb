"""Cleaning, typing and column profiles.

Every profile number comes from one fused aggregate over the table (one scan);
the decisions taken from it (drop, cast, type) are a handful of scalars per
column, collected like a fitted model and applied lazily with ``select``.
Exact distinct counts are the default; ``approx=True`` switches to
HyperLogLog sketches (mergeable, bounded memory, no per-column row expansion).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, DateType, NumericType, StringType,
                               TimestampNTZType, TimestampType)

from ..functions.columns import NUMERIC_PATTERN

NUMERIC, CATEGORICAL, TEXT, DATE, VECTOR = "numeric", "categorical", "text", "date", "vector"


def _is_date(dt) -> bool:
    return isinstance(dt, (DateType, TimestampType, TimestampNTZType))


def _is_num(dt) -> bool:
    return isinstance(dt, (NumericType, BooleanType))


def _distinct(c, approx: bool):
    return F.approx_count_distinct(c) if approx else F.count_distinct(c)


def profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row per column — dtype, rows, non-missing, distinct, text values
    that do not parse as numbers, blank texts. One aggregate, then unpivot."""
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        aggs.append(F.count(c).alias(f"n{i}"))
        aggs.append(_distinct(c, approx).alias(f"d{i}"))
        if isinstance(f.dataType, StringType):
            t = F.trim(c)
            aggs.append(F.count(F.when(c.isNotNull() & ~t.rlike(NUMERIC_PATTERN), 1)).alias(f"b{i}"))
            aggs.append(F.count(F.when(t == "", 1)).alias(f"e{i}"))
        else:
            aggs.append(F.lit(0).cast("long").alias(f"b{i}"))
            aggs.append(F.lit(0).cast("long").alias(f"e{i}"))
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(f.name).alias("column"),
                              F.lit(f.dataType.simpleString()).alias("dtype"),
                              F.col("__rows").alias("n_rows"), F.col(f"n{i}").alias("n_non_null"),
                              F.col(f"d{i}").alias("n_distinct"), F.col(f"b{i}").alias("n_not_numeric"),
                              F.col(f"e{i}").alias("n_blank"))
                     for i, f in enumerate(df.schema.fields)])
    return one.select(F.inline(rows))


def detect_types(df: DataFrame, limit: float = 0.1, margin: float = 0.2) -> DataFrame:
    """(column, type): date by dtype, numeric by dtype (bool included),
    else categorical when distinct / rows < ``limit``, else text. Distinct values
    are estimated for all columns in one pass and counted only where the estimate
    is within ``margin`` (ten of its standard errors) of the limit."""
    fixed, open_ = {}, []
    for i, f in enumerate(df.schema.fields):
        dt = f.dataType.simpleString()
        if dt in ("date", "timestamp", "timestamp_ntz"):
            fixed[i] = DATE
        elif dt in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean") or dt.startswith("decimal"):
            fixed[i] = NUMERIC
        else:
            open_.append(i)
    col = lambda i: F.col(f"`{df.columns[i]}`")
    if open_:
        one = df.agg(F.count(F.lit(1)).alias("n"), *[F.approx_count_distinct(col(i), 0.02).alias(f"d{i}") for i in open_]).first()
        n = one["n"]
        near = [i for i in open_ if n and abs(one[f"d{i}"] / n - limit) <= margin * limit]
        exact = df.agg(*[F.count_distinct(col(i)).alias(f"d{i}") for i in near]).first() if near else {}
        for i in open_:
            distinct = exact[f"d{i}"] if i in near else one[f"d{i}"]
            fixed[i] = CATEGORICAL if n and distinct / n < limit else TEXT
    rows = [(i, c, fixed[i]) for i, c in enumerate(df.columns)]
    return df.sparkSession.createDataFrame(rows, "pos int, column string, type string")


def categorical_candidates(df: DataFrame, exclude: list[str] | None = None, max_distinct: int = 20,
                           approx: bool = False) -> DataFrame:
    """String columns, or columns with at most ``max_distinct`` values,
    except the excluded (cluster) columns."""
    exclude = set(exclude or [])
    p = profile(df, approx)
    keep = (F.col("dtype") == "string") | (F.col("n_distinct") <= max_distinct)
    return p.filter(keep & ~F.col("column").isin(list(exclude) or [""])).select("pos", "column", "n_distinct")


def numeric_columns(df: DataFrame, exclude: list[str] | None = None) -> list[str]:
    """Numeric columns by dtype (bool excluded), minus ``exclude``."""
    ex = set(exclude or [])
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in ex]


def text_columns(df: DataFrame, exclude: list[str] | None = None) -> list[str]:
    ex = set(exclude or [])
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and f.name not in ex]


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """B1: drop the columns that are missing in every row (NaN counts as missing)."""
    aggs = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.simpleString() in ("double", "float"):
            c = F.when(~F.isnan(c), c)
        aggs.append(F.count(c).alias(f.name))
    counts = df.agg(*aggs).first()
    return df.select(*[F.col(f"`{n}`") for n in df.columns if counts[n] > 0])


def infer_numeric(df: DataFrame) -> DataFrame:
    """B2: a text column becomes double when every non-missing value parses as
    a number (after trimming); otherwise it is trimmed."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    if not texts:
        return df
    one = df.agg(*[F.count(F.when(F.col(f"`{c}`").isNotNull() & ~F.trim(F.col(f"`{c}`")).rlike(NUMERIC_PATTERN), 1))
                   .alias(c) for c in texts]).first()
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in texts:
            t = F.trim(c)
            out.append((t.try_cast("double") if one[f.name] == 0 else t).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def clean(df: DataFrame) -> DataFrame:
    """The reference's cleaning step: B1 then B2."""
    return infer_numeric(drop_empty_columns(df))


def impute_median(df: DataFrame, cols: list[str]) -> DataFrame:
    """Missing (and NaN) -> the exact median of the column (linear
    interpolation); all columns in one pass (``column_quantiles``)."""
    from .stats import column_quantiles
    meds = column_quantiles(df, cols, 0.5) if cols else {}
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in meds:
            v = c.cast("double")
            v = F.when(~F.isnan(v), v)
            out.append(F.coalesce(v, F.lit(meds[f.name])).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def impute_const(df: DataFrame, cols: list[str], value) -> DataFrame:
    """Missing -> a constant (e.g. 'missing', '' or 'NaN_Category')."""
    return df.fillna({c: value for c in cols})


def sample_values(df: DataFrame, cols: list[str], order_by: str, n: int = 30) -> DataFrame:
    """First non-missing value of each column in ``order_by`` order, cut to n."""
    aggs = [F.min_by(F.col(c).cast("string"), F.when(F.col(c).isNotNull(), F.col(order_by))).alias(f"s{i}")
            for i, c in enumerate(cols)]
    rows = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(c).alias("column"),
                              F.coalesce(F.substring(F.col(f"s{i}"), 1, n), F.lit("")).alias("sample"))
                     for i, c in enumerate(cols)])
    return df.agg(*aggs).select(F.inline(rows))


def column_widths(df: DataFrame, cap: int = 50) -> DataFrame:
    """Display width per column: min(longest text incl. the header + 2, cap)."""
    aggs = [F.max(F.length(F.col(f"`{c}`").cast("string"))).alias(f"w{i}") for i, c in enumerate(df.columns)]
    rows = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(c).alias("column"),
                              F.least(F.greatest(F.coalesce(F.col(f"w{i}"), F.lit(0)), F.lit(len(c))) + 2,
                                      F.lit(cap)).alias("width"))
                     for i, c in enumerate(df.columns)])
    return df.agg(*aggs).select(F.inline(rows))


def assert_not_blank(df: DataFrame, col: str) -> None:
    """A text column must hold at least one non-blank value."""
    if df.filter(F.trim(F.col(col)) != "").limit(1).count() == 0:
        raise ValueError(f"column {col!r} is blank in every row")


class ValidationError(ValueError):
    pass


def validate(df: DataFrame, features: list[str], types: dict[str, str] | None = None,
             k_range: tuple[int, int] | None = None, min_features: int = 1) -> None:
    """Selected columns exist, enough features, k range valid, every
    feature typed with a supported type."""
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise ValidationError(f"unknown columns: {missing}")
    if len(features) < min_features:
        raise ValidationError(f"at least {min_features} features are needed")
    if k_range is not None:
        lo, hi = k_range
        if lo < 1 or hi < lo:
            raise ValidationError(f"invalid k range {k_range}")
    if types is not None:
        for c in features:
            t = types.get(c)
            if t is None:
                raise ValidationError(f"no type for {c!r}")
            if t not in (NUMERIC, CATEGORICAL, TEXT, DATE, VECTOR):
                raise ValidationError(f"unsupported type {t!r} for {c!r}")

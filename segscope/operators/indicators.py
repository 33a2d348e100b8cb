"""Budget-against-commitment indicators and KPIs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, NumericType, StringType

from ..functions.columns import NUMERIC_PATTERN, col_

UNDER, ON, OVER = "under", "on", "over"


def _exact_number(df: DataFrame, c: str):
    """Number as DECIMAL(38,10); text that does not parse and missing -> NULL."""
    dt = df.schema[c].dataType
    if isinstance(dt, NumericType):
        return F.col(c).cast("string").try_cast(DecimalType(38, 10)) if not isinstance(dt, DecimalType) \
            else F.col(c).cast(DecimalType(38, 10))
    s = F.trim(F.col(c).cast(StringType()))
    return F.when(s.rlike(NUMERIC_PATTERN), s.try_cast(DecimalType(38, 10)))


def money(df: DataFrame, c: str, digits: int = 2):
    """B3 for a column of ``df``: coerce, missing/bad -> 0, rounded (DECIMAL(18, digits))."""
    return F.coalesce(F.round(_exact_number(df, c), digits), F.lit(0)).cast(DecimalType(18, digits))


def rate_expr(initial, committed):
    """Committed / initial * 100 when initial > 0, else 0 (double)."""
    i, c = col_(initial), col_(committed)
    return F.when(i > 0, c.cast("double") / i.cast("double") * F.lit(100.0)).otherwise(F.lit(0.0))


def status_expr(rate):
    """D3: under (< 100), on (= 100), over (> 100)."""
    r = col_(rate)
    return F.when(r < 100, F.lit(UNDER)).when(r == 100, F.lit(ON)).otherwise(F.lit(OVER))


def indicators(df: DataFrame, initial: str, committed: str) -> DataFrame:
    """D1-D3. Amounts are coerced (bad/missing -> 0) and rounded to 2 first.
    Adds commit_gap (DECIMAL), commit_rate (double), commit_status."""
    i = money(df, initial)
    c = money(df, committed)
    out = df.withColumn("_i", i).withColumn("_c", c)
    out = (out.withColumn("commit_gap", (F.col("_c") - F.col("_i")).cast(DecimalType(19, 2)))
              .withColumn("commit_rate", rate_expr("_i", "_c")))
    return out.withColumn("commit_status", status_expr("commit_rate")).drop("_i", "_c")


def flag_rows(df: DataFrame, threshold: float | None = None) -> DataFrame:
    """The row flags the tables colour by (gap < 0, rate > 100, status),
    and, for a Pareto table, whether the row lies inside the threshold."""
    out = df
    if "commit_gap" in df.columns:
        out = out.withColumn("flag_negative_gap", F.col("commit_gap") < 0)
    if "commit_rate" in df.columns:
        out = out.withColumn("flag_over_rate", F.col("commit_rate") > 100)
    if "commit_status" in df.columns:
        out = out.withColumn("flag_over", F.col("commit_status") == OVER)
    if threshold is not None and "cum_pct" in df.columns:
        out = out.withColumn("flag_key", F.col("cum_pct") <= F.lit(float(threshold)))
    return out


def kpis(df: DataFrame, initial: str, committed: str) -> DataFrame:
    """D4 as one row: rows, sums of both amounts (unrounded, missing -> 0), mean
    rate over rows with initial > 0, sum of gaps, rows with rate > 100.
    Only additive aggregates, so it also runs on a streaming DataFrame (D6)."""
    i = F.coalesce(_exact_number(df, initial), F.lit(0).cast(DecimalType(38, 10)))
    c = F.coalesce(_exact_number(df, committed), F.lit(0).cast(DecimalType(38, 10)))
    w = df.select(i.alias("_i"), c.alias("_c"))
    w = w.withColumn("_r", rate_expr("_i", "_c"))
    return w.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("_i").cast("double").alias("total_initial"),
        F.sum("_c").cast("double").alias("total_committed"),
        F.avg(F.when(F.col("_i") > 0, F.col("_r"))).alias("mean_rate"),
        F.sum(F.col("_c") - F.col("_i")).cast("double").alias("total_gap"),
        F.count(F.when(F.col("_r") > 100, 1)).alias("n_over"),
    )

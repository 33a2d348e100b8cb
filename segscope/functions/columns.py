"""Column-level building blocks (all JVM-side expressions, no UDF).

Numbers that a user reads are rounded through a DECIMAL cast so that the
result does not depend on the summation order of the engine: the last-bit
noise of a double sum is far below the cast scale.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

# A number in text form: optional sign, digits with an optional fraction, optional
# exponent. Anything else (for instance '12d' or 'NaN') is not a number here.
NUMERIC_PATTERN = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"

MONEY = DecimalType(18, 2)


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c, digits: int = 2) -> Column:
    """Round half away from zero to ``digits``, returned as double."""
    return F.round(col_(c).cast("double").cast(DecimalType(38, digits + 6)), digits).cast("double")


def ratio_pct(part, whole, digits: int | None = 2) -> Column:
    """part / whole * 100 in double; NULL when whole is 0 or NULL."""
    p = col_(part).cast("double")
    w = col_(whole).cast("double")
    v = F.when(w != 0, p / w * F.lit(100.0))
    return rnd(v, digits) if digits is not None else v


def safe_div(a, b) -> Column:
    a, b = col_(a).cast("double"), col_(b).cast("double")
    return F.when(b != 0, a / b)


def is_numeric_text(c) -> Column:
    return F.trim(col_(c).cast("string")).rlike(NUMERIC_PATTERN)


def to_number(c) -> Column:
    """Coerce to double, anything that is not a number becomes NULL.
    NaN is mapped to NULL (the library's single notion of missing)."""
    c = col_(c)
    s = F.trim(c.cast("string"))
    v = F.when(s.rlike(NUMERIC_PATTERN), s.try_cast("double"))
    return F.when(~F.isnan(v), v)


def amount(c, digits: int = 2) -> Column:
    """Coerce to a money amount, missing or bad -> 0, rounded to ``digits``."""
    c = col_(c)
    s = F.trim(c.cast("string"))
    v = F.when(s.rlike(NUMERIC_PATTERN), s.try_cast(DecimalType(38, 10)))
    return F.coalesce(F.round(v, digits), F.lit(0)).cast(DecimalType(18, digits))


def to_ts(c) -> Column:
    """Parse a timestamp; unparseable text becomes NULL."""
    c = col_(c)
    return F.try_to_timestamp(F.trim(c.cast("string")))


def nan_to_null(c) -> Column:
    c = col_(c)
    return F.when(~F.isnan(c), c)


def short_label(c, n: int = 20) -> Column:
    """First n characters followed by '...' when longer."""
    s = col_(c).cast("string")
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit("..."))).otherwise(s)


def fmt_amount(c) -> Column:
    """Thousands separator and two decimals; empty text for missing."""
    return F.coalesce(F.format_number(col_(c).cast("double"), 2), F.lit(""))


def fmt_pct(c, digits: int = 1) -> Column:
    """C8: 'x.x%'; empty text for missing."""
    return F.coalesce(F.format_string(f"%.{digits}f%%", col_(c).cast("double")), F.lit(""))


def noise_last(c) -> Column:
    """W5 sort key: regular clusters ascending, noise (-1) last."""
    return (col_(c).cast("long") == -1)


def literal_rows(names: list[str], *rows) -> Column:
    """array<struct> of rows given as lists of Columns, fields named ``names``;
    ``inline`` turns it into rows."""
    return F.array(*[F.struct(*[c.alias(n) for c, n in zip(r, names)]) for r in rows])

"""Row presentation — combined text, table views with filters,
sorting and paging, display formats, short labels, previews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import fmt_amount, fmt_pct, short_label


def combine_text(df: DataFrame, cols: list[str], out: str = "text_combined") -> DataFrame:
    """C4: the non-missing text columns joined with one blank."""
    return df.withColumn(out, F.concat_ws(" ", *[F.col(c).cast("string") for c in cols]))


def drop_blank(df: DataFrame, col: str) -> DataFrame:
    """Drop rows whose text is blank."""
    return df.filter(F.trim(F.col(col)) != "")


_OPS = {"=": lambda c, v: c == v, "!=": lambda c, v: c != v, "<": lambda c, v: c < v,
        "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v}


def table_view(df: DataFrame, where: list[tuple[str, str, object]] | None = None,
               order_by: list[tuple[str, bool]] | None = None, key: list[str] | None = None,
               page: int | None = None, size: int = 10) -> DataFrame:
    """Column filters (case-insensitive 'contains', or a comparison),
    sort (ties by ``key``) and paging (page numbers from 0)."""
    out = df
    for col, op, val in where or []:
        c = F.col(col)
        if op == "contains":
            out = out.filter(F.lower(c.cast("string")).contains(str(val).lower()))
        else:
            out = out.filter(_OPS[op](c, F.lit(val)))
    order = [F.col(c).asc() if asc else F.col(c).desc() for c, asc in (order_by or [])]
    order += [F.col(k).asc() for k in (key or [])]
    if order:
        out = out.orderBy(*order)
    if page is not None:
        out = out.offset(page * size).limit(size)
    return out


def page_after(df: DataFrame, order_by: list[tuple[str, bool]], key: list[str], after: dict | None = None,
               size: int = 10) -> DataFrame:
    """C6 for deep pages: the ``size`` rows that follow the last row seen, given by its values of the order columns and the
    key (none: the first page). Only rows after it are looked at, and each task keeps ``size`` of them, so a page costs the
    same wherever it is. NULL stands first in ascending and last in descending order."""
    order = [*order_by, *[(k, True) for k in key]]
    out = df
    if after:
        later, same = F.lit(False), F.lit(True)
        for c, asc in order:
            v = after[c]
            beyond = F.col(c).isNotNull() if v is None and asc else F.lit(False) if v is None else \
                F.coalesce(F.col(c) > F.lit(v), F.lit(False)) if asc else F.col(c).isNull() | (F.col(c) < F.lit(v))
            later, same = later | (same & beyond), same & F.col(c).eqNullSafe(F.lit(v))
        out = out.where(later)
    return out.orderBy(*[F.col(c).asc() if asc else F.col(c).desc() for c, asc in order]).limit(size)


def preview(df: DataFrame, order_by: list[str], n: int = 5) -> DataFrame:
    """A4: the first n rows in key order."""
    return df.orderBy(*order_by).limit(n)


def format_view(df: DataFrame, amounts: list[str] = (), pcts: list[str] = (), digits: int = 1,
                missing: str = "") -> DataFrame:
    """Amounts as '1,234.56', percentages as 'x.x%', missing values as
    ``missing`` ('' in tables and cards, 'N/A' in cluster statistics)."""
    show = lambda c, text: F.when(F.col(c).isNull(), F.lit(missing)).otherwise(text)
    return df.withColumns({**{c: show(c, fmt_amount(c)) for c in amounts}, **{c: show(c, fmt_pct(c, digits)) for c in pcts}})


def short_labels(df: DataFrame, col: str, n: int = 20, out: str = "label") -> DataFrame:
    """label = first n characters + '...' when longer."""
    return df.withColumn(out, short_label(col, n))


PROJECTION_PREFIXES = ("p2_", "p3_", "tsne_")


def drop_projection(df: DataFrame) -> DataFrame:
    """Remove the low-dimensional projection columns."""
    return df.drop(*[c for c in df.columns if c.startswith(PROJECTION_PREFIXES)])

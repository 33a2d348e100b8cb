"""Ranks and running sums over a total order, without a single-partition window.

``Window.orderBy(...)`` with no partition moves every row into one task. The
scale form used here:

1. One pass over the sort keys alone counts the rows and draws a bounded sample
   from each partition (``SAMPLE_PER_PARTITION`` rows); the driver cuts it into
   B contiguous key ranges (bucket boundaries). Ties on the value are split by
   the tie-break keys, so a hot value still spreads over many buckets.
2. Each row's bucket is a pure function of its sort key and the boundaries
   (vectorised lexicographic search in an Arrow scalar function, which only the
   key columns enter; other columns stay in the JVM and can be pruned). Nothing
   depends on partition ids, so any re-execution (lost executor, a plan that
   evaluates the input twice) gives the same buckets.
3. A window partitioned by bucket computes the local row number and running
   sum in the JVM; per-bucket counts and sums (at most B rows) give the
   offsets, joined back by broadcast (size bounded by B).

B is one bucket per ``ROWS_PER_BUCKET`` rows, at most ``BUCKETS_PER_PARTITION``
times the session's shuffle partitions: a bucket is one window partition, so
whoever raises the shuffle partitions for larger data raises the bound with it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, DateType, DecimalType, LongType, StructField, StructType, TimestampNTZType,
                               TimestampType)

ROWS_PER_BUCKET = 1_000_000
BUCKETS_PER_PARTITION = 32
SAMPLE_PER_PARTITION = 512


def _sort_cols(order):
    return [F.col(c).asc() if asc else F.col(c).desc() for c, asc in order]


def _key_expr(df: DataFrame, c: str):
    """An exactly comparable stand-in for a sort column: numbers stay numbers
    (decimals that fit a long as unscaled integers, wider ones as they are),
    times become integers, text stays text."""
    dt = df.schema[c].dataType
    col = F.col(c)
    if isinstance(dt, DecimalType):
        return (col * F.lit(10 ** dt.scale)).cast("long") if dt.precision <= 18 else col
    if isinstance(dt, TimestampType):
        return F.unix_micros(col)
    if isinstance(dt, TimestampNTZType):
        return F.unix_micros(col.cast("timestamp"))
    if isinstance(dt, DateType):
        return F.unix_date(col)
    if isinstance(dt, BooleanType):
        return col.cast("int")
    return col


def _codes(vals, isnull, bnd, asc: bool):
    """Integer codes that order rows and boundaries together (nulls first when
    ascending, last when descending, as Spark sorts). ``vals`` is a numpy array
    (numeric, or object for text) with ``isnull`` marking missing rows."""
    bnull = np.array([v is None for v in bnd], dtype=bool)
    if vals.dtype == object:
        known = next((v for v in [*bnd, *vals] if v is not None), "")
        bv = np.array([v if v is not None else known for v in bnd], dtype=object)
        filled = np.array([known if m else v for v, m in zip(vals, isnull)], dtype=object)
    else:
        bv = np.array([v if v is not None else 0 for v in bnd], dtype=vals.dtype)
        filled = np.where(isnull, 0, vals)
    allv = np.concatenate([filled, bv])
    nulls = np.concatenate([isnull, bnull])
    _, inv = np.unique(allv, return_inverse=True)
    inv = inv.astype(np.int64) + 1
    inv[nulls] = 0
    if not asc:
        inv = -inv
        inv[nulls] = np.iinfo(np.int64).max
    return inv


def _column_values(arr):
    """numpy values + null mask for an Arrow column (numbers stay numeric)."""
    import pyarrow.compute as pc
    isnull = arr.is_null().to_numpy(zero_copy_only=False)
    t = arr.type
    if pa.types.is_integer(t):
        return pc.fill_null(arr, 0).to_numpy(zero_copy_only=False).astype(np.int64), isnull
    if pa.types.is_floating(t):
        return pc.fill_null(arr, 0.0).to_numpy(zero_copy_only=False).astype(np.float64), isnull
    return np.array(arr.to_pylist(), dtype=object), isnull


def _bucket(keys: list[str], asc: list[bool], bounds: list[tuple]):
    """Column: the number of boundaries <= the row's key."""
    nb = len(bounds)

    @F.arrow_udf("int")
    def run(*columns: pa.Array) -> pa.Array:
        m = len(columns[0])
        cols = [_codes(*_column_values(c), [t[j] for t in bounds], asc[j]) for j, c in enumerate(columns)]
        flag = np.concatenate([np.ones(m, dtype=np.int64), np.zeros(nb, dtype=np.int64)])
        order = np.lexsort([flag] + cols[::-1])  # primary key last for lexsort
        place = np.empty(m + nb, dtype=np.int64)
        place[order] = np.cumsum(order >= m)
        return pa.array(place[:m].astype(np.int32))

    return run(*keys) if nb else F.lit(0)


def _sampled(work: DataFrame, keys: list[str]) -> tuple[int, list[tuple[float, tuple]]]:
    """(row count, [(rows it stands for, key)]) in one pass over the key columns."""
    rows = work.select(*keys)

    def run(batches):
        rng = np.random.Generator(np.random.PCG64(17))
        n, kept, draw = 0, None, np.zeros(0)
        for b in batches:
            n += b.num_rows
            new = rng.random(b.num_rows)
            both = pa.Table.from_batches([b]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([b])])
            draw = np.concatenate([draw, new])
            best = np.argsort(draw, kind="stable")[:SAMPLE_PER_PARTITION]
            kept, draw = both.take(best), draw[best]
        if kept is not None:
            kept = kept.append_column("_n", pa.array(np.full(kept.num_rows, n, np.int64)))
            kept = kept.append_column("_m", pa.array(np.full(kept.num_rows, kept.num_rows, np.int64)))
            kept = kept.append_column("_i", pa.array(np.arange(kept.num_rows)))
            yield from kept.combine_chunks().to_batches()

    fields = [*rows.schema.fields, *[StructField(c, LongType()) for c in ("_n", "_m", "_i")]]
    got = [tuple(r) for r in rows.mapInArrow(run, StructType(fields)).collect()]
    return sum(r[-3] for r in got if r[-1] == 0), [(r[-3] / r[-2], r[:-3]) for r in got]


def _boundaries(sample: list[tuple[float, tuple]], asc: list[bool], B: int) -> list[tuple]:
    if B <= 1 or not sample:
        return []

    def sk(t):  # Spark order: ascending puts NULL first, descending puts NULL last; NaN above all numbers
        out = []
        for v, a in zip(t, asc):
            null, nan = v is None, v != v
            v = 0 if null or nan else v
            out.append(((not null) if a else null, nan if a else not nan, v if a else _neg(v)))
        return tuple(out)

    sample = sorted(sample, key=lambda x: sk(x[1]))
    step = sum(x for x, _ in sample) / B
    out, passed = [], 0.0
    for weight, t in sample:
        if passed >= step * (len(out) + 1) and (not out or t != out[-1]):
            out.append(t)
        passed += weight
    return out[:B - 1]


class _Neg:
    __slots__ = ("v",)

    def __init__(self, v):
        self.v = v

    def __lt__(self, o):
        return self.v > o.v

    def __eq__(self, o):
        return self.v == o.v


def _neg(v):
    return -v if isinstance(v, (int, float)) else _Neg(v)


def ranked(df: DataFrame, order: list[tuple[str, bool]], value: str | None = None,
           n_ranges: int | None = None) -> DataFrame:
    """Any orderable columns: decimals of any width, text, times, NULL and NaN
    (in Spark's order). Row number ``_rank`` (1-based) in the total order ``order`` (list of
    (column, ascending)), plus ``_cum`` = running sum of ``value`` up to and
    including the row, ``_n`` = row count and ``_total`` = sum of ``value``.

    The order must be total (end it with a unique key) for a deterministic
    result. DECIMAL values give exact DECIMAL(38, s) sums; other numbers give
    double sums (summed in order inside a bucket, then offset).
    """
    keys = [f"_k{i}" for i in range(len(order))]
    asc = [a for _, a in order]
    work = df
    for (c, _), k in zip(order, keys):
        work = work.withColumn(k, _key_expr(df, c))
    n, sample = _sampled(work, keys)
    spark = df.sparkSession
    per = int(spark.conf.get("segscope.rank.rowsPerBucket", str(ROWS_PER_BUCKET)))
    most = BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    B = int(n_ranges) if n_ranges else max(1, min(most, math.ceil(n / per)))
    bucketed = work.withColumn("_b", _bucket(keys, asc, _boundaries(sample, asc, B))).drop(*keys)

    sort_cols = _sort_cols(order)
    w = Window.partitionBy("_b").orderBy(*sort_cols)
    local = bucketed.withColumn("_lrn", F.row_number().over(w))
    if value is not None:
        dt = df.schema[value].dataType
        vsum = F.col(value).cast(DecimalType(38, dt.scale)) if isinstance(dt, DecimalType) else F.col(value).cast("double")
        local = local.withColumn("_lcum", F.sum(vsum).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # bucket totals from the window output itself (already clustered by bucket:
    # no new exchange, and both branches read one exchange): count = last row
    # number, sum = last running sum. At most B rows.
    aggs = [F.max("_lrn").alias("_pn")]
    if value is not None:
        aggs.append(F.max_by("_lcum", "_lrn").alias("_pt"))
    totals = local.groupBy("_b").agg(*aggs)
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    offs = [F.col("_b"), F.coalesce(F.sum("_pn").over(before), F.lit(0)).alias("_on"),
            F.sum("_pn").over(whole).alias("_n")]
    if value is not None:
        zero = F.lit(0).cast(DecimalType(38, dt.scale)) if isinstance(dt, DecimalType) else F.lit(0.0)
        offs += [F.coalesce(F.sum("_pt").over(before), zero).alias("_ot"), F.sum("_pt").over(whole).alias("_total")]
    offsets = totals.select(*offs)
    out = local.join(F.broadcast(offsets), "_b")  # bounded: B rows
    out = out.withColumn("_rank", F.col("_on") + F.col("_lrn"))
    if value is not None:
        out = out.withColumn("_cum", F.col("_ot") + F.col("_lcum"))
        if isinstance(dt, DecimalType):
            out = out.withColumn("_cum", F.col("_cum").cast(DecimalType(38, dt.scale))) \
                     .withColumn("_total", F.col("_total").cast(DecimalType(38, dt.scale)))
    return out.drop("_b", "_lrn", "_on", "_lcum", "_ot")


def window_ranked(df: DataFrame, order: list[tuple[str, bool]], value: str | None = None) -> DataFrame:
    """Reference form (single-partition window); used by tests to check ``ranked``."""
    w = Window.orderBy(*_sort_cols(order))
    out = df.withColumn("_rank", F.row_number().over(w))
    out = out.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
    if value is not None:
        out = (out.withColumn("_cum", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
                  .withColumn("_total", F.sum(value).over(Window.partitionBy())))
    return out


def average_rank(df: DataFrame, col: str, out: str, tiebreak: list[str], ascending: bool = False) -> DataFrame:
    """Pandas-style average rank of ties: ties share the mean of the
    positions they occupy. ``tiebreak`` makes the order total."""
    r = ranked(df, [(col, ascending), *[(t, True) for t in tiebreak]])
    return r.withColumn(out, F.avg("_rank").over(Window.partitionBy(col)).cast("double")).drop("_rank", "_n")


def top_n(df: DataFrame, score: str, n: int, by: list[str] | None = None,
          tiebreak: list[str] | None = None, salt: int | None = None) -> DataFrame:
    """Top n rows by ``score`` (descending), overall or per group ``by``.

    Per group it runs in two rounds: first the top n inside (group, hash(tie) %
    salt), then the top n of those candidates. A hot group is thus split over
    ``salt`` tasks (by default the session's shuffle partitions), and the second
    round sees at most salt*n rows per group.
    Exact: every global top-n row is in the top n of its own salt cell.
    """
    tiebreak = tiebreak or []
    salt = salt or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(score).desc()] + [F.col(t).asc() for t in tiebreak]
    if not by:
        return df.orderBy(*order).limit(n)
    salt_col = F.pmod(F.xxhash64(*[F.col(t) for t in (tiebreak or [score])]), F.lit(salt))
    first = (df.withColumn("_salt", salt_col)
               .withColumn("_r1", F.row_number().over(Window.partitionBy(*by, "_salt").orderBy(*order)))
               .filter(F.col("_r1") <= n))
    return (first.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
                 .filter(F.col("_rn") <= n).drop("_salt", "_r1"))

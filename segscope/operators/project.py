"""Low-dimensional projections and their tables.

Linear projections: Spark ML PCA (one distributed covariance, d x d state), and
randomised subspace iteration for wide inputs, with a fixed sign per axis (largest
loading positive) so the result is deterministic. Coordinates of the neighbour
graph are in ``graph_layout``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .quality import as_array
from .sweep import blocks


#: Passes over the rows, and directions beyond those asked for, of the subspace iteration.
PASSES, MORE = 8, 10


def _covariance_times(sent, column: str, width: int):
    """Kernel of a pass: (rows - mean)^T ((rows - mean) q), flattened, of all rows of a partition."""
    def run(batches):
        mean, q = sent.value
        shift, out = mean @ q, np.zeros((width, q.shape[1]))
        for x in blocks(batches, column, width, 1024):
            p = x.dot(q) - shift
            out += x.across(p) - np.outer(mean, p.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array([out.ravel()], pa.list_(pa.float64()))], ["v"])
    return run


def subspace_axes(df: DataFrame, features: str, k: int, passes: int = PASSES, seed: int = 42):
    """(mean, axes: width x k, their variances): the leading principal axes of the rows themselves, by randomised subspace
    iteration. Each pass multiplies a block of k + ``MORE`` directions by the covariance, without forming it: what is held
    is width x (k + MORE) numbers, and sparse rows cost their non-zeros."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer
    from .quality import to_vector
    spark = df.sparkSession
    rows = df.select(features).where(F.col(features).isNotNull())
    width = _width(rows, features)
    first = to_vector(rows, features).agg(Summarizer.mean(F.col("_v")).alias("m"), F.count(F.lit(1)).alias("n")).first()
    mean, n = first["m"].toArray(), first["n"]
    take = min(width, k + MORE)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, take)))[0]
    data = rows if not isinstance(rows.schema[features].dataType, ArrayType) else rows.select(F.col(features).cast("array<double>").alias(features))
    for i in range(max(1, passes)):
        sent = spark.sparkContext.broadcast((mean, q))
        total = data.mapInArrow(_covariance_times(sent, features, width), "v array<double>").agg(Summarizer.sum(array_to_vector("v")).alias("v"))
        y = total.first()["v"].toArray().reshape(width, take) / n
        sent.unpersist()
        if i + 1 < max(1, passes):
            q = np.linalg.qr(y)[0]
    small = q.T @ y  # the covariance on the block
    values, turn = np.linalg.eigh((small + small.T) / 2)
    axes = q @ turn[:, ::-1][:, :k]
    signs = np.where(axes[np.abs(axes).argmax(0), range(axes.shape[1])] < 0, -1.0, 1.0)
    return mean, axes * signs, values[::-1][:k]


def _coordinates(sent, column: str, width: int, prefix: str, dim: int):
    def run(batches):
        mean, axes = sent
        for b in batches:
            parts = [x.dot(axes) - mean @ axes for x in blocks([b], column, width, 4096)]
            p = np.concatenate(parts) if parts else np.zeros((0, axes.shape[1]))
            p = np.hstack([p, np.zeros((len(p), dim - axes.shape[1]))])
            missing = b.column(b.schema.get_field_index(column)).is_null()
            new = [pc.if_else(missing, None, pa.array(p[:, j])) for j in range(dim)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *[f"{prefix}{j + 1}" for j in range(dim)]])
    return run


def _width(df: DataFrame, col: str) -> int:
    from pyspark.ml.linalg import VectorUDT
    if isinstance(df.schema[col].dataType, VectorUDT):
        return int(df.select(F.col(col)).first()[0].size)
    return len(df.select(col).first()[0])


def project(df: DataFrame, features: str, dim: int = 2, prefix: str = "p2_", method: str = "pca",
            seed: int = 42) -> DataFrame:
    """Coordinates ``{prefix}1..{prefix}dim`` (2 or 3) on the principal axes
    of the centred features, with a fixed sign per axis. ``method='pca'`` holds
    the d x d covariance; ``'random_pca'``, for wide inputs such as TF-IDF, finds
    the same axes by subspace iteration (``subspace_axes``) and keeps sparse
    vectors sparse. A missing vector has no coordinates there."""
    from pyspark.ml.stat import Summarizer
    from pyspark.ml.functions import array_to_vector
    if dim not in (2, 3):
        raise ValueError("dim must be 2 or 3")
    if method not in ("pca", "random_pca"):
        raise ValueError("only linear projections are provided: pca or random_pca")
    width = _width(df, features)
    if method == "random_pca":
        mean, axes, _ = subspace_axes(df, features, min(dim, width), seed=seed)
        fields = [*df.schema.fields, *[StructField(f"{prefix}{j + 1}", DoubleType()) for j in range(dim)]]
        return df.mapInArrow(_coordinates((mean, axes), features, width, prefix, dim), StructType(fields))
    d = as_array(df, features)
    k = min(dim, width)
    mu = d.select(Summarizer.mean(array_to_vector("_x")).alias("m")).first()["m"].toArray()
    centred = d.withColumn("_cx", array_to_vector(F.zip_with("_x", F.array(*[F.lit(float(m)) for m in mu]),
                                                             lambda a, b: a - b)))
    model = PCA(k=k, inputCol="_cx", outputCol="_pc").fit(centred)
    pc = model.pc.toArray()
    signs = np.where(pc[np.abs(pc).argmax(0), range(k)] < 0, -1.0, 1.0)
    fixed = pc * signs
    proj = F.array(*[F.aggregate(F.zip_with(vector_to_array("_cx"), F.array(*[F.lit(float(v)) for v in fixed[:, j]]),
                                            lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
                     for j in range(k)])
    out = centred.withColumn("_p", proj)
    for j in range(dim):
        out = out.withColumn(f"{prefix}{j + 1}", F.col("_p")[j] if j < k else F.lit(0.0))
    return out.drop("_x", "_cx", "_p")


def cluster_centres(df: DataFrame, label: str, coords: list[str]) -> DataFrame:
    """Label position = median of each coordinate per cluster."""
    from .stats import feature_quantiles
    medians = feature_quantiles(df.filter(F.col(label).isNotNull()), [label], coords, {"m": 0.5})
    return medians.groupBy(label).agg(*[F.max(F.when(F.col("feature") == c, F.col("m"))).alias(c) for c in coords])


def projection_table(df: DataFrame, dim: int, label: str, hover: list[str] | None = None, prefix: str = "p2_") -> DataFrame:
    """P5: coordinates, label and hover columns side by side (same rows, never
    glued by position); dims must be 2 or 3."""
    if dim not in (2, 3):
        raise ValueError("dim must be 2 or 3")
    coords = [f"{prefix}{j + 1}" for j in range(dim)]
    missing = [c for c in coords + [label] + list(hover or []) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    return df.select(*coords, label, *(hover or []))

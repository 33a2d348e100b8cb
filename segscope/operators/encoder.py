"""Non-linear encoder (autoencoder) trained data-parallel on Spark.

Layers d -> 2e (relu) -> e (relu, the code) -> 2e (relu) -> d (linear by
default, 'sigmoid' available), mean squared error, Adam. Training is model
averaging: for each epoch every partition starts from the current weights,
runs Adam over its own rows in mini-batches (numpy, inside an Arrow batch
function), and returns its weights; the new weights are the row-weighted mean
(``Summarizer.mean`` with a weight column). One Spark job per epoch; the state
that crosses the driver is the weight vector only (bounded by the layer
sizes, never by the rows).
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ..session import cut_lineage
from .quality import as_array


def _shapes(d: int, e: int):
    return [(d, 2 * e), (2 * e,), (2 * e, e), (e,), (e, 2 * e), (2 * e,), (2 * e, d), (d,)]


def _unflat(w, shapes):
    out, i = [], 0
    for s in shapes:
        k = int(np.prod(s))
        out.append(w[i:i + k].reshape(s))
        i += k
    return out


def _init(d: int, e: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    parts = []
    for s in _shapes(d, e):
        if len(s) == 2:
            lim = np.sqrt(6.0 / (s[0] + s[1]))  # Glorot uniform
            parts.append(rng.uniform(-lim, lim, size=s).ravel())
        else:
            parts.append(np.zeros(s))
    return np.concatenate(parts)


def _forward(params, X, out_act):
    W1, b1, W2, b2, W3, b3, W4, b4 = params
    h1 = np.maximum(X @ W1 + b1, 0)
    z = np.maximum(h1 @ W2 + b2, 0)
    h3 = np.maximum(z @ W3 + b3, 0)
    o = h3 @ W4 + b4
    if out_act == "sigmoid":
        o = 1.0 / (1.0 + np.exp(-o))
    return h1, z, h3, o


def _grads(params, X, out_act):
    W1, b1, W2, b2, W3, b3, W4, b4 = params
    h1, z, h3, o = _forward(params, X, out_act)
    m = X.shape[0]
    err = o - X
    loss = float((err ** 2).mean())
    g = 2.0 * err / (m * X.shape[1])
    if out_act == "sigmoid":
        g = g * o * (1 - o)
    gW4, gb4 = h3.T @ g, g.sum(0)
    g3 = (g @ W4.T) * (h3 > 0)
    gW3, gb3 = z.T @ g3, g3.sum(0)
    g2 = (g3 @ W3.T) * (z > 0)
    gW2, gb2 = h1.T @ g2, g2.sum(0)
    g1 = (g2 @ W2.T) * (h1 > 0)
    gW1, gb1 = X.T @ g1, g1.sum(0)
    return loss, [gW1, gb1, gW2, gb2, gW3, gb3, gW4, gb4]


def _epoch_fn(w, d, e, batch, lr, seed, out_act):
    shapes = _shapes(d, e)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        params = [p.copy() for p in _unflat(w.copy(), shapes)]
        mom = [np.zeros_like(p) for p in params]
        vel = [np.zeros_like(p) for p in params]
        rng = np.random.default_rng(seed + TaskContext.get().partitionId())
        t, n, loss_sum = 0, 0, 0.0
        for b in batches:  # one Arrow batch in memory at a time, shuffled within; Adam's state goes on
            X = np.asarray(b.column(0).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(b.num_rows, d)
            order = rng.permutation(len(X))
            n += len(X)
            for s in range(0, len(X), batch):
                xb = X[order[s:s + batch]]
                loss, gs = _grads(params, xb, out_act)
                loss_sum += loss * len(xb)
                t += 1
                for i, gr in enumerate(gs):  # Adam
                    mom[i] = 0.9 * mom[i] + 0.1 * gr
                    vel[i] = 0.999 * vel[i] + 0.001 * gr * gr
                    mh = mom[i] / (1 - 0.9 ** t)
                    vh = vel[i] / (1 - 0.999 ** t)
                    params[i] = params[i] - lr * mh / (np.sqrt(vh) + 1e-7)
        if not n:
            return
        flat = np.concatenate([p.ravel() for p in params])
        yield pa.RecordBatch.from_arrays(
            [pa.array([flat.tolist()], pa.list_(pa.float64())), pa.array([n], pa.int64()),
             pa.array([loss_sum])], names=["w", "n", "loss"])
    return run


def fit_autoencoder(df: DataFrame, features: str, dim: int = 32, epochs: int = 50, batch: int = 256,
                    lr: float = 1e-3, seed: int = 42, output_activation: str = "linear"):
    """Returns (weights, history of mean training loss per epoch, code size)."""
    # every epoch reads the features: stored once; rows without a vector are left out
    x = cut_lineage(as_array(df, features).select("_x").filter(F.col("_x").isNotNull()))
    d = len(x.first()[0])
    e = max(2, min(dim, d // 2))
    w = _init(d, e, seed)
    schema = StructType([StructField("w", ArrayType(DoubleType()), False), StructField("n", LongType(), False),
                         StructField("loss", DoubleType(), False)])
    history = []
    for ep in range(epochs):
        out = x.mapInArrow(_epoch_fn(w, d, e, batch, lr, seed + 7919 * ep, output_activation), schema)
        r = out.agg(Summarizer.mean(array_to_vector("w"), F.col("n").cast("double")).alias("w"),
                    F.sum("loss").alias("ls"), F.sum("n").alias("n")).first()
        w = r["w"].toArray()
        history.append(r["ls"] / r["n"])
    return {"weights": w, "history": history, "dim": e, "input_dim": d, "output_activation": output_activation}


def encode(df: DataFrame, features: str, model: dict, out: str = "encoded") -> DataFrame:
    """The code layer for every row (narrow Arrow batch function)."""
    d, e = model["input_dim"], model["dim"]
    params = _unflat(np.asarray(model["weights"]), _shapes(d, e))
    act = model["output_activation"]
    base = as_array(df, features)
    fields = [f for f in base.schema.fields] + [StructField(out, ArrayType(DoubleType()), False)]

    def run(batches):
        import pyarrow as pa
        for b in batches:
            if not b.num_rows:
                continue
            c = b.column(b.schema.get_field_index("_x"))
            X = np.asarray(c.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(b.num_rows, d)
            z = _forward(params, X, act)[1]
            yield pa.RecordBatch.from_arrays(list(b.columns) + [pa.array(z.tolist(), pa.list_(pa.float64()))],
                                             names=list(b.schema.names) + [out])
    return base.mapInArrow(run, StructType(fields)).drop("_x")

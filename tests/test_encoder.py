"""The encoder's gradients against differences, its training against a plain loop, and its error against the mean."""
import numpy as np

from segscope.operators import encoder as E

RNG = np.random.default_rng(4)


def test_gradients():
    x, w = RNG.normal(size=(7, 6)), E._init(6, 2, 1) + 0.1
    shapes = E._shapes(6, 2)
    for act in ("linear", "sigmoid"):
        loss = lambda v: E._grads(E._unflat(v, shapes), x, act)[0]
        got = np.concatenate([g.ravel() for g in E._grads(E._unflat(w, shapes), x, act)[1]])
        for i in range(0, len(w), 5):
            step = np.zeros_like(w)
            step[i] = 1e-6
            assert abs((loss(w + step) - loss(w - step)) / 2e-6 - got[i]) < 1e-5


def test_one_partition_is_plain_adam(spark):
    x = RNG.normal(size=(40, 6))
    df = spark.createDataFrame([([float(v) for v in r],) for r in x], "x array<double>").coalesce(1)
    model = E.fit_autoencoder(df, "x", dim=2, epochs=2, batch=16, lr=1e-2, seed=5)
    shapes, w = E._shapes(6, 2), E._init(6, 2, 5)
    for epoch in range(2):
        params, rng, t = E._unflat(w.copy(), shapes), np.random.default_rng(5 + 7919 * epoch), 0
        params = [p.copy() for p in params]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        order = rng.permutation(40)
        for at in range(0, 40, 16):
            t += 1
            for i, g in enumerate(E._grads(params, x[order[at:at + 16]], "linear")[1]):
                first[i], second[i] = 0.9 * first[i] + 0.1 * g, 0.999 * second[i] + 0.001 * g * g
                params[i] = params[i] - 1e-2 * (first[i] / (1 - 0.9 ** t)) / (np.sqrt(second[i] / (1 - 0.999 ** t)) + 1e-7)
        w = np.concatenate([p.ravel() for p in params])
    assert np.allclose(model["weights"], w)


def test_codes_tell_more_than_the_mean(spark):
    """Rows from two hidden numbers: decoding the codes leaves a small part of the variance."""
    x = RNG.normal(size=(500, 2)) @ RNG.normal(size=(2, 8))
    df = spark.createDataFrame([([float(v) for v in r],) for r in x], "x array<double>").repartition(3)
    model = E.fit_autoencoder(df, "x", dim=4, epochs=25, batch=32, lr=1e-2, seed=1)
    out = E._forward(E._unflat(np.asarray(model["weights"]), E._shapes(8, 4)), x, "linear")[3]
    assert ((out - x) ** 2).mean() < 0.3 * x.var()

"""Blocks stored as trees of cells against plain loops over all rows and all centroids."""
import numpy as np
import pyarrow as pa
import pytest

from segscope.operators import sweep as S

RNG = np.random.default_rng(11)
# whole numbers on two sides, as parts of dates are: many equal values, ties
ROWS = np.column_stack([RNG.integers(0, 30, 6000), RNG.integers(0, 12, 6000), RNG.normal(size=6000)]).astype(float)
MODELS = [(k, np.stack([ROWS[RNG.choice(6000, k, replace=False)] for _ in range(3)])) for k in (2, 5, 40)]


class Sent:
    value = MODELS


def _packed(rows):
    x = S.Block.of(rows, None).placed()
    return pa.RecordBatch.from_arrays([pa.array([x.dense.tobytes()], pa.binary()), pa.array([x.levels], pa.list_(pa.list_(pa.int32())))], ["x", "_levels"])


def _sums(rows, c):
    label = ((rows[:, None, :] - c) ** 2).sum(2).argmin(1)
    return np.array([[(label == j).sum(), (rows[label == j] ** 2).sum(), *rows[label == j].sum(0)] for j in range(len(c))])


def test_cells_of_a_block_are_a_tree():
    x = S.Block.of(ROWS, None).placed()
    assert sorted(map(tuple, x.dense)) == sorted(map(tuple, ROWS))
    assert list(x.levels[0]) == [0] and all(set(a) < set(b) for a, b in zip(x.levels, x.levels[1:]))
    assert np.diff(np.append(x.levels[-1], x.n)).max() <= S.CELL_ROWS
    equal = S.Block.of(np.ones((500, 3)), None).placed()
    assert np.diff(np.append(equal.levels[-1], 500)).max() <= S.CELL_ROWS


@pytest.mark.parametrize("tie", [False, True])
def test_a_round_over_packed_blocks_equals_a_plain_one_and_compares_no_cell_with_all(monkeypatch, tie):
    models = [(k, c.copy()) for k, c in MODELS]
    if tie:
        models[2][1][:, 7] = models[2][1][:, 3]
        models[1][1][0, :2] = [[10, 3, 0], [20, 3, 0]]  # rows at 15 are as near to both

    class Both:
        value = models
    asked, ask = [], S._Nearest.candidates
    monkeypatch.setattr(S._Nearest, "candidates", lambda self, x: asked.append(1) or ask(self, x))
    batches = [_packed(ROWS[:2500]), _packed(ROWS[2500:])]
    got = {g: np.reshape(v, (-1, 5)) for b in S._lloyd(Both, "x", 3)(batches) for g, v in zip(b["g"].to_pylist(), b["v"].to_pylist())}
    assert len(asked) <= 3 * len(batches)  # not once for each of more than 90 cells
    for k, c in models:
        assert np.allclose(got[k], np.concatenate([_sums(ROWS, one) for one in c]))


def test_scores_over_packed_blocks_equal_plain_ones():
    models = []
    for k, c in MODELS:
        one = c[0].copy()
        if k == 40:
            one[11] = 1e6  # a centroid without rows
        v = _sums(ROWS, one)
        live = np.maximum(v[:, 0], 1)
        models.append((k, one, v[:, 0], v[:, 2:] / live[:, None], v[:, 1] / live))
    assert (models[2][2] == 0).sum() == 1

    class Fits:
        value = models
    plain = pa.RecordBatch.from_arrays([pa.array(ROWS.tolist(), pa.list_(pa.float64()))], ["x"])
    cells = S._ScoreCells(models)
    assert cells.near.finite and not cells.near.wide(S.Block.of(ROWS, None).placed())
    read = lambda batches: {g: v for b in S._score(Fits, "x", 3)(batches) for g, v in zip(b["g"].to_pylist(), b["v"].to_pylist())}
    want, got = read([plain]), read([_packed(ROWS[:4000]), _packed(ROWS[4000:])])
    assert list(want) == list(got)
    for k in want:
        assert np.allclose(want[k], got[k], rtol=1e-9, atol=1e-6)


def test_wide_rows_and_missing_numbers_meet_all_centroids():
    rows = np.vstack([RNG.normal(size=(400, 3)), [[np.nan, 0.0, 0.0]]])
    with np.errstate(invalid="ignore"):
        got = {g: np.reshape(v, (-1, 5)) for b in S._lloyd(Sent, "x", 3)([_packed(rows)]) for g, v in zip(b["g"].to_pylist(), b["v"].to_pylist())}
    assert all(v[:, 0].sum() == 3 * 401 for v in got.values())


def test_packed_rows_come_back_and_models_are_the_same(spark, monkeypatch):
    monkeypatch.setattr(S, "PACK_ROWS", 256)
    df = spark.createDataFrame([(r,) for r in ROWS[:1500].tolist()], "x array<double>").repartition(3)
    rows = S.start_rows(df, "x", 3, 42)
    held = S.packed(S.in_cells(df, "x", rows, 2, 1), "x", 3).collect()
    back = np.concatenate([np.frombuffer(r["x"]).reshape(-1, 3) for r in held])
    assert sorted(map(tuple, back)) == sorted(map(tuple, ROWS[:1500])) and max(len(r["x"]) for r in held) <= 256 * 24
    plain, _ = S.sweep(df, "x", range(2, 6), n_init=2)
    monkeypatch.setattr(S, "MANY_CENTROIDS", 1)
    placed, _ = S.sweep(df, "x", range(2, 6), n_init=2)
    for k in plain:
        assert np.allclose(plain[k].centroids, placed[k].centroids) and plain[k].scores == pytest.approx(placed[k].scores)


def test_starts_are_those_of_least_hash_however_few_are_looked_at(spark, monkeypatch):
    monkeypatch.setattr(S, "START_ROWS", 20)
    df = spark.createDataFrame([(r,) for r in ROWS[:900].tolist()] * 3, "x array<double>").repartition(3)
    want = S.start_rows(df, "x", 3, 42)
    assert len(want) == 20 and np.array_equal(S.start_rows(df, "x", 3, 42, 2700), want)
    few = df.where("x[0] = 3")
    assert np.array_equal(S.start_rows(few, "x", 3, 42, 10 ** 6), S.start_rows(few, "x", 3, 42))

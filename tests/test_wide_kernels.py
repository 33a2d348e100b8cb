"""Kernels of wide sparse rows and of many models against plain sums; nothing wide is written out."""
import numpy as np
import pytest
from pyspark.ml.linalg import DenseVector, SparseVector, VectorUDT
from pyspark.sql.types import IntegerType, StructField, StructType

from segscope.operators import cluster as CL
from segscope.operators import sweep as S
from segscope.plans import segmentation as SEG

RNG = np.random.default_rng(5)
WIDTH = 1000
FULL = np.where(RNG.random((40, WIDTH)) < 0.02, RNG.random((40, WIDTH)), 0.0)
FULL[7] = 0.0  # a row without entries


def _block(full):
    start = np.concatenate([[0], np.cumsum((full != 0).sum(1))])
    return S.Block(start, np.nonzero(full)[1], full[full != 0], full.shape[1])


def test_sparse_products():
    x, m, p = _block(FULL), RNG.normal(size=(5, WIDTH)).T, RNG.normal(size=(40, 3))
    assert x.dense is None
    assert np.allclose(x.dot(m), FULL @ m) and np.allclose(x.across(p), FULL.T @ p)
    few = _block(FULL[:2])  # fewer entries than the width
    assert np.allclose(few.across(p[:2]), FULL[:2].T @ p[:2])
    for n, groups in ((40, 2), (2, 6)):
        label = RNG.integers(0, groups, (n, 2))
        want = [sum((FULL[i] for i in range(n) for s in range(2) if label[i, s] == g), np.zeros(WIDTH)) for g in range(groups)]
        assert np.allclose(_block(FULL[:n]).add(label, groups), want)


@pytest.mark.parametrize("odd", [None, "tie", "nan", "inf"])
def test_sums_of_short_and_long_rows_of_centroids(odd):
    rows = RNG.normal(size=(300, 4))
    rows[0] = {None: 0.5, "tie": 0.5, "nan": np.nan, "inf": np.inf}[odd]
    x = S.Block(np.arange(301) * 4, np.tile(np.arange(4), 300), rows.ravel(), 4)

    class Sent:
        value = [(k, RNG.normal(size=(3, k, 4))) for k in (2, 5, 40)]
    if odd == "tie":
        Sent.value[1][1][:, 4] = Sent.value[1][1][:, 0]
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array(rows.tolist(), pa.list_(pa.float64()))], ["x"])
    with np.errstate(invalid="ignore"):
        got = {g: v for b in S._lloyd(Sent, "x", 4)([batch]) for g, v in zip(b["g"].to_pylist(), b["v"].to_pylist())}
        for k, c in Sent.value:
            want = np.zeros((3 * k, 6))
            m, constant = S._nearness(c.reshape(-1, 4))
            label = (rows @ m + constant).reshape(300, 3, k).argmin(2)
            for i in range(300):
                for s in range(3):
                    want[s * k + label[i, s]] += [1, x.squares[i], *rows[i]]
            assert np.allclose(np.reshape(got[k], (3 * k, 6)), want, equal_nan=True)


def _vectors(spark):
    rows = [(i, SparseVector(WIDTH, np.nonzero(r)[0].tolist(), r[r != 0].tolist())) for i, r in enumerate(FULL)]
    rows += [(100, None), (101, SparseVector(9, {1: 1.0})), (102, DenseVector([1.0, 2.0])), (103, DenseVector(FULL[3]))]
    return spark.createDataFrame(rows, StructType([StructField("id", IntegerType()), StructField("v", VectorUDT())])).repartition(3)


def test_wide_vectors_are_not_written_out_for_their_labels(spark, monkeypatch):
    c = FULL[[3, 11, 20]]
    df = _vectors(spark)

    def refuse(*_):
        raise AssertionError("written out")
    monkeypatch.setattr(CL, "as_array", refuse)
    got = {r["id"]: (r["cluster"], r["d"]) for r in CL.assign(df, "v", c.tolist(), dist_out="d").collect()}
    away = ((FULL[:, None, :] - c) ** 2).sum(2)
    for i in range(40):
        assert got[i][0] == away[i].argmin() and got[i][1] == pytest.approx(away[i].min(), abs=1e-9)
    assert got[100] == got[101] == got[102] == (None, None)
    assert got[103][0] == 0 and got[103][1] == pytest.approx(0, abs=1e-9)


def test_axes_of_texts_are_found_on_the_stored_vectors(spark, monkeypatch):
    seen, project = [], SEG.PJ.project

    def spy(df, *a, **k):
        seen.append(df.columns)
        return project(df, *a, **k)
    monkeypatch.setattr(SEG.PJ, "project", spy)
    texts = [(i, f"{'apple pear plum' if i % 2 else 'stone iron brass'} word{i % 5} thing{i % 3}") for i in range(30)]
    r = SEG.text_segmentation(spark.createDataFrame(texts, "doc_id int, text string"), "doc_id", ["text"], 2, 3)
    rows = r["result"].collect()
    assert seen == [["doc_id", "features"]]  # without labels, which every pass would work out anew
    assert len(rows) == 30 and len({r["cluster_text"] for r in rows}) >= 2
    assert len({(r["doc_id"] % 2, r["cluster_text"]) for r in rows}) == len({r["cluster_text"] for r in rows})


def test_cells_meet_few_centroids_and_lose_no_nearest():
    rows = RNG.normal(size=(4000, 3)) * [5, 2, 1]
    models = [rows[RNG.choice(4000, k, replace=False)] for k in (2, 9, 60)]
    near, met = S._Nearest(models), 0
    cells = S._cells(rows, 64)
    assert sorted(np.concatenate(cells)) == list(range(4000)) and max(map(len, cells)) <= 64
    sums = np.zeros((71, 4))
    for c in cells:
        at = near.candidates(rows[c])
        met += len(at)
        for first, m in zip(near.first, models):
            label = ((rows[c][:, None, :] - m) ** 2).sum(2).argmin(1)
            assert set(first + label) <= set(at)
        assert near.add(rows[c], np.column_stack([np.ones(len(c)), rows[c]]), at, sums)
    assert met < 0.4 * len(cells) * 71  # of all meetings of a cell and a centroid
    for first, m in zip(near.first, models):
        label = ((rows[:, None, :] - m) ** 2).sum(2).argmin(1)
        assert np.allclose(sums[first:first + len(m), 0], np.bincount(label, minlength=len(m)))
        assert np.allclose(sums[first:first + len(m), 1:], [rows[label == j].sum(0) for j in range(len(m))])


def test_rows_stored_by_cells_give_the_same_models(spark, monkeypatch):
    rows = [[float(v) for v in r] for r in RNG.normal(size=(500, 3))] + [[1.0, 1.0, 1.0]] * 200
    df = spark.createDataFrame([(r,) for r in rows], "x array<double>").repartition(3)
    held = S.in_cells(df, "x", np.array(rows[:300]), 4, 1)
    assert sorted(r["x"] for r in held.collect()) == sorted(rows) and held.columns == ["x"]
    plain, n = S.sweep(df, "x", range(2, 6), n_init=2)
    monkeypatch.setattr(S, "MANY_CENTROIDS", 1)
    placed, m = S.sweep(df, "x", range(2, 6), n_init=2)
    assert n == m == 700
    for k in plain:
        assert np.allclose(plain[k].centroids, placed[k].centroids) and plain[k].scores == pytest.approx(placed[k].scores)

import pytest

from segscope.operators import indicators as ind


@pytest.fixture(scope="module")
def data(spark):
    rows = [(1, "100", "120"), (2, "100", "100"), (3, "100", "50"), (4, "0", "10"), (5, "abc", None)]
    return spark.createDataFrame(rows, "id int, initial string, committed string")


def test_indicators(data):
    out = {r["id"]: r for r in ind.indicators(data, "initial", "committed").collect()}
    assert [float(out[i]["commit_gap"]) for i in range(1, 6)] == [20, 0, -50, 10, 0]
    assert [out[i]["commit_rate"] for i in range(1, 6)] == [120, 100, 50, 0, 0]
    assert [out[i]["commit_status"] for i in range(1, 6)] == ["over", "on", "under", "under", "under"]


def test_kpis(data):
    r = ind.kpis(data, "initial", "committed").first()
    assert (r["n_rows"], r["total_initial"], r["total_committed"]) == (5, 300.0, 280.0)
    assert r["mean_rate"] == pytest.approx(90.0)
    assert (r["total_gap"], r["n_over"]) == (-20.0, 1)

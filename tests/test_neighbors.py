"""Neighbour index, spanning forest, hierarchy, validity and layout against brute force and hand-computed answers."""
import numpy as np
import pytest

from segscope.operators import forest as FO
from segscope.operators import graph_layout as GL
from segscope.operators import neighbors as N

RNG = np.random.default_rng(11)


def frame(spark, rows):
    return spark.createDataFrame([(i, None if r is None else [float(v) for v in r]) for i, r in rows], "id long, x array<double>").repartition(4)


def brute(rows, k):
    ids = [i for i, r in rows if r is not None]
    x = np.array([r for _, r in rows if r is not None])
    out = {}
    for i, r in zip(ids, x):
        d = np.sqrt(((x - r) ** 2).sum(1))
        out[i] = sorted((dist, j) for dist, j in zip(d, ids) if j != i)[:k]
    return out


def found(df):
    out = {}
    for r in df.orderBy("id", "rank").collect():
        out.setdefault(r["id"], []).append((r["dist"], r["neighbor"]))
        assert r["rank"] == len(out[r["id"]])
    return out


def same(got, want):
    assert sorted(got) == sorted(i for i, w in want.items() if w)
    for i, near in got.items():
        assert [j for _, j in near] == [j for _, j in want[i]], i
        assert np.allclose([d for d, _ in near], [d for d, _ in want[i]])


def test_all_cells_are_exact_with_copies_ties_and_missing_vectors(spark):
    rows = [(i, RNG.integers(0, 4, 3)) for i in range(150)] + [(200 + i, (1, 1, 1)) for i in range(90)] + [(500, None), (501, (9.5, 0, 0))]
    same(found(N.knn(frame(spark, rows), "x", "id", 6, cells=9, probe=9)), brute(rows, 6))


def test_hot_cells_are_cut_into_bounded_pieces(spark, monkeypatch):
    rows = [(i, RNG.normal(0, 0.01, 4)) for i in range(400)] + [(1000 + i, RNG.normal(5, 1, 4)) for i in range(100)]
    monkeypatch.setattr(N, "PIECE_ROWS", 60)
    same(found(N.knn(frame(spark, rows), "x", "id", 5, cells=4, probe=4)), brute(rows, 5))


def test_recall_of_the_index(spark):
    """Default cells and probes on blobs and on vectors without structure."""
    rows = [(i, RNG.normal(RNG.integers(0, 6, 16) if i % 2 else 0, 1, 16)) for i in range(1200)]
    got, want = found(N.knn(frame(spark, rows), "x", "id", 10)), brute(rows, 10)
    assert all(len(near) == 10 for near in got.values())
    hits = sum(len({j for _, j in got[i]} & {j for _, j in want[i]}) for i in want)
    assert hits / (10 * len(want)) >= 0.9


def test_recall_on_the_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got, want = found(N.knn(df, "embedding", "vec_id", 10)), brute(rows, 10)
    assert sum(len({j for _, j in got[i]} & {j for _, j in want[i]}) for i in want) / (10 * len(want)) >= 0.9


def test_small_tables(spark):
    assert N.knn(frame(spark, [(1, None)]), "x", "id", 3).collect() == []
    assert found(N.knn(frame(spark, [(1, (0, 0)), (2, (3, 4)), (3, None)]), "x", "id", 3)) == {1: [(5.0, 2)], 2: [(5.0, 1)]}
    near = found(N.knn(frame(spark, [(i, (7, 7)) for i in range(5)]), "x", "id", 3))
    assert near[0] == [(0.0, 1), (0.0, 2), (0.0, 3)] and near[4] == [(0.0, 0), (0.0, 1), (0.0, 2)]


def test_core_and_mutual_reachability(spark):
    near = spark.createDataFrame([(1, 1, 2, 1.0), (1, 2, 3, 4.0), (2, 1, 1, 1.0), (2, 2, 3, 3.0), (3, 1, 2, 3.0), (3, 2, 1, 4.0)],
                                 "id long, rank int, neighbor long, dist double")
    core = N.core_distances(near, 1)
    assert {r["id"]: r["core"] for r in core.collect()} == {1: 1.0, 2: 1.0, 3: 3.0}
    assert {(r["u"], r["v"]): r["w"] for r in N.mutual_reachability(near, core).collect()} == {(1, 2): 1.0, (1, 3): 4.0, (2, 3): 3.0}


def kruskal(edges):
    root, picked = {}, []

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for w, u, v in sorted((w, min(u, v), max(u, v)) for u, v, w in edges if u != v):
        if find(u) != find(v):
            root[find(u)] = find(v)
            picked.append((u, v, w))
    return picked


def test_forest_with_equal_weights_and_parts(spark):
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(RNG.integers(0, 40, 150), RNG.integers(0, 40, 150), RNG.integers(1, 4, 150))]
    edges += [(100 + i, 101 + i, 1.0) for i in range(30)] + [(7, 7, 0.5), (3, 4, 2.0), (4, 3, 1.0)]
    got = FO.spanning_forest(spark.createDataFrame(edges, "u long, v long, w double"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(kruskal(edges))
    assert FO.spanning_forest(spark.createDataFrame([], "u long, v long, w double")).collect() == []


# two pairs-of-three and a far row: 1-2-3 at 1, 4-5-6 at 2, the two at 5, row 7 at 10
TREE = [(1, 2, 1.0), (2, 3, 1.0), (4, 5, 2.0), (5, 6, 2.0), (3, 4, 5.0), (6, 7, 10.0)]


def test_tree_by_hand(spark):
    nodes, forest = spark.createDataFrame([(i,) for i in range(1, 8)], "id long"), spark.createDataFrame(TREE, "u long, v long, w double")
    tree, steps = FO.density_tree(nodes, forest)
    assert steps == [1.0, 2.0, 5.0, 10.0]
    rows = {(r["level"], r["comp"]): (r["parent"], r["size"]) for r in tree.collect()}
    assert {k: v for k, v in rows.items() if k[0] >= 0} == {
        (0, 1): (1, 3), (0, 4): (4, 1), (0, 5): (4, 1), (0, 6): (4, 1), (0, 7): (7, 1),
        (1, 1): (1, 3), (1, 4): (1, 3), (1, 7): (7, 1), (2, 1): (1, 6), (2, 7): (1, 1), (3, 1): (None, 7)}
    labels, table = FO.select_eom(tree, steps, 3)
    # 1-2-3 lives from 1/5 to 1/1, 4-5-6 from 1/5 to 1/2; the whole from 0 to 1/5 with 7 rows, then 6
    got = {r["cluster"]: (r["birth"], r["parent"], r["size"], round(r["stability"], 9), r["cluster_num"]) for r in table.collect() if r["birth"] < 3}
    assert got == {1: (1, 1, 3, round(3 * 0.8, 9), 0), 4: (1, 1, 3, round(3 * 0.3, 9), 1)}
    (whole,) = [r for r in table.collect() if r["birth"] == 3]
    assert whole["parent"] is None and whole["cluster_num"] is None and whole["stability"] == pytest.approx(7 * 0.1 + 6 * 0.1)
    assert {r["id"]: r["cluster_num"] for r in labels.collect()} == {1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 1, 7: -1}
    one, _ = FO.select_eom(tree, steps, 4)
    assert {r["cluster_num"] for r in one.collect()} == {-1}
    one, _ = FO.select_eom(tree, steps, 4, allow_single=True)
    assert {r["cluster_num"] for r in one.collect()} == {0}
    flat = {r["id"]: r["cluster_num"] for r in FO.density_cut(nodes, forest, 2.0, 3).collect()}
    assert flat == {1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 1, 7: -1}


def test_parents_win_where_children_are_less_stable(spark):
    """Two close pairs that part at the last moment: their cluster is worth more than they are."""
    edges = [(1, 2, 1.0), (3, 4, 1.0), (2, 3, 1.1), (5, 6, 1.0), (7, 8, 1.0), (6, 7, 1.1), (4, 5, 10.0)]
    nodes, forest = spark.createDataFrame([(i,) for i in range(1, 9)], "id long"), spark.createDataFrame(edges, "u long, v long, w double")
    labels, _ = FO.select_eom(*FO.density_tree(nodes, forest), 2)
    assert {r["id"]: r["cluster_num"] for r in labels.collect()} == {i: int(i > 4) for i in range(1, 9)}


def test_validity_by_hand(spark):
    forest = spark.createDataFrame(TREE, "u long, v long, w double")
    labels = spark.createDataFrame([(i, 0 if i < 4 else 1 if i < 7 else -1) for i in range(1, 8)], "id long, cluster_num int")
    got = {r["cluster_num"]: (r["sparseness"], r["separation"], round(r["validity"], 9), round(r["weight"], 9)) for r in FO.validity(labels, forest).collect()}
    assert got == {0: (1.0, 5.0, 0.8, round(3 / 7, 9)), 1: (2.0, 5.0, 0.6, round(3 / 7, 9))}


def test_hierarchy_recovers_blobs_among_noise(spark):
    centres = np.array([[0, 0], [12, 0], [0, 14]])
    rows = [(i, RNG.normal(centres[i % 3], 1)) for i in range(240)] + [(1000 + i, RNG.uniform(-40, 60, 2)) for i in range(15)]
    near = N.knn(frame(spark, rows), "x", "id", 8)
    forest = FO.spanning_forest(N.mutual_reachability(near, N.core_distances(near, 5)))
    nodes = spark.createDataFrame([(i,) for i, _ in rows], "id long")
    labels, _ = FO.select_eom(*FO.density_tree(nodes, forest, levels=12), 20)
    got = {r["id"]: r["cluster_num"] for r in labels.collect()}
    for b in range(3):
        mine = [got[i] for i in range(240) if i % 3 == b and got[i] >= 0]
        assert len(mine) >= 60 and len(set(mine)) == 1
    assert len({c for c in got.values() if c >= 0}) == 3 and sum(got[1000 + i] < 0 for i in range(15)) >= 12


def test_fuzzy_weights(spark):
    rows = [(1, 1, 2, 0.5), (1, 2, 3, 1.0), (1, 3, 4, 2.5), (2, 1, 1, 0.5), (2, 2, 3, 0.75), (2, 3, 4, 0.75)]
    near = spark.createDataFrame(rows, "id long, rank int, neighbor long, dist double")
    got = {(r["id"], r["neighbor"]): r for r in GL.fuzzy_directed(near).collect()}
    for i in (1, 2):
        mine = [r for (a, _), r in got.items() if a == i]
        assert all(r["rho"] == 0.5 for r in mine) and sum(r["weight"] for r in mine) == pytest.approx(np.log2(3), abs=1e-6)
    joined = {(r["u"], r["v"]): r["weight"] for r in GL.fuzzy_graph(near).collect()}
    assert joined[1, 2] == pytest.approx(1.0) and joined[1, 3] == pytest.approx(got[1, 3]["weight"]) and len(joined) == 5


def test_layout_against_dense_eigenvectors(spark):
    n = 30
    w = np.triu(RNG.random((n, n)) * (RNG.random((n, n)) < 0.3), 1)
    for i in range(n - 1):
        w[i, i + 1] = 1.0
    w = w + w.T
    a = w / np.sqrt(np.outer(w.sum(1), w.sum(1)))
    values, vectors = np.linalg.eigh(a)
    graph = spark.createDataFrame([(i, j, float(w[i, j])) for i in range(n) for j in range(i + 1, n) if w[i, j]], "u long, v long, weight double")
    nodes = spark.createDataFrame([(i,) for i in range(n + 1)], "id long")
    got, info = GL.spectral_layout(nodes, graph, 2, rounds=80, tol=1e-3)
    rows = {r["id"]: (r["p2_1"], r["p2_2"]) for r in got.collect()}
    assert rows[n] == (0.0, 0.0) and info["residual"] <= 1e-3 or info["rounds"] == 80
    assert np.allclose(info["values"], values[::-1][1:3], atol=1e-3)
    for c in range(2):
        v, want = np.array([rows[i][c] for i in range(n)]), vectors[:, ::-1][:, c + 1]
        assert v[np.abs(v).argmax()] > 0 and abs(v @ v - 1) < 1e-6
        assert np.linalg.norm(a @ v - info["values"][c] * v) <= 2 * max(info["residual"], 1e-3)


def test_an_area_answers_a_row_once_and_from_its_cells_alone():
    import pyarrow as pa
    rng = np.random.default_rng(5)
    x, a = rng.standard_normal((60, 4)).astype(np.float32), rng.standard_normal((9, 4)).astype(np.float32)
    home = np.arange(60) % 3
    looks = [[0, 2] if i % 2 else [1] for i in range(9)]
    vectors = lambda m: pa.array(list(m), pa.list_(pa.float32()))
    filed = pa.table({"cid": pa.array(range(60), pa.int64()), "x": vectors(x), "home": pa.array(home, pa.int32())})
    asks = pa.table({"asking": pa.array(range(100, 109), pa.int64()), "ax": vectors(a), "looks": pa.array(looks, pa.list_(pa.int32()))})
    out = N._nearest(5)(filed, asks).to_pylist()
    assert [r["cid"] for r in out] == list(range(100, 109))
    for i, r in enumerate(out):
        d = np.sqrt(((x.astype(float) - a[i].astype(float)) ** 2).sum(1))
        d[~np.isin(home, looks[i])] = np.inf
        assert [e["cid"] for e in r["near"]] == list(np.argsort(d, kind="stable")[:5])
        assert np.allclose([e["dist"] for e in r["near"]], np.sort(d)[:5])


def test_layout_rounds_send_no_table_of_nodes_to_all(spark, monkeypatch):
    plans = []

    class Watched(GL.Scratch):
        def save(self, df):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return super().save(df)

    monkeypatch.setattr(GL, "Scratch", Watched)
    graph = spark.createDataFrame([(i, (i + 1) % 12, 1.0 + i % 3) for i in range(12)], "u long, v long, weight double")
    GL.spectral_layout(spark.range(12).select("id"), graph, 2, rounds=2)
    assert sum("SortMergeJoin" in p for p in plans) >= 3 and not any("BroadcastHashJoin" in p for p in plans)


def test_limits_of_the_index_lose_no_neighbor_and_rule_out_most_pairs(monkeypatch):
    import pyarrow as pa
    from types import SimpleNamespace
    rng = np.random.default_rng(8)
    x = (1000 + rng.standard_normal((3000, 8))).astype(np.float32)
    cells = np.float64(x[:12])
    rows = pa.RecordBatch.from_arrays([pa.array(range(3000), pa.int64()), pa.array(list(x), pa.list_(pa.float32()))], ["cid", "x"])
    out = next(N._route(SimpleNamespace(value=cells), SimpleNamespace(value=np.float64(x[:600])), 7, 5)([rows])).to_pydict()
    home = np.array([n[0] for n in out["near"]])
    measured, sqrt = [], np.sqrt
    monkeypatch.setattr(N.np, "sqrt", lambda v: (measured.append(len(v)), sqrt(v))[1])
    filed = pa.table({"cid": out["cid"], "x": rows["x"], "home": pa.array(home, pa.int32())})
    asks = pa.table({"asking": rows["cid"], "ax": rows["x"], "looks": pa.array(out["near"], pa.list_(pa.int32())), "far": out["far"]})
    got = N._nearest(5)(filed, asks).to_pylist()
    monkeypatch.undo()
    assert sum(measured) < 0.05 * 3000 * 3000
    for i in range(0, 3000, 7):
        d = np.sqrt(((np.float64(x) - np.float64(x[i])) ** 2).sum(1))
        d[~np.isin(home, out["near"][i])] = np.inf
        d[i] = np.inf
        assert d[np.argsort(d, kind="stable")[4]] ** 2 <= out["far"][i]
        assert [e["cid"] for e in got[i]["near"]] == list(np.argsort(d, kind="stable")[:5])


def test_a_row_is_not_its_own_neighbor_beside_an_infinite_one():
    import pyarrow as pa
    x = [[float(i % 3), 0.0] for i in range(60)] + [[float("inf"), 1.0]]
    filed = pa.table({"cid": pa.array(range(61), pa.int64()), "x": pa.array(x), "home": pa.array([0] * 61, pa.int32())})
    asks = pa.table({"asking": filed["cid"], "ax": filed["x"], "looks": pa.array([[0]] * 61, pa.list_(pa.int32()))})
    out = {r["cid"]: [e["cid"] for e in r["near"]] for r in N._nearest(4)(filed, asks).to_pylist()}
    assert sorted(out) == list(range(60))
    assert all(out[i] == [j for j in range(i % 3, 60, 3) if j != i][:4] for i in out)


def test_a_long_chain_is_merged_in_few_steps(spark, monkeypatch):
    edges = [(i, i + 1, 200.0 - i) for i in range(200)]
    saved = []

    class Counted(FO.Scratch):
        def save(self, df):
            saved.append(1)
            return super().save(df)

    monkeypatch.setattr(FO, "Scratch", Counted)
    got = FO.spanning_forest(spark.createDataFrame(edges, "u long, v long, w double"))
    assert sorted(tuple(r) for r in got.collect()) == edges
    assert len(saved) <= 13  # one round: its edges, the least of each, the links, nine doublings at most, what is left


def test_levels_of_the_tree_are_merged_at_once(spark, monkeypatch):
    """Sixteen levels against union-find, a repeated and a null node, an edge that leaves the nodes; few tables whatever the levels."""
    rng = np.random.default_rng(4)
    edges = [(int(rng.integers(0, i)), i, float(rng.integers(1, 40))) for i in range(1, 120)] + [(119, 500, 3.0)]
    ids = [*range(130), 7, None]
    saved = []

    class Counted(FO.Scratch):
        def save(self, df, **how):
            saved.append(1)
            return super().save(df, **how)

    monkeypatch.setattr(FO, "Scratch", Counted)
    tree, steps = FO.density_tree(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(edges, "u long, v long, w double"), 50)
    assert len(steps) > 16 and len(saved) < len(steps)

    def roots(eps):
        root = {}
        for u, v, w in edges:
            if w <= eps:
                a, b = root.setdefault(u, u), root.setdefault(v, v)
                root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
        return root

    label = [roots(s) for s in steps]
    want = [(-1, i, label[0].get(i, i), 1) for i in ids]
    for at, found in enumerate(label):
        comps = [found.get(i, i) for i in ids]
        up = (lambda c: label[at + 1].get(c, c)) if at + 1 < len(steps) else (lambda c: None)  # noqa: B023
        want += [(at, c, up(c), comps.count(c)) for c in set(comps)]
    key = lambda r: tuple((v is not None, v or 0) for v in r)
    assert sorted((tuple(r) for r in tree.select("level", "comp", "parent", "size").collect()), key=key) == sorted(want, key=key)
    lone, none = FO.density_tree(spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([], "u long, v long, w double"))
    assert none == [] and sorted(tuple(r) for r in lone.collect()) == [(-1, 1, None, 1), (-1, 2, None, 1)]

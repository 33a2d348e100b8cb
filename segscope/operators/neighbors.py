"""Nearest neighbours, core distances and mutual reachability from an
inverted-file index.

Every row's ``k`` nearest other rows, without comparing all pairs.

1. *Copies.* Rows with the same vector are one class, with its least k + 1 ids; classes
   take part as one row each and are expanded at the end, so a third of all rows being
   copies costs no more than any other row.
2. *Index.* The cells are a k-means partition in two levels, fitted on a bounded sample of
   distinct vectors (``FIT_ROWS``: a bound on that fit alone). Every class is filed under its
   nearest centroid, and looks into the ``probe`` cells nearest to it. Distances inside are
   exact; what is missed lies in other cells. How many cells the wanted recall needs is
   measured: ``TRIED`` sample vectors are compared with all rows. All cells give the exact
   answer.
3. *Areas.* The cells of one coarse cell are an area. A row is sent once to each area that it
   looks into, with the list of its cells there, not once to each cell; vectors of floats
   travel as floats. An area is cut into pieces of at most about ``PIECE_ROWS`` filed rows and
   ``ASK_ROWS`` asking ones, by hashes of their ids; every piece of askers meets every piece of
   filed rows. So a group is bounded whatever a cell holds.
4. A group compares a row with its cells alone and yields k candidates, from numpy products
   over blocks of rows; the best k of a row's few lists are its neighbours.

The cell table (at most ``FIT_ROWS`` / 8 centroids) travels with the tasks. Ties go to the
smaller id; a row is not its own neighbour; rows without a vector, or with one of another
length, have no neighbours and are none's; ids are taken to be unique.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..session import Scratch
from .quality import as_array
from .rank import top_n
from .sweep import plus_plus, start_rows

FIT_ROWS, PIECE_ROWS, ASK_ROWS, BLOCK_NUMBERS, TRIED, PAIRS = 4096, 1 << 15, 1 << 14, 1 << 21, 256, 1 << 12
_KEY = ["_c1", "_c2"]


def _lloyd(rows: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    c = plus_plus(rows, k, seed)
    for _ in range(rounds):
        label = ((c * c).sum(1) - 2 * rows @ c.T).argmin(1)
        c = np.stack([rows[label == j].mean(0) if (label == j).any() else c[j] for j in range(len(c))])
    return c


def fit_cells(rows: np.ndarray, cells: int, seed: int) -> tuple[np.ndarray, list[int]]:
    """About ``cells`` centroids, and the area of each: a coarse partition, and one inside each of its cells in proportion
    to their rows."""
    coarse = _lloyd(rows, max(1, round(cells ** 0.5)), seed)
    label = ((coarse * coarse).sum(1) - 2 * rows @ coarse.T).argmin(1)
    fine = [_lloyd(rows[label == j], max(1, round(cells * (label == j).mean())), seed) for j in range(len(coarse)) if (label == j).any()]
    return np.concatenate(fine), [i for i, c in enumerate(fine) for _ in c]


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64, copy=False)


def _route(cells, sample, probe: int, k: int):
    """Kernel: per row the ``probe`` cells nearest to it, and ``far``: the squared distance that no sample row of these cells but the
    k nearest ones falls short of. The k nearest of all rows of these cells are not beyond it."""
    def run(batches):
        c, s = cells.value, sample.value
        norm, most = (c * c).sum(1), min(probe, len(c))
        among, own = norm - 2 * s @ c.T, (s * s).sum(1)
        home = among.argmin(1)
        if len(c) > 1:  # a sample row between two cells may be filed under either
            two = np.partition(among, 1, axis=1)[:, :2]
            sure = two[:, 1] - two[:, 0] > 1e-9 * (own + norm.max())
            s, own, home = s[sure], own[sure], home[sure]
        step = max(1, BLOCK_NUMBERS // (len(c) + len(s)))
        for b in batches:
            x = _matrix(b.column(1))
            near, far = [], []
            for at in range(0, len(x), step):
                part = x[at:at + step]
                d = norm - 2 * part @ c.T
                best = np.argpartition(d, most - 1, axis=1)[:, :most] if most < len(c) else np.tile(np.arange(len(c)), (len(part), 1))
                near.append(np.take_along_axis(best, np.take_along_axis(d, best, 1).argsort(1, kind="stable"), 1))
                far.append(np.full(len(part), np.inf))
                if len(s) >= k:
                    mine = (part * part).sum(1)
                    slack = 1e-12 * (mine + own.max())
                    d = own - 2 * part @ s.T + mine[:, None]
                    d[~(d > slack[:, None])] = np.inf  # the row itself
                    if most < len(c):
                        seen = np.zeros((len(part), len(c)), bool)
                        np.put_along_axis(seen, near[-1], True, 1)
                        d[~seen[:, home]] = np.inf
                    far[-1] = np.partition(d, k - 1, axis=1)[:, k - 1] + slack
            near = np.concatenate(near) if near else np.zeros((0, most), int)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(near.astype(np.int32)), pa.list_(pa.int32())),
                                              pa.array(np.concatenate([np.zeros(0), *far]))], [*b.schema.names, "near", "far"])
    return run


def _try_out(cells, asked, k: int):
    """Kernel: for each of a few vectors, the k nearest rows of a partition and the cells these are filed under."""
    def run(batches):
        c, q = cells.value, asked.value
        norm, own = (c * c).sum(1), (q * q).sum(1)
        best = [(np.zeros(0), np.zeros(0, int))] * len(q)
        for b in batches:
            whole = _matrix(b.column(1))
            for at in range(0, len(whole), max(1, BLOCK_NUMBERS // (len(c) + len(q)))):
                x = whole[at:at + max(1, BLOCK_NUMBERS // (len(c) + len(q)))]
                home = (norm - 2 * x @ c.T).argmin(1)
                d = own[:, None] - 2 * q @ x.T + (x * x).sum(1)
                for i, row in enumerate(d):
                    far = np.concatenate([best[i][0], row])
                    keep = np.argsort(far, kind="stable")[:k + 1]  # the vector itself is among them
                    best[i] = far[keep], np.concatenate([best[i][1], home])[keep]
        rows = [(i, float(p), int(h)) for i, (ds, hs) in enumerate(best) for p, h in zip(ds, hs)]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(list(zip(*rows)) or [(), (), ()], (pa.int32(), pa.float64(), pa.int32()))],
                                         ["q", "dist", "cell"])
    return run


def probes_for(classes: DataFrame, cells: np.ndarray, rows: np.ndarray, k: int, recall: float) -> int:
    """How many cells a row must look into: the nearest rows of ``TRIED`` sample vectors among all rows are measured, and
    so many cells taken that they hold ``recall`` of them."""
    context = classes.sparkSession.sparkContext
    asked = rows[:TRIED]
    kernel = _try_out(context.broadcast(cells), context.broadcast(asked), k)
    found = classes.select("cid", "x").mapInArrow(kernel, "q int, dist double, cell int").groupBy("q").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("dist", "cell"))), 2, k).alias("near")).collect()  # TRIED rows of k
    order = ((cells * cells).sum(1) - 2 * asked @ cells.T).argsort(1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(cells))[None, :], 1)
    needed = sorted(place[r["q"], e["cell"]] for r in found for e in r["near"])
    return 1 + int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) if needed else 1


def _bounds(x: np.ndarray, a: np.ndarray, far: np.ndarray):
    """Filed rows x, asking rows a and their limits -> (X, A, most, slack) in single precision: a pair whose squared distance is within
    the limit has A @ X <= most, whatever the rounding; a product is at most 2 * slack below the true value less own."""
    error = np.finfo(np.float32).eps * (x.shape[1] + 8)
    middle = np.nan_to_num(x[np.isfinite(x).all(1)].mean(0)) if np.isfinite(x).all(1).any() else np.zeros(x.shape[1])
    x, a = x - middle, a - middle
    scale = max((np.abs(m[np.isfinite(m)]).max(initial=0.0) for m in (x, a))) or 1.0
    x, a = x / scale, a / scale
    norm, own = (x * x).sum(1), (a * a).sum(1)
    most = far / scale / scale - own * (1 - error) + error * np.where(np.isfinite(far), far / scale / scale, 0.0) + 1e-30
    return (np.column_stack([x, norm * (1 - 2 * error)]).astype(np.float32), np.column_stack([-2 * a, np.ones(len(a))]).astype(np.float32),
            np.nextafter(most.astype(np.float32), np.float32(np.inf)), error * (own + 2 * norm.max(initial=0.0)))


def _nearest(k: int):
    """Kernel of one piece: filed rows and asking rows -> per asking row the k nearest filed ones. Products in single precision
    rule out the pairs beyond a row's limit; the distances of the few that are left are measured."""
    def best_of(owner, dist, cid):
        order = np.lexsort((cid, dist, owner))
        owner = owner[order]
        best = np.arange(len(owner)) - np.searchsorted(owner, owner) < k
        return owner[best], dist[order[best]], cid[order[best]]

    def search(x, ids, a, asking, flat, most, slack):
        """One cell's rows x and those that ask it -> (row of a, dist, cid)."""
        low = flat[1] @ flat[0].T
        hit = np.flatnonzero(low <= most[:, None])
        if len(hit) > 8 * k * len(a) and k < len(ids):  # limits too wide to rule out much: the k nearest of this cell set them
            low[asking[:, None] == ids] = np.inf
            most = np.fmin(most, np.partition(low, k - 1, axis=1)[:, k - 1] + 2 * slack.astype(np.float32))
            hit = np.flatnonzero(low <= most[:, None])
        row, col = np.divmod(hit, len(ids))
        dist = np.concatenate([np.zeros(0), *(np.sqrt(((a[row[i:i + PAIRS]] - x[col[i:i + PAIRS]]) ** 2).sum(1)) for i in range(0, len(row), PAIRS))])
        found = np.isfinite(dist) & (asking[row] != ids[col])
        return row[found], dist[found], ids[col[found]]

    def run(filed: pa.Table, asks: pa.Table) -> pa.Table:
        ids, home, asking = filed["cid"].to_numpy(), filed["home"].to_numpy(), asks["asking"].to_numpy()
        out = [(np.zeros(0, int), np.zeros(0), np.zeros(0, np.int64))]
        if len(ids) and len(asking):
            by_home = home.argsort(kind="stable")
            ids, home = ids[by_home], home[by_home]
            x, a = _matrix(filed["x"])[by_home], _matrix(asks["ax"])
            far = asks["far"].to_numpy() if "far" in asks.column_names else np.full(len(a), np.inf)
            with np.errstate(all="ignore"):
                flat_x, flat_a, most, slack = _bounds(x, a, far)
                looks = asks["looks"].combine_chunks()
                row = np.repeat(np.arange(len(a)), pc.list_value_length(looks).to_numpy(zero_copy_only=False))
                cell = looks.flatten().to_numpy(zero_copy_only=False)
                by_cell = cell.argsort(kind="stable")
                cell, row = cell[by_cell], row[by_cell]
                for c in np.intersect1d(home, cell):
                    here = slice(np.searchsorted(home, c), np.searchsorted(home, c, side="right"))
                    who = row[np.searchsorted(cell, c):np.searchsorted(cell, c, side="right")]
                    step = max(1, BLOCK_NUMBERS // (here.stop - here.start))
                    for at in range(0, len(who), step):
                        w = who[at:at + step]
                        r, d, q = search(x[here], ids[here], a[w], asking[w], (flat_x[here], flat_a[w]), most[w], slack[w])
                        out.append(best_of(w[r], d, q) if len(r) > 2 * k * len(w) else (w[r], d, q))
        owner, dist, cid = best_of(*map(np.concatenate, zip(*out)))
        found, n = np.unique(owner, return_counts=True)
        near = pa.StructArray.from_arrays([pa.array(dist, pa.float64()), pa.array(cid, pa.int64())], ["dist", "cid"])
        return pa.table([pa.array(asking[found], pa.int64()), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], n.cumsum()]), pa.int32()), near)],
                        names=["cid", "near"])
    return run


def _class_neighbors(scratch: Scratch, classes: DataFrame, k: int, cells: int | None, probe: int | None, recall: float, seed: int) -> DataFrame:
    """classes (cid, x) -> cid, near: array of (dist, cid), the k nearest classes."""
    spark = classes.sparkSession
    n = classes.count()
    rows = start_rows(classes.select(F.col("x").cast("array<double>").alias("x")), "x", len(classes.select("x").first()[0]), seed)[:FIT_ROWS]
    fitted, area = fit_cells(rows, cells or max(1, min(FIT_ROWS // 8, round(n ** 0.5))), seed)
    probe = probe or probes_for(classes, fitted, rows, k, recall)
    sent = spark.sparkContext.broadcast(fitted)
    schema = f"cid long, x {classes.schema['x'].dataType.simpleString()}, near array<int>, far double"
    routed = scratch.save(classes.select("cid", "x").mapInArrow(_route(sent, spark.sparkContext.broadcast(rows), probe, k), schema))
    area_of = lambda c: F.element_at(F.array(*map(F.lit, area)), c + 1)
    filed = routed.select("cid", "x", F.col("near")[0].alias("home")).withColumn("area", area_of(F.col("home")))
    # of each row the areas it looks into
    asks = routed.select(F.col("cid"), "x", "near", "far", F.explode(F.array_distinct(F.transform("near", area_of))).alias("area"))
    load = filed.groupBy("area").agg(F.count(F.lit(1)).alias("filed")).join(
        asks.groupBy("area").agg(F.count(F.lit(1)).alias("asks")), "area")  # as many rows as areas
    plan = F.broadcast(load.select("area", *[F.greatest(F.lit(1), F.ceil(F.col(c) / most)).cast("int").alias(o)
                                             for c, most, o in (("filed", PIECE_ROWS, "pieces"), ("asks", ASK_ROWS, "splits"))]))
    each = lambda upto: F.explode(F.sequence(F.lit(0), F.col(upto) - 1))
    part = lambda of, salt: F.pmod(F.xxhash64("cid", F.lit(salt)), F.col(of)).cast("int")
    filed = filed.join(plan, "area").select("cid", "x", "home", "area", part("pieces", 1).alias("piece"), each("splits").alias("split"))
    looks = F.filter("near", lambda c: area_of(c) == F.col("area"))
    asks = asks.join(plan, "area").select(F.col("cid").alias("asking"), F.col("x").alias("ax"), looks.alias("looks"), "far", "area",
                                          part("splits", 2).alias("split"), each("pieces").alias("piece"))
    keys = ["area", "piece", "split"]
    found = filed.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(_nearest(k), "cid long, near array<struct<dist:double,cid:long>>")
    lists = found.select("cid", F.explode("near").alias("e")).groupBy("cid").agg(F.slice(F.sort_array(F.collect_list("e")), 1, k).alias("near"))
    return scratch.save(lists)  # a row has at most areas x pieces lists of k


def knn(df: DataFrame, features: str, id_col: str, k: int, cells: int | None = None, probe: int | None = None, recall: float = 0.97,
        seed: int = 42) -> DataFrame:
    """Id, rank (from 1), neighbor, dist; k rows per row (fewer where there are fewer other rows). ``probe`` cells are
    looked into, by default as many as ``recall`` needs."""
    spark = df.sparkSession
    scratch = Scratch(spark, "knn")
    rows = as_array(df.select(F.col(id_col).cast("long").alias("id"), F.col(features).alias("_f")), "_f").select("id", F.col("_x").alias("x"))
    rows = rows.where(F.col("id").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    first = rows.select(F.size("x").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").first()
    schema = "id long, rank int, neighbor long, dist double"
    if first is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("x") == first["w"]).withColumns({"_c1": F.xxhash64("x", F.lit(1)), "_c2": F.xxhash64("x", F.lit(2))})
    kind = df.schema[features].dataType
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType):  # the same numbers in half the bytes
        rows = rows.withColumn("x", F.col("x").cast(kind))
    rows = scratch.save(rows)
    # classes of equal vectors with their least k + 1 ids, found in two rounds, so that a large class is no single task
    least = top_n(rows.select(*_KEY, "id", F.lit(0).alias("_s")), "_s", k + 1, by=_KEY, tiebreak=["id"])
    classes = least.groupBy(*_KEY).agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("cid", F.col("ids")[0])
    classes = scratch.save(rows.join(classes.withColumnRenamed("cid", "id"), ["id", *_KEY]).withColumnRenamed("id", "cid"))
    near = _class_neighbors(scratch, classes, k, cells, probe, recall, seed)
    members = classes.select(F.col("cid").alias("_other"), "ids")
    wide = near.select("cid", F.explode("near").alias("e")).select("cid", F.col("e.dist").alias("dist"), F.col("e.cid").alias("_other"))
    wide = wide.join(members, "_other").select("cid", F.explode(F.transform("ids", lambda i: F.struct(F.col("dist"), i.alias("neighbor")))).alias("e"))
    others = wide.groupBy("cid").agg(F.slice(F.sort_array(F.collect_list("e")), 1, k).alias("others"))
    known = scratch.save(classes.select(*_KEY, "cid", "ids").join(others, "cid", "left").select(*_KEY, "ids", "others"))
    empty = F.array().cast("array<struct<dist:double,neighbor:long>>")
    own = lambda: F.transform(F.filter("ids", lambda i: i != F.col("id")), lambda i: F.struct(F.lit(0.0).alias("dist"), i.alias("neighbor")))
    out = rows.select("id", *_KEY).join(known, _KEY).select(
        "id", F.posexplode(F.slice(F.concat(own(), F.coalesce("others", empty)), 1, k)).alias("rank", "e"))
    out = out.select("id", (F.col("rank") + 1).alias("rank"), F.col("e.neighbor").alias("neighbor"), F.col("e.dist").alias("dist"))
    return out


def core_distances(near: DataFrame, min_samples: int) -> DataFrame:
    """Id, core = distance to the ``min_samples``-th neighbour (to the last one, where there are fewer)."""
    return near.where(F.col("rank") <= min_samples).groupBy("id").agg(F.max("dist").alias("core"))


def mutual_reachability(near: DataFrame, core: DataFrame) -> DataFrame:
    """U, v, w with u < v: every neighbour pair once, w the largest of its distance and the two core distances."""
    pairs = near.select(F.least("id", "neighbor").alias("u"), F.greatest("id", "neighbor").alias("v"), "dist") \
        .groupBy("u", "v").agg(F.min("dist").alias("dist"))
    c = lambda name: core.select(F.col("id").alias(name), F.col("core").alias(f"_{name}"))
    return pairs.join(c("u"), "u").join(c("v"), "v").select("u", "v", F.greatest("dist", "_u", "_v").alias("w"))

"""N-gram Jaccard join (operator 4): a count-vector R-tree over shingle sets.

Two texts link when 100 * |A & B| >= percent * |A | B| on their sets of distinct
k-word shingles. Exact, in these steps:

1. *Points.* A set's shingles are hashed into groups; the counts per group are a
   point whose coordinates sum to the set's size. Equal sets are one point
   (``node``), so groups of exact copies cost one.
2. *Cells.* A link allows at most T = s(100 - percent)/(100 + percent) shingles
   outside the overlap for sizes summing to s. So with B > T ranges of groups,
   two linked points of one size class agree in all coordinates of at least
   B - T ranges. A cell of the index is (size class, range, the counts in
   that range); a point stands in the cells of its T + 1 fullest ranges (ties by
   number), in its class and in the next classes that a partner can be in. Of two
   linked points, the one whose list ends earlier in that order has T + 1 ranges
   there, so one agrees and stands in both lists. Points without company in any
   cell are done. (Ranges that are empty in both points agree too: a point with
   B - T or more empty ranges also stands in a cell for each choice of B - T of
   them.)
3. *Stars.* In each cell every point is paired with the least one. The overlap
   is bounded by the sum of the coordinate minima of the two points (about four
   shingles to a group); only pairs that pass have their sets compared. The links
   give first components.
4. *Families.* Only cells that still hold several components go on. Their
   points of different components are bounded pair by pair; the pairs that pass
   connect points to families (each cell gives a spanning forest of them, so no
   more pairs than points). A link that is still missing lies within a family.
   Each family then has its sets compared, pairs that pass the bound only, and
   none whose points are connected by then: near copies cost one pass.
   In both steps the points, ordered by component and size, are cut into tiles
   of bounded total size, each with its bounding rectangle (greatest
   coordinates); two tiles meet only if the summed minima of their rectangles
   allow a link and they are not of one component.
5. Components of all links; the id is the smallest doc_id.

Hash values have 64 bits and stand for the shingles. Hot cells are linear in 3;
in 4 a task works on two tiles at a time, whatever the size of the cell.

Defined results: null, empty and blank texts have no shingles and are linked
with nothing (component_id = doc_id); each input row gives one row, so repeated
ids are separate texts; a null id takes part, and a component of null ids alone
has a null id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import components
from .common import Scratch, saved, text_slices
from .shingles import U, mix, shingle_sets

GROUPS = 32
#: Below, a set may agree with another in empty ranges alone, and the keys for that grow beyond all bounds.
LEAST_PERCENT = 70
TILE_SHINGLES = 500_000
BROADCAST_NODES = 500_000  # ids of 16 bytes; beyond, the texts are shuffled to them
FINE = U(20)  # group of a shingle: its hash without the last 20 bits
_CLASSES = [1]
while _CLASSES[-1] < 1 << 40:
    _CLASSES.append(max(_CLASSES[-1] + 1, -(-_CLASSES[-1] * 7 // 5)))


def fingerprint(s: np.ndarray) -> int:
    """Name of a set: signed 64 bits."""
    return int(mix(np.add.reduce(mix(s ^ U(0x5851F42D4C957F2D)), keepdims=True) + U(len(s))).astype(np.int64)[0])


def cells(s: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the index cells that the set stands in."""
    n, out = len(s), []
    high, value = s >> U(32), mix(s >> FINE)
    for j in range(bisect_right(_CLASSES, n) - 1, len(_CLASSES) - 1):
        if 100 * n < percent * _CLASSES[j]:
            break
        differ = 2 * (_CLASSES[j + 1] - 1) * (100 - percent) // (100 + percent)
        if not differ:  # only equal sets link here
            continue
        agree = 3 + differ // 4
        ranges = differ + agree
        r = (high * U(ranges)) >> U(32)
        at = np.flatnonzero(np.diff(r, prepend=r[0] + U(1)))
        # the counts of a range as a linear hash: sum over its groups of count * random value
        keys = mix(mix(np.add.reduceat(value, at)) + r[at] * U(0x9E3779B97F4A7C15) + U(j << 44))
        out.append(keys[np.argsort(-np.diff(at, append=n), kind="stable")[:differ + 1]])
        if ranges - len(at) >= agree:
            empty = sorted(set(range(ranges)) - set(r[at].tolist()))
            names = [hash((j, c)) & (1 << 64) - 1 for c in itertools.combinations(empty, agree)]
            out.append(mix(np.array(names, U)))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Both sorted and distinct."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int(np.count_nonzero(b[at] == a)) if len(b) else 0
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def _points(df: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n, node, keys."""
    def run(batches):
        for batch in text_slices(batches, 1):
            sets = shingle_sets(batch.column(1).to_pylist(), k)
            keys = [cells(s, percent) if len(s) else np.zeros(0, np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([fingerprint(s) for s in sets], pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(x) for x in keys]), pa.int32()),
                                         pa.array(np.concatenate([np.zeros(0, np.int64), *keys]), pa.int64()))],
                ["doc_id", "n", "node", "keys"])

    return df.mapInArrow(run, "doc_id long, n long, node long, keys array<long>")


def point(s: np.ndarray) -> np.ndarray:
    """Counts of the shingles by the first bits of their hash, about four to a group."""
    bits = min(20, max(5, (len(s) // 4).bit_length()))
    return np.bincount((s >> U(64 - bits)).astype(np.int64), minlength=1 << bits).astype("<u2")


def folded(p: np.ndarray, groups: int) -> np.ndarray:
    """The point with fewer groups."""
    return p.reshape(groups, -1).sum(1)


def may_link(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether the summed coordinate minima reach the overlap that a link needs."""
    groups = min(len(p), len(q))
    p, q = folded(p, groups), folded(q, groups)
    return int(np.minimum(p, q).sum()) * (100 + percent) >= percent * int(p.sum() + q.sum())


def _sets(df: DataFrame, k: int) -> DataFrame:
    """(doc_id, text, node) -> node, n, set, point, coarse (GROUPS coordinates): the rows whose text is the node's."""
    def run(batches):
        for batch in text_slices(batches, 1):
            rows = []
            for node, s in zip(batch.column(2).to_pylist(), shingle_sets(batch.column(1).to_pylist(), k)):
                if fingerprint(s) == node:
                    p = point(s)
                    rows.append((node, len(s), s.tobytes(), p.tobytes(), folded(p, GROUPS).tolist()))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, kinds)],
                                             ["node", "n", "set", "point", "coarse"])

    return df.mapInArrow(run, "node long, n long, set binary, point binary, coarse array<int>").dropDuplicates(["node"])


def _bound(a: str, b: str):
    """Greatest possible overlap of two points or rectangles: the sum of their coordinate minima."""
    return sum((F.least(F.get(a, F.lit(i)), F.get(b, F.lit(i))) for i in range(GROUPS)), F.lit(0))


def _tested(pairs: DataFrame, sets: DataFrame, column: str, dtype, test, percent: int) -> DataFrame:
    """Those of the pairs (u, v) whose ``column`` passes ``test``."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col(column).alias(f"_{c}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "_u", "_v")

    def run(batches):
        for batch in batches:
            u, v, a, b = (c.to_pylist() for c in batch.columns)
            yes = [test(np.frombuffer(x, dtype), np.frombuffer(y, dtype), percent) for x, y in zip(a, b)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, y in zip(c, yes) if y], pa.int64()) for c in (u, v)], ["u", "v"])

    return both.mapInArrow(run, "u long, v long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (u, v) that link: by their points first, then by their sets."""
    return _tested(_tested(pairs, sets, "point", "<u2", may_link, percent), sets, "set", U, links, percent)


def _placed(leaves: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of the cells that hold several components, with ``comp``."""
    rows = leaves.join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    mixed = rows.groupBy("leaf").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("leaf")
    return rows.join(mixed, "leaf")


def _tasks(rest: DataFrame, sets: DataFrame, percent: int, tile_shingles: int, column: str, save) -> DataFrame:
    """rest: (leaf, node, comp). One row per point and pair of tiles that can hold
    a link between components: leaf, p, q, tile, node, comp, n, point, ``column``;
    the rows of a task stand together in a partition."""
    sized = rest.join(sets.select("node", "n", "coarse"), "node")
    upto = Window.partitionBy("leaf").orderBy("comp", "n", "node").rowsBetween(Window.unboundedPreceding, -1)
    sized = save(sized.withColumn("tile", F.floor(F.coalesce(F.sum("n").over(upto), F.lit(0)) / tile_shingles)))
    tile = sized.groupBy("leaf", "tile").agg(
        F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min("n").alias("n0"), F.max("n").alias("n1"),
        F.array(*[F.max(F.get("coarse", F.lit(i))) for i in range(GROUPS)]).alias("box"))
    p, q = (tile.select("leaf", *[F.col(c).alias(f"{x}_{c}") for c in ("tile", "c0", "c1", "n0", "n1", "box")]) for x in "pq")
    meet = p.join(q, "leaf").where("p_tile <= q_tile and not (p_c0 = p_c1 and q_c0 = q_c1 and p_c0 = q_c0)")
    meet = meet.where(f"100 * q_n1 >= {percent} * p_n0 and 100 * p_n1 >= {percent} * q_n0")
    meet = meet.where(_bound("p_box", "q_box") * (100 + percent) >= percent * (F.col("p_n0") + F.col("q_n0")))
    meet = meet.select("leaf", F.col("p_tile").alias("p"), F.col("q_tile").alias("q"))
    tasks = meet.select("leaf", "p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("tile"))
    rows = tasks.join(sized.select("leaf", "tile", "node", "comp", "n"), ["leaf", "tile"])
    rows = rows.join(sets.select("node", *dict.fromkeys(("point", column))), "node")
    return rows.select("leaf", "p", "q", "tile", "node", "comp", "n", F.col("point"), F.col(column).alias("values")).repartition(
        "leaf", "p", "q").sortWithinPartitions("leaf", "p", "q")


def _connecting(tasks: DataFrame, percent: int, exact: bool) -> DataFrame:
    """Pairs (u, v) that join components within a task: those that pass the bound,
    and if ``exact`` those that link. Pairs already connected are passed over."""
    def pairs_of(task: list[tuple]) -> list[tuple[int, int]]:
        task.sort(key=lambda r: (r[5], r[6], r[4]))
        _, one, other, tile, node, comp, n, points, values = zip(*task)
        points = [np.frombuffer(x, "<u2") for x in points]
        least = min(map(len, points))
        m = np.array([folded(x, least) for x in points], np.int64)
        _, root = np.unique(np.array(comp), return_inverse=True)
        n, first, within, out = np.array(n), np.array(tile) == one[0], one[0] == other[0], []
        sets = [np.frombuffer(x, U) for x in values] if exact else None
        for i in range(len(node)):
            if not within and not first[i]:
                continue
            ok = root != root[i]
            ok &= np.arange(len(node)) > i if within else ~first
            at = np.flatnonzero(ok)
            at = at[np.minimum(m[at], m[i]).sum(1) * (100 + percent) >= percent * (n[at] + n[i])]
            for j in at.tolist():
                if root[i] != root[j] and (not exact or links(sets[i], sets[j], percent)):
                    out.append((node[i], node[j]))
                    root[root == root[j]] = root[i]
        return out

    def run(batches):
        task: list[tuple] = []
        for batch in batches:
            found: list[tuple[int, int]] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if task and row[:3] != task[0][:3]:
                    found += pairs_of(task)
                    task = []
                task.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["u", "v"])
        found = pairs_of(task) if task else []
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["u", "v"])

    return tasks.mapInArrow(run, "u long, v long")


def groups(df: DataFrame, k: int, percent: int, doc_id: str = "doc_id", text: str = "text",
           tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """doc_id, n, node (names the shingle set), root (names the component): one row per input row."""
    if not LEAST_PERCENT <= percent <= 100:
        raise ValueError(f"the index serves similarities from {LEAST_PERCENT} to 100 %")
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    scratch = Scratch(df.sparkSession, "ngram-join")
    save = scratch.save
    whole = save(_points(docs, k, percent))
    points = save(whole.select("doc_id", "n", "node"))
    # one row per set and cell it stands in; then the cells with company
    keyed = whole.where("n > 0").select("node", "keys").dropDuplicates(["node"]).select("node", F.explode("keys").alias("key"))
    cell = Window.partitionBy("key")
    leaves = keyed.select("node", F.min("node").over(cell).alias("center"), F.max("node").over(cell).alias("last"),
                          F.count(F.lit(1)).over(cell).alias("m"), F.bit_xor(F.xxhash64("node")).over(cell).alias("leaf"))
    # cells with the same points count once
    leaves = save(leaves.where("center <> last").select("leaf", "node", "center", "m").distinct())
    scratch.drop(1)  # the keys
    wanted = points.join(leaves.select("node").distinct(), "node").groupBy("node").agg(F.min("doc_id").alias("_id"))
    wanted = save(wanted)
    few = wanted.count() <= BROADCAST_NODES
    texts = docs.join(F.broadcast(wanted) if few else wanted, F.col("doc_id").eqNullSafe(F.col("_id"))).select("doc_id", "text", "node")
    sets = save(_sets(texts, k))
    pairs = save(leaves.where("node <> center").select(F.col("center").alias("u"), F.col("node").alias("v")).distinct())
    roots = save(components(_verified(pairs, sets, percent), save))
    mixed = save(_placed(leaves.where("m > 2").select("leaf", "node"), roots))
    near = _connecting(_tasks(mixed, sets, percent, tile_shingles, "point", save), percent, exact=False)
    family = components(near.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))), save)
    members = mixed.select("node", "comp").distinct().join(family, "node").select(F.col("root").alias("leaf"), "node", "comp")
    several = members.groupBy("leaf").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("leaf")
    linked = _connecting(_tasks(members.join(several, "leaf"), sets, percent, tile_shingles, "set", save), percent, exact=True)
    roots = save(components(linked.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))), save))
    placed = points.join(roots, "node", "left").select("doc_id", "n", "node", F.coalesce("root", "node").alias("root"))
    placed = saved(placed, "groups")
    scratch.drop()
    return placed


def ngram_join(df: DataFrame, k: int = 3, percent: int = 90, doc_id: str = "doc_id", text: str = "text",
               tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per input row."""
    placed = groups(df, k, percent, doc_id, text, tile_shingles)
    least = placed.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return placed.join(least, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(df: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` less all but one of each component: the smallest id
    stays (null ids last), texts without words all stay. Only the ids that go
    are joined to the texts; rows of repeated or null ids, whose id does not name
    one text, are told apart by their shingle sets."""
    placed = groups(df, k, percent, doc_id, text)
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("node").alias("c"))
    stays = placed.where("n > 0").groupBy("root").agg(F.min(order).alias("o")).select(
        F.col("o.b").alias("_id"), F.col("o.c").alias("_node"))
    unclear = placed.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.col("doc_id").alias("_id"))
    rows = df.select(F.struct(*df.columns).alias("_row"), F.col(doc_id).cast("long").alias("doc_id"))
    goes = placed.where("n > 0").join(stays, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("node") == F.col("_node")), "left_anti")
    goes = goes.select(F.col("doc_id").alias("_id")).unionByName(unclear).distinct()
    kept = rows.join(goes, F.col("doc_id") == F.col("_id"), "left_anti").where("doc_id is not null").select("_row.*")
    if unclear.isEmpty():
        return kept
    some = rows.join(unclear, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")

    @F.pandas_udf("struct<n:long,node:long>")
    def name(texts):
        found = [s for at in range(0, len(texts), 256) for s in shingle_sets([(t or "").encode() for t in texts[at:at + 256]], k)]
        return pd.DataFrame({"n": [len(s) for s in found], "node": [fingerprint(s) for s in found]})

    some = some.withColumn("_s", name(F.col(f"_row.`{text}`"))).select("_row", "doc_id", "_s.n", "_s.node")
    first = some.where("n > 0").join(stays, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("node") == F.col("_node")), "left_semi")
    first = first.groupBy("doc_id", "node").agg(F.first("_row").alias("_row"))
    return kept.unionByName(some.where("n = 0").select("_row.*")).unionByName(first.select("_row.*"))

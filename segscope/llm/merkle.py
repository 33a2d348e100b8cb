"""Merkle dataset manifest (operator 13): built levels as parent-linked node rows,
climbed leaf by leaf with a recursive query.

Each row of a table is a leaf; the leaves of a source, in id order, form a tree in
which every run of ``FAN`` consecutive nodes has their hash as parent, and the
roots of the sources, in source order, form one more tree of the same kind.

*Places.* One total order over (source, id) gives every leaf its place
(``operators.rank.ranked``: key ranges, so no source meets in one task).

*Levels.* ``STRIDE`` levels are built at a time: ``FAN ** STRIDE`` neighbours meet
in one group, whatever their source's size, and are hashed level by level inside
the row. A round leaves one node of 729, so the rounds are few (three for 387 million
leaves of one source) and each shuffles a 729th of the one before. What is
stored is one row per node that a climb passes: its key, its parent's key (the
node ``STRIDE`` levels up, or the source's place in the upper tree), the parent's
digest, and the siblings on the way, level by level.

*Climb.* A Spark recursive query starts with every leaf's node row and its digest
as found in the data that is to be checked, appends the siblings to the proof,
folds the digest with them and goes on at the parent's node row, until there is
none. Each step is one equi-join with the rows above the leaves, a 729th of them.

Hashes are sha256 over hexadecimal text; in rows a digest takes its 32 bytes.

Defined results: the null source comes first; rows that repeat an id stand next
to each other, in the order of a hash of their leaves; a null id comes first in its source;
the proof of a lone leaf is the hash of nothing; an empty table has no rows;
columns other than the leaf's five are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rank import ranked
from .common import Scratch, saved

FAN, STRIDE = 3, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def hashed(text: Column) -> Column:
    """The 32 bytes of the sha256 of a text."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def as_hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def leaf(fields: list[Column]) -> Column:
    """Digest of a row: each value as its UTF-8 length, a colon and itself, or ``-`` for null."""
    def one(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return hashed(F.concat(*map(one, fields)))


def _joined(digests: Column) -> Column:
    return F.aggregate(digests, F.lit(b""), lambda acc, d: F.concat(acc, d))


def _above(level: Column) -> Column:
    """The next level: the hash of each run."""
    runs = F.sequence(F.lit(0), ((F.size(level) - 1) / FAN).cast("int"))
    return F.transform(runs, lambda i: hashed(as_hex(_joined(F.slice(level, i * FAN + 1, FAN)))))


def _steps(levels: list[Column], place: Column) -> Column:
    """For a node at ``place`` of the lowest level: per level the siblings before and after it in its run."""
    steps = []
    for depth, level in enumerate(levels):
        at = (place / FAN ** depth).cast("int")
        run = (at / FAN).cast("int") * FAN
        steps.append(F.when(F.col("_depth") > depth, F.struct(
            _joined(F.slice(level, run + 1, at - run)).alias("before"),
            _joined(F.slice(level, at + 2, FAN - 1 - (at - run))).alias("after"))))
    return F.filter(F.array(*steps), lambda s: s.isNotNull())


def _round(nodes: DataFrame, payload: tuple[str, ...] = ()) -> DataFrame:
    """Nodes (tree, level, place, n of them in the tree, digest, payload) -> their blocks of ``FAN ** STRIDE``: where each
    leads to (``up``, ``next_level``: -1 where the tree ends in its root), its ``top`` digest, and the members' paths."""
    block = FAN ** STRIDE
    grouped = nodes.groupBy("tree", "level", "n", F.floor(F.col("place") / block).alias("up")).agg(
        F.sort_array(F.collect_list(F.struct("place", "digest", *payload))).alias("_members"))
    # a block's height: the whole stride, or what is left to a root
    height = reduce(lambda acc, d: F.when(F.col("n") <= FAN ** d, d).otherwise(acc), range(STRIDE - 1, -1, -1), F.lit(STRIDE))
    grouped = grouped.withColumn("_depth", height).withColumn("_l0", F.transform("_members", lambda m: m["digest"]))
    for d in range(1, STRIDE + 1):
        grouped = grouped.withColumn(f"_l{d}", F.when(F.col("_depth") >= d, _above(F.col(f"_l{d - 1}"))).otherwise(F.col(f"_l{d - 1}")))
    levels = [F.col(f"_l{d}") for d in range(STRIDE)]
    paths = F.transform("_members", lambda m: F.struct(
        m["place"].alias("place"), m["digest"].alias("digest"), *[m[c].alias(c) for c in payload],
        _steps(levels, (m["place"] - F.col("up") * block).cast("int")).alias("steps")))
    return grouped.select("tree", "level", "n", "up", F.when(F.col("n") <= block, -1).otherwise(F.col("level") + 1).alias("next_level"),
                          F.col(f"_l{STRIDE}")[0].alias("top"), paths.alias("paths"))


def _build(scratch: Scratch, nodes: DataFrame, payload: tuple[str, ...] = ()) -> tuple[list[DataFrame], DataFrame]:
    """(node rows of each round, roots: tree, top) of the trees of ``nodes`` (tree, place, n, digest, payload). The rows
    of the first round are the leaves and keep the payload."""
    now, rows, roots = nodes.withColumn("level", F.lit(0)), [], []
    while True:
        carried = () if rows else payload
        built = scratch.save(_round(now, carried))  # stored: the arrays are worked out once
        rows.append(built.select("tree", "level", "up", "next_level", "top", F.explode("paths").alias("p")).select(
            "tree", "level", "up", "next_level", "top", "p.place", "p.steps", *([f"p.{c}" for c in ("digest", *carried)] if carried else [])))
        roots.append(built.where("next_level = -1").select("tree", "top"))
        open_trees = built.where("next_level >= 0")
        if open_trees.isEmpty():
            return rows, reduce(DataFrame.unionByName, roots)
        now = open_trees.select("tree", F.col("next_level").alias("level"), F.col("up").alias("place"),
                                F.ceil(F.col("n") / FAN ** STRIDE).alias("n"), F.col("top").alias("digest"))


UPPER, DONE = -1, -2


def _linked(rows: DataFrame, upper: bool, *more: str) -> DataFrame:
    """Node rows with their parent's key; ``ends``: which tree ends with this step."""
    root = F.col("next_level") == -1
    if upper:
        link = [F.when(root, DONE).otherwise(UPPER).cast("long"), F.col("next_level"), F.col("up")]
    else:  # the root of a source is a leaf of the upper tree, at the source's place
        link = [F.when(root, F.lit(UPPER).cast("long")).otherwise(F.col("tree")), F.when(root, 0).otherwise(F.col("next_level")),
                F.when(root, F.col("tree")).otherwise(F.col("up"))]
    return rows.select("tree", "level", "place", "steps", "top", *[c.alias(n) for c, n in zip(link, ("next_tree", "next_level", "next_place"))],
                       F.when(root, "all" if upper else "source").alias("ends"), *more)


_FOLD = ("aggregate(n.steps, {start}, (acc, s) -> "
         "unhex(sha2(CAST(lower(hex(concat(s.before, acc, s.after))) AS BINARY), 256)))")
_SIBLINGS = "aggregate(n.steps, X'', (acc, s) -> concat(acc, s.before, s.after))"
CLIMB = f"""
WITH RECURSIVE climb (row, digest, tree, level, place, folded, proof, subroot, root) AS (
  SELECT n.row, n.digest, n.next_tree, n.next_level, n.next_place, {_FOLD.format(start="n.found")}, {_SIBLINGS},
    CASE WHEN n.ends = 'source' THEN n.top END, CAST(NULL AS BINARY)
  FROM {{leaves}} n
  UNION ALL
  SELECT c.row, c.digest, n.next_tree, n.next_level, n.next_place, {_FOLD.format(start="c.folded")}, concat(c.proof, {_SIBLINGS}),
    CASE WHEN n.ends = 'source' THEN n.top ELSE c.subroot END, CASE WHEN n.ends = 'all' THEN n.top END
  FROM climb c JOIN {{nodes}} n ON c.tree = n.tree AND c.level = n.level AND c.place = n.place
)
SELECT row, digest, folded, proof, subroot, root FROM climb WHERE root IS NOT NULL
"""


def manifest(docs: DataFrame, found: Column, fields: tuple[str, ...] = FIELDS, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """doc_id, leaf, subroot, root, folded_root (hexadecimal) and proof (the siblings' bytes from the leaf up). The tree is
    built from ``docs``; ``found`` is the last field as it is found when a leaf is checked, and its digest is folded."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "merkle")
    own = [F.col(c) for c in fields]
    leaves = scratch.save(docs.select(F.col(doc_id).alias("row"), F.col(source).cast("string").alias("source"),
                                      leaf(own).alias("digest"), leaf([*own[:-1], found]).alias("found")))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = scratch.save(ranked(leaves.withColumn("_tie", F.xxhash64("digest")), [("source", True), ("row", True), ("_tie", True)],
                                 n_ranges=ranges).select("row", "source", "digest", "found", "_rank"))
    scratch.drop(1)
    # a source's number is its place among the sources; its leaves are counted from its first rank
    sources = placed.groupBy("source").agg(F.min("_rank").alias("_from"), F.count(F.lit(1)).alias("n"))
    sources = scratch.save(ranked(sources, [("source", True)]).select(
        F.col("source").alias("_source"), "_from", F.col("n"), (F.col("_rank") - 1).cast("long").alias("tree")))
    placed = placed.join(sources, F.col("source").eqNullSafe(F.col("_source"))).select(
        "row", "tree", (F.col("_rank") - F.col("_from")).alias("place"), "n", "digest", "found")
    lower, subroots = _build(scratch, placed, ("row", "found"))
    scratch.drop(2)
    upper, _ = _build(scratch, subroots.select(F.lit(UPPER).cast("long").alias("tree"), F.col("tree").alias("place"),
                                               F.lit(sources.count()).cast("long").alias("n"), F.col("top").alias("digest")))
    leaf_rows = _linked(lower[0], False, "row", "digest", "found")
    nodes = scratch.save(reduce(DataFrame.unionByName, [*[_linked(d, False) for d in lower[1:]], *[_linked(d, True) for d in upper]]))
    # the session's bound on the rows of a recursion is for endless ones; this one ends with the height of the tree
    name = "spark.sql.cteRecursionRowLimit"
    limit = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        out = saved(spark.sql(CLIMB, leaves=leaf_rows, nodes=nodes), "merkle-climb")
    finally:
        spark.conf.set(name, limit)
    scratch.drop()
    return out.select(F.col("row").alias("doc_id"), as_hex(F.col("digest")).alias("leaf"), as_hex(F.col("subroot")).alias("subroot"),
                      as_hex(F.col("root")).alias("root"), "proof", as_hex(F.col("folded")).alias("folded_root"))

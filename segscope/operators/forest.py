"""F6c, F6d, F6e, G5: spanning forest of a weighted graph, flat cuts, the hierarchy of a
ladder of thresholds with its choice by stability, and validity read off the forest.

Everything works on edge and component tables; a round is joins and map-side
aggregates, and stored before the next one.

*Forest* (Borůvka). In each round every component takes its least edge, by (weight, u, v),
so that equal weights make no circle but that of two components with one edge; the components
these edges join are merged along them, in as many steps as the longest way has doublings, and the
edges between what is left are contracted (of parallel ones the least stays). The number
of rounds grows with the logarithm of the nodes.

*Hierarchy.* The components at any threshold are those of the forest. The ladder holds all
distinct weights while there are no more than ``levels``, else that many quantiles of
them. The components of all levels are found together, an edge of the forest taking part in
every level from its own up; each has a row
(level, component, parent in the next coarser level, size). From the coarsest down, a
component of at least ``min_cluster_size`` rows stays the cluster of its parent while it
is the only such child, and starts a cluster where there are several. The stability of a
cluster is the sum over its levels of rows times the growth of 1 / threshold. Bottom-up,
level by level, a cluster is chosen if its stability is at least the sum of what its
children achieve; the whole is chosen only where nothing splits off and ``allow_single``
says so (parts that no threshold joins are children of the whole). Rows outside chosen clusters are noise, -1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch, cut_lineage
from .components import components
from .rank import ranked


def tops(links: DataFrame, save) -> DataFrame:
    """links (c, to): the one link of every node, where circles are of two nodes only -> (node, root), root being the smaller
    of the two. Each round doubles the way of the links that have not reached their root; ``save`` stores a round."""
    links = save(links)
    on = links.select(F.col("c").alias("to"), F.col("to").alias("next"))
    pair = F.col("next") == F.col("c")
    now = save(links.join(on, "to").select("c", F.when(pair, F.least("c", "to")).otherwise(F.col("next")).alias("to"), pair.alias("there")))
    while not now.where(~F.col("there")).isEmpty():
        on = now.select(F.col("c").alias("to"), F.col("to").alias("next"), "there")
        moved = now.where(~F.col("there")).select("c", "to").join(on, "to").select("c", F.col("next").alias("to"), "there")
        now = save(now.where("there").unionByName(moved))
    return now.select(F.col("c").alias("node"), F.col("to").alias("root"))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """F6e: the edges (u, v, w) of a minimum spanning forest of the graph of ``edges`` (u, v, w); loops, and edges without
    an end or a weight are ignored; ends are ordered u < v."""
    scratch = Scratch(edges.sparkSession, "forest")
    now = edges.where(F.col("u") != F.col("v")).where(F.col("w").isNotNull()).select(
        F.least("u", "v").cast("long").alias("u"), F.greatest("u", "v").cast("long").alias("v"), F.col("w").cast("double").alias("w"))
    now = now.select(F.col("u").alias("a"), F.col("v").alias("b"), F.struct("w", "u", "v").alias("e"))
    least = lambda d: d.groupBy("a", "b").agg(F.min("e").alias("e"))
    now, found = scratch.save(least(now)), None
    while not now.isEmpty():
        way = lambda c, to: now.select(F.col(c).alias("c"), F.struct("e", F.col(to).alias("to")).alias("way"))  # noqa: E731,B023
        taken = way("a", "b").unionByName(way("b", "a")).groupBy("c").agg(F.min("way").alias("way"))
        taken = scratch.save(taken.select("c", "way.to", "way.e"))
        picked = taken.select("e.u", "e.v", "e.w").distinct()  # an edge may be the least of both its ends
        found = picked if found is None else found.unionByName(picked)
        merged = tops(taken.select("c", "to"), scratch.save)
        now = now.join(merged.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a") \
                 .join(merged.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b").where("ra <> rb")
        now = scratch.save(least(now.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), "e")))
    out = cut_lineage(found) if found is not None else edges.sparkSession.createDataFrame([], "u long, v long, w double")
    scratch.drop()
    return out


def density_cut(nodes: DataFrame, edges: DataFrame, eps: float, min_cluster_size: int) -> DataFrame:
    """Id, cluster_num: components of the edges up to ``eps`` with enough rows, numbered by their least id, else -1.
    ``nodes`` has one column id."""
    comp = components(edges.where(F.col("w") <= eps).select("u", "v"))
    placed = nodes.join(comp.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("root"))
    kept = placed.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_cluster_size).select("root")
    numbered = ranked(kept, [("root", True)]).select("root", (F.col("_rank") - 1).cast("int").alias("cluster_num"))
    return placed.join(numbered, "root", "left").select("id", F.coalesce("cluster_num", F.lit(-1)).alias("cluster_num"))


def ladder(forest: DataFrame, levels: int) -> list[float]:
    """The thresholds, finest first: all distinct weights, or ``levels`` quantiles of them."""
    few = [r[0] for r in forest.select("w").distinct().orderBy("w").limit(levels + 1).collect()]
    if len(few) <= levels:
        return few
    marks = [(i + 1) / levels for i in range(levels)]
    return sorted(set(forest.agg(F.percentile_approx("w", marks, 100 * levels)).first()[0]))


def density_tree(nodes: DataFrame, forest: DataFrame, levels: int = 32, scratch: Scratch | None = None) -> tuple[DataFrame, list[float]]:
    """F6d: (level, comp, parent, size) of every component at every threshold, level 0 the finest; comp is the least id of
    its rows, parent that of the component that holds it in the next level (none in the last). Second: the thresholds."""
    save = (scratch or Scratch(nodes.sparkSession, "tree")).save
    steps = ladder(forest, levels)
    top = len(steps) - 1
    if not steps:
        return save(nodes.select(F.lit(-1).alias("level"), F.col("id").alias("comp"), F.lit(None).cast("long").alias("parent"),
                                 F.lit(1).cast("long").alias("size"))), steps
    # an edge is in every level from the first whose threshold it does not pass; all levels are merged at once
    first = F.size(F.filter(F.array(*map(F.lit, steps)), lambda s: s < F.col("w")))
    edges = forest.select("u", "v", first.alias("from")).where(F.col("from") <= top)
    edges = edges.select("u", "v", F.explode(F.sequence("from", F.lit(top))).alias("level"))
    merged = save(components(edges, cut=save, by=["level"]))
    root = merged.select("level", F.col("node").alias("comp"), "root")
    every = nodes.select(F.col("id").alias("comp"), F.explode(F.sequence(F.lit(0), F.lit(top))).alias("level"))
    comps = every.join(root, ["level", "comp"], "left").select("level", F.coalesce("root", "comp").alias("comp")) \
                 .groupBy("level", "comp").agg(F.count(F.lit(1)).alias("size"))
    comps = comps.unionByName(nodes.select(F.lit(-1).alias("level"), F.col("id").alias("comp"), F.lit(1).cast("long").alias("size")))  # rows as they are
    up = root.withColumn("level", F.col("level") - 1)
    tree = comps.join(up, ["level", "comp"], "left").select(
        "level", "comp", F.when(F.col("level") < top, F.coalesce("root", "comp")).alias("parent"), "size")
    return save(tree, by=("level",)), steps


def select_eom(tree: DataFrame, steps: list[float], min_cluster_size: int, allow_single: bool = False,
               scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """F6d: (id, cluster_num) and the condensed clusters (cluster, birth, parent, stability, chosen), from the tables of
    ``density_tree``. A cluster's key is the level of its birth and its component there."""
    spark = tree.sparkSession
    own = scratch or Scratch(spark, "eom")
    save, top = own.save, len(steps) - 1
    # 1 / threshold, a zero threshold taken as the least positive one's tenth
    least = min([s for s in steps if s > 0], default=1.0) / 10
    density = [1.0 / max(s, least) for s in steps] + [0.0]
    # from the coarsest level down: the cluster of each large component
    held, clusters = None, []
    for level in range(top, -1, -1):
        big = tree.where((F.col("level") == level) & (F.col("size") >= min_cluster_size)).select("comp", "parent", "size")
        gain = F.lit(density[level] - density[level + 1])
        if held is None:
            # several parts: children of a whole that no threshold joins; one part is that whole
            above = F.struct(F.lit(top + 1).alias("birth"), F.lit(None).cast("long").alias("comp"))
            above = above if len(big.limit(2).collect()) > 1 else F.lit(None).cast("struct<birth:int,comp:long>")
            now = big.select("comp", "size", F.struct(F.lit(level).alias("birth"), "comp").alias("cluster"), above.alias("up"))
        else:
            j = big.join(held.select(F.col("comp").alias("parent"), F.col("cluster").alias("_above")), "parent")
            j = j.withColumn("_sisters", F.count(F.lit(1)).over(Window.partitionBy("parent")))
            alone = F.col("_sisters") == 1
            now = j.select("comp", "size", F.when(alone, F.col("_above")).otherwise(F.struct(F.lit(level).alias("birth"), "comp")).alias("cluster"),
                           F.when(~alone, F.col("_above")).alias("up"))
        held = save(now)
        clusters.append(held.select("cluster", "up", (F.col("size") * gain).alias("gain"), "size"))
    every = clusters[0]
    for c in clusters[1:]:
        every = every.unionByName(c)
    every = save(every.groupBy("cluster").agg(F.max("up").alias("up"), F.sum("gain").alias("stability"), F.max("size").alias("size")))
    # bottom-up: what a cluster and its children achieve
    births = sorted((r[0] for r in every.select("cluster.birth").distinct().collect()))
    value = None
    for birth in births:
        here = every.where(F.col("cluster.birth") == birth)
        if value is None:
            done = here.withColumn("below", F.lit(0.0))
        else:
            below = value.where(F.col("up").isNotNull()).groupBy("up").agg(F.sum("value").alias("below")).withColumnRenamed("up", "cluster")
            done = here.join(below, "cluster", "left").withColumn("below", F.coalesce("below", F.lit(0.0)))
        whole = F.col("up").isNull()
        wins = (F.col("stability") >= F.col("below")) & (~whole | ((F.col("below") == 0) & F.lit(allow_single)))
        done = done.withColumns({"wins": wins, "value": F.when(wins, F.col("stability")).otherwise(F.col("below"))})
        value = save(done if value is None else value.unionByName(done.select(value.columns)))
    # top-down: the first winner on the way is chosen, and holds what is below it
    state = save(tree.where(F.col("level") == top).select("comp", F.lit(None).cast("struct<birth:int,comp:long>").alias("held")))
    winners = value.where("wins").select(F.col("cluster").alias("_w"), F.col("cluster.birth").alias("_birth"), F.col("cluster.comp").alias("_comp"))
    for level in range(top, -2, -1):
        if level < top:
            state = tree.where(F.col("level") == level).select("comp", "parent").join(
                state.select(F.col("comp").alias("parent"), "held"), "parent").select("comp", "held")
        mine = winners.where(F.col("_birth") == level).select(F.col("_comp").alias("comp"), "_w")
        state = save(state.join(mine, "comp", "left").select("comp", F.coalesce("held", "_w").alias("held")))
    chosen = state.where("held is not null").select("held").distinct().select(F.col("held.comp").alias("_comp"), F.col("held.birth").alias("_birth"))
    numbers = ranked(chosen, [("_comp", True), ("_birth", True)]).select(
        F.struct(F.col("_birth").alias("birth"), F.col("_comp").alias("comp")).alias("held"), (F.col("_rank") - 1).cast("int").alias("cluster_num"))
    numbers = save(numbers)
    labels = cut_lineage(state.join(numbers, "held", "left").select(F.col("comp").alias("id"), F.coalesce("cluster_num", F.lit(-1)).alias("cluster_num")))
    table = cut_lineage(value.join(numbers.withColumnRenamed("held", "cluster"), "cluster", "left").select(
        F.col("cluster.comp").alias("cluster"), F.col("cluster.birth").alias("birth"), F.col("up.comp").alias("parent"), "size", "stability",
        "cluster_num"))
    if scratch is None:
        own.drop()
    return labels, table


def validity(labels: DataFrame, forest: DataFrame, noise: int = -1) -> DataFrame:
    """G5, relative form: per cluster (cluster_num, n, sparseness, separation, validity) and its share in the index.
    Sparseness is the heaviest forest edge inside the cluster, separation the lightest forest edge that leaves it to
    another cluster (noise is no cluster); validity is their difference by the larger of them, 1 for a cluster that no edge
    leaves. ``weight`` is the cluster's share of all rows, noise included: the index is the sum of weight * validity."""
    end = lambda c: labels.select(F.col("id").alias(c), F.col("cluster_num").alias(f"c{c}"))
    e = forest.join(end("u"), "u").join(end("v"), "v").where((F.col("cu") != noise) & (F.col("cv") != noise))
    inside = e.where("cu = cv").groupBy(F.col("cu").alias("cluster_num")).agg(F.max("w").alias("sparseness"))
    across = e.where("cu <> cv").select(F.explode(F.array("cu", "cv")).alias("cluster_num"), "w").groupBy("cluster_num").agg(F.min("w").alias("separation"))
    sizes = labels.groupBy("cluster_num").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("weight", F.col("n") / sizes.agg(F.sum("n")).scalar()).where(F.col("cluster_num") != noise)
    t = sizes.join(inside, "cluster_num", "left").join(across, "cluster_num", "left").withColumn("sparseness", F.coalesce("sparseness", F.lit(0.0)))
    most = F.greatest("sparseness", "separation")
    v = F.when(F.col("separation").isNull(), 1.0).when(most > 0, (F.col("separation") - F.col("sparseness")) / most).otherwise(0.0)
    return t.withColumn("validity", v)

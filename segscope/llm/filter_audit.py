"""Filter interaction audit (operator 12): sorted posting lists.

For every part of a corpus (a language) and every filter there is the sorted
list of the rows that fail it. What a filter does after others, in any order, is
a size of unions and differences of these lists, so all orders are answered
without running the filters again.

1. One pass over the texts finds the failures that a text shows by itself and a
   digest of the text. The first copy of each text is the least id of its digest,
   an aggregate with map-side combine, so thousands of copies cost one row.
2. Rows, first copies and labels, a few bytes each, are dealt by id range. A task
   sorts its range and works through it in blocks of ids; a block's rows are
   numbered, and its lists are lists of these numbers: per part all rows, the
   rows that fail each filter (duplicates: all rows less the first copies), the
   good ones and the toxic ones.
3. In each block, the unions of all 2^F sets of filters and the differences that
   one more filter adds are merged by galloping (exponential search from the last
   place, runs between two hits are skipped whole). Sizes are summed per part,
   in the block, in the task and then over all ranges.

Nothing but sizes leaves a range, and a range holds one block of lists at a time.
Blocks end between two ids.

Filters: A fewer than ``MIN_WORDS`` words; B under half of the words distinct; C
more than 3 % capitals A-Z; D holds any of ``#$%&*|``; E the same text as a row
with a smaller id anywhere in the table. Words are maximal runs without ASCII
white space, case-sensitive.

Defined results: a null text is the empty text, a null part the empty string; a
null id has no smaller and is none's smaller, and takes no label; rows that
repeat an id are all counted, each by its own text, and the labels hold for all
of them (they meet in one task); a document is good (toxic) if any label row of its
id says 1; labels without a document, null labels and extra columns are ignored;
a part has rows for all orders and steps, zeros included; an empty table has none.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, saved, text_slices

FILTERS = "ABCDE"
MIN_WORDS = 200
#: Rows of a block: what a task holds as lists at one time (an id with more rows makes a longer block).
BLOCK_ROWS = 1 << 17
_UPPER, _SYMBOLS, _TAIL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|", bytes(range(0x80, 0xC0))
_ROW, _FIRST, _GOOD, _TOXIC = range(4)
_LEAST = -(1 << 63)


def failures(text: bytes) -> int:
    """Bits 0 to 3: which of A to D a text (UTF-8) fails."""
    words = text.split()  # on bytes: ASCII white space
    points = len(text.translate(None, _TAIL))
    return ((len(words) < MIN_WORDS) | (100 * len(set(words)) < 50 * len(words)) << 1
            | (100 * (len(text) - len(text.translate(None, _UPPER))) > 3 * points) << 2
            | (len(text) != len(text.translate(None, _SYMBOLS))) << 3)


def _facts(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest, own (failures A to D) of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"),
                       F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"))

    def run(batches):
        for batch in text_slices(batches, 1):
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                pa.array([failures(t) for t in texts], pa.int32())], ["doc_id", "part", "digest", "own"])

    return rows.mapInArrow(run, "doc_id long, part string, digest binary, own int")


# ---- sorted lists -----------------------------------------------------------------------------------------------------

def gallop(a: np.ndarray, value: int, at: int) -> int:
    """The first place from ``at`` on whose value is at least ``value``: doubling steps, then bisection."""
    step, n = 1, len(a)
    while at + step < n and a[at + step] < value:
        at += step
        step *= 2
    return at + int(np.searchsorted(a[at:at + step + 1], value))


def places(a: np.ndarray, keys: np.ndarray, run: int = 4096) -> np.ndarray:
    """Place of each sorted key in ``a``: gallop to the stretch that a run of keys covers, search inside it."""
    out, at = np.empty(len(keys), np.int64), 0
    for i in range(0, len(keys), run):
        part = keys[i:i + run]
        at = gallop(a, part[0], at) if at < len(a) else at
        end = gallop(a, part[-1], at) if at < len(a) else at
        out[i:i + run] = at + np.searchsorted(a[at:end + 1], part)
        at = end
    return out


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the sorted ``a`` are in the sorted ``b``."""
    if not len(a) or not len(b):
        return np.zeros(len(a), bool)
    at = places(b, a)
    return b[np.minimum(at, len(b) - 1)] == a


def less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[~common(a, b)]


def merged(lists: list[np.ndarray]) -> np.ndarray:
    """Union of sorted lists: what each one adds to those before goes in at its place."""
    out = np.zeros(0, np.int64)
    for new in lists:
        new = less(new, out)
        if len(out) and len(new):
            out = np.insert(out, places(out, new), new)
        elif len(new):
            out = new
    return out


def sizes(fails: list[np.ndarray], good: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """For each set S of filters (bits) and each filter x outside it, at [S, x]: how many S fails, how many x adds,
    and how many of those are good, and toxic."""
    n = len(fails)
    out = np.zeros((1 << n, n, 4), np.int64)
    union = {0: np.zeros(0, np.int64)}
    for s in range(1 << n):
        for x in range(n):
            if s >> x & 1:
                continue
            added = less(fails[x], union[s])
            if s | 1 << x not in union:
                union[s | 1 << x] = merged([union[s], added])
            out[s, x] = len(union[s]), len(added), common(added, good).sum(), common(added, toxic).sum()
    return out


# ---- ranges of ids ----------------------------------------------------------------------------------------------------

def _block(table: pa.Table, total: dict) -> None:
    """Lists and sizes of one block of sorted entries, added to ``total`` (part -> rows, sizes)."""
    kind = table["kind"].to_numpy()
    ids, mark = (table[c].to_numpy() for c in ("doc_id", "mark"))
    row = np.flatnonzero(kind == _ROW)
    if not len(row):
        return
    known = table["known"].to_numpy(zero_copy_only=False)[row]
    first = kind == _FIRST
    # the first copies: rows whose id and digest stand among the least ids
    firsts = set(zip(ids[first].tolist(), mark[first].tolist()))
    passes = np.fromiter((not k or p in firsts for k, p in zip(known, zip(ids[row].tolist(), mark[row].tolist()))), bool, len(row))
    labelled = [known & common(ids[row], np.unique(ids[kind == k])) for k in (_GOOD, _TOXIC)]
    own = table["own"].to_numpy(zero_copy_only=False)[row].astype(np.int64)
    parts = table["part"].combine_chunks().dictionary_encode()
    part_of, names = parts.indices.to_numpy(zero_copy_only=False)[row], parts.dictionary.to_pylist()
    for p in np.unique(part_of):
        member = part_of == p
        everyone = np.flatnonzero(member)
        fails = [np.flatnonzero(member & (own >> b & 1 == 1)) for b in range(len(FILTERS) - 1)]
        fails.append(less(everyone, np.flatnonzero(member & passes)))
        n, sums = total.get(names[int(p)], (0, 0))
        total[names[int(p)]] = n + len(everyone), sums + sizes(fails, *(np.flatnonzero(member & x) for x in labelled))


def _counts(batches):
    total: dict = {}
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= BLOCK_ROWS:
            table = pa.Table.from_batches(held)
            ids = table["doc_id"].to_numpy()
            cut = int(np.searchsorted(ids, ids[-1]))  # the last id may go on
            if cut:
                _block(table.slice(0, cut), total)
                held = table.slice(cut).to_batches()
    if held:
        _block(pa.Table.from_batches(held), total)
    rows = [(part, n, s, x, *map(int, sums[s, x])) for part, (n, sums) in total.items()
            for s in range(1 << len(FILTERS)) for x in range(len(FILTERS)) if not s >> x & 1]
    if rows:
        names = ["part", "n", "before", "x", "failed", "added", "good", "toxic"]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def set_sizes(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, n (its rows), before (bits of a set of filters), x (a filter outside it), failed (rows that fail the set),
    added (rows that fail x and pass the set), good and toxic (of those): 80 rows a part."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "filter-audit")
    facts = scratch.save(_facts(docs))
    mark = F.xxhash64("digest")
    first = facts.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    none = lambda t: F.lit(None).cast(t)
    # a null id goes to the lowest range; ``known`` keeps it apart from a real least one
    entries = [facts.select(F.coalesce("doc_id", F.lit(_LEAST)).alias("doc_id"), F.lit(_ROW).alias("kind"), mark.alias("mark"),
                            "own", "part", F.col("doc_id").isNotNull().alias("known")),
               first.select("doc_id", F.lit(_FIRST).alias("kind"), mark.alias("mark"), none("int").alias("own"),
                            none("string").alias("part"), F.lit(True).alias("known"))]
    for column, kind in (("quality", _GOOD), ("toxic", _TOXIC)):
        entries.append(labels.where((F.col(column) == 1) & F.col("doc_id").isNotNull()).select(
            F.col("doc_id").cast("long"), F.lit(kind).alias("kind"), F.lit(0).cast("long").alias("mark"), none("int").alias("own"),
            none("string").alias("part"), F.lit(True).alias("known")).distinct())
    entries = scratch.save(reduce(DataFrame.unionByName, entries))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = entries.repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id").mapInArrow(
        _counts, "part string, n long, before int, x int, failed long, added long, good long, toxic long")
    out = saved(counted.groupBy("part", "before", "x").agg(*[F.sum(c).alias(c) for c in ("n", "failed", "added", "good", "toxic")]),
                "filter-audit-sizes")
    scratch.drop()
    return out


def order_table(spark) -> DataFrame:
    """filter_order, step, before, x of every step of every order of the filters."""
    rows = []
    for order in itertools.permutations(range(len(FILTERS))):
        before = 0
        for step, x in enumerate(order, 1):
            rows.append(("".join(FILTERS[i] for i in order), step, before, x))
            before |= 1 << x
    return spark.createDataFrame(rows, "filter_order string, step int, before int, x int")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    n, all_bits = len(FILTERS), (1 << len(FILTERS)) - 1
    found = set_sizes(docs, labels)
    # in how many orders exactly the filters of ``before`` stand in front of x
    orders = F.lit(0)
    for k in range(n):
        orders = F.when(F.bit_count("before") == k, math.factorial(k) * math.factorial(n - 1 - k)).otherwise(orders)
    per_filter = found.groupBy("part", "x").agg(
        F.sum(F.when(F.col("before") == 0, F.col("added"))).alias("_fails"),
        F.sum(F.when(F.expr("before + shiftleft(1, x)") == all_bits, F.col("added"))).alias("unique_fails"),
        F.sum(F.col("added") * orders).alias("shapley"))
    steps = order_table(docs.sparkSession).join(found, ["before", "x"]).join(per_filter, ["part", "x"])
    return steps.select("part", "filter_order", "step", (F.col("n") - F.col("failed") - F.col("added")).alias("kept"),
                        F.col("added").alias("removed"), (F.col("_fails") - F.col("added")).alias("redundant"), "unique_fails",
                        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley")

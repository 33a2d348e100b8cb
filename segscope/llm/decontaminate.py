"""Benchmark decontamination (operator 3): template windows with typed slots.
DataFrame functions only.

Texts are made canonical: names (a run of capitalised words), numbers (with their
commas, decimals and fractions) and units after a number become one typed
placeholder each, the rest is lower-cased and cut into runs of letters and digits.
Names are told in two ways, each with its own windows: ``INSIDE`` a sentence only,
or ``EVERY`` run of capitalised words, since a name may open a sentence. Windows of
``window`` tokens are hashed; those of the benchmark (with at least ``min_literal``
real words) are joined to all windows of all documents. Beside them the ``PLAIN``
lower-case tokens of every item are cut into windows, without a least number of
words, and joined exactly, so a verbatim copy is found whatever the template makes
of it. Hits on one diagonal (document position minus item position) form runs; a
run is evidence when it covers ``min_tokens`` plain tokens of the item, or the
whole item if that is shorter. So are template runs together whose diagonals
follow each other within ``NEAR`` tokens (a new value may change the token count)
and that cover as much. Then the slots of the evidence are compared: one name or
unit of the item must stand for one name or unit of the document throughout, and
the other way round for names; numbers may change freely. So a re-parameterised
question is found, and chance meetings of a template are not.

The benchmark's windows are broadcast only while they number at most
``BROADCAST_WINDOWS`` (they are counted first); beyond that the join shuffles. Texts
move only where they have runs: the ids of these are stored, counted, and broadcast
while they number at most ``BROADCAST_IDS``.

Defined results: null and empty texts and items match nothing; items of fewer
than ``MIN_ITEM`` tokens match as verbatim wholes only; of runs of one item that
lie in one another in the document the longest is given (exact if equal); documents are named by id, so repeated rows of an
id answer together, and null ids are left out; repeated items are separate; an
empty table on either side gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

WINDOW, MIN_TOKENS, MIN_LITERAL, MIN_ITEM = 8, 13, 5, 5
BROADCAST_WINDOWS, BROADCAST_IDS = 500_000, 1_000_000
BLOCK = 256  # tokens whose sizes are summed once
NEAR = 8
INSIDE, EVERY, PLAIN = 0, 1, 2
NAME, NUMBER, UNIT = "\x01", "\x02", "\x03"
END, NUMBER_END = "\x04", "\x05"  # of what a placeholder stands for, where that is kept
# possessive, so that the matcher does not recurse over long runs
NAMES = r"\p{Lu}\p{L}*+(?:(?:\s++|['\u2019-])\p{Lu}\p{L}*+)*+"
NUMBERS = r"\p{N}++(?:[.,/\u00a0\u202f]\p{N}++)*+(?:\s++\p{N}++/\p{N}++)?+"
UNITS = ("mm", "cm", "m", "km", "inch", "inches", "feet", "foot", "miles", "mg", "g", "kg", "tons", "pounds", "ml", "l", "liters",
         "litres", "seconds", "minutes", "hours", "days", "weeks", "months", "years", "dollars", "cents", "euros", "percent",
         "degrees", "mph", "kmh")
RESULT = "doc_id", "item_id", "doc_start", "item_start", "n_tokens", "kind"


def _marked(text: Column, names: int, keep: bool) -> Column:
    """The text in lower case with placeholders, before what they stand for if that is kept."""
    held = lambda end: f"$0{end}" if keep else ""
    before = r"(?=\p{Lu})(?<=[^.!?:\s]\s)" if names == INSIDE else r"(?=\p{Lu})(?<![\p{L}\p{N}])"  # the look ahead fails fast
    marks = "".join((NAME, NUMBER, UNIT, END, NUMBER_END))
    t = F.coalesce(text, F.lit(""))
    t = F.when(t.rlike(f"[{marks}]"), F.translate(t, marks, " " * 5)).otherwise(t)
    t = F.regexp_replace(t, before + NAMES, NAME + held(END))
    t = F.regexp_replace(F.lower(t), NUMBERS, NUMBER + held(NUMBER_END))
    units = "|".join(sorted(UNITS, key=lambda u: (-len(u), u)))
    return F.regexp_replace(t, f"({NUMBER_END if keep else NUMBER} ?)({units})(?![\\p{{L}}\\p{{N}}])", f"$1{UNIT}$2{END}" if keep else f"$1{UNIT}")


def canonical(text: Column, names: int = INSIDE) -> Column:
    """Array of canonical tokens."""
    return F.array_remove(F.split(_marked(text, names, False), rf"[^a-z\p{{L}}\p{{N}}{NAME}{NUMBER}{UNIT}]+"), "")


def surfaces(text: Column, names: int = INSIDE) -> Column:
    """What the canonical tokens stand for, in lower case: plain tokens with blanks between."""
    kept = F.regexp_extract_all(_marked(text, names, True), F.lit(
        rf"(?:[{NAME}{NUMBER}{UNIT}][^{END}{NUMBER_END}]*+[{END}{NUMBER_END}]|[\p{{L}}\p{{N}}]++)++"), F.lit(0))
    return F.transform(kept, lambda x: F.btrim(F.regexp_replace(
        F.regexp_replace(x, f"[{NAME}{NUMBER}{UNIT}{END}{NUMBER_END}]", ""), r"[^\p{L}\p{N}]+", " ")))


def plain(text: Column) -> Column:
    """The same tokens as they are, in lower case."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z\p{L}\p{N}]+"), "")


def _seed(mode: int, size: int) -> Column:
    return F.lit(mode * 1_000_000 + size)


def _window_hash(span: Column, mode: int, size: int) -> Column:
    """The hash of a window of ``size`` tokens."""
    return F.xxhash64(span, _seed(mode, size))


def _windows(df: DataFrame, sizes: list[int], mode: int, *keys: str) -> DataFrame:
    """keys, pos, h: every window of the given sizes over the tokens t."""
    def of(size):
        # outer: for the inner form the planner repeats the tokens in a filter below it
        rows = df.select(*keys, "t", F.posexplode_outer("t").alias("pos", "_token")).where(F.col("pos") <= F.size("t") - size)
        return rows.select(*keys, "pos", _window_hash(F.slice("t", F.col("pos") + 1, F.lit(size)), mode, size).alias("h"))

    return functools.reduce(DataFrame.unionByName, map(of, sizes))


def _tokens(text: Column, mode: int) -> Column:
    return plain(text) if mode == PLAIN else canonical(text, mode)


def _surfaces(text: Column, mode: Column) -> Column:
    return F.when(mode == PLAIN, plain(text)).when(mode == EVERY, surfaces(text, EVERY)).otherwise(surfaces(text, INSIDE))


def _plain_size(tokens: Column) -> Column:
    """Plain tokens in an array of surfaces."""
    return F.when(F.size(tokens) > 0, F.size(F.split(F.array_join(tokens, " "), " "))).otherwise(F.lit(0))


def _items(texts: DataFrame, window: int, min_literal: int, least: int, mode: int) -> DataFrame:
    """mode, item_id, size, n (plain tokens of the item), item_pos, lo and hi (the window in plain tokens), h,
    rank (among the item's windows that count), valid (how many)."""
    items = texts.select("item_id", _tokens(F.col("text"), mode).alias("t"), _surfaces(F.col("text"), F.lit(mode)).alias("s"))
    items = items.withColumn("n", _plain_size(F.col("s"))).where((F.col("n") >= least) & F.col("item_id").isNotNull())
    items = items.withColumn("size", F.least(F.size("t"), F.lit(window)))
    spans = items.select("item_id", "s", "size", "n", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.size("t") - F.col("size")), lambda i: F.slice("t", i + 1, F.col("size")))).alias("item_pos", "span"))
    literal = F.size(F.filter("span", lambda x: ~x.rlike(f"[{NAME}{NUMBER}{UNIT}]")))
    spans = spans.where(literal >= F.least(F.lit(min_literal), F.col("size")))
    each = Window.partitionBy("item_id")
    hashed = functools.reduce(lambda c, n: c.when(F.size("span") == n, _window_hash(F.col("span"), mode, n)), range(1, window + 1),
                              F.when(F.lit(False), F.lit(0).cast("long")))
    return spans.select(F.lit(mode).alias("mode"), "item_id", "size", "n", "item_pos",
                        _plain_size(F.slice("s", F.lit(1), F.col("item_pos"))).alias("lo"),
                        _plain_size(F.slice("s", F.lit(1), F.col("item_pos") + F.col("size"))).alias("hi"), hashed.alias("h"),
                        F.row_number().over(each.orderBy("item_pos")).alias("rank"), F.count(F.lit(1)).over(each).alias("valid"))


def _slots(run: str) -> Column:
    """run: array of (c canonical item token, i item surface, d document surface); the names and units among them.
    A word that opens both surfaces of a name is left out ("Did Tom", "Did Mia")."""
    rest = lambda x: F.regexp_replace(x, r"^\S+ ", "")
    shared = lambda x: (F.substring_index(x["i"], " ", 1) == F.substring_index(x["d"], " ", 1)) & x["i"].contains(" ") & x["d"].contains(" ")
    return F.transform(F.filter(run, lambda x: x["c"].rlike(f"[{NAME}{UNIT}]")), lambda x: F.struct(
        x["c"].contains(NAME).alias("name"), x["c"].contains(UNIT).alias("unit"),
        F.when(shared(x), rest(x["i"])).otherwise(x["i"]).alias("i"), F.when(shared(x), rest(x["d"])).otherwise(x["d"]).alias("d")))


def _having(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows whose doc_id is (``left_semi``) or is not (``left_anti``) among the ids; rows are only shuffled if the ids are many."""
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", how)


def _before(at: Column) -> Column:
    """Plain tokens before the token at ``at``: whole blocks, then the rest of one."""
    whole = F.floor(at / BLOCK).cast("int")
    total = lambda c: F.aggregate(c, F.lit(0), lambda acc, x: acc + x)
    return total(F.slice("_blocks", F.lit(1), whole)) + total(F.slice("_sizes", whole * BLOCK + 1, at - whole * BLOCK))


def _cut(runs: DataFrame, docs: DataFrame) -> DataFrame:
    """Runs with _d (the document's surfaces there), doc_start and doc_end in plain tokens, and _copy (which text of the id).
    Surfaces are worked out once for each text that has runs, and only such texts move."""
    own = [c for c in runs.columns if c not in ("mode", "doc_id")]
    lists = runs.groupBy("mode", "doc_id").agg(F.collect_list(F.struct(*own)).alias("_runs"))
    with_runs = _having(docs, saved(runs.select("doc_id").distinct(), "run-ids"), "left_semi")
    modes = runs.select("mode", "doc_id").distinct()
    texts = with_runs.join(modes, "doc_id").select("mode", "doc_id", F.xxhash64("text").alias("_copy"), _surfaces(F.col("text"), F.col("mode")).alias("_all"))
    texts = saved(texts, "surfaces")  # stored: else they are worked out anew in the lambdas
    texts = texts.withColumn("_sizes", F.transform("_all", lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1))
    texts = saved(texts.withColumn("_blocks", F.transform(F.sequence(F.lit(0), F.floor(F.size("_sizes") / BLOCK).cast("int")), lambda i: F.aggregate(
        F.slice("_sizes", i * BLOCK + 1, BLOCK), F.lit(0), lambda acc, x: acc + x))), "surface-sizes")
    joined = texts.join(lists, ["mode", "doc_id"])

    def one(r):
        at, size = r["diagonal"] + r["first"], r["end"] - r["first"]
        return F.struct(*[r[c].alias(c) for c in own], F.slice("_all", at + 1, size).alias("_d"), _before(at).alias("doc_start"),
                        _before(at + size).alias("doc_end"))

    return joined.select("mode", "doc_id", "_copy", F.inline(F.transform("_runs", one)))


def contaminated(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
                 min_tokens: int = MIN_TOKENS, min_literal: int = MIN_LITERAL) -> DataFrame:
    """doc_id, item_id, doc_start, item_start, n_tokens, kind (``exact`` or ``reparameterised``): the runs that
    give a document away, positions in tokens."""
    modes = INSIDE, EVERY, PLAIN
    texts = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    items = saved(functools.reduce(DataFrame.unionByName, [_items(
        texts, window, 0 if m == PLAIN else min_literal, 1 if m == PLAIN else MIN_ITEM, m) for m in modes]), "items")
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull())
    sizes = sorted((r["mode"], r["size"]) for r in items.select("mode", "size").distinct().collect())  # at most three times ``window`` values
    small = items.count() <= BROADCAST_WINDOWS
    rows = functools.reduce(DataFrame.unionByName, [_windows(
        docs.select("doc_id", _tokens(F.col("text"), m).alias("t")), [n for q, n in sizes if q == m] or [window], m, "doc_id") for m in modes])
    hits = rows.join(F.broadcast(items) if small else items, "h")  # one long key: the mode and size are in the hash
    hits = hits.select("mode", "doc_id", "item_id", "item_pos", "lo", "hi", "rank", "valid", "n", "size",
                       (F.col("pos") - F.col("item_pos")).alias("diagonal")).distinct()
    pair = "mode", "doc_id", "item_id"
    line = Window.partitionBy(*pair, "diagonal").orderBy("rank")
    runs = hits.withColumn("island", F.col("rank") - F.row_number().over(line)).groupBy(*pair, "diagonal", "island").agg(
        F.count(F.lit(1)).alias("hits"), F.min("item_pos").alias("first"), F.max(F.col("item_pos") + F.col("size")).alias("end"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.first("valid").alias("valid"), F.first("n").alias("n"))
    along = Window.partitionBy(*pair).orderBy("diagonal", "first")
    step = F.col("diagonal") - F.lag("diagonal").over(along)
    runs = runs.withColumn("_step", F.when(step > NEAR, 1).otherwise(0)).withColumn("near", F.sum("_step").over(along))
    group = Window.partitionBy(*pair, "near")
    reach = F.max("hi").over(group.orderBy("lo", "hi", "diagonal").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("_new", F.greatest(F.lit(0), F.col("hi") - F.greatest("lo", F.coalesce(reach, F.lit(0)))))
    runs = runs.withColumn("together", F.sum("_new").over(group)).withColumn("members", F.count(F.lit(1)).over(group))
    enough, alone = F.least(F.lit(min_tokens), F.col("n")), F.col("hi") - F.col("lo")
    one = F.when((alone >= enough) | (F.col("hits") == F.col("valid")), F.struct(
        F.col("diagonal").alias("a"), F.col("first").alias("b"), alone.cast("long").alias("tokens")))
    many = F.when((F.col("mode") != PLAIN) & (F.col("members") > 1) & (F.col("together") >= enough), F.struct(
        F.col("near").cast("int").alias("a"), F.lit(-1).alias("b"), F.col("together").alias("tokens")))
    runs = runs.select(*pair, "diagonal", "first", "end", "lo", F.explode(F.array_compact(F.array(one, many))).alias("case"))
    texts = texts.join(items.select("mode", "item_id").distinct(), "item_id").select(
        "mode", "item_id", F.when(F.col("mode") == PLAIN, plain(F.col("text"))).when(F.col("mode") == EVERY, canonical(F.col("text"), EVERY))
        .otherwise(canonical(F.col("text"), INSIDE)).alias("_c"), _surfaces(F.col("text"), F.col("mode")).alias("_i"))
    part = lambda c: F.slice(c, F.col("first") + 1, F.col("end") - F.col("first"))
    found = _cut(saved(runs, "runs"), docs).join(texts, ["mode", "item_id"]).withColumns({"_c": part("_c"), "_i": part("_i")})
    found = found.withColumn("_run", F.transform("_c", lambda c, k: F.struct(
        c.alias("c"), F.get("_i", k).alias("i"), F.get("_d", k).alias("d"))))
    found = found.withColumn("_same", F.array_join("_i", " ") == F.array_join("_d", " "))
    # the row number keeps the filter above the arrays, which else are worked out anew in each lambda
    found = found.withColumn("_row", F.monotonically_increasing_id()).where((F.col("_same") | (F.col("mode") != PLAIN)) & (F.col("_row") >= 0))
    found = found.select(*pair, "case", "_copy", "diagonal", "doc_start", "doc_end", "lo", "_same", F.explode_outer(_slots("_run")).alias("_slot"))
    slots = lambda kind, *cs: F.count_distinct(F.when(F.col(f"_slot.{kind}"), F.struct(*[f"_slot.{c}" for c in cs])))
    found = found.groupBy(*pair, "case", "_copy").agg(
        F.min("doc_start").alias("doc_start"), F.max("doc_end").alias("_end"), F.min("lo").alias("item_start"),
        (F.min("_same") & (F.min("diagonal") == F.max("diagonal"))).alias("_same"),
        *[slots(k, *cs).alias(f"_{k}_{''.join(cs)}") for k, cs in (("name", "i"), ("name", "d"), ("name", "id"), ("unit", "i"), ("unit", "id"))])
    found = found.where("_name_i = _name_id and _name_d = _name_id and _unit_i = _unit_id")
    found = found.select("doc_id", "item_id", "doc_start", "item_start", F.col("case.tokens").cast("int").alias("n_tokens"),
                         F.when(F.col("_same"), "exact").otherwise("reparameterised").alias("kind"), "_end").distinct()
    outer = Window.partitionBy("doc_id", "item_id").orderBy("doc_start", F.desc("_end"), "kind", "item_start").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("_reach", F.max("_end").over(outer)).where("_reach is null or _end > _reach").select(*RESULT)


def without_contaminated(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``documents`` whose id is not given away; null ids stay."""
    ids = saved(contaminated(documents, benchmark, doc_id=doc_id, **options).select("doc_id").distinct(), "contaminated-ids")
    rows = documents.select(F.struct(*documents.columns).alias("_row"), F.col(doc_id).alias("doc_id"))
    return _having(rows, ids, "left_anti").select("_row.*")

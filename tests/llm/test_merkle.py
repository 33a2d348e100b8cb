"""Merkle manifest against trees built one node at a time."""
import hashlib
import random

from pyspark.sql import functions as F

from segscope.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels_of(digests):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def climb(levels, place, digest, proof):
    for level in levels[:-1]:
        run = place // 3 * 3
        before, after = level[run:place], level[place + 1:run + 3]
        proof += before + after
        digest, place = h(*before, digest, *after), place // 3
    return digest


def brute(rows, found):
    """rows: doc_id, source, lang, n_chars, text, with distinct ids in a source."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0)) for s in sources}
    built = {s: levels_of([leaf_of(r) for r in t]) for s, t in trees.items()}
    top = levels_of([built[s][-1][0] for s in sources])
    out = []
    for i, s in enumerate(sources):
        for place, r in enumerate(trees[s]):
            proof = []
            digest = climb(top, i, climb(built[s], place, leaf_of((*r[:4], found(r))), proof), proof)
            out.append((r[0], leaf_of(r), built[s][-1][0], top[-1][0], h(*proof), digest))
    return out


def manifest(spark, rows, found=lambda: F.replace(F.col("text"), F.lit("\n"), F.lit(""))):
    df = spark.createDataFrame([(*r, "clash", 5) for r in rows],
                               "doc_id long, source string, lang string, n_chars long, text string, tree string, place int").repartition(3)
    got = merkle.manifest(df, found()).select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.as_hex(F.col("proof")).cast("binary"), 256), "folded_root")
    return [tuple(r) for r in got.collect()]


def without_breaks(r):
    return r[4] and r[4].replace("\n", "")


def key(r):
    return r[0] is not None, r[0] or 0, r[1]


def test_sources_of_all_sizes(spark):
    rnd = random.Random(4)
    rows, i = [], 0
    for source, n in ((None, 5), ("", 1), ("z", 82), ("é", 81), ("q", 729), ("r", 730), ("b\U0001f600", 3), ("big", 2400), ("Z", 27), ("one", 2), ("￿", 4)):
        for _ in range(n):
            rows.append((i := i + rnd.randrange(1, 9), source, rnd.choice(["en", None, ""]), rnd.choice([0, -5, None, 10 ** 12]),
                         rnd.choice([None, "", "\n", "a\nb", "日本\n語", "plain", "x" * 5000])))
    assert sorted(manifest(spark, rows), key=key) == sorted(brute(rows, without_breaks), key=key)


def test_one_hot_source_and_many_sources(spark):
    rows = [(i, f"s{i:04d}" if i % 3 else "hot", "en", i, f"line\n{i}") for i in range(400)]
    assert sorted(manifest(spark, rows), key=key) == sorted(brute(rows, without_breaks), key=key)


def test_a_single_leaf_is_the_root(spark):
    rows = [(7, "s", None, None, "a\nb")]
    (got,) = manifest(spark, rows)
    assert got[1] == got[2] == got[3] == leaf_of(rows[0]) and got[4] == h() and got[5] == leaf_of((7, "s", None, None, "ab"))


def test_null_and_repeated_ids(spark):
    rows = [(None, "s", "en", 1, "a"), (3, "s", "en", 1, "b"), (3, "s", "en", 1, "b"), (1, "t", "en", 1, None)]
    assert sorted(manifest(spark, rows, lambda: F.col("text")), key=key) == sorted(brute(rows, lambda r: r[4]), key=key)


def test_empty_table_and_the_session_setting(spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    assert manifest(spark, []) == []
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before

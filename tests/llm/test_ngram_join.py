import random

import numpy as np
import pytest

from segscope.llm.ngram_join import ngram_join
from segscope.llm.shingles import shingle_sets


def brute(rows, k, percent):
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    sets = []
    for _, t in rows:
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", low(t)) if x]
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "ß", "Wort"]
    rows = [(None, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "One two"), (5, "one  TWO"), (6, None), (7, "one two"), (7, "other text here")]
    doc = 10
    for _ in range(12):
        base = rnd.choices(vocabulary, k=rnd.choice([3, 5, 12, 40, 90, 300]))
        for _ in range(rnd.choice([1, 2, 12])):
            copy = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            if rnd.random() < 0.3:
                copy = copy[:max(1, len(copy) - rnd.randrange(4))]
            rows.append((doc, " ".join(copy)))
            doc += rnd.choice([1, 1, 0])
    return rows


@pytest.mark.parametrize("seed,k,percent,tile", [(1, 3, 90, 500_000), (2, 5, 80, 500_000), (3, 3, 90, 100), (4, 5, 80, 60)])
def test_equals_all_pairs(spark, seed, k, percent, tile):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], "doc_id long, text string, node string, n int")
    got = sorted((tuple(r) for r in ngram_join(df, k, percent, tile_shingles=tile).collect()), key=str)
    assert got == brute(rows, k, percent)


def test_hot_group_of_near_copies(spark):
    rnd = random.Random(9)
    base = [f"t{i}" for i in range(70)]
    rows = []
    for d in range(150):
        copy = list(base)
        for _ in range(rnd.choice([1, 2])):
            copy[rnd.randrange(70)] = f"x{rnd.randrange(1000)}"
        rows.append((d, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in ngram_join(df, 3, 90, tile_shingles=800).collect()), key=str)
    assert got == brute(rows, 3, 90)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join(df).collect() == []


def test_blocks_and_long_runs(monkeypatch):
    import segscope.llm.shingles as s
    text = ("ab cde f " * 50 + "x" * 300 + " tail end").encode()
    whole = shingle_sets([text, b"ab", None], 3)
    monkeypatch.setattr(s, "BLOCK", 64)
    s._powers.cache_clear()
    cut = shingle_sets([text, b"ab", None], 3)
    s._powers.cache_clear()
    assert [len(x) for x in whole] == [len(x) for x in cut] == [len(whole[0]), 1, 0]
    assert len(np.intersect1d(whole[0], cut[0])) >= len(whole[0]) - 3


def test_low_percents_are_refused(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, "a b c e")], "doc_id long, text string")
    with pytest.raises(ValueError, match="70 to 100"):
        ngram_join(df, k=1, percent=60)
    assert {r["component_id"] for r in ngram_join(df, k=1, percent=70).collect()} == {1, 2}

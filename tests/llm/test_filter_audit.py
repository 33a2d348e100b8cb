"""Filter audit against counting row by row, and sorted lists against Python sets."""
import itertools
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from segscope.llm import filter_audit as A

SORTED = st.lists(st.integers(0, 60), max_size=40).map(lambda x: np.array(sorted(set(x)), np.int64))


@settings(max_examples=200, deadline=None)
@given(st.lists(SORTED, min_size=1, max_size=5), st.integers(1, 5))
def test_sorted_lists(lists, run):
    a, b = lists[0], lists[-1]
    assert A.places(a, b, run).tolist() == np.searchsorted(a, b).tolist()
    assert A.less(a, b).tolist() == sorted(set(a.tolist()) - set(b.tolist()))
    assert A.merged(lists).tolist() == sorted(set().union(*(x.tolist() for x in lists)))


def test_gallop_over_long_stretches():
    a = np.arange(0, 3_000_000, 3)
    keys = np.array([0, 1, 5, 2_999_997, 2_999_998, 5_000_000])
    assert A.places(a, keys, 2).tolist() == np.searchsorted(a, keys).tolist()
    assert len(A.merged([a, a + 1, a + 2])) == 3_000_000 and len(A.less(a, a[::2])) == 500_000


def brute(docs, labels):
    words = lambda t: [w for w in t.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    rows = []
    for i, t, part in docs:
        t, w = t or "", words(t or "")
        fails = {f for f, bad in zip("ABCDE", (
            len(w) < A.MIN_WORDS, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            any(c in "#$%&*|" for c in t), i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs))) if bad}
        says = [(q, x) for j, q, x in labels if j is not None and j == i]
        rows.append((part or "", fails, any(q == 1 for q, _ in says), any(x == 1 for _, x in says)))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            kept = mine
            for step, f in enumerate(order, 1):
                lost, still = [r for r in kept if f in r[1]], [r for r in kept if f not in r[1]]
                failing = [r for r in mine if f in r[1]]
                out[part, "".join(order), step] = [len(still), len(lost), len(failing) - len(lost), sum(r[1] == {f} for r in mine),
                                                   sum(r[2] for r in lost), sum(r[3] for r in lost)]
                total[f] += len(lost)
                kept = still
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def audited(spark, docs, labels):
    d = spark.createDataFrame([(*r, "clash", 1) for r in docs], "doc_id long, text string, lang string, part string, kind int").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = A.audit(d, lab).collect()
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    out = {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in got}
    assert len(out) == len(got)
    return out


def table(seed, n):
    rnd = random.Random(seed)
    texts = [None, "", " ", "a" * 5, "$", "AB cd", " ".join(f"w{i}" for i in range(200)), " ".join(f"w{i}" for i in range(199)),
             "x " * 300, "x\x1cy " * 200 + "|", "É" * 4 + "A", "A" * 3 + "a" * 97, "A" * 4 + "a" * 96, "w\xa0w " * 220]
    docs = [(i, rnd.choice(texts), rnd.choice([None, "", "en", "de"])) for i in range(n)]
    docs += [(3, "again", "en"), (3, "again", "fr"), (None, "", "en"), (None, "x " * 300, None), (-7, "a" * 5, "zz")]
    labels = [(rnd.randrange(n + 5), rnd.choice([0, 1, None]), rnd.choice([0, 1])) for _ in range(n)] + [(None, 1, 1)]
    return docs, labels


def test_audit_against_counting(spark, monkeypatch):
    docs, labels = table(1, 120)
    want = brute(docs, labels)
    assert audited(spark, docs, labels) == want


def test_blocks_end_between_ids(monkeypatch):
    """The kernel in blocks of a few rows gives the sizes of one block."""
    import pyarrow as pa
    rnd = random.Random(2)
    entries = sorted((rnd.randrange(40), rnd.randrange(4), rnd.randrange(3), rnd.randrange(16), rnd.choice(["", "p"])) for _ in range(300))
    cols = list(zip(*entries))
    batch = pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()),
                                        pa.array(cols[3], pa.int32()), pa.array(cols[4]), pa.array([True] * 300)],
                                       ["doc_id", "kind", "mark", "own", "part", "known"])
    whole = [b.to_pylist() for b in A._counts([batch])]
    monkeypatch.setattr(A, "BLOCK_ROWS", 7)
    key = lambda r: (r["part"], r["before"], r["x"])
    parts = [b.to_pylist() for b in A._counts([batch.slice(i, 5) for i in range(0, 300, 5)])]
    assert sorted(whole[0], key=key) == sorted(parts[0], key=key)


def test_empty_tables(spark):
    assert audited(spark, [], []) == {}
    docs, _ = table(3, 10)
    assert audited(spark, docs, []) == brute(docs, [])

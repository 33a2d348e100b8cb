"""TF-IDF: texts move, not their terms; repeated keys count together; the vocabulary is sent."""
import math
from collections import Counter, defaultdict

import pytest

from segscope.operators import text as T

ROWS = [(1, "a", "red red blue"), (1, "a", "blue green"), (1, "b", "red sun"), (2, "b", "sun sun moon"), (2, "b", "sun sun moon"), (None, "b", "moon red"),
        (3, "a", None), (4, "a", ""), (5, "a", "green green red sky")]


@pytest.mark.parametrize("most", [500_000, 0])
def test_terms_are_counted_where_the_text_is(spark, monkeypatch, most):
    plans, save = [], T.Scratch.save

    def spy(self, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return save(self, df)
    monkeypatch.setattr(T.Scratch, "save", spy)
    monkeypatch.setattr(T, "BROADCAST_TERMS", most)
    got = T.tfidf_long(spark.createDataFrame(ROWS, "id int, lang string, text string"), "id", "text", 3, [], by=["lang"])
    moves = [line for line in plans[0].splitlines() if "Exchange hashpartitioning" in line]
    assert len(moves) == 1 and "term" not in moves[0]
    tf, n = defaultdict(Counter), Counter(lang for _, lang, _ in ROWS)
    for i, lang, text in ROWS:
        tf[lang, i].update((text or "").split())
    want = {}
    for lang in "ab":
        df, total = Counter(), Counter()
        for (la, _), c in tf.items():
            if la == lang:
                df.update(c.keys())
                total.update(c)
        kept = sorted(total, key=lambda t: (-total[t], t))[:3]
        for (la, i), c in tf.items():
            if la == lang:
                w = {t: c[t] * (math.log((1 + n[lang]) / (1 + df[t])) + 1) for t in c if t in kept}
                norm = math.sqrt(sum(v * v for v in w.values()))
                want.update({(i, lang, t): v / norm for t, v in w.items()})
    assert {(r["id"], r["lang"], r["term"]): pytest.approx(r["tfidf"]) for r in got.collect()} == want

import math
from collections import Counter

import pytest

from assayfold.llm import lm_scoring as lm
from helpers import ODD, documents, frame


def by_hand(rows, target, prior=2.0):
    """P(word | history) = (count of both + prior / V) / (count of history + prior), own counts left out of the background."""
    grams = lambda t: Counter(zip([None, *(w := (t or "").encode().lower().split())], w))
    mine = {}
    for i, t in rows:
        if i is not None:
            mine[i] = mine.get(i, Counter()) + grams(t)
    aim, base = sum(map(grams, target), Counter()), sum(mine.values(), Counter())
    v = len({w for _, w in aim | base})

    def histories(c):
        out = Counter()
        for (h, _), k in c.items():
            out[h] += k
        return out

    of_aim, of_base = histories(aim), histories(base)
    out = {}
    for i, c in mine.items():
        n, own = sum(c.values()), histories(c)
        if n:
            t = sum(k * -math.log((aim[g] + prior / v) / (of_aim[g[0]] + prior)) for g, k in c.items()) / n
            b = sum(k * -math.log((base[g] - k + prior / v) / (of_base[g[0]] - own[g[0]] + prior)) for g, k in c.items()) / n
            out[i] = (n, t - b)
    return out


@pytest.mark.parametrize("source", ["odd", "documents", "no target"])
def test_equals_brute_force(spark, sf, source):
    rows = ODD if source != "documents" else [(i, t) for i, t, _ in documents(sf)]
    rows = rows + [(-1, "below zero"), (-2, "the quick brown")]
    target = [] if source == "no target" else [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()] + ["the quick brown fox", None, ""]
    got = lm.score(frame(spark, rows), spark.createDataFrame([(t,) for t in target], "text string")).collect()
    want = by_hand(rows, target)
    assert len(got) == len(rows)
    for r in got:
        n, score = want.get(r.doc_id, (0, None))
        assert r.n_tokens == n and (r.score is None if score is None else abs(r.score - score) < 1e-9)


def test_empty(spark):
    assert lm.score(frame(spark, ODD).where("false"), frame(spark, ODD)).count() == 0

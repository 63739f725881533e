import math
import re
from collections import defaultdict

from assayfold.llm import entropy_mixing as em
from helpers import ODD, documents, frame


def by_hand(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, stopped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in stopped]
        rest = total - sum(stopped.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return stopped | share
        stopped |= {s: 3.0 * sizes[s] for s in over}


def check(out, rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    want = by_hand(dict(sizes))
    assert sorted(((r.doc_id, r.source, r.size) for r in out), key=repr) == sorted(((i, s, size(t)) for i, t, s in rows), key=repr)
    taken = defaultdict(int)
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    return {s: (taken[s], want[s]) for s in sizes}


def test_targets_and_mix(spark, sf):
    rows = documents(sf)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = em.mix(docs).collect()
    for taken, want in check(out, rows).values():
        assert abs(taken - want) <= 0.02 * want + 30
    key = lambda rows: sorted((r.doc_id, r.copies) for r in rows)
    assert key(em.mix(docs.repartition(5, "text")).collect()) == key(out)


def test_rates_solve_the_dual(spark, sf):
    """Rates are exp(lambda * size), at most 3, with the lambda that a bisection over all documents of a source finds."""
    rows = documents(sf)
    out = em.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = defaultdict(list)
    for r in out:
        by[r.source].append(r)
    assert any(len({round(r.rate, 6) for r in own}) > 5 for own in by.values())
    for own in by.values():
        total = lambda lam: sum(r.size * min(3.0, math.exp(min(50.0, lam * r.size))) for r in own)  # noqa: E731,B023
        if own[0].target >= 3 * own[0].source_size:
            assert all(r.rate == 3 for r in own)
            continue
        low, high = -10.0, 10.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if total(mid) < own[0].target else (low, mid)
        assert all(abs(r.rate - min(3.0, math.exp(low * r.size))) < 1e-4 for r in own)
        assert sum(r.copies not in (int(r.rate), int(r.rate) + 1) for r in own) <= em.EXCHANGES


def test_many_equal_rows(spark):
    docs = spark.createDataFrame([(i, "a b c d", "s" if i % 3 else "t") for i in range(3000)] + [(7, "a b c d", "s")] * 500, "doc_id long, text string, source string")
    out = em.mix(docs).collect()
    for taken, want in check(out, [(r.doc_id, r.text, r.source) for r in docs.collect()]).values():
        assert abs(taken - want) <= 4


def test_odd_rows(spark):
    docs = frame(spark, ODD)
    check(em.mix(docs).collect(), [(r.doc_id, r.text, r.source) for r in docs.collect()])
    assert em.mix(docs.where("false")).count() == 0


def test_one_empty_source(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "", "a"), (3, "x y z", "b")], "doc_id long, text string, source string")
    out = {r.doc_id: (r.target, r.taken) for r in em.mix(docs).collect()}
    assert out == {1: (0.0, 0), 2: (0.0, 0), 3: (3.0, 3)}

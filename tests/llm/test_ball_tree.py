import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from helpers import same_as_sql

from assayfold.llm import ball_tree


def by_hand(rows, dim, k=8, rounds=10):
    """The contract in Python's whole numbers, every vector against every centroid."""
    ok = [(i, [math.floor(Fraction(x) * 1024) for x in v], v) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    centres = [v for _, v, _ in sorted(ok, key=lambda r: (name(r[0]), r[2]))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min(range(len(centres)), key=lambda c: (far(v, centres[c]), c))
    for _ in range(rounds):
        groups = [[v for _, v, _ in ok if near(v) == c] for c in range(len(centres))]
        centres = [[sum(x) // len(g) for x in zip(*g)] if g else c for g, c in zip(groups, centres)]
    at = [(i, near(v), far(v, centres[near(v)])) for i, v, _ in ok]
    total = {c: sum(d for _, b, d in at if b == c) for c in range(len(centres))}
    held = lambda x: x if x < 1 << 63 else None
    lost = {c for _, c, d in at if held(d) is None}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, held(d), None if c in lost else held(total[c]), None if lost else held(sum(total.values())), sha[c]) for i, c, d in at), key=repr)


def found(spark, rows, dim, kind="double", **more):
    vectors = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "'x' as cluster", "1 as distance", "'y' as v")
    return sorted((tuple(r) for r in ball_tree.cluster(vectors, dim=dim, **more).collect()), key=repr)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0]), (8, [1.0, 2.0, 3.0]), (9, [0.1, -0.1]), (None, [0.5, 0.5]), (None, [0.25, 0.5]), (9, [0.1, -0.1]), (9, [5.0, 5.0]), (10, [-0.0001, 7.0])]
    rows += [(20 + k, [k / 7, -k / 3]) for k in range(30)]
    for kind in ("double", "float"):
        own = rows if kind == "double" else [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
        assert found(spark, rows, 2, kind) == by_hand(own, 2)
    assert found(spark, rows[:2], 2) == [] and found(spark, [], 2) == []
    assert found(spark, rows[8:10], 2) == by_hand(rows[8:10], 2)  # fewer vectors than centroids


@pytest.mark.parametrize("most", [1e3, 1e5, 1e9, 1e30, 1e300])
def test_large_numbers_stay_exact(spark, most):
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rng.standard_normal(3) * (most if k % 3 == 0 else 1)]) for k in range(40)]
    assert found(spark, rows, 3, rounds=3) == by_hand(rows, 3, rounds=3)


def test_clusters_copies_and_ties(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [round(float(x), 2) for x in rng.integers(-2, 3, 4) / 2 + (rng.standard_normal(4) / 50 if k % 2 else 0)]) for k in range(600)]
    rows += [(1000 + k, [0.25, 0.25, -0.25, 0.5]) for k in range(400)]
    assert found(spark, rows, 4) == by_hand(rows, 4)


def test_balls_hold_their_points_and_go_whole():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(c, 30, (700, 16)) for c in (-5000, 0, 5000)]).astype(np.int64)
    order, tree = ball_tree.build(points)
    own = points[order]
    assert sorted(order) == list(range(len(points)))
    for ball in range(len(tree["lo"])):
        mine = own[tree["lo"][ball] : tree["hi"][ball]]
        assert (mine.sum(0) == tree["sums"][ball]).all()
        assert np.sqrt(((mine - tree["centre"][ball]) ** 2).sum(1)).max() <= tree["radius"][ball] * (1 + 1e-9) + 1e-6
    centres = np.array([[-4000] * 16, [100] * 16, [4000] * 16])
    parts = list(ball_tree.filtered(tree, own, centres))
    assert sum(b - a for a, b, *_ in parts) == len(points) and all(ball is not None for _, _, ball, _ in parts) and len(parts) < 40
    for a, b, _, clusters in parts:
        assert (ball_tree.distances(own[a:b], centres).argmin(1) == clusters).all()


def test_sql(spark, sf):
    same_as_sql(spark, "op12_ball_tree", sf)

import math

import duckdb
import numpy as np
import pytest

from assayfold.llm import dimension_scan as ds


def by_hand(rows, every=100, nearest=10):
    """Every query row against every other row, in double precision."""
    ok = [(k, i, np.array(v, float)) for k, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for k, i, v in ok:
        if i % every == 0:
            near = sorted((float(np.sqrt(((v - u) ** 2).sum())), j) for m, j, u in ok if m != k and len(u) == len(v))[:nearest]
            out.setdefault(i, []).append([(j, d) for d, j in near])
    return {i: sorted(x) for i, x in out.items()}


def found(spark, rows, kind="double", **more):
    vectors = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "'x' as row", "1 as rank", "2 as list", "'y' as score")
    out = {}
    for r in ds.search(vectors, **more).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for i, own in out.items():
        assert [k for k, *_ in own] == list(range(1, len(own) + 1))
    return {i: [(j, d) for _, j, d in own] for i, own in out.items()}


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None), (100, []), (200, [0.0, 0.0]), (300, [1.0, None]), (400, [nan, 1.0]), (500, [inf, 1.0]), (None, [1.0, 2.0]), (600, [1.0, 2.0]), (7, [1.0, 2.0]), (5, [1.0, 2.0]), (700, [1.0, 2.0, 3.0]), (8, [3.0, 2.0, 1.0]), (800, [1.0]), (9, [1e200, -1e200]), (10, [-1.0, 4.0]), (900, [1e30, 1.0, 2.0])]
    want = by_hand(rows)
    assert found(spark, rows) == {i: x[0] for i, x in want.items() if x[0]}
    assert want[600][0][:2] == [(5, 0.0), (7, 0.0)] and not want[800][0]
    assert found(spark, []) == {} and found(spark, rows[:6]) == {}


def test_copies_ties_and_repeated_ids(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.standard_normal(8).tolist()) for k in range(1, 400)] + [(1000 + k, [0.5] * 8) for k in range(500)] + [(0, [0.5] * 8), (5000, [0.25] * 8), (6000, rng.standard_normal(8).tolist())]
    got, want = found(spark, rows, per_list=100), by_hand(rows)
    assert got[0] == want[0][0] == [(1000 + k, 0.0) for k in range(10)]  # copies without end: the smallest ids
    assert got[5000] == want[5000][0]
    twice = found(spark, [*rows[:50], (100, rows[3][1]), (100, rows[4][1])])
    assert len(twice[100]) == 20 and {twice[100][0], twice[100][10]} == {(4, 0.0), (5, 0.0)}  # each row is a query


@pytest.mark.parametrize("near", [0.2, 3.0])
def test_recall_over_clusters(spark, near):
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((40, 32))
    rows = [(k, (centres[k % 40] + near * rng.standard_normal(32)).astype("f4").tolist()) for k in range(4000)]
    got, want = found(spark, rows, "float", per_list=100), by_hand(rows)
    assert set(got) == set(want) and all(len(x) == 10 for x in got.values())
    hit = sum(len(set(got[i]) & set(want[i][0])) for i in want) / (10 * len(want))
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    told = ds.recall(vectors, ds.search(vectors, per_list=100))
    assert hit >= 0.95 and abs(told - hit) < 0.02
    for own in got.values():
        assert own == sorted(own, key=lambda x: (x[1], x[0]))


def test_abandons_early_and_keeps_the_nearest():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1000, 64))
    x[:20] = x[0] + 0.05 * rng.standard_normal((20, 64))
    turned = x @ ds.rotation(64)
    at = ds.edges(64)
    axes = [np.ascontiguousarray(turned[:, a:b].T.astype("f4")) for a, b in zip(at, at[1:])]
    left = ds.scan(axes, turned[0], np.inf, 11)
    assert set(np.argsort(((x - x[0]) ** 2).sum(1))[:11]) <= set(left) and len(left) <= 40
    assert np.allclose(ds.rotation(64) @ ds.rotation(64).T, np.eye(64))


def test_query_recall(spark, sf):
    from assayfold.llm.queries import op11_dimension_scan

    sf = sf.replace("0.001", "0.1")
    rows = duckdb.sql(f"select vec_id, embedding from read_parquet('{sf}/embeddings.parquet')").fetchall()
    want, got = by_hand(rows), {}
    for r in op11_dimension_scan(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q][0]}) for q in want)
    assert set(got) == set(want) and hit >= 0.97 * 10 * len(want)

import numpy as np

from assayfold.llm import nn_descent as nd


def by_hand(rows):
    ok = lambda v, y, i: i is not None and v is not None and y is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, (i, v, y) in enumerate(rows):
        for b in range(a):
            j, u, z = rows[b]
            if ok(v, y, i) and ok(u, z, j) and y == z and len(u) == len(v):
                p, q = np.array(u, float), np.array(v, float)
                if p @ q / np.sqrt((p @ p) * (q @ q)) >= 0.93:
                    n[a] += 1
                    n[b] += 1
                    x, y2 = sorted((find(a), find(b)))
                    root[y2] = x
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, n[k], None if i is None else least[find(k)], i is not None and least[find(k)] == i) for k, (i, _, _) in enumerate(rows)), key=repr)


def found(spark, rows, kind="float"):
    vectors = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").selectExpr("*", "'x' as id", "1 as w", "2 as comp")
    return sorted((tuple(r) for r in nd.link_vectors(vectors).drop("recall").collect()), key=repr)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [nan, 1.0], 0), (6, [inf, 1.0], 0), (7, [1.0, 2.0], None), (8, [1.0, 2.0], 0), (9, [2.0, 4.0], 0), (10, [1.0, 2.0], 1), (11, [1.0, 2.0, 0.0], 0), (12, [1.0, 2.0], 0), (None, [1.0, 2.0], 0), (13, [2.0, 1.0], 0), (14, [-1.0, -2.0], 0)]
    for kind in ("float", "double"):
        assert found(spark, rows, kind) == by_hand(rows)
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert nd.link_vectors(vectors).count() == 0


def test_repeated_ids_and_mixed_dimensions(spark):
    """An id is no key: its rows link each for itself, and take no other row along."""
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.0, 1.0, 0.0], 0), (3, [1.0, 0.0], 1), (4, [0.0, 1.0, 0.05], 0), (2, [1.0, 0.01], 0), (4, [0.02, 1.0], 0), (1, [1.0, 0.02], 1)]
    assert found(spark, rows) == by_hand(rows)
    assert [n for i, n, *_ in by_hand(rows[:3])] == [0, 1, 1]
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(0, 40)), (np.eye(3)[k % 3] + rng.standard_normal(3) * 0.25).astype("f4").tolist()[: 3 - k % 2], k % 2) for k in range(120)]
    assert found(spark, rows) == by_hand(rows)


def test_saturated_lists_grow(spark, monkeypatch):
    edges = spark.createDataFrame([(1, k, 0.95) for k in range(2, 12)] + [(2, k, 0.95 if k < 9 else 0.9) for k in range(3, 13)] + [(3, 4, 0.99)], "a long, b long, sim double")
    assert [r.a for r in nd.saturated(edges, 10, 0.93).collect()] == [1]
    monkeypatch.setattr(nd, "tables_for", lambda n, threshold: (6, 1))
    kept, sizes = nd._best, []
    monkeypatch.setattr(nd, "_best", lambda edges, size: (sizes.append(size), kept(edges, size))[1])
    rng = np.random.default_rng(9)
    x = np.concatenate([around(rng, c / np.linalg.norm(c), 0.99, n) for c, n in zip(rng.standard_normal((61, 16)), [2] * 60 + [200])])
    rows = [(i, v.astype("f4").tolist(), 0) for i, v in enumerate(x)]
    assert {r[0]: r[1] for r in found(spark, rows)} == n_links(rows)
    assert max(sizes) == nd.LIST << nd.ENLARGE


def test_audit_tells_recall(spark):
    kinds = spark.createDataFrame([(i, 0, [1.0, i / 100]) for i in range(8)] + [(i, 0, [i / 100, 1.0]) for i in range(8, 10)], "id long, label int, v array<double>")
    comps = lambda *groups: spark.createDataFrame([(i, min(g)) for g in groups for i in g], "id long, comp long")
    probe = nd._sample(kinds)
    assert nd._audit(kinds, comps(range(8), (8, 9)), probe, 0.93) == 1.0
    assert nd._audit(kinds, comps(range(4), range(4, 8), (8, 9)), probe, 0.93) < 0.6


def test_clusters_and_pairs(spark):
    rng, rows = np.random.default_rng(4), []
    for size in [1] * 300 + [2] * 60 + [5] * 10 + [40, 400]:
        center = rng.standard_normal(24)
        for _ in range(size):
            rows.append((len(rows), (center + rng.standard_normal(24) * 0.2).astype("f4").tolist(), int(rng.integers(0, 2)) if size < 9 else 0))
    rows += [(len(rows) + k, rows[-1][1], 0) for k in range(30)]
    got, want = found(spark, rows), by_hand(rows)
    links = [sum(r[1] for r in x) for x in (got, want)]
    assert links[0] >= 0.99 * links[1]
    assert all(g[1] <= w[1] for g, w in zip(got, want))


def around(rng, center, cosine, n):
    """n unit vectors at this cosine from center."""
    noise = rng.standard_normal((n, len(center)))
    noise -= np.outer(noise @ center, center)
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    return cosine * center + np.sqrt(1 - cosine**2) * noise


def test_tight_groups_with_links_between(spark):
    """Two revisions of a text: each vector has more closer copies of its own revision than a list holds."""
    rng = np.random.default_rng(8)
    center = np.eye(64)[0]
    rows = [v for revision in around(rng, center, 0.975, 2) for v in around(rng, revision, 0.995, 40)]
    rows = [(i, v.astype("f4").tolist(), 0) for i, v in enumerate(rows)]
    assert found(spark, rows) == by_hand(rows)
    assert {r[2] for r in by_hand(rows)} == {0}


def n_links(rows):
    """Links of each row (id, unit vector, label), by id."""
    ids, x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], "f4").astype(float), np.array([r[2] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    return dict(zip(ids.tolist(), (((x @ x.T >= 0.93) & (y[:, None] == y)).sum(1) - 1).tolist()))


def test_hot_topic_in_first_blocks(spark, monkeypatch):
    """A label of one topic, whose blocks hold far more vectors than are compared at once; links are few."""
    monkeypatch.setattr(nd, "RETRIES", 0)
    monkeypatch.setattr(nd, "ROUNDS", 0)
    rng = np.random.default_rng(3)
    x = around(rng, np.eye(64)[0], 0.91, 3000)
    x[:300] = [around(rng, v, 0.94, 1)[0] for v in x[300:600]]
    rows = [(i, v.astype("f4").tolist(), 0) for i, v in enumerate(x)]
    assert {r[0]: r[1] for r in found(spark, rows)} == n_links(rows)


def test_chunks_of_blocks_and_hubs(spark, monkeypatch):
    monkeypatch.setattr(nd, "CHUNK", 5)
    monkeypatch.setattr(nd, "RETRIES", 0)
    rng = np.random.default_rng(6)
    x = np.concatenate([around(rng, c / np.linalg.norm(c), 0.98, n) for c, n in zip(rng.standard_normal((160, 64)), [1] * 100 + [3] * 50 + [20] * 10)])
    rows = [(i, v.astype("f4").tolist(), i % 2) for i, v in enumerate(x)]
    assert {r[0]: r[1] for r in found(spark, rows)} == n_links(rows)


def test_audit_leaves_nothing_short(spark, monkeypatch):
    """Blocks that find next to nothing outside one hot group: its many links must not carry the audit, and what the
    last attempt leaves short is compared whole."""
    monkeypatch.setattr(nd, "RETRIES", 0)
    monkeypatch.setattr(nd, "ROUNDS", 0)
    monkeypatch.setattr(nd, "tables_for", lambda n, threshold: (30, 1))
    rng = np.random.default_rng(5)
    x = np.concatenate([around(rng, c / np.linalg.norm(c), 0.98 if n == 2 else 1 - 1e-9, n) for c, n in zip(rng.standard_normal((151, 64)), [2] * 150 + [600])])
    rows = [(i, v.astype("f4").tolist(), 0) for i, v in enumerate(x)]
    assert {r[0]: r[1] for r in found(spark, rows)} == n_links(rows)

import random

import numpy as np

from assayfold.llm import parity_join as pj
from helpers import ODD, documents, frame


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def by_hand(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    held = {}
    for k, (i, s) in enumerate(sets):
        if i is not None:
            for x in s:
                held.setdefault(x, []).append(k)
    near = {(a, b) for at in held.values() for a in at for b in at if a < b}
    for a, b in near:
        both = len(sets[a][1] & sets[b][1])
        if 100 * both >= 75 * len(sets[a][1] | sets[b][1]):
            x, y = sorted((find(sets[a][0]), find(sets[b][0])))
            root[y] = x
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=repr)


def check(spark, rows):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in pj.near_duplicates(frame(spark, rows)).collect()), key=repr)
    assert got == by_hand(rows)


def test_documents(spark):
    check(spark, [(i, t) for i, t, _ in documents("/root/testdata/sf0.01")])


def test_odd_rows(spark):
    check(spark, [*ODD, (30, "a b c d e f"), (31, "a b c d e f g"), (32, "a b c d e f g h"), (33, "b c d e f g h"), (34, "a b c d"), (35, "A b\tc d")])
    assert pj.near_duplicates(frame(spark, ODD).where("false")).count() == 0


def test_edits_of_all_sizes(spark):
    """Chains of edited copies around the limit, with a passage that all of them share."""
    dice, rows = random.Random(5), []
    passage = [f"p{i}" for i in range(30)]
    for family in range(40):
        n = dice.choice([5, 6, 7, 9, 12, 20, 40, 90, 200, 500])
        words = [f"f{family}w{i}" for i in range(n)] + (passage if family % 2 else [])
        for _ in range(12):
            words = list(words)
            for _ in range(dice.choice([0, 1, 1, 2, max(1, n // 40)])):
                at = dice.randrange(len(words))
                words[at : at + dice.choice([0, 1, 1, 2])] = [f"x{dice.randrange(10**6)}"] * dice.choice([0, 1, 1])
                words = words or ["x"]
            rows.append((len(rows), " ".join(words)))
    check(spark, rows)


def test_large_bucket_rounds(spark, monkeypatch):
    monkeypatch.setattr(pj, "SMALL", 3)
    monkeypatch.setattr(pj, "GROUP", 4)
    dice, base = random.Random(9), [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in dice.sample(range(120), 4):
            words[at] = f"y{dice.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    check(spark, rows)


def agreements(s):
    out = {}
    for k, _, g, t in zip(*(x.tolist() for x in pj.join_keys(s, np.array([0, len(s)])))):
        out.setdefault(g, (set(), t))[0].add(k)
    return out


def test_hashes_of_long_texts(monkeypatch):
    import pyarrow as pa

    from assayfold.llm import shingles

    texts = [None, "", " a", "b " * 50, "ünï cödé\u3000x\x0bY", "z" * 200, *(f"w{i} q" for i in range(20))]
    whole = shingles.shingle_sets(pa.array(texts), 5)
    assert np.diff(whole[1]).tolist() == [len(shingles_of) for shingles_of in map(shingles_by_hand, texts)]
    monkeypatch.setattr(shingles.word_hashes, "__defaults__", (7,))
    cut = shingles.shingle_sets(pa.array(texts), 5)
    assert all((a == b).all() for a, b in zip(whole, cut))


shingles_by_hand = shingles


def test_pigeonhole_bound():
    """Linked sets agree in as many bands as either of them says a partner must."""
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 4, 5, 8, 13, 30, 77, 200, 1000, 5000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            drop = rng.integers(0, n // 4 + 1)
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, rng.integers(0, n // 4 + 1)).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 4 * both < 3 * (len(a) + len(b) - both) or not both:
                continue
            ka, kb = (agreements(x) for x in (a, b))
            group = int(np.searchsorted(pj._LOWS, min(len(a), len(b)), "right")) - 1
            assert len(ka[group][0] & kb[group][0]) >= max(ka[group][1], kb[group][1])


def test_need_of_the_text_that_needs_least(spark):
    """An id with two texts in a size band: few agreements are enough for the one, too few for the other."""
    met = spark.createDataFrame([(1, 7, 3, 2, 2), (2, 7, 3, 9, 1), (3, 8, 3, 4, 3)], "run long, id long, band int, need int, n long")
    assert sorted(r.run for r in pj.with_enough(met).collect()) == [1, 2]

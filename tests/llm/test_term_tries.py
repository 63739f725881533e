import os
import re
from collections import Counter, defaultdict

import numpy as np
from helpers import ODD, frame, same_as_sql
from hypothesis import given, settings
from hypothesis import strategies as st

from assayfold.llm import term_tries as tt


def by_hand(rows, least=3, listed=200):
    """The contract over (text, lang, source) in Python's whole numbers."""
    lower = {c: c + 32 for c in range(65, 91)}
    docs = [(Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower))), lang or "", s or "") for t, lang, s in rows]
    groups, seen = defaultdict(Counter), defaultdict(Counter)
    for terms, lang, s in docs:
        groups[lang, s].update(terms)
        seen[lang].update(terms.keys())
    out = []
    for lang in {g for g, _ in groups}:
        kept = [t for t, n in seen[lang].items() if n >= least]
        sources = [s for g, s in groups if g == lang]
        n = {s: sum(groups[lang, s][t] for t in kept) for s in sources}
        total = {t: sum(groups[lang, s][t] for s in sources) for t in kept}
        p = lambda c, size: 1 + 1_000_000_000 * (c + 1) // (size + len(kept))  # noqa: E731, B023
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            mine = {t: p(groups[lang, s][t], n[s]) for t in kept}
            parts = {"pair": [(-sum(f(mine[t], p(groups[lang, o][t], n[o])) for t in kept), o) for o in sources if o != s]}
            q = {t: p(total[t], sum(n.values())) for t in kept}
            parts["term"] = [(-f(mine[t], q[t]), t) for t in kept if groups[lang, s][t] and mine[t] > q[t]]
            for part, values in parts.items():
                values = sorted(values, key=lambda x: (x[0], x[1].encode()))[: listed if part == "term" else None]
                out += [(lang, s, part, item, -v, k + 1) for k, (v, item) in enumerate(values)]
    return sorted(out)


WORDS = "the The quick brown fox été ÉTÉ naïve 中文 über don't a1b2 inter internal interne international in i 𝒳𝒴 Ｆ".split()


def rows_of(n):
    texts = [" ".join(WORDS[(k * 7 + j * j) % len(WORDS)] for j in range(k % 9)) for k in range(n)]
    return [(None if k % 17 == 0 else t, None if k % 13 == 0 else "en" if k % 3 else "fr", None if k % 11 == 0 else f"s{k % 4}" if k % 5 else "Ünï") for k, t in enumerate(texts)]


def found(spark, rows, **more):
    docs = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "1 as value", "2 as rank", "'p' as part", "null as doc_id")
    return sorted(tuple(r) for r in tt.audit(docs, **more).collect())


def test_brute_force(spark):
    rows = rows_of(200)
    assert found(spark, rows) == by_hand(rows)
    assert found(spark, rows, leaves=5, heavy=2, listed=3) == by_hand(rows, listed=3)  # small tries, deep cuts
    assert found(spark, rows, least=1000) == by_hand(rows, least=1000)  # no term is kept


def test_odd_rows(spark):
    docs = frame(spark, ODD)
    rows = [(r.text, r.lang, r.source) for r in docs.select("text", "lang", "source").collect()]
    assert sorted(tuple(r) for r in tt.audit(docs).collect()) == by_hand(rows)
    assert found(spark, []) == []
    assert found(spark, [("a b c", "en", "x")] * 4) == by_hand([("a b c", "en", "x")] * 4)  # one source: no pairs
    assert found(spark, [("z" * 300_000 + " y", "en", f"{k % 2}") for k in range(6)] + [(None, "en", "3")]) == by_hand([("z" * 300_000 + " y", "en", f"{k % 2}") for k in range(6)] + [(None, "en", "3")])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=6).map(lambda b: bytes(97 + x % 3 for x in b)), max_size=60))
def test_trie_is_a_sorted_set(terms):
    trie, leaf = tt.Radix(), {}
    for t in terms:
        assert trie.extend([t]) == [leaf.setdefault(t, len(leaf))]
    assert trie.extend(sorted(terms)) == [leaf[t] for t in sorted(terms)] and trie.leaves == len(leaf)
    ordered = tt.Radix()
    assert ordered.extend(sorted(leaf)) == list(range(len(leaf)))
    assert [t for _, t, _ in ordered.walk()] == sorted(leaf)
    walked, last = list(trie.walk()), b""
    assert [(t, k) for _, t, k in walked] == sorted(leaf.items())
    for shared, t, _ in walked:
        assert shared == len(os.path.commonprefix([last, t]))
        last = t


@settings(max_examples=40, deadline=None)
@given(st.sets(st.text(alphabet="abcé中", min_size=1, max_size=7), max_size=40), st.integers(1, 4))
def test_segments_give_their_leaves_back(terms, depth):
    tally = tt.Tally()
    for k, t in enumerate(sorted(terms, reverse=True)):
        leaves = tally.leaves([t.encode()])
        tally.docs[leaves] += k + 1
        for source, n in (("a", k), ("b", 5), ("a", 2)):
            tally.add(leaves, np.array([tally.place(source)]), np.array([n]))
    names = [c.split()[0] for c in tt.SEGMENT.split(", ")]
    rows = [dict(zip(names, r)) for r in tt._cut("en", list(tally.places), *tally.in_order(), depth)]
    back = {}
    for row in rows:
        own, at = tt._terms(row), 0
        assert all(t[:depth] == row["prefix"] for t in own)
        for t, d, w in zip(own, row["docs"], row["width"]):
            back[t.decode()] = (d, {row["sources"][k]: n for k, n in zip(row["at"][at : at + w], row["n"][at : at + w])})
            at += w
    assert back == {t: (k + 1, {"a": k + 2, "b": 5}) for k, t in enumerate(sorted(terms, reverse=True))}
    assert list(back) == sorted(terms, key=str.encode) and len({r["prefix"] for r in rows}) == len(rows)


def test_probabilities_are_exact_for_large_counts():
    counts, total = np.array([[0, 7], [10**12, 3]]), np.array([10**13, 10])
    want = [[1 + 10**9 * (int(c) + 1) // (int(n) + 5) for c, n in zip(row, total)] for row in counts]
    assert tt.probabilities(counts, total, 5).tolist() == want


def test_sql(spark, sf):
    same_as_sql(spark, "op13_term_tries", sf)

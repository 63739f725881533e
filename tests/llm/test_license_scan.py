import re

from assayfold.llm import license_scan as ls
from assayfold.llm import queries
from helpers import ODD, documents, frame

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base(text):
    w, found = words(text), []
    for phrase, label in PHRASES.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    at = [i for i, _ in found]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def query(monkeypatch, docs):
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    return queries.op5_diagonal_voting(None, "")


def check(out, rows):
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out), key=repr)
    assert got == sorted(((i, *base(t)) for i, t in rows), key=repr)
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in out)


def test_base_equals_brute_force(spark, sf, monkeypatch):
    rows = [(i, t) for i, t, _ in documents(sf)]
    check(query(monkeypatch, frame(spark, rows)).collect(), rows)


def test_odd_rows(spark, monkeypatch):
    rows = [*ODD, (20, "cc by nc cc by nc by nc"), (21, "under the mit license " * 500)]
    check(query(monkeypatch, frame(spark, rows)).collect(), rows)
    assert query(monkeypatch, frame(spark, rows).where("false")).count() == 0


def test_edited_spans_are_found(spark):
    text = ls.TEMPLATES[0].text.split()
    edited = [*"some words first".split(), *text[:9], "inserted", *text[9:20], *text[22:]]
    rows = ls.scan(frame(spark, [(1, " ".join(edited)), (2, " ".join(text[:6]))])).collect()
    spans = {r.doc_id: r.spans for r in rows}
    assert [(s.label, s.start) for s in spans[1]] == [("mit", 2)]  # two words are left out after the inserted one
    assert spans[1][0].share > 0.8
    assert spans[2] == []


def spans_by_hand(text, k=3, drift=6, coverage=0.6):
    """All spans of a text: hits by words, one diagonal each for exact templates, merged diagonals for the others."""
    w, out = words(text), []
    for number, t in enumerate(ls.PHRASES + ls.TEMPLATES):
        of = words(t.text)
        grams = {}
        for at in range(len(of) - k + 1):
            grams.setdefault(tuple(of[at : at + k]), []).append(at)
        diagonals = {}
        for pos in range(len(w) - k + 1):
            for at in grams.get(tuple(w[pos : pos + k]), ()):
                diagonals.setdefault(pos - at, set()).add(at)
        groups, last, first, n = {}, None, None, len(of) - k + 1
        for d in sorted(diagonals):
            if t.exact or last is None or d - last > drift:
                first = d
            groups.setdefault((first, (d - first) // max(n // 2, 4 * drift)), []).append(d)
            last = d
        for own in groups.values():
            ats = set().union(*(diagonals[d] for d in own))
            if len(ats) >= (n if t.exact or n < 12 else coverage * n):
                out.append((number, t.label, t.exact, own[0], len(ats)))
    return sorted(out)


def test_spans_equal_brute_force(spark):
    cut = [" ".join(t.text.split()[: 3 * len(t.text.split()) // 4]) for t in ls.TEMPLATES]
    loose = " ".join(x for t in ls.TEMPLATES for x in (t.text, "and", t.text.replace(" the ", " of the very ")))
    rows = [*ODD, (30, loose), (31, loose), (31, loose), *((40 + i, f"before {x} after") for i, x in enumerate(cut)), (90, "to use copy modify " * 2000)]
    got = [(r.doc_id, [(s.template, s.label, s.exact, s.start, s.votes) for s in r.spans]) for r in ls.scan(frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(((i, spans_by_hand(t)) for i, t in rows), key=repr)
    assert sum(len(s) for _, s in got) > 30


def test_equal_hashes_of_other_words_are_no_hits(spark, monkeypatch):
    """Spans are verified on words: where all k-grams share one hash, nothing more is found."""
    texts = [(1, "under the mit license"), (2, "some four other words"), (3, ls.TEMPLATES[0].text)]
    want = [(r.doc_id, r.spans) for r in ls.scan(frame(spark, texts)).orderBy("doc_id").collect()]
    kept = ls.grams
    monkeypatch.setattr(ls, "grams", lambda of, k: ls.F.transform(kept(of, k), lambda g: ls.F.lit(1).cast("long")))
    assert [(r.doc_id, r.spans) for r in ls.scan(frame(spark, texts)).orderBy("doc_id").collect()] == want


def test_a_mention_is_no_license(spark):
    rows = [(1, "The tool is not under the GNU General Public License at all."), (2, "It is licensed under the GNU General Public License."), (3, "to use copy modify then " * 3000)]
    assert [[s.label for s in r.spans] for r in ls.scan(frame(spark, rows)).orderBy("doc_id").collect()] == [[], ["gpl"], []]


def test_many_templates_join_without_names(spark, monkeypatch):
    rows = [(1, "under the mit license"), (2, ls.TEMPLATES[0].text), (None, None)]
    want = sorted(map(repr, ls.scan(frame(spark, rows)).collect()))
    monkeypatch.setattr(ls, "KEYS", 3)
    assert sorted(map(repr, ls.scan(frame(spark, rows)).collect())) == want

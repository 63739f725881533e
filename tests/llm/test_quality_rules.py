import re

from assayfold.llm import quality_rules
from helpers import ODD, documents, frame, same_as_sql


def by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def counts(df):
    return sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in df.collect()), key=repr)


def expected(rows):
    return sorted(((i, *(m := by_hand(t)), m[0] < 20 or 100 * m[4] > 30 * m[0]) for i, t in rows), key=repr)


def test_counts_equal_brute_force(spark, sf):
    rows = [(i, t) for i, t, _ in documents(sf)]
    assert counts(quality_rules.apply_rules(frame(spark, rows))) == expected(rows)


def test_odd_rows(spark):
    out = quality_rules.apply_rules(frame(spark, ODD))
    assert counts(out) == expected(ODD)
    assert all(r.kept is not None and (not r.base_failed or not r.kept) for r in out.collect())
    assert quality_rules.apply_rules(frame(spark, ODD).where("false")).count() == 0


def test_rules_are_a_table(spark):
    rules = (quality_rules.Rule("few", "n_words", 3, None), quality_rules.Rule("signs", "n_symbols / n_words", None, 0.1))
    out = {r.doc_id: r.failed_rules for r in quality_rules.apply_rules(frame(spark, [(1, "a b"), (2, "a b c"), (3, "a # c")]), rules, ("few",)).collect()}
    assert out == {1: ["few"], 2: [], 3: ["signs"]}


def test_sql(spark, sf):
    same_as_sql(spark, "op7_threshold_table", sf)

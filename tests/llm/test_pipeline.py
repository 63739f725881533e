from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from assayfold.llm import compression_classifier, cost_packing, entropy_mixing, quality_rules
from helpers import ODD, frame
from test_parity_join import by_hand


def test_stages_against_brute_force(spark, sf):
    """Every stage by its own rule on what the one before kept; joins by hand."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = compression_classifier.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = docs.collect()
    scores = compression_classifier.Scorer(model).scores([r.text for r in rows])
    rows = [r for r, s in zip(rows, scores) if s >= 0.5]
    good = {r.doc_id for r in quality_rules.apply_rules(spark.createDataFrame(rows, docs.schema)).where("kept").collect()}
    rows = [r for r in rows if r.doc_id in good]
    rows = [r for r, (i, _, c) in zip(sorted(rows, key=lambda r: repr(r.doc_id)), by_hand([(r.doc_id, r.text) for r in rows])) if r.doc_id == i == c]
    mix = {r.doc_id: r.copies for r in entropy_mixing.mix(spark.createDataFrame(rows, docs.schema)).collect()}
    want = sorted((r.doc_id, k) for r in rows for k in range(mix[r.doc_id]))
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == cost_packing.NAMES
    tokens = {}
    for r in got.collect():
        tokens.setdefault(r.doc_id, [0, r.doc_tokens])[0] += r.length
    assert {i: n // t for i, (n, t) in tokens.items()} == {i: sum(d == i for d, _ in want) for i in {d for d, _ in want}}
    assert all(n % t == 0 for n, t in tokens.values())


def test_odd_rows_and_clashing_names(spark, sf):
    """Stages return whole rows of their input: own columns keep their values, whatever operators call theirs."""
    base = frame(spark, ODD).unionByName(frame(spark, [(20 + i, " ".join(f"word{i} the {k} of" for k in range(20))) for i in range(4)]))
    docs = base.withColumns({c: F.lit(f"mine {c}") for c in ("_score", "_hash", "_n", "rate", "failed_rules")})
    there = {tuple(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        rows = [tuple(r) for r in out.collect()]
        assert rows and set(rows) <= there, name
        assert stage(spark, docs.where("false"), sf).count() == 0, name
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, docs, sf).groupBy("doc_id").count().count() == docs.select("doc_id").distinct().count()
    assert last(spark, docs.where("false"), sf).count() == 0


def test_mix_takes_repeated_rows_as_often_as_it_says(spark, sf):
    rows = [(1, "a b c d", "s", "x")] * 3 + [(1, "a b c d", "s", "y")] + [(i, f"w{i} " * 9, "t", "z") for i in range(2, 30)] + [(None, "no id here", "s", "z")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    want = Counter()
    for r in entropy_mixing.mix(docs).collect():
        want[r.doc_id] += r.copies
    got = Counter(r.doc_id for r in corpus_pipeline.mixed(spark, docs, sf).collect())
    assert got == Counter({k: v for k, v in want.items() if v})


def test_null_and_repeated_ids_stay(spark, sf):
    one, two, three = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, one, "s"), (2, one, "s"), (3, two, "s"), (3, three, "t"), (3, three, "s"), (None, "other words of no id", "s"), (None, None, "s")]
    got = corpus_pipeline.deduplicated(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), sf)
    assert set(map(tuple, got.collect())) == {rows[k] for k in (0, 2, 4, 5, 6)} and got.count() == 5

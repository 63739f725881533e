import zlib

import pytest

from assayfold.llm import compression_classifier as cc
from assayfold.llm import queries
from helpers import ODD, frame


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op10_compression_classifier(spark, sf).collect()]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    test = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in test if y == 1], [s for s, y in test if y == 0]
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / len(good) / len(bad) > 0.9
    assert sum((s >= 0.5) == y for s, y in test) / len(test) > 0.93


def test_scores_equal_brute_force(spark):
    """Each text compressed by itself with either dictionary, and the logistic of what that gives, one number at a time."""
    import math

    import zstandard

    rows = [(i, (f"calm words about topic {i % 7} and more of it " if i % 2 else f"buy now!!! http://x{i}.biz free $$$ ") * (3 + i % 11)) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    docs = frame(spark, [*rows, *ODD])
    model = cc.fit(docs, labels)
    size = lambda raw, d: len(zstandard.ZstdCompressor(level=model.level, write_content_size=False, **({"dict_data": zstandard.ZstdCompressionDict(d), "write_dict_id": False} if d else {})).compress(raw))
    assert model.good and model.bad and model.good != model.bad
    for r in cc.score(docs, model, "s").collect():
        raw = (r.text or "").encode()
        n, good, bad, plain = max(1, len(raw)), size(raw, model.good), size(raw, model.bad), size(raw, b"")
        x = [(bad - good) / max(good, bad), (bad - good) / n, (plain - good) / n, plain / n, math.log1p(n)]
        z = model.weights[0] + sum(w * (v - m) / s for w, v, m, s in zip(model.weights[1:], x, model.means, model.scales))
        assert abs(r.s - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9


def test_odd_rows(spark):
    docs = frame(spark, ODD)
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(1, 16)] + [(None, 1, 0), (3, None, 0), (40, 1, 1)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.where("false"), labels.where("quality = 1")):
        out = cc.score(docs, cc.fit(docs, known)).collect()
        assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
        assert len({r.score for r in out if not (r.text or "")}) == 1
    assert cc.score(docs.where("false"), cc.fit(docs, labels)).count() == 0


@pytest.mark.parametrize("bound", [0, 1, 3])
def test_bounds(spark, bound):
    docs = frame(spark, [(i, f"text {i} " * 20) for i in range(40)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    assert cc.fit(docs, labels, rows=bound).weights

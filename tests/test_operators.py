import json
import random

import pytest
from pyspark.sql import functions as F

from assayfold.errors import AssayError
from assayfold.operators import experiments, judging, questions, selective
from assayfold.sources import labelled, ledger


def judged(spark, rows):
    return spark.createDataFrame([(i, float(c), bool(r)) for i, (c, r) in enumerate(rows)], "pos long, certainty double, right boolean")


def auroc_by_hand(rows):
    good, bad = [c for c, r in rows if r], [c for c, r in rows if not r]
    return sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad)) if good and bad else None


@pytest.mark.parametrize("seed", range(6))
def test_auroc_by_hand(spark, seed):
    """Random rows on a coarse grid, so that ties are many; some seeds have one kind of rows only."""
    dice = random.Random(seed)
    rows = [(dice.randrange(7) / 8, dice.random() < (0.3, 0.8, 1.1)[seed % 3]) for _ in range(5 + 9 * seed)]
    got, want = selective.discrimination(judged(spark, rows)).first().auroc, auroc_by_hand(rows)
    assert got is None if want is None else abs(got - want) < 1e-12


def test_cut_keeps_whole_levels(spark):
    dice = random.Random(3)
    rows = [(k / 40, dice.random() < 0.55 + k / 110) for k in range(12, 41) for _ in range(dice.randrange(5, 120))]
    best = None
    for cut in sorted({c for c, _ in rows}):
        kept = [r for c, r in rows if c >= cut]
        if len(kept) >= 30 and sum(kept) / len(kept) >= 0.9:
            best = cut
            break
    assert selective.cut_for_accuracy(judged(spark, rows), 0.9).first().cut == best
    assert selective.cut_for_accuracy(judged(spark, rows), 0.999).first() is None


def test_triage(spark):
    dice = random.Random(17)
    certainty = [dice.randrange(50, 60) / 60 for _ in range(10)]
    answers = spark.createDataFrame([(i, c, "x" if i == 0 else None) for i, c in enumerate(certainty)], "pos long, certainty double, error string")
    for keep in (0, 0.1, 0.5, 0.6, 1):
        n = int(9 * keep)
        want = set(sorted(range(1, 10), key=lambda i: (-certainty[i], i))[:n])
        assert {r.pos for r in selective.triage(answers, keep=keep).where("trusted").collect()} == want
    for bad in ({}, {"keep": 0.5, "at_least": 0.5}, {"keep": 2}):
        with pytest.raises(ValueError):
            selective.triage(answers, **bad)


def test_refusals(spark):
    few = judged(spark, [(0.9, 1)] * 10)
    flat = judged(spark, [(0.5 + i % 2 / 4, i // 2 % 2) for i in range(100)])
    for rows, args in ((few, {"keep": 0.5}), (flat, {"keep": 0.5}), (flat, {}), (flat, {"keep": 0.5, "confidence": 0.9})):
        with pytest.raises(ValueError):
            selective.calibrate(rows, **args)
    with pytest.raises(ValueError):
        selective.routing(flat, 1.0)


def test_packs_equal_brute_force(spark):
    dice = random.Random(1)
    rows = [(i, "x" * dice.choice([5, 400, 3000, 19_000])) for i in range(500)]
    want, state, request, k, group = {}, 0, 0, 0, 0
    for i, t in rows:
        chars = len(t) + 12
        if k and not (k < 32 and state + chars < 98_000 and request + chars < 196_000):
            state, request, k, group = 0, 0, 0, group + 1
        state, request, k = state + chars, request + chars, k + 1
        want[i] = (group, k)
    got = {r.pos: (r.pack_id, r.position) for r in judging.plan_packs(spark.createDataFrame(rows, "pos long, item string")).collect()}
    assert got == want


@pytest.mark.parametrize("pack, block", [(32, 7), (3, 3), (5, 64)])
def test_packs_cross_blocks(spark, pack, block):
    """Positions with gaps, texts of all lengths, questions of their own, a block of fewer items than a pack, no items."""
    dice = random.Random(pack * 100 + block)
    rows = [(i * 3 + i % 2, dice.choice([None, "", "x" * 9, "x" * 3000, "x" * 120_000]), dice.choice([None, 0, 9000])) for i in range(151)]
    want, group, now = {}, -1, []
    for pos, text, more in rows:
        chars = len(text or "") + 12
        now.append((chars, chars + (more or 0)))
        if len(now) == 1 or len(now) > pack or sum(c for c, _ in now) >= 98_000 or sum(q for _, q in now) >= 196_000:
            group, now = group + 1, now[-1:]
        want[pos] = (group, len(now))
    sizes = {g: max(p for h, p in want.values() if h == g) for g, _ in want.values()}
    items = spark.createDataFrame(rows, "pos long, item string, overhead int")
    got = {r.pos: (r.pack_id, r.position, r.packed) for r in judging.plan_packs(items, pack, block=block).collect()}
    assert got == {pos: (g, p, sizes[g]) for pos, (g, p) in want.items()}
    assert judging.plan_packs(items.limit(0), pack, block=block).count() == 0


def test_decode(spark):
    entries = [
        '{"noul": 0.5}',
        '{"noul": null}',
        '{"choice": "c", "probabilities": {"a": 1}}',
        '{"score": 2.5, "legend": {"0": "l", "1": "m", "2": "h"}, "probabilities": {"2": 0.7}}',
        '{"score": -3, "legend": {"0": "l"}, "probabilities": {"0": 0.4}}',
        "torn",
        None,
    ]
    out = judging.decode(spark.createDataFrame(list(enumerate(entries)), "pos long, payload string")).orderBy("pos").collect()
    assert [(r.kind, r.label, r.p) for r in out] == [
        ("noul", "yes", 0.5),
        ("error", "", 0.0),
        ("choice", "c", 0.0),
        ("score", "h", 0.7),
        ("score", "l", 0.4),
        ("error", "", 0.0),
        ("error", "", 0.0),
    ]
    assert out[3].distribution == {"h": 0.7} and [r.error is None for r in out] == [True, False, True, True, True, False, False]


def test_scores_by_their_own_keys(spark):
    """The clamp goes by the probabilities' largest level, and a missing legend leaves the number as label."""
    entries = [
        '{"score": 5, "legend": {"0": "l", "1": "m", "2": "h"}, "probabilities": {"0": 0.2, "1": 0.8}}',
        '{"score": 1.4, "probabilities": {"0": 0.1, "1": 0.6, "2": 0.3}}',
        '{"score": 3}',
        '{"score": 0.5, "legend": {}, "probabilities": {"0": 0.4, "1": 0.6}}',
    ]
    out = judging.decode(spark.createDataFrame(list(enumerate(entries)), "pos long, payload string")).orderBy("pos").collect()
    assert [(r.kind, r.label, r.p) for r in out] == [("score", "m", 0.8), ("score", "1", 0.6), ("score", "0", 0.0), ("score", "0", 0.4)]


def test_rates_need_a_full_window(spark):
    """Windows by a loop over the samples: an edge is taken by the first sample behind it, one sample an edge."""
    dice = random.Random(5)
    kind = "t double, requests long, input_tokens long, retries long, pushback long, waited double"
    for n, step in ((1, 1), (5, 1), (60, 4), (40, 30), (200, 3)):
        t, total, rows = 100.0, 0, []
        for _ in range(n):
            rows.append((t, total, 10 * total, total // 9, total // 11, total / 2))
            t, total = t + dice.choice([0.5, 1.0, step, 3 * step]), total + dice.randrange(9)
        want, edge, last = [], rows[0][0] + 20, rows[0]
        for r in rows:
            if r[0] >= edge:
                want.append((last[0] - rows[0][0], r[0] - last[0], (r[1] - last[1]) / (r[0] - last[0]) * 60, r[3] - last[3]))
                last, edge = r, edge + 20
        got = [
            (r["from"], r.seconds, r.requests_per_minute, r.retries)
            for r in experiments.rate_windows(spark.createDataFrame(rows, kind), 20).orderBy("from").collect()
        ]
        assert [tuple(round(x, 9) for x in r) for r in got] == [tuple(round(x, 9) for x in r) for r in want]
    assert experiments.sustained(experiments.rate_windows(spark.createDataFrame(rows[:2], kind), 20)).count() == 0


def test_percentiles_are_ranks(spark):
    for n in (1, 2, 11, 40, 101):
        values = sorted(random.Random(n).choices(range(50), k=n))
        row = experiments.percentiles(spark.createDataFrame([(v,) for v in values], "v int"), "v").first()
        assert (row.n, row.p95, row.tail) == (n, values[min(n - 1, round(0.95 * (n - 1)))], values[int(0.95 * n)])
    assert experiments.percentiles(spark.createDataFrame([], "v int"), "v").first().n == 0


def test_overhead_is_the_length_of_json(spark):
    odd = ["plain", 'a "quoted" \\ text', "line\nbreak\ttab\x01\x7f", "été 中文", "\U0001f600 sign"]
    rows = [(i, t, {"k" + t: t} if i % 2 else None, None, None) for i, t in enumerate(odd)] + [
        (9, "x", None, {t: t for t in odd}, None), (10, "x", {"a": "b"}, None, odd), (11, "x", {}, {}, [])
    ]
    frame = spark.createDataFrame(
        rows, "pos long, instructions string, criteria map<string,string>, options map<string,string>, levels array<string>"
    )
    for r in frame.withColumn("n", questions.overhead(*[F.col(c) for c in ("instructions", "criteria", "options", "levels")])).collect():
        kind = "score" if r.levels else "choice" if r.options else "noul"
        more = r.levels or r.options or r.criteria
        assert r.n == len(json.dumps({"type": kind, "instructions": r.instructions} | ({"criteria": more} if more else {}))), r


def test_bodies_are_json(spark):
    odd = ['say "x"', "line\nbreak", "été 中文", "back\\slash"]
    rows = [(i // 3, i % 3 + 1, t, "Is it so?", {"yes": t}) for i, t in enumerate(odd)]
    packs = spark.createDataFrame(rows, "pack_id long, position int, item string, instructions string, criteria map<string,string>").selectExpr(
        "*", "cast(null as map<string,string>) as options", "cast(null as array<string>) as levels"
    )
    out = {r.pack_id: json.loads(r.body) for r in questions.bodies(packs, "m").collect()}
    assert out[0]["state"] == {f"item_{k + 1}": t for k, t in enumerate(odd[:3])} and out[0]["model"] == "m"
    assert out[0]["questions"]["item_2"] == {
        "type": "noul", "instructions": "Is it so? Answer for item_2 alone; no other item matters.", "criteria": {"yes": odd[1]}
    }
    assert out[1] == {
        "model": "m",
        "state": {"item_1": odd[3]},
        "questions": {"item_1": {"type": "noul", "instructions": "Is it so?", "criteria": {"yes": odd[3]}}},
    }
    same = packs.withColumn("criteria", F.create_map(F.lit("no"), F.lit("never")))
    once = {r.pack_id: json.loads(r.body) for r in questions.bodies(same, "m", once=True).collect()}
    assert once[0]["state"]["guidance"] == "Is it so?\nno: never" and "criteria" not in once[0]["questions"]["item_1"] and "guidance" not in once[1][
        "state"
    ]


def test_questions_are_refused(spark):
    rows = spark.createDataFrame([(0, None, None), (1, {"a": "b"}, ["x"])], "pos long, options map<string,string>, levels array<string>")
    with pytest.raises(Exception, match="row 1 has no instructions"):
        questions.with_defaults(rows.where("pos = 0")).collect()
    with pytest.raises(Exception, match="row 2 has options and levels"):
        questions.with_defaults(rows, instructions="x").collect()
    assert questions.with_defaults(rows.where("pos = 0"), instructions="x", levels=["l"]).first().levels == ["l"]


def test_ledger_answers_are_returned(spark, tmp_path):
    """What a ledger holds comes back, resumed; a later run's record wins; a foreign folder is refused, not appended to."""
    book = f"file://{tmp_path}/book"
    items = lambda *texts: spark.createDataFrame([(i, t, t) for i, t in enumerate(texts)], "pos long, item string, key string")
    for p in (0.2, 0.7):
        answers = judging.judge(items("a", "b"), lambda texts, p=p: [json.dumps({"noul": p}) for _ in texts])
        ledger.append(answers, book, ledger.next_seq(spark, book), "m")
    out = {
        r.pos: r
        for r in judging.judge(items("a", "new", "a"), lambda texts: [json.dumps({"noul": 0.9}) for _ in texts], ledger.read(spark, book)).collect()
    }
    assert [(out[k].p, out[k].label, out[k].origin) for k in range(3)] == [(0.7, "yes", "resumed"), (0.9, "yes", "asked"), (0.7, "yes", "resumed")]
    assert out[1].certainty == 0.9
    (tmp_path / "foreign").mkdir()
    (tmp_path / "foreign" / "x.json").write_text('{"a": 1}\n')
    with pytest.raises(AssayError, match="not a ledger"):
        ledger.read(spark, f"file://{tmp_path}/foreign")
    assert len(list((tmp_path / "foreign").iterdir())) == 1


def test_logs(spark, tmp_path):
    """Heads among rows, older samples, notes, CSV."""
    (tmp_path / "run.jsonl").write_text('{"pack": 32, "model": "m"}\n{"arm": "a", "p": 0.5}\n{"arm": "b", "p": 0.25}\n{"arm": "c", "p')
    rows, heads = labelled.read_log(spark, str(tmp_path / "run.jsonl"), "arm string, p double", "pack int, model string")
    assert sorted(map(tuple, rows.collect())) == [("a", 0.5), ("b", 0.25)] and [tuple(r) for r in heads.collect()] == [(32, "m")]
    (tmp_path / "s.jsonl").write_text(
        '{"pack": 1}\n{"t": 1.5, "requests": 3, "pushback": {"429": 2, "503": 1}}\n{"t": 2.5, "requests": 4, "pushback": 5}\n'
    )
    assert [(r.t, r.pushback) for r in labelled.read_samples(spark, str(tmp_path / "s.jsonl")).orderBy("t").collect()] == [(1.5, 3), (2.5, 5)]
    corpus = spark.createDataFrame([("1", "text", "yes")], "id string, input string, target string")
    labelled.write_noted(corpus, str(tmp_path / "noted"), "keep out of training")
    assert [tuple(r) for r in labelled.read_labelled(spark, str(tmp_path / "noted")).collect()] == [("1", "text", "yes", None)]
    labelled.write_answers_csv(spark.createDataFrame([("a, b", "yes", 0.25)], "item string, label string, p double"), str(tmp_path / "csv"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()] == [("a, b", "yes", "0.2500")]
    assert labelled.repeats(corpus, 3).count() == 3


def test_unreachable_bar_names_the_crowd(spark):
    dice = random.Random(2)
    rows = [(1.0, dice.random() < 0.8) for _ in range(300)] + [(k / 200, dice.random() < 0.3) for k in range(100, 190) for _ in range(3)]
    with pytest.raises(ValueError, match="share the certainty"):
        selective.calibrate(judged(spark, rows), accuracy=0.97)


def test_clean(spark):
    with pytest.raises(Exception, match="item 1 is over"):
        judging.clean(spark.createDataFrame([(0, "x" * 20_001)], "pos long, item string")).collect()


def test_worst_window(spark):
    stamps = [30] * 900 + [60] * 900 + [200 + i for i in range(50)]
    events = spark.createDataFrame([(s,) for s in stamps], "s long").select(F.timestamp_seconds("s").alias("ts"))
    row = experiments.worst_window(events).first()
    assert (row.most, row.began) == (1800, 0.0)  # the window starts with the first burst


def test_bootstrap_interval(spark):
    log = spark.createDataFrame([(i, int(i % 10 == 0), 0) for i in range(400)], "source long, label int, gold int")
    row = experiments.bootstrap(log, draws=400).first()
    assert row.low < 0.9 < row.high and row.high - row.low < 0.08


def test_ledger_of_torn_lines(spark, tmp_path):
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "x.json").write_text('{"a": 1}\n{"k": "torn')
    with pytest.raises(ledger.NotALedger):
        ledger.read(spark, str(tmp_path / "other"))


def test_labelled_corpus(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text(
        '{"note": "canary"}\n{"id": "1", "input": "x", "target": "yes", "metadata": {"agreement": "true"}}\n{"id": "2", "input": "y", "target": '
        '""}\n{"id": "3", "inp'
    )
    assert [tuple(r) for r in labelled.read_labelled(spark, str(tmp_path)).collect()] == [("1", "x", "yes", True)]
    assert labelled.workload(spark, 5, (("a", "b"), ("c",))).count() == 5

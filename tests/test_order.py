"""Order statistics and running sums, cut into small pieces, against Python."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayfold.errors import AssayError
from assayfold.operators import experiments as ex
from assayfold.operators import order, reports
from assayfold.operators import selective as sel


def crowded(n=3000, seed=1):
    """(pos, certainty, right, label): 65 % of the rows on one certainty, the others nearly all different."""
    dice = random.Random(seed)
    rows = [(k, 0.9 if dice.random() < 0.65 else dice.random(), dice.random() < 0.7, dice.choice("ab")) for k in range(n)]
    dice.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows(spark):
    return crowded(), spark.createDataFrame(crowded(), "pos long, certainty double, right boolean, label string").cache()


def test_running_sums_in_pieces(spark, rows):
    plain, table = rows
    for down in (False, True):
        out = order.running(
            table, "certainty", {"upto": F.lit(1), "r": F.col("right").cast("long")}, by=("label",), down=down, totals={"all": F.lit(1)}, share=100
        )
        before = (lambda a, b: a >= b) if down else (lambda a, b: a <= b)
        for r in random.Random(2).sample(out.collect(), 40):
            own = [x for x in plain if x[3] == r.label and before(x[1], r.certainty)]
            assert (r.upto, r.r, r["all"]) == (len(own), sum(x[2] for x in own), sum(x[3] == r.label for x in plain))
    ranks = order.running(table, "certainty", {"i": F.lit(1)}, then=("pos",), down=True, share=100)
    assert [r.pos for r in ranks.orderBy("i").collect()] == [p for p, *_ in sorted(plain, key=lambda x: (-x[1], x[0]))]
    odd = spark.createDataFrame([(None, 1), (float("nan"), 2), (1.0, 3), (None, 4)], "x double, y int")
    assert {r.y: r.n for r in order.running(odd, "x", {"n": F.lit(1)}, share=1).collect()} == {1: 2, 4: 2, 3: 3, 2: 4}


def test_kth_value(spark, rows):
    plain, table = rows
    for down in (False, True):
        values = sorted((x[1] for x in plain), reverse=down)
        for k in (1, 2, 700, 1500, 2999, 3000):
            got = order.kth(table, "certainty", k, down=down, share=100)
            assert got == (values[k - 1], values.index(values[k - 1]))
        assert order.kth(table, "certainty", 3001, down=down, share=100) is None
    assert order.kth(table, "certainty", 0) is None and order.kth(table.limit(0), "certainty", 1) is None


def test_triage_cuts_a_crowded_level(spark, rows, monkeypatch):
    plain, table = rows
    monkeypatch.setattr(order, "SHARE", 100)
    answers = table.withColumn("error", F.when(F.col("pos") % 50 == 0, "x"))
    usable = sorted((x for x in plain if x[0] % 50), key=lambda x: (-x[1], x[0]))
    for keep in (0.0, 0.05, 0.5, 1.0):
        got = {r.pos for r in sel.triage(answers, keep=keep).where("trusted").collect()}
        assert got == {x[0] for x in usable[: int(len(usable) * keep)]}


def test_no_window_holds_a_whole_table(spark, rows, monkeypatch):
    """Of crowded and continuous certainty alike: every window is partitioned by pieces, or runs over the pieces."""
    plain, table = rows
    monkeypatch.setattr(order.cuts, "__defaults__", (100,))
    log = table.select(
        F.col("pos").alias("source"), "pos", F.lit("y").alias("gold"), F.when(F.col("right"), "y").otherwise("n").alias("label"), "certainty"
    )
    usable = sorted(plain, key=lambda x: (-x[1], x[0]))
    for r in ex.risk_coverage(log).collect():
        own = usable[: r.kept]
        assert r.kept == max(1, int(len(usable) * r.coverage)) and r.edge == own[-1][1]
        assert abs(r.accuracy - statistics.mean(x[2] for x in own)) < 1e-12
    good, bad = [x[1] for x in plain if x[2]], [x[1] for x in plain if not x[2]]
    pairs = (np.array(good)[:, None] > np.array(bad)).mean() + (np.array(good)[:, None] == np.array(bad)).mean() / 2
    assert abs(sel.discrimination(table).first().auroc - pairs) < 1e-12
    for r in sel.rungs(table).orderBy("certainty").limit(50).collect():
        own = [x for x in plain if x[1] >= r.certainty]
        assert (r.kept, r.total) == (len(own), len(plain)) and abs(r.accuracy - statistics.mean(x[2] for x in own)) < 1e-12
    p = ex.percentiles(table, "certainty").first()
    values = sorted(x[1] for x in plain)
    assert (p.n, p.p95, p.tail) == (3000, values[round(0.95 * 2999)], values[int(0.95 * 3000)])
    plan = sel.rungs(table)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line]
    assert len(windows) == 3 and all("_piece" in line or "sum(_total" in line for line in windows)  # totals of pieces, not of rows


def test_halves_are_exact(spark, rows):
    plain, table = rows
    for n in (0, 1, 2, 7, 3000):
        split = sel.split_halves(table.where(F.col("pos") < n), 5).groupBy("split").agg(
            F.count_if("fit").alias("fit"), F.count("*").alias("n")
        ).collect()
        assert all((r.fit, r.n) == (n // 2, n) for r in split)
    fits = [{r.pos for r in sel.split_halves(table, 2).where(f"fit and split = {k}").collect()} for k in (0, 1)]
    assert 600 < len(fits[0] & fits[1]) < 900  # halves of their own
    log = table.select((F.col("pos") % 501).alias("source"), "pos")
    items = reports.halves(log).select("source", "fit").distinct()
    assert (items.count(), items.where("fit").count()) == (501, 250)


def test_interval_agrees_with_resampling(spark):
    dice = random.Random(3)
    values = [dice.choice([0.0, 1 / 6, 1 / 3, 0.5, 2 / 3, 1.0, 1.0, 1.0]) for _ in range(800)] + [dice.random() for _ in range(20)]
    rng = np.random.default_rng(4)
    means = np.sort(rng.choice(values, (4000, len(values))).mean(1))
    low, high = means[100], means[3900]
    table = spark.createDataFrame(list(enumerate(values)), "unit long, value double")
    got = ex.interval(table, 2000).first()
    assert abs(got.low - low) < 0.004 and abs(got.high - high) < 0.004
    again = ex.interval(table.repartition(7), 2000).first()
    assert (again.low, again.high) == (got.low, got.high)
    assert ex.interval(table.limit(0), 50).count() == 0
    one = ex.interval(table.where("unit = 0"), 200).first()  # a single unit: every draw that has it has its value
    assert one.low == one.high == values[0]


def test_poisson_counts(spark):
    """Exact means of few, the normal form of many: mean and variance are those of Poisson counts."""
    for m in (1, 16, 17, 400):
        table = spark.range(m).select(F.col("id").alias("unit"), F.lit(1.0).alias("value")).unionByName(
            spark.range(m).select((F.col("id") + m).alias("unit"), F.lit(0.0).alias("value"))
        )
        got = ex.interval(table, 4000).first()
        # the share of m ones among 2m units has a variance of about 1 / (8 m)
        if m >= 16:
            assert abs((got.high - got.low) - 2 * 1.96 * (1 / (8 * m)) ** 0.5) < 0.25 * (got.high - got.low)
    assert all(abs(own[-1] - 1) < 1e-9 for own in ex.poisson_table())


def test_calibrate_refuses_and_notes(spark):
    def judged(n, right, certainty=lambda k: (k % 97) / 97, label=lambda k: "a"):
        return spark.createDataFrame(
            [(k, certainty(k), right(k), label(k)) for k in range(n)], "pos long, certainty double, right boolean, label string"
        )

    sorted_ = lambda k: (k * 31) % 97 < (k % 97) + 20
    for more in (
        {},
        {"keep": 0.5, "accuracy": 0.9},
        {"keep": 1.5},
        {"accuracy": 1.0},
        {"keep": 0.5, "confidence": 0.95},
        {"accuracy": 0.9, "confidence": 0.42},
    ):
        with pytest.raises(AssayError):
            sel.calibrate(judged(100, sorted_), **more)
    with pytest.raises(AssayError, match="too few"):
        sel.calibrate(judged(29, sorted_), accuracy=0.8)
    with pytest.raises(AssayError, match="does not tell"):
        sel.calibrate(judged(300, lambda k: k % 2 == 0, lambda k: (k % 7) / 7), accuracy=0.8)
    with pytest.raises(AssayError, match="with a confidence of 99%"):
        sel.calibrate(judged(60, sorted_), accuracy=0.93, confidence=0.99)
    with pytest.raises(AssayError, match="the best is"):
        sel.calibrate(judged(300, lambda k: (k * 31) % 97 < (k % 97) * 0.6 + 5), accuracy=0.99)
    few = sel.calibrate(judged(97, sorted_), accuracy=0.8).first()
    assert any("97 rows are few" in n for n in few.notes)
    # 34 rows reach the bar together, no half of them has thirty
    thin = sel.calibrate(judged(40, lambda k: k >= 6, lambda k: k / 40), accuracy=0.9).first()
    assert thin.splits == 0 and (thin.low, thin.high) == (0.0, 0.0) and any("no half" in n for n in thin.notes) and thin.accuracy >= 0.9
    inverted = sel.calibrate(
        judged(2000, lambda k: sorted_(k) if k % 9 else not sorted_(k), label=lambda k: "ab"[k % 9 == 0]), accuracy=0.8, min_signal=0.3
    ).first()
    assert any("labelled 'b'" in n for n in inverted.notes)
    kept = sel.calibrate(judged(2000, sorted_), keep=0.4).first()
    assert abs(kept.coverage - 0.4) < 0.05 and kept.splits == 20 and kept.headroom == 0
    bound = sel.calibrate(judged(2000, sorted_), accuracy=0.8, confidence=0.95).first()
    assert bound.headroom > 0

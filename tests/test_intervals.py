"""Intervals against draws made by hand."""

import hashlib

from assayfold.operators import experiments as ex
from assayfold.operators import reports


def resampled(units, draws, seed=1):
    """(low, high) by hand: every unit drawn a Poisson(1) number of times, by the hash of unit, draw and seed."""
    means = []
    for draw in range(draws):
        w = [sum(int(hashlib.md5(f"{unit}:{draw}:{seed}".encode()).hexdigest()[:8], 16) / 2**32 >= b for b in ex.poisson_table()[0]) for unit, _ in units]
        if sum(w):
            means.append(sum(n * value for n, (_, value) in zip(w, units)) / sum(w))
    means.sort()
    return means[int(len(means) * 0.025)], means[int(len(means) * 0.975)]


def test_bootstrap_draws_every_unit(spark):
    """Items of equal accuracy, more than the exact table has means for, are each drawn for themselves; one has no gold."""
    log = [(i, None if i == 70 else 1, int(i % 3 > 0 or c == 0)) for i in range(71) for c in range(2)]
    got = ex.bootstrap(spark.createDataFrame(log, "source long, gold int, label int"), draws=150).first()
    want = resampled([(i, 1.0 if i % 3 else 0.5) for i in range(70)], 150)
    assert abs(got.low - want[0]) < 1e-12 and abs(got.high - want[1]) < 1e-12


def test_paired_interval_draws_every_unit(spark):
    """Common items are drawn by their own hash; what only one arm has takes no part."""
    arm = lambda n, right: spark.createDataFrame([(i, 1, int(right(i) > 0)) for i in range(n)], "source long, gold int, label int")
    got = reports.paired_interval(arm(60, lambda i: i % 3), arm(50, lambda i: i % 4), draws=150).first()
    want = resampled([(i, float(i % 4 > 0) - float(i % 3 > 0)) for i in range(50)], 150)
    assert got.items == 50 and abs(got.low - want[0]) < 1e-12 and abs(got.high - want[1]) < 1e-12

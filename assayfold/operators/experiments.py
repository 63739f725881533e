"""Experiment analytics over judgement logs (source, pos, gold, label, certainty, position, packed, arm) and run logs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayfold.operators import order

#: Edges of the certainty bands (fixed values).
BANDS = (0.0, 0.5, 0.7, 0.8, 0.9, 0.95, 1.01)
#: Shares of the rows that are kept, most certain first (fixed values).
COVERAGES = (1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.3)


def right() -> F.Column:
    return (F.col("label") == F.col("gold")).cast("double")


def macro_accuracy(log: DataFrame, *by: str) -> DataFrame:
    """Accuracy with every item counting once, whatever its repeats; and the mean share of an item's commonest label."""
    votes = log.groupBy(*by, "source", "label").agg(F.count("*").alias("n"), F.sum(right()).alias("r"))
    items = votes.groupBy(*by, "source").agg((F.sum("r") / F.sum("n")).alias("acc"), (F.max("n") / F.sum("n").cast("double")).alias("mode"))
    return items.groupBy(*by).agg(F.count("*").alias("items"), F.avg("acc").alias("accuracy"), F.avg("mode").alias("steady"))


def votes(log: DataFrame) -> DataFrame:
    """Items of one mind against wavering ones, majority against the first ask (ties: the label seen first)."""
    n = log.groupBy("source", "gold", "label").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    items = n.groupBy("source", "gold").agg(
        F.max_by("label", F.struct("n", -F.col("first"))).alias("major"),
        F.min_by("label", "first").alias("one"),
        (F.count("*") == 1).alias("firm"),
        F.sum(F.when(F.col("label") == F.col("gold"), F.col("n")).otherwise(0)).alias("r"),
        F.sum("n").alias("n"),
    )
    acc = F.col("r") / F.col("n").cast("double")
    return items.agg(
        F.count("*").alias("items"),
        F.count_if("firm").alias("firm"),
        F.avg(F.when(F.col("firm"), acc)).alias("firm_accuracy"),
        F.avg(F.when(~F.col("firm"), acc)).alias("split_accuracy"),
        F.avg((F.col("major") == F.col("gold")).cast("double")).alias("majority"),
        F.avg((F.col("one") == F.col("gold")).cast("double")).alias("first_ask"),
    )


def reliability(log: DataFrame) -> DataFrame:
    """Bands of certainty: rows, mean certainty, accuracy, and accuracy less certainty (below zero: too sure)."""
    band = F.lit(None).cast("double")
    for low, high in zip(BANDS, BANDS[1:]):
        band = F.when((F.col("certainty") >= low) & (F.col("certainty") < high), F.lit(low)).otherwise(band)
    out = log.withColumn("band", band).where("band is not null").groupBy("band").agg(
        F.count("*").alias("n"), F.avg("certainty").alias("said"), F.avg(right()).alias("happened")
    )
    return out.withColumn("gap", F.col("happened") - F.col("said"))


def calibration_gap(log: DataFrame) -> DataFrame:
    """Weighted mean of the bands' absolute and signed gaps."""
    return reliability(log).agg(
        (F.sum(F.col("n") * F.abs("gap")) / F.sum("n")).alias("absolute"), (F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("signed")
    )


def prefixes(log: DataFrame, sizes: DataFrame) -> DataFrame:
    """(k, edge, accuracy) of the k most certain rows (ties by position) for each k of sizes, which are few.

    Running counts go over levels of certainty, and over the rows of those levels alone in which a k ends."""
    levels = log.groupBy("certainty").agg(F.count("*").alias("n"), F.sum(right()).alias("r"))
    levels = order.running(levels, "certainty", {"upto": F.col("n"), "r_upto": F.col("r")}, down=True, at=order.cuts(log, "certainty")).withColumns(
        {"above": F.col("upto") - F.col("n"), "r_above": F.col("r_upto") - F.col("r")}
    )
    ends = levels.join(F.broadcast(sizes), (F.col("above") < F.col("k")) & (F.col("k") <= F.col("upto"))).select("certainty", "k", "above", "r_above")
    inside = log.join(F.broadcast(ends.select("certainty").distinct()), "certainty", "left_semi").select("certainty", "pos", right().alias("r"))
    inside = order.running(inside, "pos", {"i": F.lit(1), "so_far": F.col("r")}, by=("certainty",))
    at = inside.join(F.broadcast(ends), "certainty").where(F.col("i") == F.col("k") - F.col("above"))
    return at.select("k", F.col("certainty").alias("edge"), ((F.col("r_above") + F.col("so_far")) / F.col("k")).alias("accuracy"))


def sizes_of(rows: DataFrame, coverages: tuple[float, ...]) -> DataFrame:
    """(coverage, k): how many of the rows each coverage keeps, one at least; none of an empty table."""
    total = rows.agg(F.count("*").alias("total")).where("total > 0")
    return total.select(F.explode(F.array(*map(F.lit, coverages))).alias("coverage"), "total").select(
        "coverage", F.greatest(F.lit(1), F.floor(F.col("total") * F.col("coverage"))).alias("k")
    )


def risk_coverage(log: DataFrame, coverages: tuple[float, ...] = COVERAGES) -> DataFrame:
    """Accuracy of the most certain rows at each coverage (ties by position), and the certainty of the last of them."""
    sizes = sizes_of(log, coverages)
    return sizes.join(prefixes(log, sizes.select("k").distinct()), "k").select("coverage", F.col("k").alias("kept"), "accuracy", "edge")


def position_bands(log: DataFrame, width: int = 8) -> DataFrame:
    """Accuracy by place in the request, packed rows only."""
    return log.where("packed > 1").groupBy(F.floor((F.col("position") - 1) / width).alias("band")).agg(
        F.count("*").alias("n"), F.avg(right()).alias("accuracy")
    )


def spread(bands: DataFrame, least: int = 1) -> DataFrame:
    """One row: bands of at least so many rows, and how far the best of them lies above the worst."""
    return bands.where(F.col("n") >= least).agg(F.count("*").alias("bands"), (F.max("accuracy") - F.min("accuracy")).alias("spread"))


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per-item accuracy of two arms: items, mean difference, share of items that moved."""
    acc = lambda x, name: x.groupBy("source").agg(F.avg(right()).alias(name))
    both = acc(a, "a").join(acc(b, "b"), "source")
    return both.agg(
        F.count("*").alias("items"),
        F.avg(F.col("b") - F.col("a")).alias("difference"),
        F.avg((F.col("a") != F.col("b")).cast("double")).alias("moved"),
    )


#: Up to this mean a Poisson count is drawn from its exact distribution, above it from a normal one with its skewness; lots
#: that the draws are dealt in; decimals to which values count as equal.
EXACT, LOTS, DECIMALS = 16, 64, 12


def poisson_table() -> list[list[float]]:
    """For each mean 1 to EXACT, the distribution function from 0 on, as far as 32 bits reach."""
    table = []
    for mean in range(1, EXACT + 1):
        term = below = math.exp(-mean)
        own, k = [below], 0
        while 1 - below > 2.0**-33:
            k += 1
            term *= mean / k
            below += term
            own.append(below)
        table.append(own)
    return table


def interval(values: DataFrame, draws: int = 2000, seed: int = 1) -> DataFrame:
    """95 % percentile interval of the mean of (unit, value) over resampled units; a unit without a value takes no part.

    Each unit is drawn a Poisson(1) number of times per draw, chosen by a hash of unit and draw. Units are dealt over the
    session's partitions before they are drawn, and a draw's sums combine before they travel."""
    own = values.where(F.col("value").isNotNull()).select("unit", "value")
    # not by the unit itself: where that is what they were grouped by, no exchange is made and few partitions are left
    own = own.repartition(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("unit"))
    drawn = own.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    text = F.concat_ws(":", F.col("unit").cast("string"), F.col("draw").cast("string"), F.lit(str(seed)))
    drawn = drawn.withColumn("u", F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32))
    times = sum(((F.col("u") >= below).cast("int") for below in poisson_table()[0]), F.lit(0))
    means = drawn.select("draw", "value", times.alias("w")).groupBy("draw").agg(
        F.try_divide(F.sum(F.col("w") * F.col("value")), F.sum("w")).alias("m")
    )
    return percentiles_of(means)


def percentiles_of(means: DataFrame) -> DataFrame:
    """(low, high): the 2.5th and 97.5th percentile of the draws' means (m), one number a draw."""
    found = means.agg(F.sort_array(F.collect_list("m")).alias("s"))
    place = lambda share: F.element_at("s", F.least(F.size("s"), F.floor(F.size("s") * share).cast("int") + 1))
    return found.where(F.size("s") > 0).select(place(0.025).alias("low"), place(0.975).alias("high"))


def pooled_interval(values: DataFrame, draws: int = 2000, seed: int = 1) -> DataFrame:
    """`interval` in short: m units of equal value are drawn a Poisson(m) number of times together, not each for itself.

    The work is different values times draws, whatever the units, and means over EXACT are drawn from a normal form. Values
    count as equal to DECIMALS decimals, and must lie within 9 million of 0."""
    spark = values.sparkSession
    at = F.round(F.col("value") * 10.0**DECIMALS).cast("long")
    kinds = values.where(F.col("value").isNotNull()).groupBy(at.alias("kind")).agg(F.count("*").alias("m"), F.avg("value").alias("value"))
    dealt = kinds.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(LOTS - 1)))).repartition(
        int(spark.conf.get("spark.sql.shuffle.partitions")), "kind", "lot"
    )
    drawn = dealt.where(F.col("lot") < draws).withColumn("draw", F.explode(F.sequence(F.col("lot"), F.lit(draws - 1), F.lit(LOTS))))
    drawn = drawn.withColumn("h", F.md5(F.concat_ws(":", F.col("kind").cast("string"), F.col("draw").cast("string"), F.lit(str(seed)))))
    number = lambda k: F.conv(F.substring("h", k, 8), 16, 10).cast("double") / float(1 << 32)
    drawn = drawn.withColumns({"u": number(1), "v": number(9)})
    table = spark.createDataFrame([(m + 1, own) for m, own in enumerate(poisson_table())], "m long, below array<double>")
    drawn = drawn.join(F.broadcast(table), "m", "left")  # EXACT rows
    z = F.sqrt(-2 * F.log(1 - F.col("u"))) * F.cos(2 * math.pi * F.col("v"))
    many = F.greatest(F.lit(0.0), F.round(F.col("m") + F.sqrt(F.col("m").cast("double")) * z + (z * z - 1) / 6))
    times = F.when(F.col("below").isNull(), many).otherwise(F.size(F.filter("below", lambda b: b <= F.col("u"))).cast("double"))
    means = drawn.select("draw", "value", times.alias("w")).groupBy("draw").agg(
        F.try_divide(F.sum(F.col("w") * F.col("value")), F.sum("w")).alias("m")
    )
    return percentiles_of(means)


def bootstrap(log: DataFrame, draws: int = 2000, seed: int = 1) -> DataFrame:
    """Interval of macro accuracy over resampled items."""
    return interval(log.groupBy(F.col("source").alias("unit")).agg(F.avg(right()).alias("value")), draws, seed)


def price(log: DataFrame, runs: DataFrame, cut: float) -> DataFrame:
    """Per arm: rows, share trusted at a cut, its accuracy, and dollars for a thousand trusted rows."""
    arms = log.groupBy("arm").agg(
        F.count("*").alias("n"),
        F.avg((F.col("certainty") >= cut).cast("double")).alias("kept"),
        F.avg(F.when(F.col("certainty") >= cut, right())).alias("accuracy"),
    )
    return arms.join(runs, "arm", "left").select(
        "arm", "n", "kept", "accuracy", F.when(F.col("kept") > 0, F.col("usd") / F.col("n") * 1000 / F.col("kept")).alias("usd_per_1000")
    )


COUNTERS = ("requests", "input_tokens", "retries", "pushback", "waited")


def rate_windows(samples: DataFrame, seconds: float, pack: int = 1) -> DataFrame:
    """Rates over the full windows of one run's counter samples (t in seconds, and COUNTERS, growing totals).

    Windows are anchored at the first sample: each edge is taken by the first sample at or behind it, one sample an edge,
    and a window lies between the samples of two edges; what follows the last edge is no window. The edge k belongs to
    sample max over j <= k of (first sample behind edge j) + k - j, so no sample waits for another. Few rows: one a
    sample of one run."""
    order = W.orderBy("t")
    rows = samples.select("t", *COUNTERS).withColumn("i", F.row_number().over(order) - 1).withColumn("t0", F.min("t").over(W.partitionBy()))
    passed = F.floor((F.col("t") - F.col("t0")) / seconds).cast("long")
    first = rows.withColumn("passed", passed).withColumn("last", F.lag("passed", 1, 0).over(order)).where("passed > last")
    edges = first.select(F.explode(F.sequence(F.col("last") + 1, F.col("passed"))).alias("k"), "i")
    taken = edges.select(
        F.col("k"), (F.max(F.col("i") - F.col("k")).over(W.orderBy("k").rowsBetween(W.unboundedPreceding, 0)) + F.col("k")).alias("i")
    )
    at = rows.join(taken, "i").select("k", "t", "t0", *COUNTERS).unionByName(
        rows.where("i = 0").select(F.lit(0).cast("long").alias("k"), "t", "t0", *COUNTERS)
    )
    before = lambda c: F.lag(c).over(W.orderBy("k"))
    grown = at.select(
        "k",
        (before("t") - F.col("t0")).alias("from"),
        (F.col("t") - before("t")).alias("seconds"),
        *((F.col(c) - before(c)).alias(c) for c in COUNTERS),
    ).where("seconds > 0")
    per = lambda c: F.col(c) / F.col("seconds")
    return grown.select(
        "from",
        "seconds",
        (per("requests") * 60).alias("requests_per_minute"),
        (per("requests") * pack).alias("items_per_second"),
        per("input_tokens").alias("tokens_per_second"),
        "retries",
        "pushback",
        "waited",
    )


def sustained(windows: DataFrame) -> DataFrame:
    """One row over a run's rate windows: the first is a burst, the rest are the rate; drift compares the rest's halves,
    where it has four windows or more. No row without windows."""
    rows = windows.withColumn("k", F.row_number().over(W.orderBy("from")) - 1).withColumn("rest", F.count("*").over(W.partitionBy()) - 1)
    half = F.floor(F.col("rest") / 2)
    rate = lambda where: F.avg(F.when(where, F.col("requests_per_minute")))
    later = F.col("k") > 0
    out = rows.agg(
        F.max("rest").alias("windows"),
        rate(~later).alias("burst"),
        rate(later).alias("held"),
        F.percentile(F.when(later, F.col("requests_per_minute")), 0.5).alias("middle"),
        F.min(F.when(later, F.col("requests_per_minute"))).alias("least"),
        F.max(F.when(later, F.col("requests_per_minute"))).alias("most"),
        F.avg(F.when(later, F.col("items_per_second"))).alias("items_per_second"),
        F.avg(F.when(later, F.col("tokens_per_second"))).alias("tokens_per_second"),
        rate(later & (F.col("k") <= half)).alias("early"),
        rate(F.col("k") > half).alias("late"),
    )
    return out.where("windows is not null").withColumn(
        "drift", F.when(F.col("windows") >= 4, F.try_divide(F.col("late") - F.col("early"), F.col("early")))
    )


def worst_window(events: DataFrame, seconds: int = 60) -> DataFrame:
    """Most events in any closed window of that width that ends at an event, and when the earliest such window's first
    event stands, in seconds from the first event of all. Rows are dealt by windows of time, each event to its own and
    the next, so no task sees more than two windows' width."""
    t, w = F.unix_micros(F.col("ts").cast("timestamp")), seconds * 1_000_000
    dealt = events.select(t.alias("t"), F.explode(F.array(F.floor(t / w), F.floor(t / w) + 1)).alias("part"))
    upto = W.partitionBy("part").orderBy("t").rangeBetween(-w, 0)
    per = dealt.withColumns({"n": F.count("*").over(upto), "start": F.min("t").over(upto)}).where(F.floor(F.col("t") / w) == F.col("part"))
    out = per.agg(
        F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.min_by("start", F.struct(-F.col("n"), "t")).alias("start"), F.min("t").alias("first")
    )
    return out.select("most", F.coalesce((F.col("start") - F.col("first")) / 1e6, F.lit(0.0)).alias("began"))


def percentiles(values: DataFrame, column: str) -> DataFrame:
    """n, mean, median, and two 95th percentiles by rank: p95 at position round(0.95 (n - 1)), halves to even, and tail
    at int(0.95 n), of the sorted values from 0. Exact, from counts of values; one row, null over nothing."""
    levels = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    levels = order.running(levels, "v", {"upto": F.col("n")}, totals={"total": F.col("n")}, at=order.cuts(values, column))
    at = lambda place: F.min(F.when(F.col("upto") > F.least(F.col("total") - 1, place), F.col("v")))
    return levels.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"),
        F.percentile("v", 0.5, F.col("n")).alias("median"),
        at(F.bround((F.col("total") - 1) * F.lit(0.95)).cast("long")).alias("p95"),
        at(F.floor(F.col("total") * F.lit(0.95))).alias("tail"),
    )

"""Comparisons over judgement logs: halves, annotators, held-out cuts, arms, baselines, and what a run has to say for itself.

A log has rows (source, pos, gold, label, certainty, position, packed, arm); every function is a few aggregates over it,
and windows go over levels of certainty, units or windows of a run, never over all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayfold.operators.experiments import COVERAGES, calibration_gap, interval, macro_accuracy, pooled_interval, prefixes, right, sizes_of, votes
from assayfold.operators.order import hash_limit

#: Edges of the distances from a level, and the distances of a settled score and of one astride (fixed values).
DISTANCES, SETTLED, ASTRIDE = (0.0, 0.05, 0.15, 0.3, 0.5001), 0.05, 0.3
#: Requests a minute of the ceiling; tokens of a request's state and characters of a token (fixed values).
CEILING, STATE_TOKENS, CHARS_PER_TOKEN = 1000, 28_000, 3.5
#: Failures that are listed, and latencies that are kept.
LISTED, LATEST = 1000, 10_000


def legacy_certainty() -> Column:
    """certainty, or where a log of old lacks it that of its p: the distance from the coin flip of a yes/no, p itself else."""
    return F.coalesce("certainty", F.when(F.col("kind") == "noul", F.greatest(F.col("p"), F.lit(1.0) - F.col("p"))).otherwise(F.col("p")))


def annotators(log: DataFrame) -> DataFrame:
    """One row: items and macro accuracy where annotators agreed (`agreed`) and where not (null counts as not), and the
    share of all disagreement that the latter carry. No row where `agreed` is null throughout."""
    items = log.groupBy("source").agg(
        F.avg(right()).alias("acc"), F.max(F.coalesce("agreed", F.lit(False))).alias("easy"), F.max(F.col("agreed").isNotNull()).alias("known")
    )
    easy, hard = F.col("easy"), ~F.col("easy")
    out = items.agg(
        F.max("known").alias("known"),
        F.count_if(easy).alias("easy_items"),
        F.avg(F.when(easy, F.col("acc"))).alias("easy_accuracy"),
        F.count_if(hard).alias("hard_items"),
        F.avg(F.when(hard, F.col("acc"))).alias("hard_accuracy"),
        F.try_divide(F.sum(F.when(hard, 1 - F.col("acc")).otherwise(0.0)), F.sum(1 - F.col("acc"))).alias("hard_share"),
    )
    return out.where("known").drop("known")


def request_halves(log: DataFrame) -> DataFrame:
    """Per arm: accuracy of the front and back half of packed requests, front less back, and rows. Arms that lack a half
    are left out."""
    front = F.col("position") <= F.col("packed") / 2
    out = log.where("packed > 1").groupBy("arm").agg(
        F.avg(F.when(front, right())).alias("front"), F.avg(F.when(~front, right())).alias("back"), F.count("*").alias("n")
    )
    return out.where("front is not null and back is not null").withColumn("gap", F.col("front") - F.col("back"))


def from_level(score: Column) -> Column:
    """How far a score lies from the nearest level, halves to even."""
    return F.abs(score - F.bround(score))


def scored(log: DataFrame, levels: tuple[str, ...]) -> DataFrame:
    """A score log (score, gold and more) with what it says: `said`, the level nearest to the score, halves to even, within the
    levels, whether that is `right`, and how far `between` two levels it lies. A row without a score has none of them."""
    names, place = F.array(*map(F.lit, levels)), F.greatest(F.lit(0), F.least(F.lit(len(levels) - 1), F.bround("score").cast("int")))
    said = F.when(F.col("score").isNotNull(), F.element_at(names, place + 1))
    return log.withColumn("said", said).withColumns({"right": F.col("said") == F.col("gold"), "between": from_level(F.col("score"))})


def distance_bands(scored: DataFrame) -> DataFrame:
    """Accuracy by distance from a level: band, n, accuracy. scored: score, label, gold; rows without a score are left out."""
    band = F.lit(None).cast("double")
    for low, high in zip(DISTANCES, DISTANCES[1:]):
        band = F.when((F.col("between") >= low) & (F.col("between") < high), F.lit(low)).otherwise(band)
    return scored.withColumn("between", from_level(F.col("score"))).withColumn("band", band).where("band is not null").groupBy("band").agg(
        F.count("*").alias("n"), F.avg(right()).alias("accuracy")
    )


def settled(scored: DataFrame) -> DataFrame:
    """One row: accuracy of scores on a level and of those between two; none where either is missing."""
    at = from_level(F.col("score"))
    out = scored.agg(F.avg(F.when(at < SETTLED, right())).alias("settled"), F.avg(F.when(at >= ASTRIDE, right())).alias("astride"))
    return out.where("settled is not null and astride is not null")


def halves(log: DataFrame, seed: int = 29) -> DataFrame:
    """log with `fit`: exactly n // 2 of its n items, those with the smallest hashes. Items are halved and not rows, so that
    repeats of an item stay together."""
    hashed = F.md5(F.concat_ws(":", F.col("source").cast("string"), F.lit(str(seed))))
    items = log.select(hashed.alias("_h")).distinct()
    limit = hash_limit(items, "_h", F.floor(F.col("count") / 2)).agg(F.max("limit").alias("_limit"))
    return log.crossJoin(F.broadcast(limit)).withColumn("fit", F.coalesce(hashed <= F.col("_limit"), F.lit(False))).drop("_limit")  # one row


def applied(test: DataFrame, cuts: DataFrame) -> DataFrame:
    """cuts (edge and what names it) with the share that each keeps of test's rows and their accuracy; none that keep nothing."""
    over = test.groupBy("certainty").agg(F.count("*").alias("n"), F.sum(right()).alias("r"))
    both = over.crossJoin(F.broadcast(cuts))  # levels by cuts, both few
    kept = F.col("certainty") >= F.col("edge")
    sums = both.groupBy(*cuts.columns).agg(
        F.sum(F.when(kept, F.col("n")).otherwise(0)).alias("k"),
        F.sum("n").alias("total"),
        F.sum(F.when(kept, F.col("r")).otherwise(0.0)).alias("right"),
    )
    return sums.where("k > 0").select(*cuts.columns, (F.col("k") / F.col("total")).alias("kept"), (F.col("right") / F.col("k")).alias("accuracy"))


def held_out(log: DataFrame, coverages: tuple[float, ...] = COVERAGES, seed: int = 29) -> DataFrame:
    """Per coverage: the certainty that cuts half of the items there, what it keeps of the other half, and how right."""
    rows = halves(log, seed)
    fit = rows.where("fit")
    sizes = sizes_of(fit, coverages)
    cuts = sizes.join(prefixes(fit, sizes.select("k").distinct()), "k").select("coverage", "edge")
    return applied(rows.where("not fit"), cuts)


def coverage_at(log: DataFrame, target: float, seed: int = 29) -> DataFrame:
    """One row (edge, kept, accuracy): the largest of 200 evenly spaced prefixes of one half of the items that reaches
    the target, applied to the other; 0, 0 where none does or nothing is kept. The edge may split equal certainties;
    `selective.cut_for_accuracy` never does."""
    rows = halves(log, seed)
    fit = rows.where("fit")
    total = fit.agg(F.count("*").alias("total")).where("total > 0")
    step = F.greatest(F.lit(1), F.floor(F.col("total") / 200))
    sizes = total.select(F.explode(F.sequence(F.col("total"), F.lit(1), -step)).alias("k"))
    best = prefixes(fit, sizes).where(F.col("accuracy") >= target).agg(F.max_by("edge", "k").alias("edge"))
    return best.join(applied(rows.where("not fit"), best.where("edge is not null")), "edge", "left").fillna(0.0, ["kept", "accuracy"])


def corpora(logs: dict[str, DataFrame], draws: int = 2000) -> DataFrame:
    """A row for each named log: items, accuracy with its interval, held-out accuracy at 90, 80 and 70 %, the signed
    gap, and accuracy of firm and of wavering items."""
    out = None
    for name, log in logs.items():
        items = log.groupBy(F.col("source").alias("unit")).agg(F.avg(right()).alias("value"))
        at = held_out(log).agg(*(F.max(F.when(F.col("coverage") == c, F.col("accuracy"))).alias(f"at_{round(100 * c)}") for c in (0.9, 0.8, 0.7)))
        row = macro_accuracy(log).select("items", "accuracy")
        for more in (
            pooled_interval(items, draws),
            at,
            calibration_gap(log).select(F.col("signed").alias("gap")),
            votes(log).select(F.col("firm_accuracy").alias("firm"), F.col("split_accuracy").alias("split")),
        ):
            row = row.crossJoin(F.broadcast(more))  # one row each
        row = row.select(F.lit(name).alias("corpus"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def paired_interval(a: DataFrame, b: DataFrame, margin: float = 0.02, draws: int = 2000, seed: int = 1) -> DataFrame:
    """One row: mean difference of two arms over their common items, its interval, and whether that lies inside the margin."""
    acc = lambda x, name: x.groupBy("source").agg(F.avg(right()).alias(name))
    both = acc(a, "a").join(acc(b, "b"), "source").select(F.col("source").alias("unit"), (F.col("b") - F.col("a")).alias("value"))
    mean = both.agg(F.count("*").alias("items"), F.avg("value").alias("difference"))
    # one row each
    return mean.crossJoin(F.broadcast(interval(both, draws, seed))).withColumn("within", (F.col("low") > -margin) & (F.col("high") < margin))


def against_baseline(run: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row over the items that both have (item, p): items, share on the same side of a half, mean shift of p."""
    both = run.select("item", "p").join(baseline.select("item", F.col("p").alias("was")), "item")
    return both.agg(
        F.count("*").alias("items"),
        F.avg(((F.col("p") >= 0.5) == (F.col("was") >= 0.5)).cast("double")).alias("same"),
        F.avg(F.abs(F.col("p") - F.col("was"))).alias("moved"),
    )


def ceilings(log: DataFrame, arms: DataFrame, cut: float) -> DataFrame:
    """Per arm, best first: items a second at the ceiling, share trusted at a cut, trusted items a second, dollars for a
    thousand trusted, and the pack that fits texts of the arm's mean length. arms: arm, pack, usd, mean_chars; an arm
    that it does not know counts as unpacked and free."""
    kept = log.groupBy("arm").agg(F.count("*").alias("n"), F.avg((F.col("certainty") >= cut).cast("double")).alias("kept"))
    out = kept.join(arms, "arm", "left").withColumn("items_per_second", F.coalesce("pack", F.lit(1)) * F.lit(float(CEILING)) / 60)
    out = out.withColumn("trusted_per_second", F.col("items_per_second") * F.col("kept"))
    usd = F.when(F.col("kept") > 0, F.coalesce("usd", F.lit(0.0)) / F.col("n") * 1000 / F.col("kept"))
    fits = F.floor(F.try_divide(F.lit(STATE_TOKENS * CHARS_PER_TOKEN), F.col("mean_chars")))
    return out.select("arm", "n", "kept", "items_per_second", "trusted_per_second", usd.alias("usd_per_1000"), fits.alias("pack_that_fits")).orderBy(
        F.desc("trusted_per_second"), "arm"
    )


def label_counts(log: DataFrame) -> DataFrame:
    """arm, label, n and mean certainty."""
    return log.groupBy("arm", "label").agg(F.count("*").alias("n"), F.avg("certainty").alias("certainty"))


def retries(tries: DataFrame) -> DataFrame:
    """One row: retries, seconds waited, and both as text by status, such as "2x429, 0.6s waiting"; status 0 is the
    transport. tries: status, waited; the text is empty without any."""
    counts = tries.groupBy("status").agg(F.count("*").alias("n"), F.sum("waited").alias("w"))
    out = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("retries"),
        F.coalesce(F.sum("w"), F.lit(0.0)).alias("waited"),
        F.array_sort(F.collect_list(F.struct("status", "n"))).alias("by"),
    )
    parts = F.transform(
        "by", lambda x: F.concat(x["n"].cast("string"), F.lit("x"), F.when(x["status"] == 0, "transport").otherwise(x["status"].cast("string")))
    )
    text = F.when(F.size("by") == 0, "").otherwise(F.concat(F.array_join(parts, ", "), F.format_string(", %.1fs waiting", F.col("waited"))))
    return out.select("retries", "waited", text.alias("why"))


def failures(answers: DataFrame, listed: int = LISTED) -> DataFrame:
    """The first failures by position with their reasons, and in each row how many there are in all."""
    failed = answers.where("error is not null")
    total = failed.agg(F.count("*").alias("failed"))
    return failed.orderBy("pos").limit(listed).select("pos", "error").crossJoin(F.broadcast(total))  # one row


def latest(latencies: DataFrame, kept: int = LATEST) -> DataFrame:
    """The last latencies of a run (at, ms)."""
    return latencies.orderBy(F.desc("at"), F.desc("ms")).limit(kept)


def percent(share: Column) -> Column:
    return F.format_string("%.1f%%", 100 * share)


def gain_text() -> Column:
    """A calibration's row as one line."""
    line = F.concat(
        F.lit("from "),
        F.format_string("%.3f", "cut"),
        F.lit(" on: "),
        percent(F.col("coverage")),
        F.lit(" kept, "),
        percent(F.col("accuracy")),
        F.lit(" right ("),
        percent(F.col("low")),
        F.lit(" to "),
        percent(F.col("high")),
    )
    return F.concat(
        line,
        F.lit("), "),
        F.format_string("%+.1f", 100 * F.col("gain")),
        F.lit(" points over "),
        percent(F.col("baseline")),
        F.format_string(" of %d rows", "items"),
    )


def blocked_text() -> Column:
    """A row of `selective.blocked` as one line."""
    crowd = F.concat(
        F.col("levels").cast("string"),
        F.lit(" levels, "),
        percent(F.col("share")),
        F.format_string(" of the rows at %.3f, ", "crowd"),
        percent(F.col("crowd_accuracy")),
        F.lit(" of them right"),
    )
    reach = F.when(F.col("reachable").isNull(), "").when(F.col("blocked"), "; no cut reaches the bar").otherwise(
        F.concat(F.lit("; the bar is reached on "), percent(F.col("reachable")))
    )
    return F.concat(crowd, reach)


def verdict_text() -> Column:
    """A row of `selective.routing` as one line."""
    area = F.when(F.col("auroc").isNull(), "none").otherwise(F.format_string("%.3f", "auroc"))
    return F.concat(
        F.col("label").cast("string"),
        F.format_string(": %d rows, ", "count"),
        percent(F.col("accuracy")),
        F.lit(" right, AUROC "),
        area,
        F.lit(", "),
        "action",
        F.lit(": "),
        "why",
    )

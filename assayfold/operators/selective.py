"""Which answers to trust: everything follows from a histogram of certainty, (rows, right ones) per level.

Answers are rows (pos, label, certainty, error); judged rows also carry `right` (boolean). The histogram is one hash
aggregate over the rows. Running sums go over its levels, which may be as many as rows: `order.running` cuts them into
pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayfold.errors import AssayError
from assayfold.functions.stats import auroc_bounds, wilson_lower, z_for
from assayfold.operators import order

#: Rows that a cut must keep; rows of a label that routing needs; AUROC below which a signal is too weak.
FLOOR, ENOUGH, SIGNAL = 30, 100, 0.60


def score(answers: DataFrame, gold: DataFrame) -> DataFrame:
    """Usable answers joined with gold by position; refuses tables that do not line up."""
    if answers.count() != gold.count():
        raise AssayError("answers and gold have to line up")
    return answers.where("error is null").join(gold, "pos").withColumn("right", F.col("label") == F.col("gold"))


def histogram(judged: DataFrame, *by: str) -> DataFrame:
    """(by, certainty, n, n_right, first_pos) of judged rows, or of a histogram of them by more than `by`: whatever takes
    judged rows takes their histogram too."""
    groups = judged.groupBy(*by, "certainty")
    if "n_right" in judged.columns:
        return groups.agg(F.sum("n").alias("n"), F.sum("n_right").alias("n_right"), F.min("first_pos").alias("first_pos"))
    return groups.agg(F.count("*").alias("n"), F.count_if("right").alias("n_right"), F.min("pos").alias("first_pos"))


def triage(answers: DataFrame, *, keep: float | None = None, at_least: float | None = None) -> DataFrame:
    """answers with `trusted`. keep: the int(n * keep) most certain usable rows, ties by position; at_least: from that
    certainty on. Failures are never trusted. For keep, the certainty and the position of the last row that is kept are
    found by counts, and the rest is a projection."""
    if (keep is None) == (at_least is None):
        raise AssayError("give exactly one of keep and at_least")
    usable, sure = F.col("error").isNull(), F.col("certainty")
    if at_least is not None:
        return answers.withColumn("trusted", usable & (sure >= at_least))
    if not 0 <= keep <= 1:
        raise AssayError("keep must lie between 0 and 1")
    rows = answers.where(usable)
    k = int(rows.count() * keep)
    last = order.kth(rows, "certainty", k, down=True)
    if last is None:
        return answers.withColumn("trusted", F.lit(False))
    level, above = last
    at, _ = order.kth(rows.where(sure == level), "pos", k - above)
    return answers.withColumn("trusted", F.coalesce(usable & ((sure > level) | ((sure == level) & (F.col("pos") <= at))), F.lit(False)))


def discrimination(judged: DataFrame, *by: str) -> DataFrame:
    """count, n_right, auroc (ties at mid rank; null without both kinds) and its interval, for each value of `by`."""
    levels = order.running(histogram(judged, *by), "certainty", {"upto": F.col("n")}, by=by, at=order.cuts(judged, "certainty"))
    levels = levels.withColumn("rank", F.col("upto") - F.col("n") + (F.col("n") + 1) / 2.0)
    sums = levels.groupBy(*by).agg(
        F.sum("n").alias("count"), F.sum("n_right").alias("n_right"), F.sum(F.col("n_right") * F.col("rank")).alias("ranks")
    )
    r, w = F.col("n_right").cast("double"), (F.col("count") - F.col("n_right")).cast("double")
    out = sums.withColumn("auroc", F.when((r > 0) & (w > 0), F.try_divide(F.col("ranks") - r * (r + 1) / 2, r * w)))
    low, high = auroc_bounds(F.col("auroc"), r, w)
    return out.select(
        *by,
        "count",
        "n_right",
        "auroc",
        F.when(F.col("auroc").isNotNull(), low).alias("low"),
        F.when(F.col("auroc").isNotNull(), high).alias("high"),
    )


def rungs(judged: DataFrame, *by: str, z: float = 0.0) -> DataFrame:
    """Every deployable cut: certainty, rows kept from it on, their accuracy and its lower bound; whole levels only."""
    out = order.running(
        histogram(judged, *by),
        "certainty",
        {"kept": F.col("n"), "kept_right": F.col("n_right")},
        by=by,
        down=True,
        totals={"total": F.col("n")},
        at=order.cuts(judged, "certainty"),
    )
    share = F.col("kept_right") / F.col("kept").cast("double")
    return out.where(F.col("kept") >= FLOOR).select(
        *by, "certainty", "kept", "total", share.alias("accuracy"), (wilson_lower(share, F.col("kept"), z) if z else share).alias("reached")
    )


def cut_for_accuracy(judged: DataFrame, accuracy: float, *by: str, confidence: float = 0.0) -> DataFrame:
    """The lowest cut whose rows reach the accuracy, with its coverage and accuracy; no row where none does."""
    if not 0 < accuracy <= 1:
        raise AssayError("accuracy must lie in (0, 1]")
    good = rungs(judged, *by, z=z_for(confidence)).where(F.col("reached") >= accuracy)
    at = F.min_by(F.struct("kept", "total", "accuracy"), "certainty")
    return good.groupBy(*by).agg(F.min("certainty").alias("cut"), at.alias("at")).select(
        *by, "cut", (F.col("at.kept") / F.col("at.total").cast("double")).alias("coverage"), F.col("at.accuracy").alias("accuracy")
    ).where("cut is not null")


def cut_for_keep(judged: DataFrame, keep: float) -> DataFrame:
    """The certainty of the last of the int(n * keep) most certain rows, at least one."""
    if not 0 < keep <= 1:
        raise AssayError("keep must lie in (0, 1]")
    n = judged.count()
    last = order.kth(judged, "certainty", min(n - 1, max(0, int(n * keep) - 1)) + 1, down=True)
    return judged.sparkSession.createDataFrame([(last and last[0],)], "cut double")


def resolution(judged: DataFrame, accuracy: float | None = None) -> DataFrame:
    """levels, the most crowded one (ties: first seen), its share and accuracy, and the coverage reachable at a bar."""
    levels = histogram(judged)
    top = F.max_by(F.struct("certainty", "n", "n_right"), F.struct("n", -F.col("first_pos")))
    out = levels.agg(F.count("*").alias("levels"), top.alias("t"), F.sum("n").alias("total"))
    out = out.select(
        "levels",
        F.col("t.certainty").alias("crowd"),
        (F.col("t.n") / F.col("total").cast("double")).alias("share"),
        (F.col("t.n_right") / F.col("t.n").cast("double")).alias("crowd_accuracy"),
    )
    if accuracy is None:
        return out.withColumn("reachable", F.lit(None).cast("double"))
    reach = rungs(judged).where(F.col("reached") >= accuracy).agg(
        F.coalesce(F.max(F.col("kept") / F.col("total").cast("double")), F.lit(0.0)).alias("reachable")
    )
    return out.crossJoin(F.broadcast(reach))  # one row each


def blocked(resolved: DataFrame) -> DataFrame:
    """`resolution` with `blocked`: whether a bar was asked for that no coverage reaches."""
    return resolved.withColumn("blocked", F.coalesce(F.col("reachable") <= 0, F.lit(False)))


def routing(judged: DataFrame, accuracy: float, confidence: float = 0.0) -> DataFrame:
    """What to do with each output label, the most frequent first: unknown, take, inverted, send or cut, and why."""
    if not 0 < accuracy < 1:
        raise AssayError("accuracy must lie strictly between 0 and 1")
    z = z_for(confidence)
    out = discrimination(judged, "label").withColumn("accuracy", F.col("n_right") / F.col("count").cast("double"))
    out = out.withColumn("floor", wilson_lower(F.col("accuracy"), F.col("count"), z) if z else F.col("accuracy"))
    out = out.join(cut_for_accuracy(judged, accuracy, "label", confidence=confidence).select("label", "cut", "coverage"), "label", "left")
    weak = F.col("auroc").isNull() | (F.col("low") <= 0.5) | (F.col("auroc") < SIGNAL)
    action: Column = F.when(F.col("count") < ENOUGH, "unknown").when(F.col("floor") >= accuracy, "take").when(F.col("high") < 0.5, "inverted").when(
        weak, "send"
    )
    action = action.when(F.col("cut").isNull() | (F.col("coverage") <= 0), "send").otherwise("cut")
    out = out.withColumn("action", action)
    is_ = lambda name: F.col("action") == name
    percent = lambda c: F.format_string("%.1f%%", 100 * c)
    why = F.when(is_("unknown"), F.format_string("only %d answers, fewer than routing needs", F.col("count")))
    why = why.when(is_("take"), F.concat(F.lit("right often enough without a cut: "), percent(F.col("floor"))))
    why = why.when(is_("inverted"), F.format_string("surer answers are wrong more often, AUROC at most %.3f: never cut here", F.col("high")))
    why = why.when(is_("send") & weak, F.lit("its certainty says nothing about being right")).when(
        is_("send"), F.lit("no cut reaches the accuracy asked for")
    )
    why = why.otherwise(F.concat(F.format_string("from %.3f on, ", F.col("cut")), percent(F.col("coverage")), F.lit(" of its answers")))
    held = lambda c: F.when(is_("cut"), F.col(c)).alias(c)
    return out.select(
        "label", "count", "accuracy", "floor", "auroc", "low", "high", held("cut"), held("coverage"), "action", why.alias("why")
    ).orderBy(F.desc("count"), "label")


#: Share of the rows from which a level is crowded.
CROWDED = 0.20


def crowding(judged: DataFrame, accuracy: float) -> DataFrame:
    """The crowded level that keeps a bar out of reach: levels, crowd, share and the accuracy of all rows from it on. No
    row where the most crowded level (ties: first seen) holds under CROWDED of the rows, or its block passes the bar."""
    levels = histogram(judged)
    top = levels.agg(
        F.count("*").alias("levels"), F.max_by(F.struct("certainty", "n"), F.struct("n", -F.col("first_pos"))).alias("t"), F.sum("n").alias("total")
    )
    block = levels.crossJoin(F.broadcast(top)).where(F.col("certainty") >= F.col("t.certainty"))  # top is one row
    out = block.groupBy("levels", F.col("t.certainty").alias("crowd"), (F.col("t.n") / F.col("total").cast("double")).alias("share")).agg(
        (F.sum("n_right") / F.sum("n").cast("double")).alias("crowd_accuracy")
    )
    return out.where((F.col("share") >= CROWDED) & (F.col("crowd_accuracy") < accuracy))


def headroom(judged: DataFrame, accuracy: float, confidence: float) -> DataFrame:
    """What a confidence costs: coverage of the cut by the plain estimate and of that by the bound, and their difference."""
    plain = cut_for_accuracy(judged, accuracy).agg(F.coalesce(F.max("coverage"), F.lit(0.0)).alias("plain"))
    bound = cut_for_accuracy(judged, accuracy, confidence=confidence).agg(F.coalesce(F.max("coverage"), F.lit(0.0)).alias("bound"))
    return plain.crossJoin(F.broadcast(bound)).withColumn("headroom", F.col("plain") - F.col("bound"))  # one row each


#: Rows under which a calibration is thin; half splits; the share of held-out scores left out at either end, from TRIMMED
#: scores on; spread of the labels' AUROC, and coverage, that are worth a note (fixed values).
FEW, SPLITS, TAILS, TRIMMED, SPREAD, LITTLE = 200, 20, 0.05, 20, 0.25, 0.25
#: The columns of a calibration.
CALIBRATION = "cut double, coverage double, accuracy double, low double, high double, baseline double, items long, splits long, discrimination double, headroom double, gain double, notes array<string>"


def split_halves(judged: DataFrame, splits: int = SPLITS, seed: int = 7) -> DataFrame:
    """judged `splits` times, with `split` and `fit`: exactly n // 2 rows of each, those with the smallest hashes."""
    halves = judged.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(max(1, splits) - 1))))
    halves = halves.withColumn("_h", F.md5(F.concat_ws(":", F.col("pos").cast("string"), F.col("split").cast("string"), F.lit(str(seed)))))
    limits = order.hash_limit(halves.select("split", "_h"), "_h", F.floor(F.col("count") / 2), "split")
    return halves.join(F.broadcast(limits), "split").withColumn("fit", F.col("_h") <= F.col("limit")).drop("_h", "limit")  # a row a split


def held_out_scores(
    judged: DataFrame, *, keep: float | None = None, accuracy: float | None = None, z: float = 0.0, splits: int = SPLITS, seed: int = 7
) -> DataFrame:
    """(split, coverage, accuracy): the cut that one half finds, on the other half. Splits whose half finds none, or whose cut keeps
    nothing of the other half, are left out."""
    levels = histogram(split_halves(judged.select("pos", "certainty", "right"), splits, seed), "split", "fit")
    at = order.cuts(judged, "certainty")  # of the rows, so that the halves are made once
    fit = order.running(
        levels.where("fit"),
        "certainty",
        {"kept": F.col("n"), "kept_right": F.col("n_right")},
        by=("split",),
        down=True,
        totals={"total": F.col("n")},
        at=at,
    )
    if keep is not None:
        good, pick = F.col("kept") >= F.greatest(F.floor(F.col("total") * F.lit(float(keep))), F.lit(1)), F.max("certainty")
    else:
        share = F.col("kept_right") / F.col("kept").cast("double")
        good, pick = (F.col("kept") >= FLOOR) & ((wilson_lower(share, F.col("kept"), z) if z else share) >= accuracy), F.min("certainty")
    cuts = fit.where(good).groupBy("split").agg(pick.alias("cut"))
    over = F.col("certainty") >= F.col("cut")
    rest = levels.where("not fit").join(F.broadcast(cuts), "split").groupBy("split")  # a row a split
    kept, right = F.sum(F.when(over, F.col("n"))), F.sum(F.when(over, F.col("n_right")))
    return rest.agg((F.coalesce(kept, F.lit(0)) / F.sum("n")).alias("coverage"), F.try_divide(right, kept).alias("accuracy")).where("coverage > 0")


def _refusal(judged: DataFrame, accuracy: float, confidence: float, items: int) -> str:
    """Why no cut reaches the accuracy: a crowded level, too few rows for the bound, or the judge."""
    best = rungs(judged, z=z_for(confidence)).agg(F.max("reached")).first()[0] or 0.0
    crowd = crowding(judged, accuracy).first()
    if crowd:
        return f"no cut reaches {accuracy:.0%}: {crowd.share:.0%} of the rows share the certainty {crowd.crowd:.3f}, one of {crowd.levels}, and from it on {crowd.crowd_accuracy:.1%} are right; more rows will not help, asking each item several times may"
    if z_for(confidence):
        return f"no cut reaches {accuracy:.0%} with a confidence of {confidence:.0%}: the best bound is {best:.1%} over {items} rows; more rows, less confidence or a lower bar may help"
    return f"no cut reaches {accuracy:.0%}: the best is {best:.1%} of at least {FLOOR} rows"


def calibrate(
    answers: DataFrame,
    *,
    keep: float | None = None,
    accuracy: float | None = None,
    confidence: float = 0.0,
    splits: int = SPLITS,
    seed: int = 7,
    min_signal: float = SIGNAL,
) -> DataFrame:
    """One row (CALIBRATION): the cut that all rows find, and what to expect of it: medians over half splits, refit on one half and
    measured on the other, their low and high ends (the middle 90 % from 40 scores on, least and most below), baseline,
    items, splits with a score, AUROC, headroom of a confidence, gain over the baseline, and notes.

    answers: judged rows, or answers with `gold`, whose failures are left out and noted. Where no split has a score the
    figures are those of all rows, and a note says so. Refuses under 30 usable rows, a signal under min_signal, and an
    accuracy that no cut reaches, with the reason. Extra columns are ignored."""
    if (keep is None) == (accuracy is None):
        raise AssayError("give exactly one of keep and accuracy")
    if not 0 < (keep or accuracy or 0) <= 1 or accuracy == 1:
        raise AssayError("keep must lie in (0, 1], accuracy strictly between 0 and 1")
    if confidence and accuracy is None:
        raise AssayError("confidence goes with accuracy")
    z_for(confidence)
    judged, skipped = answers, 0
    if "error" in answers.columns:
        judged, skipped = answers.where("error is null"), answers.where("error is not null").count()
    if "right" not in answers.columns:
        judged = judged.withColumn("right", F.col("label") == F.col("gold"))
    if "label" not in judged.columns:
        judged = judged.withColumn("label", F.lit(""))
    levels = histogram(judged, "label").persist()  # what follows, but for the halves, is read from it
    try:
        return _calibrated(judged, levels, skipped, keep, accuracy, confidence, splits, seed, min_signal)
    finally:
        levels.unpersist()


def _calibrated(
    judged: DataFrame,
    levels: DataFrame,
    skipped: int,
    keep: float | None,
    accuracy: float | None,
    confidence: float,
    splits: int,
    seed: int,
    min_signal: float,
) -> DataFrame:
    z, base = z_for(confidence), discrimination(levels).first()
    if base is None or base["count"] < FLOOR:
        raise AssayError(f"too few usable answers to calibrate on: {base['count'] if base else 0}, fewer than {FLOOR}")
    items, baseline = base["count"], base.n_right / base["count"]
    if base.auroc is None or base.auroc < min_signal:
        found = "undefined" if base.auroc is None else f"{base.auroc:.3f}"
        raise AssayError(
            f"certainty does not tell right answers from wrong ones here: AUROC {found}, under {min_signal:.2f}, with {baseline:.1%} right"
        )
    row = (cut_for_keep(judged, keep) if keep is not None else cut_for_accuracy(levels, accuracy, confidence=confidence)).first()
    if row is None or row.cut is None:
        raise AssayError(_refusal(levels, accuracy, confidence, items))
    over = F.col("certainty") >= row.cut
    kept, right = F.sum(F.when(over, F.col("n"))), F.sum(F.when(over, F.col("n_right")))
    own = levels.agg((kept / F.sum("n")).alias("coverage"), F.try_divide(right, kept).alias("accuracy")).first()
    spare = max(0.0, headroom(levels, accuracy, confidence).first().headroom) if z else 0.0
    scores = held_out_scores(judged, keep=keep, accuracy=accuracy, z=z, splits=splits, seed=seed)
    place = F.greatest(F.lit(0), F.floor(F.size("all") * TAILS).cast("int") - 1)
    edge = F.when(F.size("all") >= TRIMMED, place).otherwise(0)
    held = scores.agg(
        F.percentile("coverage", 0.5).alias("coverage"),
        F.percentile("accuracy", 0.5).alias("accuracy"),
        F.sort_array(F.collect_list("accuracy")).alias("all"),
    )
    held = held.select(
        "coverage",
        "accuracy",
        F.size("all").alias("splits"),
        F.try_element_at("all", edge + 1).alias("low"),
        F.try_element_at("all", F.greatest(F.size("all") - edge, F.lit(1))).alias("high"),
    ).first()
    notes = [f"{skipped} answers were not usable and are left out; triage sends them to review"] if skipped else []
    notes += [f"{items} rows are few; from {FEW} on the interval is narrower"] if items < FEW else []
    if not held.splits:
        notes.append("no half of the rows finds this cut, so nothing says what it does on rows it has not seen")
        coverage, right, low, high = own.coverage, own.accuracy, 0.0, 0.0
    else:
        coverage, right, low, high = held.coverage, held.accuracy, held.low, held.high
        notes += _notes(levels, accuracy, confidence, baseline, coverage, right)
    values = (row.cut, coverage, right, low, high, baseline, items, held.splits, base.auroc, spare, right - baseline, notes)
    return judged.sparkSession.createDataFrame([values], CALIBRATION)


def _notes(judged: DataFrame, accuracy: float | None, confidence: float, baseline: float, coverage: float, right: float) -> list[str]:
    """What a reader of a calibration should know besides its figures."""
    notes, level = [], resolution(judged).first()
    if level.share >= CROWDED:
        notes.append(
            f"{level.share:.0%} of the rows share the certainty {level.crowd:.3f}, {level.crowd_accuracy:.1%} of them right, so a cut keeps all of "
            f"them or none; there are {level.levels} levels to cut at"
        )
    if accuracy is None:
        return notes
    if baseline >= accuracy:
        notes.append(f"{baseline:.1%} are right without any cut, so none may be needed")
    ways = routing(judged, accuracy, confidence).select("label", "count", "auroc", "action").collect()  # a row a label
    known = [w.auroc for w in ways if w.auroc is not None]
    inverted = [w for w in ways if w.action == "inverted"]
    if inverted:
        worst = max(inverted, key=lambda w: w["count"])
        notes.append(
            f"surer answers are wrong more often among the {worst['count'] / sum(w['count'] for w in ways):.0%} labelled {worst.label!r}, AUROC "
            f"{worst.auroc:.3f}; see routing"
        )
    elif len(ways) > 1 and known and max(known) - min(known) >= SPREAD:
        notes.append("certainty says much more within some labels than within others; see routing")
    if right < accuracy:
        notes.append(f"rows that the cut has not seen are right in {right:.1%} of cases, not in the {accuracy:.1%} asked for; plan with that")
    if coverage < LITTLE:
        notes.append(f"the bar leaves only {coverage:.0%} of the rows, the rest goes to review")
    return notes

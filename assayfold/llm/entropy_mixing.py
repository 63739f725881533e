"""Mixing sources to target weights by entropy balancing.

Rates of documents minimise the relative entropy to taking each once, under one constraint a source: its rated words sum
to its target, and under a most of copies. The solution tilts documents exponentially by size, rate = exp(lambda_source *
size), stopped at the most; the dual is convex in lambda, and Newton's steps need the sums of size * rate and size^2 *
rate over all documents of a source. They run as distributed aggregates, one a step; documents of equal source and size
have equal rates, so counts by (source, size) carry all that the sums need.

Rates become whole copies by systematic rounding in the order of size, so that a source misses its target by half its
longest document at most, and a few exchanges of whole copies close most of that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, Kept

#: Weights of sources in turn; most copies; rounds of exchanges; parts into which rows of one source and size are dealt.
WEIGHTS, MOST, EXCHANGES, SALTS = (5, 2, 1), 3, 8, 1024
#: Newton steps at most, and the share of the target by which rated words may miss it.
STEPS, CLOSE = 80, 1e-7


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, weight, target) of each source. sizes: source, source_size (one row a source).

    Sources by code point, null last, weigh `weights` in turn and share the sum of all sizes; a target stops at `most`
    times its source's size, and the excess is shared again by weight among the others. Sorted by size per weight, the
    sources that stop are the first ones, so one pass of running sums finds the level of the others.
    """
    turn = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")).cast("double")
    out = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    everything = W.partitionBy()
    before = order.rowsBetween(W.unboundedPreceding, -1)
    level = F.try_divide(
        F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    )
    out = out.withColumn("_level", level)
    # the first source in this order that does not stop sets the level for itself and all after it
    open_ = F.first(F.when(F.col("_level") * F.col("weight") <= F.col("cap"), F.col("_level")), ignorenulls=True).over(
        order.rowsBetween(W.unboundedPreceding, 0)
    )
    return out.select("source", "source_size", "weight", F.coalesce(open_ * F.col("weight"), F.col("cap")).alias("target"))


def rate_of(size: Column, mean: Column, lam: Column, most: int) -> Column:
    """The tilt of a document: exp(lambda * size / mean), `most` at most; a null lambda means `most`."""
    tilted = F.exp(F.least(lam * F.coalesce(F.try_divide(size, mean), F.lit(0.0)), F.lit(50.0)))
    return F.when(lam.isNull(), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), tilted))


def newton(cells: DataFrame, wanted: DataFrame, kept: Kept, most: int = MOST, steps: int = STEPS) -> DataFrame:
    """wanted with lambda (`lam`) of every source. cells: key, size, n; wanted: key, source_size, target, mean, one row a source.

    Each step aggregates the dual's gradient and curvature over the cells of sources that are not yet close. It
    is taken on the logarithm of the rated words, which is nearly linear in lambda; a step that would leave the bracket
    of known signs is a bisection of it, or a doubling while one side is open. Sources whose target is the most of all
    their words have no finite lambda (null); those without words keep 0. Not converging is an error."""
    full = F.col("target") >= F.col("source_size") * most * (1 - 1e-12)
    empty = F.col("source_size") == 0
    none = F.lit(None).cast("double")
    state = wanted.withColumns({"lam": F.when(full & ~empty, none).otherwise(0.0), "low": none, "high": none, "done": full | empty})
    state = kept.put(state, "lambdas")
    for _ in range(steps):
        if state.where("not done").isEmpty():
            return state.drop("low", "high", "done")
        z, rate = F.try_divide("size", "mean"), rate_of(F.col("size"), F.col("mean"), F.col("lam"), most)
        # merged, not broadcast: a broadcast table takes pages of memory on every executor, and there are two a step
        at = cells.join(state.where("not done").select("key", "mean", "lam").hint("merge"), "key").select("key", "n", z.alias("z"), rate.alias("r"))
        bends = F.when(F.col("r") < most, F.col("r")).otherwise(0.0)
        sums = at.groupBy("key").agg(
            F.sum(F.col("n") * F.col("z") * F.col("r")).alias("f"), F.sum(F.col("n") * F.col("z") * F.col("z") * bends).alias("d")
        )
        now = state.join(sums.hint("merge"), "key", "left").withColumn("t", F.try_divide("target", "mean"))
        now = now.withColumns(
            {
                "low": F.when(F.col("f") < F.col("t"), F.col("lam")).otherwise(F.col("low")),
                "high": F.when(F.col("f") >= F.col("t"), F.col("lam")).otherwise(F.col("high")),
            }
        )
        step = F.col("lam") - F.try_divide(F.col("f") * (F.log("f") - F.log("t")), F.col("d"))
        inside = F.coalesce(
            (step > F.coalesce("low", F.lit(float("-inf")))) & (step < F.coalesce("high", F.lit(float("inf")))) & (F.abs(step) < 1e12), F.lit(False)
        )
        wider = F.when(F.col("high").isNull(), F.greatest(F.col("lam") * 2, F.col("lam") + 1)).when(
            F.col("low").isNull(), F.least(F.col("lam") * 2, F.col("lam") - 1)
        ).otherwise((F.col("low") + F.col("high")) / 2)
        close = F.abs(F.col("f") - F.col("t")) <= F.col("t") * CLOSE
        now = now.withColumn("lam", F.when(F.col("done") | close, F.col("lam")).when(inside, step).otherwise(wider)).withColumn(
            "done", F.col("done") | F.coalesce(close, F.lit(False))
        )
        state = kept.put(now.select(state.columns), "lambdas")
        kept.drop("lambdas", 1)
    raise RuntimeError(f"Newton's steps did not converge in {steps}")


def rounded(cells: DataFrame, kept: Kept, most: int = MOST, exchanges: int = EXCHANGES) -> DataFrame:
    """cells (key, size, n, rate, target) with `copies`, those that the n rows of a cell have together.

    Within a source the fractions of the rates are summed in the order of size, and a cell gets what the rounded sum
    grows by. Then each exchange adds or takes away, in one cell a source, as many copies as bring the source nearest to
    its target."""
    order = W.partitionBy("key").orderBy("size")
    part = F.col("n") * (F.col("rate") - F.floor("rate"))
    upto = F.sum(part).over(order.rowsBetween(W.unboundedPreceding, 0))
    extra = F.least(F.col("n"), F.floor(F.col("_upto") + 0.5) - F.floor(F.col("_upto") - F.col("_part") + 0.5))
    out = cells.withColumns({"_upto": upto, "_part": part}).withColumn("copies", (F.col("n") * F.floor("rate") + extra).cast("long")).drop(
        "_upto", "_part"
    )
    out = kept.put(out, "rounded")
    for _ in range(exchanges):
        gap = out.groupBy("key").agg(F.round(F.max("target") - F.sum(F.col("size") * F.col("copies"))).cast("long").alias("gap"))
        seen = out.join(gap.hint("merge"), "key").where("size > 0 and gap <> 0")
        free = F.when(F.col("gap") < 0, F.col("copies")).otherwise(F.col("n") * most - F.col("copies"))
        moved = F.least(free, F.greatest(F.lit(1), F.floor(F.abs("gap") / F.col("size"))))
        seen = seen.withColumn("moved", moved).withColumn("left", F.abs(F.abs("gap") - F.col("moved") * F.col("size"))).where(
            F.col("moved") > 0
        ).where(F.col("left") < F.abs("gap"))
        best = seen.groupBy("key").agg(
            F.min_by(F.struct("size", (F.signum("gap") * F.col("moved")).cast("long").alias("by")), F.struct("left", "size")).alias("b")
        )
        best = kept.put(best.select("key", "b.size", "b.by"), "best")
        if best.isEmpty():
            break
        out = kept.put(
            out.join(best.hint("merge"), ["key", "size"], "left").withColumn("copies", F.col("copies") + F.coalesce("by", F.lit(0))).drop("by"),
            "rounded",
        )
        kept.drop("rounded", 1)
    return out


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, rate, copies, taken (= copies * size), row_hash.

    A null source is a source. Null, empty and blank texts have size 0, so rate 1: they are taken once and count nothing.
    Repeated rows and equal or null ids count each for themselves; extra columns are ignored; an empty table gives no
    rows. Reruns agree: which rows of a source and size are taken once more goes by a hash of the row, never by arrival.
    Only doc_id, source, size and that hash are shuffled. Windows hold one row a source, or one a size of a source.
    """
    kept = Kept(docs.sparkSession, "mix")
    key = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("+"), F.col("source")))
    rows = kept.put(docs.select("doc_id", "source", key.alias("key"), size_of(F.col("text")).alias("size"), row_hash().alias("row_hash")), "rows")
    salted = rows.withColumn("salt", F.pmod("row_hash", F.lit(SALTS)).cast("int"))
    parts = kept.put(salted.groupBy("source", "key", "size", "salt").agg(F.count("*").alias("n")), "parts")
    cells = kept.put(parts.groupBy("source", "key", "size").agg(F.sum("n").alias("n")), "cells")
    sizes = cells.groupBy("source", "key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("rows"))
    wanted = targets(sizes.select("source", "source_size"), weights, most).withColumn("key", key).join(sizes.select("key", "rows"), "key")
    wanted = wanted.select("key", "source_size", "target", (F.col("source_size") / F.col("rows")).alias("mean"))
    tilt = newton(cells.select("key", "size", "n"), wanted, kept, most)
    rated = cells.select("key", "size", "n").join(tilt, "key").select(
        "key", "size", "n", "source_size", "target", rate_of(F.col("size"), F.col("mean"), F.col("lam"), most).alias("rate")
    )
    taken = rounded(rated, kept, most)
    kept.drop_but("rows", "parts", "rounded")
    # a cell's rows share its copies evenly; what is left over goes to the first by (salt, hash)
    before = F.coalesce(F.sum("n").over(W.partitionBy("key", "size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("key", "size", "salt", before.alias("_before")).join(
        taken.withColumnsRenamed({"copies": "_all", "n": "_n"}), ["key", "size"]
    )
    ranked = salted.withColumn("_inside", F.row_number().over(W.partitionBy("key", "size", "salt").orderBy("row_hash", "doc_id")))
    out = ranked.join(parts, ["key", "size", "salt"])
    copies = (F.floor(F.col("_all") / F.col("_n")) + F.when(F.col("_before") + F.col("_inside") <= F.col("_all") % F.col("_n"), 1).otherwise(0)).cast(
        "long"
    )
    return out.select(
        "doc_id", "source", "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "row_hash"
    )


def row_hash() -> Column:
    """What tells a row from others: rows of equal id, source and text are interchangeable here."""
    return F.xxhash64("doc_id", "source", "text")

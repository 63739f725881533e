"""Order over tables of any size: running sums and k-th values without a task that holds them all.

A column is cut into pieces of about SHARE rows by its own quantiles. Sums run within pieces, which are windows of bounded
size; the pieces' totals, a few thousand rows, run over the pieces and are joined back. Quantiles only say how even the
pieces are: results are exact whatever they are. A table of no more than SHARE rows is one piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a piece; pieces at most.
SHARE, PIECES = 250_000, 1024
#: The quantiles in between, written as SQL: as columns they would be made one call at a time.
_QUANTILES = f"array({', '.join(f'{k / PIECES!r}D' for k in range(1, PIECES))})"


def cuts(rows: DataFrame, column: str, share: int = SHARE) -> list[float]:
    """Values that cut a numeric column into pieces of about `share` rows; none for fewer. One pass over the column."""
    n, at = rows.select(F.col(column).alias("v")).agg(F.count("*"), F.expr(f"percentile_approx(v, {_QUANTILES}, {4 * PIECES})")).first()
    if n <= share or not at:
        return []
    every = max(1, PIECES * share // n)
    return sorted(set(at[every - 1 :: every]))


def piece(column: Column, at: list[float]) -> Column:
    """How many of the cuts a value reaches; -1 for null. A search by halves, so that many cuts stay cheap."""

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(column < at[middle], among(low, middle)).otherwise(among(middle + 1, high))

    return F.when(column.isNull(), -1).otherwise(among(0, len(at)))


def running(
    rows: DataFrame,
    order: str,
    sums: dict[str, Column],
    *,
    by: tuple[str, ...] = (),
    then: tuple[str, ...] = (),
    down: bool = False,
    totals: dict[str, Column] | None = None,
    share: int = SHARE,
    at: list[float] | None = None,
) -> DataFrame:
    """rows with sums that run along a numeric column within each value of `by`, equal values included; with `then`, that
    breaks ties, one row at a time. totals are sums over all of a group. Nulls come first, or last where the order runs down. at:
    cuts of the column that are known already."""
    totals, at = totals or {}, cuts(rows, order, share) if at is None else at
    along = [F.desc(order) if down else F.col(order), *then]
    frame = lambda w: w.orderBy(*along).rowsBetween(W.unboundedPreceding, 0) if then else w.orderBy(*along)
    if not at:
        return rows.withColumns(
            {k: F.sum(x).over(frame(W.partitionBy(*by))) for k, x in sums.items()} | {k: F.sum(x).over(W.partitionBy(*by)) for k, x in totals.items()}
        )
    cut = rows.withColumn("_piece", piece(F.col(order), at))
    local = cut.withColumns({k: F.sum(x).over(frame(W.partitionBy(*by, "_piece"))) for k, x in sums.items()})
    pieces = cut.groupBy(*by, "_piece").agg(*(F.sum(x).alias(f"_{k}") for k, x in (sums | totals).items()))  # PIECES rows a group at most
    before = W.partitionBy(*by).orderBy(F.desc("_piece") if down else F.col("_piece")).rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.select(
        *(F.col(c).alias(f"_{c}_") for c in by),
        F.col("_piece").alias("_piece_"),
        *(F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in sums),
        *(F.sum(f"_{k}").over(W.partitionBy(*by)).alias(f"_{k}") for k in totals),
    )
    on = F.col("_piece") == F.col("_piece_")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}_"))
    out = local.join(pieces, on)
    return out.select(*rows.columns, *((F.col(k) + F.col(f"_{k}")).alias(k) for k in sums), *(F.col(f"_{k}").alias(k) for k in totals))


def kth(rows: DataFrame, column: str, k: int, *, down: bool = False, share: int = SHARE) -> tuple[float, int] | None:
    """(value, rows before it) of the k-th value, from 1, of a numeric column without nulls; None where there is none.

    Counts by range say which range holds it, and that range is cut again, until it has no more than `share` rows or one
    value. Every round is one pass that sends back one count a range."""
    left, passed = rows.select(F.col(column).alias("v")).where(F.col("v").isNotNull()), 0
    while True:
        at = cuts(left, "v", share)
        if not at:
            break
        counts = dict(left.groupBy(piece(F.col("v"), at).alias("p")).count().collect())  # PIECES rows at most
        own = None
        for p in sorted(counts, reverse=down):
            if passed + counts[p] >= k:
                own = p
                break
            passed += counts[p]
        if own is None:
            return None
        if own > 0:
            left = left.where(F.col("v") >= at[own - 1])
        if own < len(at):
            left = left.where(F.col("v") < at[own])
        # a crowded value is a piece's first: where the k-th is that value, it is found
        edge = left.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n")).first()
        if edge.low == edge.high or edge.n == sum(counts.values()):
            break
    levels = left.groupBy("v").agg(F.count("*").alias("n"))
    levels = levels.withColumn("upto", F.sum("n").over(W.orderBy(F.desc("v") if down else F.col("v"))))  # share levels at most
    found = levels.where(F.col("upto") + passed >= k).agg(F.min_by(F.struct("v", "n", "upto"), "upto").alias("x")).first().x
    return None if found is None or k < 1 else (found.v, passed + found.upto - found.n)


def hash_limit(items: DataFrame, hashed: str, keep: Column, *by: str) -> DataFrame:
    """(by, limit): the largest of the hashes (hex texts, all different) that a choice of `keep` of `count` smallest ones takes, null
    where it takes none.

    Two passes: counts by the hashes' first digits say where the limit lies, and only what lies there is sorted."""
    first = F.substring(hashed, 1, 4)
    n = items.groupBy(*by, first.alias("_first")).agg(F.count("*").alias("_n"))
    upto = W.partitionBy(*by).orderBy("_first")  # 65,536 rows a group at most
    n = n.withColumns({"_upto": F.sum("_n").over(upto), "count": F.sum("_n").over(W.partitionBy(*by))}).withColumn("_keep", keep)
    edge = n.where((F.col("_upto") >= F.col("_keep")) & (F.col("_upto") - F.col("_n") < F.col("_keep"))).select(
        *by, "_first", (F.col("_keep") - F.col("_upto") + F.col("_n")).cast("int").alias("_at")
    )
    inside = items.withColumn("_first", first).join(F.broadcast(edge), [*by, "_first"])  # a row a group
    return inside.groupBy(*by, "_at").agg(F.sort_array(F.collect_list(hashed)).alias("_all")).select(
        *by, F.element_at("_all", F.col("_at")).alias("limit")
    )

"""Requests filled in order: one sequential rule, evaluated in blocks that know nothing of each other.

Where a request begins decides where the next one does, and it begins at most `pack` items further. So a block of items
maps each of its first `pack` places, where a request may begin, to the place in the next block where one begins then.
These maps, `pack` numbers a block, are followed in one pass; after it every block can place its own items."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What an item costs besides its text; characters a token, and the least; tokens of state and request (fixed values).
OVERHEAD, CHARS_PER_TOKEN, LEAST_CHARS, STATE_TOKENS, REQUEST_TOKENS = 12, 3.5, 0.25, 28_000, 56_000
#: Items of a block.
BLOCK = 65_536


def numbered(items: DataFrame, block: int) -> DataFrame:
    """items with `at`, their rank by pos from 0. Ranges of positions are counted first, so no task sorts them all."""
    ranged = items.withColumn("_range", F.floor(F.col("pos") / block))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    # one row a range
    before = counts.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(W.partitionBy("_range").orderBy("pos")) - 1
    return ranged.withColumn("_rank", rank).join(before, "_range").withColumn("at", F.col("_before") + F.col("_rank")).drop(
        "_range", "_rank", "_before"
    )


def begins(chars, cost, own: int, pack: int, state: float, request: float):
    """For each of a block's own items: where the next request begins if one begins there."""
    import numpy as np

    i = np.arange(own)
    end = np.minimum(i + pack, len(chars))
    for amount, limit in ((chars, state), (cost, request)):
        total = np.concatenate([[0], np.cumsum(amount)])
        # the first item whose sum reaches the limit stays out; the first of a request never does
        end = np.minimum(end, np.maximum(np.searchsorted(total, total[:own] + limit) - 1, i + 1))
    return end


def plan_packs(items: DataFrame, pack: int = 32, chars_per_token: float = CHARS_PER_TOKEN, block: int = BLOCK) -> DataFrame:
    """items with pack_id (from 0, in order), position in it (from 1) and `packed`, its size.

    Items go by `pos`, which must be unique and not null. A request takes the next item while it holds fewer than `pack`
    and texts and questions stay under the limits of state and request; an item too large for any goes alone. `overhead`,
    where there is such a column, counts the characters of an item's question and is dropped. A null text has no
    characters. The answer is that of one pass over all items, whatever the block."""
    extra = F.col("overhead") if "overhead" in items.columns else F.lit(0)
    sizes = items.select("pos", F.length("item").alias("length"), extra.alias("overhead"))
    return items.drop("overhead").join(places(sizes, pack, chars_per_token, block), "pos")


def places(sizes: DataFrame, pack: int = 32, chars_per_token: float = CHARS_PER_TOKEN, block: int = BLOCK) -> DataFrame:
    """(pos, pack_id, position, packed) of rows (pos, length, overhead), as `plan_packs` has it; no text is moved."""
    pack = max(1, pack)
    block = max(block, pack)
    limit = max(LEAST_CHARS, chars_per_token)
    state, request = STATE_TOKENS * limit, REQUEST_TOKENS * limit
    chars = (F.coalesce("length", F.lit(0)) + OVERHEAD).cast("long")
    cost = chars + F.coalesce("overhead", F.lit(0))
    at = numbered(sizes.select(F.col("pos").cast("long").alias("pos"), chars.alias("chars"), cost.alias("cost")), block)
    # a block also sees the first `pack` items of the next one
    home = F.floor(F.col("at") / block)
    seen = F.when((F.col("at") % block < pack) & (home > 0), F.array(home, home - 1)).otherwise(F.array(home))
    blocks = at.withColumn("block", F.explode(seen))

    def ends(number: int, rows) -> tuple:
        rows = rows.sort_values("at")
        own = int((rows["at"] < (number + 1) * block).sum())
        return rows, own, begins(rows["chars"].to_numpy(), rows["cost"].to_numpy(), own, pack, state, request)

    def through(key, rows):
        import pandas as pd

        _, own, end = ends(int(key[0]), rows)
        leave, begun = [0] * own, [1] * own
        for i, e in zip(range(own - 1, -1, -1), end[::-1].tolist()):
            if e < own:
                leave[i], begun[i] = leave[e], begun[e] + 1
            else:
                leave[i] = e - own
        return pd.DataFrame({"block": [int(key[0])], "leave": [leave[:pack]], "begun": [begun[:pack]]})

    maps = blocks.groupBy("block").applyInPandas(through, "block long, leave array<int>, begun array<int>")
    enters = maps.repartition(1).sortWithinPartitions("block").mapInPandas(followed(), "block long, enter int, first long")

    def place(key, rows, enter):
        import numpy as np
        import pandas as pd

        rows, own, end = ends(int(key[0]), rows)
        starts, i = [], int(enter["enter"].iloc[0])
        step = end.tolist()
        while i < own:
            starts.append(i)
            i = step[i]
        sizes = end[starts] - np.array(starts, dtype="int64")
        which = np.repeat(np.arange(len(starts)), sizes)
        place = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
        lo = starts[0] if starts else 0
        return pd.DataFrame(
            {
                "pos": rows["pos"].to_numpy()[lo : lo + len(which)],
                "pack_id": which + int(enter["first"].iloc[0]),
                "position": place,
                "packed": sizes[which],
            }
        )

    return blocks.groupBy("block").cogroup(enters.groupBy("block")).applyInPandas(place, "pos long, pack_id long, position int, packed int")


def followed() -> Callable[[Iterator], Iterator]:
    """The pass over the blocks' maps, in order: where a request begins in each, and how many began before it."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        enter, first = 0, 0
        for batch in batches:
            out = []
            for number, leave, begun in zip(batch["block"], batch["leave"], batch["begun"]):
                out.append((number, enter, first))
                if enter < len(leave):  # the last block may hold fewer items
                    enter, first = int(leave[enter]), first + int(begun[enter])
            yield pd.DataFrame(out, columns=["block", "enter", "first"])

    return run

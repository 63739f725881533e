"""Near-duplicate vectors by NN-descent: a neighbour graph refined through neighbours of neighbours.

First lists come from blocks of equal hyperplane signs, whose number follows from the similarity sought; a label whose
blocks would hold as many pairs as the label itself is compared whole instead. Each round then
brings the vectors that share a neighbour together, compares them, and keeps the best of each list. A list that is full
of links may hide more: it is saturated, and while there are such lists all may grow to twice their length, and those who
meet around saturated ones meet again. Lists only say who meets next: every link among vectors that meet joins their
components. A component's vectors are then compared block by block, and links only counted, however many a vector has.
Bounded samples compared with all vectors say what share of a vector's links was found; too little adds blocks and
rounds, and at last all vectors of a label are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, bounded_batches, connected_components

#: Links from this cosine; similarity from which a neighbour is kept in a list and followed; length of a list.
THRESHOLD, FLOOR, LIST = 0.93, 0.7, 10
#: Times that saturated lists are enlarged.
ENLARGE = 3
#: Rounds; vectors of a component compared at once; vectors of a group compared at once (all pairs of chunks are); chance of missing a link at the threshold in the first lists.
ROUNDS, BLOCK, CHUNK, MISS = 2, 256, 1024, 1e-3
#: Vectors in a sample of the audit; mean share of their links that must be found; further attempts.
AUDIT, RECALL, RETRIES = 256, 0.995, 2


def units(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one dimension as unit vectors in double precision."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.sqrt((x * x).sum(1))[:, None]


def tables_for(n: int, threshold: float) -> tuple[int, int]:
    """(hyperplanes, tables) for n vectors: blocks of about 64, and enough tables for pairs at the threshold."""
    bits = max(3, min(40, math.ceil(math.log2(max(2, n) / 64))))
    met = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(MISS) / math.log1p(-met)))


def _blocks(bits: int, tables: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = {}
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.slice(at, 2000)
                dims = part.column(2).value_lengths().to_numpy(zero_copy_only=False)
                for dim in np.unique(dims):
                    rows = part.take(pa.array(np.flatnonzero(dims == dim)))
                    if dim not in planes:
                        planes[dim] = np.random.default_rng([seed, int(dim)]).standard_normal((int(dim), bits * tables))
                    signs = (units(rows.column(2)) @ planes[dim] > 0).reshape(len(rows), tables, bits)
                    key = signs @ (1 << np.arange(bits, dtype=np.int64))
                    for t in range(tables):
                        yield pa.RecordBatch.from_arrays(
                            [
                                rows.column(0),
                                rows.column(1),
                                pa.array(np.full(len(rows), int(dim), np.int32)),
                                pa.array(np.full(len(rows), t, np.int32)),
                                pa.array(key[:, t]),
                            ],
                            ["id", "label", "dim", "t", "key"],
                        )

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Runs of sorted batches whose first `keys` columns agree."""
    held: list[pa.RecordBatch] = []
    last = None

    def out():
        t = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        return t.to_batches()[0]

    for batch in batches:
        if not len(batch):
            continue
        cols = [batch.column(i).to_pylist() for i in range(keys)]
        rows = list(zip(*cols))
        cuts = [0, *(i for i in range(1, len(rows)) if rows[i] != rows[i - 1]), len(rows)]
        for a, b in zip(cuts, cuts[1:]):
            if rows[a] != last and held:
                yield out()
            last = rows[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield out()


def _trees(link: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smallest id, id) of what the links between the ids of rows and of columns connect: a tree for each component."""
    back, open_left, open_right = np.ascontiguousarray(link.T), link.any(1), link.any(0)
    a, b = [], []
    for start in np.flatnonzero(open_left):
        if not open_left[start]:
            continue
        open_left[start] = False
        rows, ids = [start], [left[start : start + 1]]
        while rows:
            cols = np.flatnonzero(link[rows.pop()] & open_right)
            open_right[cols] = False
            ids.append(right[cols])
            for c in cols:
                new = np.flatnonzero(back[c] & open_left)
                open_left[new] = False
                ids.append(left[new])
                rows.extend(new)
        own = np.unique(np.concatenate(ids))
        a.append(np.full(len(own) - 1, own[0]))
        b.append(own[1:])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64), np.empty(0, np.int64))


def _near(keys: int, size: int, floor: float, threshold: float):
    """For each pair of a group's chunks (…, i, j): every member's best `size` others from `floor`, as directed edges,
    and trees (of sim null) that connect what the links connect, however many links a member has. Rows are
    (…, i, j, side, id, v); where size is 0 there are trees only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, keys + 2):
            same = group.column(keys)[0].as_py() == group.column(keys + 1)[0].as_py()
            side, ids = (group.column(keys + k).to_numpy(zero_copy_only=False) for k in (2, 3))
            left = np.flatnonzero(side == 0)
            right = left if same else np.flatnonzero(side == 1)
            if not len(left) or not len(right):
                continue
            x = units(group.column(keys + 4))
            sims = x[left] @ x[right].T
            if same:
                np.fill_diagonal(sims, -2)
            a, b = _trees(sims >= threshold, ids[left], ids[right])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.float64())], ["a", "b", "sim"])
            for s, own, others in ((sims, ids[left], ids[right]), (sims.T, ids[right], ids[left]))[: 1 if same else 2]:
                k = min(size, len(others) - same)
                if k < 1:
                    continue
                best = np.argpartition(-s, k - 1, axis=1)[:, :k]
                s = np.take_along_axis(s, best, 1)
                r, c = np.nonzero((s >= floor) & (others[best] != own[:, None]))
                if len(r):
                    yield pa.RecordBatch.from_arrays([pa.array(own[r]), pa.array(others[best[r, c]]), pa.array(s[r, c])], ["a", "b", "sim"])

    return run


def _paired(rows: DataFrame, sizes: DataFrame, by: list[str], vec: DataFrame, parts: int) -> DataFrame:
    """Rows with their vectors (vec: id, label, dim, v), once for each pair (i, j) of chunks of their group, sorted by
    group and pair. sizes: n of the groups above CHUNK rows, by columns of rows; the others are one chunk each."""
    rows = rows.join(sizes, [c for c in sizes.columns if c != "n"], "left").withColumn("n", F.ceil(F.coalesce("n", F.lit(1)) / CHUNK).cast("int"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.col("n")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    )
    rows = rows.withColumns(
        {"i": F.least("part", "other"), "j": F.greatest("part", "other"), "side": F.when(F.col("part") <= F.col("other"), 0).otherwise(1)}
    ).drop("n", "part", "other")
    rows = rows.join(vec, [c for c in ("id", "label", "dim") if c in rows.columns]).select(*by, "i", "j", "side", "id", "v")
    return rows.repartition(parts, *by, "i", "j").sortWithinPartitions(*by, "i", "j")


def _best(edges: DataFrame, size: int) -> DataFrame:
    """Each id's best `size` neighbours of either direction (ties by id)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    lists = both.groupBy("a").agg(F.slice(F.sort_array(F.collect_set(F.struct("sim", (-F.col("b")).alias("minus"))), False), 1, size).alias("l"))
    return lists.select("a", F.explode("l").alias("e")).select("a", (-F.col("e.minus")).alias("b"), F.col("e.sim").alias("sim"))


def _count(threshold: float):
    """For each pair of a component's chunks (comp, i, j): how many rows each vector links to. Rows are (…, side, id, w, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            i, j = group.column(1)[0].as_py(), group.column(2)[0].as_py()
            side, ids, w = (group.column(k).to_numpy(zero_copy_only=False) for k in (3, 4, 5))
            x = units(group.column(6))
            left = side == 0
            right = left if i == j else ~left
            for a, b in [(left, right)] + [(right, left)] * (i != j):
                if a.any() and b.any():
                    link = x[a] @ x[b].T >= threshold
                    if i == j:
                        np.fill_diagonal(link, False)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(link @ w[b].astype(np.int64))], ["id", "n"])

    return run


def saturated(edges: DataFrame, size: int, threshold: float) -> DataFrame:
    """(a) of the lists of `size` entries or more that are links throughout."""
    return edges.groupBy("a").agg(F.count("*").alias("n"), F.min("sim").alias("least")).where(
        (F.col("n") >= size) & (F.col("least") >= threshold)
    ).select("a")


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept, recall) of every row of vectors (vec_id long, embedding array, label).

    Rows link when labels are equal and not null, dimensions are equal, and the cosine in double precision reaches the
    threshold. Rows without a label, and vectors that are null, empty, zero or hold null or non-finite components, link
    with nothing. Equal vectors of a label count as so many rows but are compared once. Rows that share a vec_id, with
    equal vectors or not, are rows of their own, each with its own links and component, whose id is the smallest vec_id
    in it; rows with a null vec_id link with nothing and have a null component and kept false. recall is the audit's
    last figure, the same in every row. Extra columns are ignored; an empty table gives no rows. Links between components may be missed where the audit finds
    recall enough (of a link at the threshold, with chance MISS); where it does not after the last attempt, all vectors
    of a label are compared. Inside a component all links are counted.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    kept = Kept(spark, "descent")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label"))
    fine = F.coalesce(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False)
    )
    valid = rows.where(fine & F.col("vec_id").isNotNull() & F.col("label").isNotNull()).withColumn(
        "v", F.col("v").cast("array<float>") if dict(vectors.dtypes)["embedding"] == "array<float>" else F.col("v")
    )
    # a number for each different vector of a label, fixed by being written; vec_ids may repeat
    kinds = valid.groupBy("label", "v").agg(F.min("vec_id").alias("first"), F.count("*").alias("w"))
    kinds = kept.put(kinds.withColumn("id", F.monotonically_increasing_id()), "kinds")
    sizes = kinds.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    bits, tables = tables_for(sizes, threshold)
    label = kinds.schema["label"].dataType.simpleString()
    v = kinds.schema["v"].dataType.simpleString()
    of = kinds.select("id", "label", "v")
    probe = _sample(of)
    vec = of.select("id", "label", F.size("v").alias("dim"), "v")
    edges = trees = None

    def met(groups: DataFrame, keys: int, size: int, keep: int = LIST) -> tuple[DataFrame, DataFrame]:
        """Edges of the groups and of before, best `keep` of each list; trees of the groups and of before."""
        found = kept.put(groups.mapInArrow(_near(keys, size, FLOOR, threshold), "a long, b long, sim double"), "found")
        lists, more = found.where("sim is not null"), found.where("sim is null").select("a", "b")
        best = kept.put(_best(lists if edges is None else edges.unionByName(lists), keep), "edges")
        new = kept.put((more if trees is None else trees.unionByName(more)).distinct(), "trees")
        for name, last in (("found", 0), ("edges", 1), ("trees", 1)):
            kept.drop(name, last)
        return best, new

    def whole(labels: DataFrame) -> DataFrame:
        """All vectors of these labels and dimensions (label, dim, n) as groups."""
        every = vec.select("label", "dim", "id").join(labels.select("label", "dim"), ["label", "dim"], "left_semi")
        return _paired(every, labels.where(F.col("n") > CHUNK), ["label", "dim"], vec, parts)

    totals = kept.put(vec.groupBy("label", "dim").agg(F.count("*").alias("n")), "totals")
    done_whole = None
    for attempt in range(1 + RETRIES):
        by = ["label", "dim", "t", "key"]
        blocks = kept.put(of.mapInArrow(_blocks(bits, tables, attempt), f"id long, label {label}, dim int, t int, key long"), "blocks")
        kept.drop("blocks", 1)
        sizes = kept.put(blocks.groupBy(*by).agg(F.count("*").alias("n")), "sizes")
        kept.drop("sizes", 1)
        if done_whole is None:
            # where blocks hold as many pairs as all vectors of the label do, these are compared instead, once
            dense = sizes.groupBy("label", "dim").agg(F.sum(F.col("n") * F.col("n")).alias("pairs")).join(totals, ["label", "dim"])
            done_whole = kept.put(dense.where(F.col("pairs") >= F.col("n") * F.col("n")).select("label", "dim", "n"), "whole")
            edges, trees = met(whole(done_whole), 2, 0)
        rest = blocks.join(done_whole.select("label", "dim"), ["label", "dim"], "left_anti")
        edges, trees = met(_paired(rest.select(*by, "id"), sizes.where(F.col("n") > CHUNK), by, vec, parts), 4, LIST)
        for turn in range(ROUNDS + ENLARGE):
            # who has a neighbour in common meets there
            size = LIST << max(0, turn - ROUNDS + 1)
            at = edges.select(F.col("a").alias("pivot"), F.col("b").alias("id")).unionByName(
                edges.select(F.col("b").alias("pivot"), F.col("a").alias("id"))
            ).unionByName(edges.select(F.col("a").alias("pivot"), F.col("a").alias("id"))).distinct()
            if turn >= ROUNDS:
                full = kept.put(saturated(edges, size // 2, threshold), "full")
                if full.isEmpty():
                    break
                around = full.select(F.col("a").alias("pivot")).unionByName(
                    edges.join(full, "a", "left_semi").select(F.col("b").alias("pivot"))
                ).distinct()
                at = at.join(around, "pivot", "left_semi")
            hubs = at.groupBy("pivot").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK)
            edges, trees = met(_paired(at, hubs, ["pivot", "label", "dim"], vec, parts), 3, size, size)
        comps = kept.put(connected_components(trees, kept), "comps")
        recall = _audit(kinds, comps, probe, threshold)
        if recall >= RECALL:
            break
    else:
        # what the attempts leave short is compared whole
        edges, trees = met(whole(totals.join(done_whole.select("label", "dim"), ["label", "dim"], "left_anti")), 2, 0)
        comps, recall = kept.put(connected_components(trees, kept), "comps"), 1.0
    # links are those inside components: chunks of it are compared pair by pair, links only counted
    members = of.join(kinds.select("id", "w"), "id").join(comps, "id")
    counts = comps.groupBy("comp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    members = kept.put(members.join(counts, "comp").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")), "members")
    pairs = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pairs = pairs.select(
        "comp",
        F.least("part", "other").alias("i"),
        F.greatest("part", "other").alias("j"),
        F.when(F.col("part") <= F.col("other"), 0).otherwise(1).alias("side"),
        "id",
        "w",
        "v",
    )
    links = pairs.repartition(parts, "comp", "i", "j").sortWithinPartitions("comp", "i", "j").mapInArrow(
        _count(threshold), "id long, n long"
    ).groupBy("id").agg(F.sum("n").alias("n"))
    named = comps.join(kinds.select("id", "first"), "id").groupBy("comp").agg(F.min("first").alias("smallest"))
    done = kinds.join(links, "id", "left").join(comps, "id", "left").join(named, "comp", "left")
    done = kept.put(
        done.select(
            "label", "v", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("smallest", "first").alias("component_id")
        ),
        "done",
    )
    kept.drop_but("done")
    own = valid.join(done, ["label", "v"]).select("vec_id", "n_links", "component_id")
    rest = rows.where(~(fine & F.col("vec_id").isNotNull() & F.col("label").isNotNull())).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return own.unionByName(rest).withColumns(
        {"kept": F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)), "recall": F.lit(float(recall))}
    )


def _sample(rows: DataFrame) -> list[tuple]:
    """(id, label, vector) of AUDIT rows, chosen by hash."""
    return [(r.id, r.label, np.asarray(r.v, float)) for r in rows.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(AUDIT).collect()]


def _audit(kinds: DataFrame, comps: DataFrame, probe: list[tuple], threshold: float) -> float:
    """Recall by two bounded samples compared with all vectors, the lower one: that of vectors (probe), and that of one
    vector a component, where a large group counts once. A vector's recall is the share of its links that lie inside
    components; a sample's is the mean over its vectors with links, however many they have."""
    if not probe:
        return 1.0
    spark = kinds.sparkSession
    firsts = kinds.select("id", "label", "v").join(comps.where("id <> comp").select("id"), "id", "left_anti").select("id", "label", "v")
    samples = [probe, _sample(firsts)]
    asked = list({(i, label, v.tobytes()): (i, label, v / np.sqrt((v * v).sum())) for part in samples for i, label, v in part}.values())
    shared = spark.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, ids = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            dims = batch.column(2).value_lengths().to_pylist()
            a, b = [], []
            for dim in set(dims):
                at = [k for k, d in enumerate(dims) if d == dim]
                ask = [p for p in shared.value if len(p[2]) == dim]
                if ask:
                    sims = units(batch.column(2).take(pa.array(at))) @ np.array([p[2] for p in ask]).T
                    for r, c in zip(*np.nonzero(sims >= threshold)):
                        if labels[at[r]] == ask[c][1] and ids[at[r]] != ask[c][0]:
                            a.append(ask[c][0])
                            b.append(ids[at[r]])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    true = kinds.select("id", "label", "v").mapInArrow(run, "a long, b long")
    mine = true.join(comps.select(F.col("id").alias("a"), F.col("comp").alias("ca")), "a", "left").join(
        comps.select(F.col("id").alias("b"), F.col("comp").alias("cb")), "b", "left"
    )
    shares = {r.a: r.hit / r.n for r in mine.groupBy("a").agg(F.count("*").alias("n"), F.count_if(F.col("ca") == F.col("cb")).alias("hit")).collect()}
    own = [[shares[i] for i in {i for i, *_ in part} if i in shares] for part in samples]
    return min([sum(x) / len(x) for x in own if x], default=1.0)

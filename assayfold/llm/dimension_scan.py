"""Nearest neighbours by an adaptive scan of dimensions within inverted lists.

Vectors are turned by a seeded random rotation, after which any of their first d axes are a fair sample of all of them, and
stored by list in blocks of columns. A scan of a block adds up the squared distance over one column block after another.
After each, a candidate whose distance, estimated from the axes seen so far, lies above the query's tenth best by more than
chance allows is abandoned: a hypothesis test with error bound EPSILON. What is left is measured in full, in double
precision on the original vectors. A query goes through its nearest list first; the tenth best distance found there is
the bar for its other lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Kept, bounded_batches

#: Neighbours; every how many-th id is a query; how many standard errors above the bar a candidate is abandoned at (with
#: fewer axes seen the error is larger); seed of rotation and lists.
NEAREST, EVERY, EPSILON, SEED = 10, 100, 2.1, 11
#: Vectors, and components, that lists are fitted on at most; lists at most, and vectors of one as they are planned; share
#: of the sample's neighbours that the probed lists must hold; vectors, and queries, of a block; blocks of a list's part.
SAMPLE, COMPONENTS, LISTS, PER_LIST, SHARE, BLOCK, ASKED, PART = 16_384, 1 << 22, 1024, 400, 0.99, 1024, 256, 16
#: Where the column blocks end, as shares of the axes.
CUTS = (0.125, 0.25, 0.5, 1.0)
BLOCKS = "list int, dim int, part int, rows array<long>, ids array<long>, own binary, " + ", ".join(f"axes{k} binary" for k in range(len(CUTS)))
PROBES = "list int, dim int, asked long, own binary, turn int"
FOUND = "asked long, row long, vec_id long, score double"


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def edges(dim: int) -> list[int]:
    """Where the column blocks of that many axes begin and end; with few axes some are empty."""
    return [0, *(round(c * dim) for c in CUTS)]


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part: an id, and a vector that is not null, empty or zero and all of whose
    components are there and finite."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")
    )


class Lists:
    """Centroids of the inverted lists of one dimension, and how many of them a query is looked up in. Vectors of another
    dimension have one list of their own."""

    def __init__(self, sample: np.ndarray, rows: int, seed: int = SEED, per_list: int = PER_LIST):
        rng = np.random.default_rng(seed)
        n = int(min(LISTS, max(1, rows // per_list), max(1, len(np.unique(sample, axis=0)) // 4)))
        self.dim = sample.shape[1]
        centres = sample[rng.choice(len(sample), n, replace=False)].copy()
        for _ in range(12):
            to = self._near(sample, centres, 1)[:, 0]
            for k in np.unique(to):
                centres[k] = sample[to == k].mean(0)
        self.centres = centres
        self.probes = self._enough(sample, rng)

    @staticmethod
    def _near(x: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
        """The k nearest centroids of each row, nearest first."""
        d = -2 * (x @ centres.T) + (centres * centres).sum(1)
        return np.argsort(d, 1, kind="stable")[:, :k] if k > 1 else d.argmin(1)[:, None]

    def _enough(self, sample: np.ndarray, rng: np.random.Generator) -> int:
        """The least number of lists that hold SHARE of the sample's own nearest neighbours."""
        some = rng.choice(len(sample), min(len(sample), 256), replace=False)
        d = -2 * (sample[some] @ sample.T) + (sample * sample).sum(1)
        d[np.arange(len(some)), some] = np.inf
        near = np.argpartition(d, min(NEAREST, d.shape[1] - 1), 1)[:, :NEAREST]
        home = self._near(sample, self.centres, 1)[:, 0]
        order = self._near(sample[some], self.centres, len(self.centres)) if len(self.centres) > 1 else np.zeros((len(some), 1), int)
        place = np.argsort(order, 1)  # of each list in the query's order
        turn = np.sort(np.take_along_axis(place, home[near], 1).ravel())
        return int(turn[min(len(turn) - 1, int(np.ceil(SHARE * len(turn))) - 1)]) + 1

    def of(self, x: np.ndarray, k: int = 1) -> np.ndarray:
        return self._near(x, self.centres, min(k, len(self.centres))) if x.shape[1] == self.dim else np.zeros((len(x), 1), int)


def fit(rows: DataFrame, seed: int = SEED, per_list: int = PER_LIST) -> Lists | None:
    """Lists from at most SAMPLE of the vectors and COMPONENTS numbers, those with the smallest hashes; for the commonest
    dimension."""
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.desc("n"), "dim").first()
    if most is None:
        return None
    own = rows.where(F.size("v") == most.dim)
    # twice as many as are wanted pass by their hash, so that a sort of all is spared
    size, hashed = max(1, min(SAMPLE, COMPONENTS // most.dim)), F.xxhash64("vec_id", F.lit(seed))
    few = own.where(F.pmod(hashed, F.lit(1 << 20)) < int(min(1, 2 * size / most.n) * (1 << 20)))
    sample = few.orderBy(hashed, "row").limit(size).select("v").toArrow().column(0).combine_chunks()
    x = sample.flatten().to_numpy().reshape(-1, most.dim) if len(sample) else np.array([own.first().v], float)
    return Lists(x, most.n, seed, per_list)


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors) of a batch (id, vector), by dimension."""
    column = batch.column(1)
    sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        yield at, flat[starts[at][:, None] + np.arange(dim)]


def _listed(lists: Lists):
    """(row, v) to (row, list, dim)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, dims = np.zeros(len(batch), np.int32), np.zeros(len(batch), np.int32)
            for at, x in _groups(batch):
                home[at], dims[at] = lists.of(x)[:, 0], x.shape[1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), pa.array(dims)], ["row", "v", "vec_id", "list", "dim"])

    return run


def _stored(block: int):
    """(row, v, vec_id, list, dim, part), a list's part together, to blocks of at most `block` vectors, turned and cut by columns."""
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    types = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.binary()] * (1 + len(CUTS))]

    def stored(key: tuple[int, int, int], parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows, ids, x = (np.concatenate([p[k] for p in parts]) for k in range(3))
        kind, at = "<f4" if np.abs(x).max() < 1e15 else "<f8", edges(key[1])
        turned = (x @ rotation(key[1])).astype(kind)
        for a in range(0, len(x), block):
            cut = slice(a, a + block)
            axes = [np.ascontiguousarray(turned[cut, b:c].T).tobytes() for b, c in zip(at, at[1:])]
            values = [*key, rows[cut], ids[cut], x[cut].astype("<f8").tobytes(), *axes]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, size = None, [], 0
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in (3, 4, 5)], 1)
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)])
            for a, b in zip(starts, np.r_[starts[1:], len(keys)]):
                here, some = tuple(map(int, keys[a])), batch.slice(a, b - a)
                if key is not None and (here != key or size >= 4 * block):
                    yield from stored(key, parts)
                    parts, size = [], 0
                key = here
                for _, x in _groups(some):  # of one dimension
                    parts.append((some.column(0).to_numpy(), some.column(2).to_numpy(), x))
                    size += len(x)
        if parts:
            yield from stored(key, parts)

    return run


def _probed(lists: Lists, every: bool):
    """Queries (asked, v) to a row for every list that they are looked up in, in turn from the nearest; with `every` all lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _groups(batch):
                to = lists.of(x, len(lists.centres) if every else lists.probes)
                n = to.shape[1]
                own = pa.array([raw for v in x.astype("<f8") for raw in [v.tobytes()] * n], pa.binary())
                values = [
                    pa.array(to.ravel(), pa.int32()),
                    pa.array(np.full(to.size, x.shape[1]), pa.int32()),
                    batch.column(0).take(pa.array(np.repeat(at, n))),
                    own,
                    pa.array(np.tile(np.arange(n), len(at)), pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(values, ["list", "dim", "asked", "own", "turn"])

    return run


def scan(axes: list[np.ndarray], query: np.ndarray, bar: float, nearest: int, epsilon: float = EPSILON) -> np.ndarray:
    """Rows of a block that may be among a query's `nearest`, as far as the tests tell. bar: a distance none of these is
    above, or infinity.

    axes: the block's turned columns, axes x vectors; query: its turned axes."""
    dim, left, seen = len(query), np.arange(axes[0].shape[1]), 0
    partial = np.zeros(len(left))
    off = 1e-6 * float(np.sqrt(query @ query))  # columns are floats, the bar a double
    for own in axes:
        mine = query[seen : seen + len(own)]
        partial += ((own[:, left].astype(np.float64) - mine[:, None]) ** 2).sum(0)
        seen += len(own)
        if not seen or len(left) <= nearest:
            continue
        if not np.isfinite(bar):  # the nearest by the axes seen so far give a first bar
            first = left[np.argpartition(partial, nearest - 1)[:nearest]]
            bar = float(
                np.sqrt(sum(((a[:, first].astype(np.float64) - query[b : b + len(a), None]) ** 2).sum(0) for a, b in zip(axes, edges(dim)))).max()
            )
        allowed = (bar + off) * (1 + epsilon / np.sqrt(seen) if seen < dim else 1 + 1e-6)
        stay = ~(np.sqrt(partial * (dim / seen)) > allowed)
        left, partial = left[stay], partial[stay]
    return left


def _scanned(nearest: int, epsilon: float):
    """Blocks with `asked`, an array of (asked, own, bar), to the block's best for each, by exact distance, vec_id and row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                dim = batch.column("dim")[k].as_py()
                rows, ids = (batch.column(c).slice(k, 1).flatten().to_numpy() for c in ("rows", "ids"))
                x = np.frombuffer(batch.column("own")[k].as_buffer(), "<f8").reshape(-1, dim)
                raw, at, axes = [batch.column(f"axes{c}")[k].as_buffer() for c in range(len(CUTS))], edges(dim), []
                kind = "<f4" if sum(b.size for b in raw) == 4 * x.size else "<f8"
                for b, lo, hi in zip(raw, at, at[1:]):
                    axes.append(np.frombuffer(b, kind).reshape(hi - lo, len(ids)))
                turn, out = rotation(dim), []
                for a in batch.column("asked")[k].as_py():
                    query = np.frombuffer(a["own"], "<f8")
                    # one more than wanted, for a query's own row is no neighbour of it
                    left = scan(axes, query @ turn, np.inf if a["bar"] is None else a["bar"], nearest + 1, epsilon)
                    left = left[rows[left] != a["asked"]]
                    far = np.sqrt(((x[left] - query) ** 2).sum(1))
                    out += [
                        (a["asked"], int(rows[left[i]]), int(ids[left[i]]), float(far[i]))
                        for i in np.lexsort((rows[left], ids[left], far))[:nearest]
                    ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64()))],
                    ["asked", "row", "vec_id", "score"],
                )

    return run


def search(
    vectors: DataFrame, every: int = EVERY, nearest: int = NEAREST, epsilon: float = EPSILON, seed: int = SEED, per_list: int = PER_LIST
) -> DataFrame:
    """(query_id, rank, vec_id, score): the `nearest` rows found for every row whose vec_id is divisible by `every`.

    Score is the Euclidean distance of the original vectors in double precision; ties go to the smaller vec_id. A query's
    own row is no candidate, other rows of its vec_id are; rows that share a vec_id are rows and queries of their own,
    whose ranks follow each other under that id. Vectors of other dimensions than the query's are no candidates. Rows
    with a null vec_id, and vectors that are null, empty, zero or hold null or non-finite components, take no part. A
    query that finds fewer than `nearest` goes through all lists, so it lacks neighbours only where there are none. Extra
    columns are ignored; an empty table gives no rows. Lists are fitted on at most SAMPLE vectors, chosen by hash; every
    vector is stored. What the search finds of the true neighbours is measured by `recall`.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    kept = Kept(spark, "scan")
    rows = kept.put(usable(vectors).withColumn("row", F.monotonically_increasing_id()), "rows")
    lists = fit(rows, seed, per_list)
    if lists is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    home = kept.put(rows.select("row", "v", "vec_id").mapInArrow(_listed(lists), "row long, v array<double>, vec_id long, list int, dim int"), "home")
    parts = home.groupBy("list", "dim").agg(F.ceil(F.count("*") / (BLOCK * PART)).cast("int").alias("parts"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a crowded list is dealt over as many parts as it needs
    dealt = home.join(parts, ["list", "dim"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    dealt = dealt.select("row", "v", "vec_id", "list", "dim", "part").repartition(n, "list", "dim", "part").sortWithinPartitions(
        "list", "dim", "part"
    )
    blocks = kept.put(dealt.mapInArrow(_stored(BLOCK), BLOCKS), "blocks")
    parts = kept.put(parts, "parts")
    kept.drop("home")
    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("row").alias("asked"), "v", F.col("vec_id").alias("query_id"))
    best_first = W.partitionBy("asked").orderBy("score", "vec_id", "row")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= nearest)

    def scanned(probes: DataFrame) -> DataFrame:
        """What the lists hold for the probes (list, dim, asked, own, bar), queries of a list in lots."""
        lots = probes.groupBy("list", "dim").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("lots"))
        own = probes.join(lots, ["list", "dim"]).withColumn("lot", F.pmod(F.xxhash64("asked"), F.col("lots")))
        lot = own.groupBy("list", "dim", "lot").agg(F.collect_list(F.struct("asked", "own", "bar")).alias("asked"))
        lot = lot.join(parts, ["list", "dim"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("lot", "parts")
        return kept.put(blocks.join(lot, ["list", "dim", "part"]).mapInArrow(_scanned(nearest, epsilon), FOUND), "found")

    probes = kept.put(queries.select("asked", "v").mapInArrow(_probed(lists, False), PROBES), "probes")
    found = best(scanned(probes.where("turn = 0").withColumn("bar", F.lit(None).cast("double")))).drop("rank")
    bars = found.groupBy("asked").agg(F.when(F.count("*") >= nearest, F.max("score")).alias("bar"))
    more = scanned(probes.where("turn > 0").join(bars, "asked", "left"))
    found = kept.put(best(found.unionByName(more)), "best")
    few = queries.join(found.groupBy("asked").agg(F.count("*").alias("n")), "asked", "left").where(F.coalesce("n", F.lit(0)) < nearest)
    rest = few.select("asked", "v").mapInArrow(_probed(lists, True), PROBES)
    again = best(scanned(rest.withColumn("bar", F.lit(None).cast("double"))))
    out = found.join(few.select("asked"), "asked", "left_anti").unionByName(again.select(*found.columns)).join(
        queries.select("asked", "query_id"), "asked"
    )
    out = kept.put(
        out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("asked", "rank"))).select("query_id", "rank", "vec_id", "score"),
        "out",
    )
    kept.drop_but("out")
    return out


def recall(vectors: DataFrame, found: DataFrame, every: int = EVERY, nearest: int = NEAREST, at_most: int = 200) -> float:
    """Share of the true neighbours' number that `found` has no farther than the last true one, over at most `at_most`
    queries chosen by hash: these against all rows, in blocks."""
    rows = usable(vectors)
    # bounded by at_most
    asked = rows.where(F.col("vec_id") % every == 0).orderBy(F.xxhash64("vec_id")).limit(at_most).dropDuplicates(["vec_id"]).collect()
    ids, own = [r.vec_id for r in asked], [np.array(r.v) for r in asked]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at, x in _groups(batch):
                mine = batch.column(0).to_numpy()[at]
                for i, q in zip(ids, own):
                    if len(q) == x.shape[1]:
                        far = np.sqrt(((x - q) ** 2).sum(1))[mine != i]
                        out += [(i, float(f)) for f in np.sort(far)[:nearest]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.float64())], ["query_id", "score"]
            )

    true = rows.mapInArrow(near, "query_id long, score double").withColumn(
        "k", F.row_number().over(W.partitionBy("query_id").orderBy("score"))
    ).where(F.col("k") <= nearest)
    last = true.groupBy("query_id").agg(F.max("score").alias("last"), F.count("*").alias("n"))
    hit = found.join(last, "query_id").where(F.col("score") <= F.col("last") * (1 + 1e-12)).groupBy("query_id").agg(F.count("*").alias("hit"))
    out = last.join(hit, "query_id", "left").agg((F.sum(F.least(F.coalesce("hit", F.lit(0)), "n")) / F.sum("n")).alias("r")).first()
    return 1.0 if out.r is None else float(out.r)

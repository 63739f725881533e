"""Centroid clustering by ball-tree filtering, in whole numbers throughout.

Every task turns its vectors into metric trees, one an Arrow batch, so a tree is bounded. A ball stores its radius, its
count (as a range of the tree's points) and its sum in whole numbers; the trees are written once and read in every round. A ball that lies nearer to one centroid than
to any other by more than its diameter goes to it whole, with its sum; the others are opened, down to leaves whose points
are compared exactly. Distances and sums are integers, so rounds do not depend on how rows are dealt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, bounded_batches

#: Components of a vector; its scale; centroids; rounds; seed of the first centroids; points of a leaf.
DIM, SCALE, CENTROIDS, ROUNDS, SEED, LEAF = 64, 1024, 8, 10, 3, 32
#: Whole numbers up to which squared distances are exact in doubles, and in 64-bit integers.
IN_DOUBLE, IN_LONG = 1 << 22, 1 << 26
#: Share by which a ball's bounds are widened, far above what doubles may be off.
SLACK = 1e-9
OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
TREES = "ids array<long>, points binary, lo binary, hi binary, left binary, right binary, centre binary, radius binary, sums binary, wide array<string>"


def whole_numbers(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """(vec_id, v) of the vectors with exactly dim components, none null or non-finite; v as doubles, not yet scaled."""
    v = F.col("embedding").cast("array<double>")
    fine = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def scaled(x: float, scale: int = SCALE) -> int:
    """floor(scale * x), exactly: where a double has no fraction, in whole numbers."""
    return int(x) * scale if abs(x) >= 1 << 53 else int(np.floor(x * scale))


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole vectors, by points and centres: in doubles, longs or Python's integers, as these hold them."""
    most = max((int(abs(a).max()) for a in (points, centres) if a.size), default=0)
    if most <= IN_DOUBLE:
        p, c = points.astype(np.float64), centres.astype(np.float64)
        return ((p * p).sum(1)[:, None] - 2 * (p @ c.T) + (c * c).sum(1)).astype(np.int64)
    kind = np.int64 if most <= IN_LONG else object
    p, c = points.astype(kind), centres.astype(kind)
    return np.stack([((p - one) ** 2).sum(1) for one in c], 1)


def build(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """A tree over the points (n x dim, longs): their order, and the balls' arrays. A ball is a range of that order; left
    and right are its halves, 0 in a leaf."""
    order, at = np.arange(len(points)), points.astype(np.float64)
    lo, hi, left, right, centre, radius, sums = [], [], [], [], [], [], []
    todo = [(0, len(points), -1, None)]
    while todo:
        a, b, parent, side = todo.pop()
        me, mine = len(lo), order[a:b]
        if side is not None:
            side[parent] = me
        total, own = points[mine].sum(0), at[mine]
        middle = total / (b - a)
        far = ((own - middle) ** 2).sum(1)
        for column, value in ((lo, a), (hi, b), (left, 0), (right, 0), (centre, middle), (radius, np.sqrt(far.max())), (sums, total)):
            column.append(value)
        if b - a > leaf and far.max() > 0:
            one = ((own - own[far.argmax()]) ** 2).sum(1)
            lean = one - ((own - own[one.argmax()]) ** 2).sum(1)
            near = lean <= 0
            if min(near.sum(), (~near).sum()) * 16 < b - a:  # lopsided halves would make the tree deep
                near = np.zeros(b - a, bool)
                near[np.argsort(lean, kind="stable")[: (b - a) // 2]] = True
            order[a:b] = np.concatenate([mine[near], mine[~near]])
            cut = a + int(near.sum())
            todo += [(cut, b, me, right), (a, cut, me, left)]
    return order, {
        "lo": np.array(lo, "<i4"),
        "hi": np.array(hi, "<i4"),
        "left": np.array(left, "<i4"),
        "right": np.array(right, "<i4"),
        "centre": np.array(centre, "<f8"),
        "radius": np.array(radius, "<f8"),
        "sums": np.array(sums, "<i8"),
    }


def plant(batches: Iterator[pa.RecordBatch], dim: int = DIM, scale: int = SCALE) -> Iterator[pa.RecordBatch]:
    """A tree for every batch of (vec_id, v); vectors whose numbers are too large for longs come as rows of their own."""
    kinds = [pa.list_(pa.int64()), *[pa.binary()] * 8, pa.list_(pa.string())]
    names = [c.split()[0] for c in TREES.split(", ")]
    row = lambda *values: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names)
    for batch in batches:
        if not len(batch):
            continue
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        wide = (np.abs(x) > IN_LONG / scale).any(1)
        for k in np.flatnonzero(wide):
            yield row([batch.column(0)[int(k)].as_py()], *[None] * 8, [str(scaled(float(v), scale)) for v in x[k]])
        few = np.flatnonzero(~wide)
        if len(few):
            points = np.floor(x[few] * scale).astype(np.int64)
            order, tree = build(points)
            ids = batch.column(0).take(pa.array(few[order]))
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            rest = [points[order].astype("<i4").tobytes(), *(a.tobytes() for a in tree.values())]
            yield pa.RecordBatch.from_arrays([lists, *(pa.array([v], t) for v, t in zip([*rest, None], kinds[1:]))], names)


def filtered(tree: dict[str, np.ndarray], points: np.ndarray, centres: np.ndarray) -> Iterator[tuple[int, int, int | None, np.ndarray | None]]:
    """(lo, hi, ball, clusters) of ranges of a tree's points: a whole ball and its one cluster, or a leaf's points, no ball,
    and theirs. Equally near centroids: the smaller number."""
    to = np.clip(centres, -(10**150), 10**150).astype(np.float64) if centres.dtype == object else centres.astype(np.float64)
    slack = SLACK * (1 + np.abs(tree["centre"]).max() + np.abs(to).max())
    open_ = np.array([0])
    while len(open_):
        d = np.sqrt(((tree["centre"][open_][:, None, :] - to) ** 2).sum(2))
        best = d.argmin(1)
        least = d[np.arange(len(d)), best]
        d[np.arange(len(d)), best] = np.inf
        whole = d.min(1) - least > 2 * tree["radius"][open_] * (1 + SLACK) + slack
        for ball, cluster in zip(open_[whole], best[whole]):
            yield int(tree["lo"][ball]), int(tree["hi"][ball]), int(ball), np.array([cluster])
        rest = open_[~whole]
        inner = tree["left"][rest] > 0
        for ball in rest[~inner]:
            a, b = int(tree["lo"][ball]), int(tree["hi"][ball])
            yield a, b, None, distances(points[a:b], centres).argmin(1)
        open_ = np.concatenate([tree["left"][rest[inner]], tree["right"][rest[inner]]])


def _read(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[pa.Array, dict | None, np.ndarray]]:
    """(ids, tree, points) of the rows; a wide vector has no tree."""
    for k in range(len(batch)):
        ids = batch.column(0).slice(k, 1).flatten()
        if batch.column(9)[k].is_valid:
            yield ids, None, np.array([[int(v) for v in batch.column(9)[k].as_py()]], object)
            continue
        raw = [
            np.frombuffer(batch.column(c)[k].as_buffer(), t) for c, t in zip(range(1, 9), ("<i4", "<i4", "<i4", "<i4", "<i4", "<f8", "<f8", "<i8"))
        ]
        tree = dict(zip(("lo", "hi", "left", "right", "centre", "radius", "sums"), raw[1:]))
        tree["centre"], tree["sums"] = tree["centre"].reshape(-1, dim), tree["sums"].reshape(-1, dim)
        yield ids, tree, raw[0].reshape(-1, dim).astype(np.int64)


def _limbs(total: int) -> Iterator[tuple[int, int]]:
    """A whole number of any size as (limb, value), the sum of value << 32 * limb, for sums in columns of longs."""
    limb = 0
    while not -(1 << 62) <= total < 1 << 62:
        yield limb, total & 0xFFFFFFFF
        total, limb = total >> 32, limb + 1
    yield limb, total


def _summed(centres: np.ndarray, dim: int):
    """A task's sums by cluster: (cluster, axis, limb, total); axis -1 counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = [0] * len(centres), [[0] * dim for _ in centres]
        for batch in batches:
            for _, tree, points in _read(batch, dim):
                if tree is None:
                    parts = [(int(distances(points, centres).argmin(1)[0]), 1, points[0])]
                else:
                    parts = []
                    for a, b, ball, clusters in filtered(tree, points, centres):
                        if ball is not None:
                            parts.append((int(clusters[0]), b - a, tree["sums"][ball]))
                        else:
                            parts += [(int(c), int((clusters == c).sum()), points[a:b][clusters == c].sum(0)) for c in np.unique(clusters)]
                for c, n, total in parts:
                    counts[c] += n
                    sums[c] = [x + int(y) for x, y in zip(sums[c], total)]
        rows = [(c, axis, limb, v) for c, n in enumerate(counts) if n for axis, total in ((-1, n), *enumerate(sums[c])) for limb, v in _limbs(total)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))],
            ["cluster", "axis", "limb", "total"],
        )

    return run


def _assigned(centres: np.ndarray, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, tree, points in _read(batch, dim):
                cluster, far = np.zeros(len(points), np.int32), np.zeros(len(points), object)
                for a, b, ball, clusters in filtered(tree, points, centres) if tree else [
                    (0, len(points), None, distances(points, centres).argmin(1))
                ]:
                    cluster[a:b] = clusters
                    for c in np.unique(clusters):
                        at = slice(a, b) if ball is not None else a + np.flatnonzero(clusters == c)
                        far[at] = distances(points[at], centres[c : c + 1])[:, 0]
                held = pa.array([int(d) if d < 1 << 63 else None for d in far], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster), held], ["vec_id", "cluster", "distance"])

    return run


def cluster(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector of `dim` finite components.

    A component x counts as floor(1024 * x). The first centroids are the vectors whose `seed:vec_id` has the smallest
    sha256 (a null vec_id counts as no text; of equal ones the smaller vector); with fewer vectors there are as many
    centroids. Rows that share a vec_id are vectors of their own. Vectors that are null, or have another length, a null or
    a non-finite component, are left out; without any vector there are no rows. Ties go to the smaller number, an empty
    cluster keeps its centroid. A squared distance, or a sum of them, that no long can hold is null: the clusters are
    exact all the same. Extra columns are ignored.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    kept = Kept(spark, "balls")
    rows = whole_numbers(vectors, dim)
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.select(hashed.alias("h"), "v").orderBy("h", "v").limit(centroids).collect()  # as few as centroids are asked for
    if not first:
        return spark.createDataFrame([], OUT)
    centres = [[scaled(x) for x in r.v] for r in first]
    trees = kept.put(rows.mapInArrow(lambda batches: plant(batches, dim), TREES), "trees")
    for _ in range(rounds):
        sums = trees.mapInArrow(_summed(_table(centres), dim), "cluster int, axis int, limb int, total long")
        found: dict[tuple[int, int], int] = {}
        # a few numbers a centroid
        for r in sums.groupBy("cluster", "axis", "limb").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
            found[r.cluster, r.axis] = found.get((r.cluster, r.axis), 0) + (int(r.total) << 32 * r.limb)
        moved = [[found[c, axis] // found[c, -1] for axis in range(dim)] if (c, -1) in found else old for c, old in enumerate(centres)]
        if moved == centres:
            break  # later rounds would find the same
        centres = moved
    out = kept.put(trees.mapInArrow(_assigned(_table(centres), dim), "vec_id long, cluster int, distance long"), "final")
    kept.drop("trees")
    lost = F.count_if(F.col("distance").isNull()) > 0
    sums = {
        r.cluster: None if r.lost else int(r.d)
        for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"), lost.alias("lost")).collect()
    }
    held = lambda x: x if x is not None and x < 1 << 63 else None
    total = None if None in sums.values() else sum(sums.values())
    names = [(c, held(sums[c]), held(total), hashlib.sha256(",".join(map(str, centre)).encode()).hexdigest()) for c, centre in enumerate(centres) if c in sums]
    of = spark.createDataFrame(names, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(of), "cluster").select(*[c.split()[0] for c in OUT.split(", ")])  # a row a centroid


def _table(centres: list[list[int]]) -> np.ndarray:
    """Centroids as longs where these hold them, as Python's integers where not."""
    large = any(not -(1 << 63) <= x < 1 << 63 for c in centres for x in c)
    return np.array(centres, object if large else np.int64)

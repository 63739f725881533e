"""N-gram Jaccard join by parity sketches.

A document's distinct word shingles are dealt over K bands by a hash; a band's sketch is the XOR of its shingles' hash
words, so one shingle more or less changes one band at most: the bands in which two sketches differ bound the symmetric
difference from below. Sets with Jaccard similarity of 3/4 or more and sizes n and m differ in at most (n + m) / 7
shingles. So of the nz bands that hold anything, at least nz minus that many agree: the pigeonhole joins documents on
(size band, band, sketch), says how many agreements a pair must have, and lets documents with too few in all go before
any pair is made. At last pairs are made only outside the need - 1 agreements of a document's largest buckets, and only
where the parity sketches of the whole sets differ in no more bits than that. Survivors are verified on whole sets.

Sizes are dealt into bands of ratio 4/3; a document joins in its own band and, as the larger one, in the band below.
Where a small set fills too few bands for the pigeonhole, it is joined on the first n // 4 + 1 of its shingles too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Kept, bounded_batches, connected_components, free_shuffles
from .shingles import chunks, mix, numbers, planes, shingle_sets

#: Words of a shingle; similarity as a fraction; bands for each element of the largest set of a size band.
WORDS, NUM, DEN, BANDS = 5, 3, 4, 0.42
#: Bits of the longest sketch; bits for each shingle and bits of the longest fine sketch.
SKETCH, FINE, FINEST = 2048, 8, 1 << 16
#: Bytes of a key that travel; its place tells the rest. Keys that fall together make candidates, never links.
KEY = 4
#: Members up to which all pairs of a bucket between components are compared at once; rounds for the larger ones.
SMALL, ROUNDS = 4096, 4
#: Rows of a leader's group that meet in one place; bits of the fixed-size filter that spares a scan the other texts.
GROUP, FILTER_BITS = 512, 24
#: Rows (key, salt, role, id) of a verification up to which they are broadcast to the texts' scan.
BROADCAST = 1 << 20
#: First runs of a document that its rows carry; what stands for none.
FIRST, NONE = 8, (1 << 63) - 1

_LOW = [1]
while _LOW[-1] < 1 << 40:
    _LOW.append(4 * _LOW[-1] // 3 + 1)
_LOWS = np.array(_LOW)


def join_keys(sets: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, set, size band, agreements that any partner must have there) for sets given by their hashes and offsets."""
    n = np.diff(cuts)
    own = np.searchsorted(_LOWS, n, "right") - 1
    out = []
    for down in (0, 1):
        use = np.flatnonzero((n > 0) & (own >= down))
        if not len(use):
            continue
        group = own - down
        largest = 4 * n // 3 if not down else _LOWS[np.maximum(own, 0)] - 1
        n_bands = np.maximum(1, np.ceil(BANDS * _LOWS[group + 1])).astype(np.uint64)
        of = np.repeat(np.arange(len(n)), n)
        took = np.isin(of, use) if len(use) < len(n) else slice(None)
        s, of = sets[took], of[took]
        g = group[of].astype(np.uint64) + np.uint64(1)
        band = mix(s ^ (g << np.uint64(50))) % n_bands[of]
        order = np.argsort((of.astype(np.uint64) << np.uint64(40)) | band, kind="stable")
        band, of, g, word = band[order], of[order], g[order], mix(s + np.uint64(0x9E3779B97F4A7C15))[order]
        start = np.flatnonzero(np.concatenate(([True], (band[1:] != band[:-1]) | (of[1:] != of[:-1]))))
        key = mix(np.bitwise_xor.reduceat(word, start) + mix((band[start] << np.uint64(8)) + g[start]))
        of = of[start]
        need = np.bincount(of, minlength=len(n)) - (n + largest) // 7
        out.append((key, of, group[of], np.maximum(need[of], 1)))
        for i in use[need[use] < 1]:  # the bands alone promise nothing: the set's prefix does
            head = mix(sets[cuts[i] : cuts[i] + n[i] // 4 + 1] ^ mix((1 << 60) + int(group[i])))
            out.append((head, np.full(len(head), i), np.full(len(head), group[i]), np.ones(len(head), np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 3)


def _batch(columns: dict[str, object]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], list(columns))


def _prints(sets: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two words for each set that only equal sets share; 0 for empty ones."""
    full = np.flatnonzero(np.diff(cuts))
    f, g = np.zeros((2, len(cuts) - 1), np.uint64)
    if len(full):
        f[full] = np.bitwise_xor.reduceat(mix(sets + np.uint64(1)), cuts[full])
        g[full] = np.add.reduceat(mix(sets ^ np.uint64(77)), cuts[full])
    return f.view(np.int64), g.view(np.int64)


def bit_sketch(own: np.ndarray, times: int = 1, most: int = SKETCH) -> bytes:
    """Bit i is odd where an odd number of shingles falls on it. Shorter sketches are longer ones folded by XOR."""
    size = min(max(1 << (times * len(own) - 1).bit_length(), 64), most)
    odd = np.bincount((mix(own ^ np.uint64(0x51ED27)) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of words, all as short as the shortest."""
    least, out = min(map(len, sketches)), np.empty((len(sketches), min(map(len, sketches)) // 8), np.uint64)
    for i, raw in enumerate(sketches):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(raw, "<u8").reshape(-1, least // 8), axis=0)
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_shingles, the two words of its set, its bit sketch and its fine one."""
    for part in chunks(batches, 1):
        sets, cuts = shingle_sets(part.column(1), WORDS)
        f, g = _prints(sets, cuts)
        own = [sets[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        bits, fine = [bit_sketch(x) for x in own], [bit_sketch(x, FINE, FINEST) for x in own]
        yield pa.RecordBatch.from_arrays(
            [part.column(0), *(pa.array(x) for x in (np.diff(cuts), f, g)), pa.array(bits, pa.binary()), pa.array(fine, pa.binary())],
            ["doc_id", "n_shingles", "f", "g", "sketch", "fine"],
        )


def _signatures(batches: Iterator[pa.RecordBatch], places: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Join keys of every set, of equal ones in a task only the first. A row carries all that a chunk has for one
    partition: keys, and their documents with size band, need and number of keys."""
    seen: set[tuple[int, int]] = set()
    parts = np.uint64(len(places))
    for part in chunks(batches, 1):
        sets, cuts = shingle_sets(part.column(1), WORDS)
        known = [not n or doc is None or (own := (f, g)) in seen or seen.add(own) for doc, n, f, g in zip(part.column(0).to_pylist(), np.diff(cuts).tolist(), *(x.tolist() for x in _prints(sets, cuts)))]
        new = np.flatnonzero(~np.array([bool(x) for x in known], bool))
        if not len(new):
            continue
        n = np.diff(cuts)
        sets = sets[np.isin(np.repeat(np.arange(len(n)), n), new)]
        key, of, group, need = join_keys(sets, np.concatenate([[0], np.cumsum(n[new])]))
        ids = part.column(0).to_numpy(zero_copy_only=False)[new].astype(np.int64)
        to = (key % parts).astype(np.int64)
        order = np.argsort(to, kind="stable")
        key, of, group, need, to = key[order], of[order], group[order], need[order], to[order]
        edge = np.flatnonzero(np.concatenate(([True], (to[1:] != to[:-1]) | (of[1:] != of[:-1]) | (group[1:] != group[:-1]))))
        runs = np.diff(np.append(edge, len(key)))
        lots, key_at = np.unique(to, return_index=True)
        run_at = np.searchsorted(edge, key_at)
        bounds = [(*np.append(key_at, len(key))[i : i + 2], *np.append(run_at, len(edge))[i : i + 2]) for i in range(len(lots))]
        short = (key // parts).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY]
        of, group, need = ids[of[edge]], group[edge], np.minimum(need[edge], 32767)
        rows = [(int(places[p]), short[a:b].tobytes(), planes(np.diff(of[c:d], prepend=0), "<i8"), planes(group[c:d], "i1"), planes(need[c:d], "<i2"), planes(runs[c:d], "<u4")) for p, (a, b, c, d) in zip(lots, bounds)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32()] + [pa.binary()] * 5)], ["place", "keys", "ids", "bands", "needs", "counts"]
        )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys that several ids have, as runs of their members: run, size band, in how many of the partition's keys just
    these members meet (they are then one run), and the members' ids, in order, and needs, packed."""
    parts = [[], [], [], []]
    for batch in batches:
        for k, *rest in zip(*(batch.column(i).to_pylist() for i in range(1, 6))):
            short = np.zeros((len(k) // KEY, 8), np.uint8)
            short[:, :KEY] = np.frombuffer(k, np.uint8).reshape(-1, KEY)
            parts[0].append(short.view("<u8").ravel())
            ids, band, need, n = (numbers(x, t) for x, t in zip(rest, ("<i8", "i1", "<i2", "<u4")))
            for x, values in zip(parts[1:], (np.cumsum(ids), band, need)):
                x.append(np.repeat(values, n))
    if not parts[0]:
        return
    key, ids, band, need = (np.concatenate(x) for x in parts)
    del parts
    order = np.lexsort((ids, key))
    key = key[order]
    start = np.concatenate(([True], key[1:] != key[:-1]))
    many = np.zeros(len(key), bool)
    many[1:] |= ~start[1:]
    many[:-1] |= ~start[1:]
    order, key = order[many], key[many]
    ids, band, need = ids[order], band[order], need[order]
    if not len(key):
        return
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(at, len(key)))
    who = mix(ids.view(np.uint64) + mix(need.astype(np.uint64)))
    run = mix(
        np.bitwise_xor.reduceat(who, at) + mix(np.add.reduceat(who, at)) + mix(size.astype(np.uint64) * np.uint64(4096) + band[at].astype(np.uint64))
    )
    _, first, times = np.unique(run, return_index=True, return_counts=True)
    for k in range(0, len(first), 10_000):
        f, n = first[k : k + 10_000], times[k : k + 10_000]
        spans = [(at[i], at[i] + size[i]) for i in f]
        packed = [[planes(np.diff(ids[a:b], prepend=0), "<i8") for a, b in spans], [planes(need[a:b], "<i2") for a, b in spans]]
        yield _batch(
            {"run": run[f].view(np.int64), "band": band[at[f]].astype(np.int16), "n": n.astype(np.int64), "ids": packed[0], "needs": packed[1]}
        )


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed runs as rows of their members."""
    for batch in batches:
        for k in range(0, len(batch), 1000):
            part = batch.slice(k, 1000)
            ids = [np.cumsum(numbers(x, "<i8")) for x in part.column(3).to_pylist()]
            needs = [numbers(x, "<i2") for x in part.column(4).to_pylist()]
            size = np.array([len(x) for x in ids])
            put = lambda i: np.repeat(part.column(i).to_numpy(zero_copy_only=False), size)  # noqa: E731,B023
            yield _batch(
                {
                    "run": put(0),
                    "id": np.concatenate(ids),
                    "band": put(1),
                    "need": np.concatenate(needs).astype(np.int32),
                    "leader": np.repeat([x[0] for x in ids], size),
                    "n": put(2),
                    "held": np.repeat(size, size),
                }
            )


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (run, id, comp, size, sketch, first runs) sorted by run: pairs (a < b) of a run's members of different
    components whose sketches differ in no more bits than linked sets may.

    A pair that meets in many runs is made in one: where the first runs of both have a common one, the first such is the
    first that the pair has at all, and it is made there only; where they have none, it is made wherever it meets."""

    def pairs(run, ids, comp, size, sketches, firsts):
        bits = _folded(sketches)
        for i in range(1, len(ids)):
            j = np.flatnonzero(comp[:i] != comp[i])
            j = j[7 * np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64) <= size[j] + size[i]]
            if len(j):
                shared = (firsts[j][:, :, None] == firsts[i][None, None, :]).any(axis=2) & (firsts[j] != NONE)
                least = firsts[j, shared.argmax(axis=1)]  # lists have one order, that of all runs
                j = j[~shared.any(axis=1) | (least == run)]
                yield np.minimum(ids[j], ids[i]), np.maximum(ids[j], ids[i])

    def groups(table: pa.Table):
        run, ids, comp, size = (table.column(i).to_numpy() for i in range(4))
        sketches, firsts = table.column(4).to_pylist(), np.column_stack([table.column(5 + k).to_numpy() for k in range(FIRST)])
        cuts = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1], [True])))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if b - a > 1:
                yield from pairs(run[a], ids[a:b], comp[a:b], size[a:b], sketches[a:b], firsts[a:b])

    def made(table: pa.Table):
        some, n = [], 0
        for x in groups(table):
            some.append(x)
            n += len(x[0])
            if n > 100_000:
                yield _batch(dict(zip(("a", "b"), map(np.concatenate, zip(*some)))))
                some, n = [], 0
        if some:
            yield _batch(dict(zip(("a", "b"), map(np.concatenate, zip(*some)))))

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        run = table.column(0).to_numpy()
        last = int(np.flatnonzero(run != run[-1])[-1]) + 1 if len(run) and run[0] != run[-1] else 0
        yield from made(table.slice(0, last))
        held = table.slice(last)
    if held is not None:
        yield from made(held)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, salt, role, id, set) sorted so that a leader's sets come first: links found, a and b."""
    key, sets = None, []
    for batch in batches:
        a, b = [], []
        values = batch.column(4)
        flat, at = values.values.to_numpy(zero_copy_only=False), values.offsets.to_numpy()
        for i, (k, salt, role, doc) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)))):
            own = flat[at[i] : at[i + 1]]
            if (k, salt) != key:
                key, sets = (k, salt), []
            if role == 0:
                sets.append(own.copy())
            else:
                for s in sets:
                    both = len(np.intersect1d(s, own, assume_unique=True))
                    if DEN * both >= NUM * (len(s) + len(own) - both):
                        a.append(k)
                        b.append(doc)
                        break
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


class IdFilter:
    """A bitmap of fixed size that lets the ids of a frame through, and some others; a full one lets all through."""

    def __init__(self, ids: DataFrame):
        size = 1 << FILTER_BITS
        bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {size}) & 63 as int))")
        bits = ids.select(F.shiftright(F.pmod(F.xxhash64("id"), F.lit(size)), 6).alias("word"), bit.alias("bit")).groupBy("word").agg(
            F.bit_or("bit").alias("bits")
        )
        found = bits.toArrow()  # at most 2 ** (FILTER_BITS - 6) words
        words = np.zeros(size >> 6, np.int64)
        words[found.column(0).to_numpy()] = found.column(1).to_numpy()
        self.shared, self.place = ids.sparkSession.sparkContext.broadcast(words), F.pmod(F.xxhash64("id"), F.lit(size)).cast("long")

    def rows(self, frame: DataFrame, then, schema: str) -> DataFrame:
        """then(batches) of the frame's rows that are let through; the frame has an id."""
        shared, last = self.shared, len(frame.columns)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w = shared.value

            def wanted():
                for batch in batches:
                    at = batch.column(last).to_numpy(zero_copy_only=False)
                    yield batch.filter(pa.array((w[at >> 6] >> (at & 63)) & 1 == 1)).drop_columns(["_place"])

            yield from then(wanted())

        return frame.withColumn("_place", self.place).mapInArrow(run, schema)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, set) of rows (id, text)."""
    for part in chunks(batches, 1):
        found, cuts = shingle_sets(part.column(1), WORDS)
        yield pa.RecordBatch.from_arrays(
            [part.column(0), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(found.view(np.int64)))], ["id", "set"]
        )


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, sizes and fine sketches of both) the pairs whose sketches differ in no more bits than linked sets may."""
    for batch in batches:
        n, m = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
        near = np.ones(len(batch), bool)
        for i, pair in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())):
            if None not in pair:
                x, y = _folded(list(pair))
                near[i] = 7 * int(np.bitwise_count(x ^ y).sum()) <= n[i] + m[i]
        yield batch.select(["a", "b"]).filter(pa.array(near))


def close_pairs(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """The pairs that may link by their fine sketches, without those of equal sets, which are linked already. Sketches
    are an eighth of the sets that a verification moves; an id with several texts has none, and its pairs stay."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    rows = prints.where("doc_id is not null and n_shingles > 0").select(F.col("doc_id").alias("id"), "n_shingles", "f", "g", "fine")
    rows = IdFilter(ids).rows(rows, lambda it: it, "id long, n long, f long, g long, fine binary")
    one = F.min("f").eqNullSafe(F.max("f")) & F.min("g").eqNullSafe(F.max("g"))
    rows = rows.groupBy("id").agg(F.max("n").alias("n"), *(F.when(one, F.max(c)).alias(c) for c in ("f", "g", "fine")))
    of = lambda side: rows.select(F.col("id").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("n", "f", "g", "fine")))
    both = pairs.join(of("a"), "a").join(of("b"), "b").where(
        ~F.coalesce((F.col("f_a") == F.col("f_b")) & (F.col("g_a") == F.col("g_b")), F.lit(False))
    )
    return both.select("a", "b", "n_a", "n_b", "fine_a", "fine_b").mapInArrow(_close, "a long, b long")


def verify(docs: DataFrame, prints: DataFrame, pairs: DataFrame, kept: Kept) -> DataFrame:
    """The pairs (a, b) of different sets whose whole sets link. A leader a meets its partners in groups of bounded size.

    Texts are scanned once more and sets built only for ids that a bitmap of fixed size lets through (a bitmap that
    fills up lets all through, and the join that follows drops them)."""
    pairs = kept.put(close_pairs(kept.put(pairs, "met-pairs"), prints), "pairs")
    kept.drop("met-pairs")
    counts = pairs.groupBy("a").agg(F.count("*").alias("n"))
    members = pairs.join(counts, "a").select(
        F.col("a").alias("key"), F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / GROUP)).alias("salt"), F.lit(1).alias("role"), F.col("b").alias("id")
    )
    kept.drop("roles")
    roles = members.unionByName(members.select("key", "salt", F.lit(0).alias("role"), F.col("key").alias("id")).distinct())
    own = docs.where("doc_id is not null").select(F.col("doc_id").alias("id"), "text")
    own = IdFilter(roles.select("id")).rows(own, _sets, "id long, set array<long>")
    few = kept.put(roles, "roles")
    few = F.broadcast(few) if few.count() <= BROADCAST else few  # else both sides are shuffled by id
    grouped = few.join(own, "id").select("key", "salt", "role", "id", "set").repartition(
        int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "salt"
    ).sortWithinPartitions("key", "salt", "role")
    return kept.put(grouped.mapInArrow(_compare, "a long, b long").distinct(), "links")


def with_enough(met: DataFrame) -> DataFrame:
    """The rows of ids that have as many agreements in a size band as any partner needs (of an id with several texts, of
    that which needs least), with that need and all agreements, `total`; the rows are dealt once."""
    own = Window.partitionBy("id", "band")
    return met.drop("total").withColumns({"total": F.sum("n").over(own), "need": F.min("need").over(own)}).where("total >= need")


def merged(comps: DataFrame, links: DataFrame, kept: Kept) -> DataFrame:
    """comps (id, comp) after more links: only the links between components are followed anew."""
    of = lambda side: comps.select(F.col("id").alias(side), F.col("comp").alias(f"c{side}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    roots = kept.put(connected_components(between, kept), "roots").select(F.col("id").alias("comp"), F.col("comp").alias("root"))
    known = comps.join(roots, "comp", "left").select("id", F.coalesce("root", "comp").alias("comp"))
    new = roots.select(F.col("comp").alias("id"), F.col("root").alias("comp"))  # ids that had no component yet, and roots
    return kept.put(known.unionByName(new).groupBy("id").agg(F.min("comp").alias("comp")), "comps")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id long, text; further columns are ignored).

    Texts without words, null ones among them, have no shingles and link with nothing. component_id is the smallest
    doc_id reachable by links, its own included; rows with a null doc_id get their counts and a null component. Rows
    that share a doc_id are one document that links where any of its texts does. Equal sets are joined by fingerprint
    and compared once a task; no group's pairs are all made: a bucket's members first meet one leader each, and later
    only members of different components meet. An empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kept = Kept(spark, "parity")
    prints = kept.put(docs.mapInArrow(_fingerprints, "doc_id long, n_shingles long, f long, g long, sketch binary, fine binary"), "prints")
    ids = prints.where("doc_id is not null and n_shingles > 0")
    classes = ids.groupBy("n_shingles", "f", "g").agg(F.min("doc_id").alias("b"))
    equal = ids.join(classes, ["n_shingles", "f", "g"]).where("doc_id <> b").select(F.col("doc_id").alias("a"), "b")
    links = kept.put(equal, "links")

    # keys travel in lots, one a chunk and partition: for each partition, a number that Spark's hash deals to it
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = spark.range(40 * parts + 1000).groupBy(F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts)).alias("p")).agg(
        F.min("id").alias("place")
    ).collect()
    places = np.array([r.place for r in dealt])
    signed = docs.mapInArrow(lambda it: _signatures(it, places), "place int, keys binary, ids binary, bands binary, needs binary, counts binary")
    packed = "run long, band short, n long, ids binary, needs binary"
    runs = signed.repartition(parts, "place").mapInArrow(_runs, packed)
    # equal runs of different partitions are one: they are met before members are rows of their own
    runs = runs.groupBy("run").agg(F.first("band").alias("band"), F.sum("n").alias("n"), F.first("ids").alias("ids"), F.first("needs").alias("needs"))
    met = runs.mapInArrow(_members, "run long, id long, band short, need int, leader long, n long, held long")
    # whoever agrees with others in fewer bands than any partner needs has no partner
    met = kept.put(with_enough(met), "met")
    free_shuffles(spark)

    def best(votes: DataFrame) -> DataFrame:
        """For each id the leader that it meets most often, as pairs."""
        votes = votes.groupBy("id", "leader").agg(F.sum("n").alias("n"))
        return votes.groupBy("id").agg(F.max_by("leader", F.struct("n", -F.col("leader"))).alias("a")).select("a", F.col("id").alias("b"))

    links = links.unionByName(verify(docs, prints, best(met.where("id <> leader")), kept))
    comps = kept.put(connected_components(links, kept), "comps")
    largest = met.agg(F.max("held")).first()[0] or 0  # members of a run; those that left are counted too
    met = met.drop("leader")
    free_shuffles(spark)
    for turn in range(ROUNDS if largest > SMALL else 0):
        # a large run's members of other components meet one of its members, another one each time
        run = Window.partitionBy("run")
        lead = F.min_by(F.struct(F.col("id").alias("leader"), F.col("comp").alias("lead_comp")), F.xxhash64("id", F.lit(turn))).over(run)
        now = met.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        now = now.withColumns({"low": F.min("comp").over(run), "high": F.max("comp").over(run), "held": F.count("*").over(run), "l": lead}).where(
            "low <> high"
        )
        # links to other components need enough agreements in buckets that hold other components
        now = kept.put(with_enough(now.select("run", "id", "band", "need", "n", "held", "comp", "l.leader", "l.lead_comp")), "mixed")
        large = now.where(F.col("held") > SMALL).where("comp <> lead_comp")
        met = now.select("run", "id", "band", "need", "n", "held", "total")
        kept.drop("mixed", 1)
        more = verify(docs, prints, best(large), kept)
        if more.isEmpty():
            break
        comps = merged(comps, more, kept)
    # an id with several texts has no sketch of its own: size and sketch are such that it passes
    one = F.min("f").eqNullSafe(F.max("f")) & F.min("g").eqNullSafe(F.max("g"))
    of = ids.groupBy(F.col("doc_id").alias("id")).agg(
        F.when(one, F.max("n_shingles")).otherwise(F.lit(1 << 40)).alias("size"),
        F.when(one, F.max("sketch")).otherwise(F.lit(bytes(SKETCH // 8))).alias("sketch"),
    )
    # of agreements that a partner needs, one lies outside the need - 1 in a document's largest runs: only the others deal.
    # One window from the smallest run on: how many agreements lie in a run and all larger ones, and the first runs
    order = Window.partitionBy("id", "band").orderBy("held", F.desc("run"))
    all_, upto = (order.rowsBetween(Window.unboundedPreceding, last) for last in (Window.unboundedFollowing, 0))
    firsts = {f"v{k}": F.nth_value(F.struct("run", "n"), k).over(all_) for k in range(1, FIRST + 1)}
    rows = met.repartition(parts, "id").withColumns({"ahead": F.col("total") - F.sum("n").over(upto) + F.col("n")} | firsts).where("ahead >= need")
    left = F.col("total")
    for k in range(1, FIRST + 1):
        rows = rows.withColumn(f"first{k}", F.coalesce(F.when(left >= F.col("need"), F.col(f"v{k}.run")), F.lit(NONE)))
        left = left - F.coalesce(F.col(f"v{k}.n"), F.lit(0))
    rows = rows.join(comps, "id", "left").join(of, "id").select(
        "run", "id", F.coalesce("comp", "id").alias("comp"), "size", "sketch", *(f"first{k}" for k in range(1, FIRST + 1))
    )
    rows = rows.repartition(parts, "run").sortWithinPartitions("run")
    pairs = rows.mapInArrow(_cross, "a long, b long").distinct()
    pairs = kept.put(pairs, "late")
    free_shuffles(spark)
    late = verify(docs, prints, pairs, kept)
    if not late.isEmpty():
        comps = merged(comps, late, kept)
    kept.drop("comps", 1)
    kept.drop_but("prints", "comps")
    return prints.join(comps.withColumnRenamed("id", "doc_id"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id")
    )

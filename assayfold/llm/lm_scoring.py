"""Language-model scoring by cross-entropy difference.

A target model (of texts that are wanted) and a background model (of all documents) are word n-gram models over one
vocabulary, the V words of either. A word's probability after its history is (count of history and word + PRIOR / V) /
(count of history + PRIOR), so it sums to 1 over the vocabulary. A document's score is the mean of its tokens' losses
under the target less that under the background, in which its own counts do not count: the lower, the more it reads like
the target.

The logarithm of a fraction is a difference, so histories and n-grams are counted apart: both are keys of one exchange
that deals them by hash, and what travels back are a document's sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, bounded_batches
from .shingles import chunks, mix, numbers, planes, text_buffer, word_hashes

#: Words of an n-gram; what a history counts besides its occurrences, dealt evenly over the vocabulary.
ORDER, PRIOR = 2, 2.0
#: Keys of a partition of the exchange that counts them, at most on average.
KEYS = 4_000_000
#: Bytes of a key that travel; its partition and its kind tell the rest.
KEY = 6


def distinct(out: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, occurrences) of each text's distinct hashes; n: hashes of each text. Sorts `out` in place."""
    of = np.repeat(np.arange(len(n)), n)
    cuts = np.concatenate([[0], np.cumsum(n)])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        out[a:b].sort()
    start = np.flatnonzero(np.concatenate(([True], (out[1:] != out[:-1]) | (of[1:] != of[:-1])))) if len(out) else np.empty(0, np.int64)
    return out[start], of[start], np.diff(np.append(start, len(out)))


def ngrams(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, occurrences) of each text's distinct n-grams and their histories.

    Texts are padded in front, so that every word ends one n-gram. The hash's lowest bit tells histories (1)."""
    data, offsets = text_buffer(texts)
    words, n = word_hashes(data, offsets)
    place = np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n)
    power = mix(np.arange(201, 201 + order, dtype=np.uint64)) | np.uint64(1)
    padded = np.concatenate([np.zeros(order, np.uint64), words])
    history = np.zeros(len(words), np.uint64)
    for j in range(1, order):
        history += np.where(place >= j, padded[order - j : order - j + len(words)], np.uint64(7)) * power[j]
    both = [distinct(mix(history + words * power[0]) & ~np.uint64(1), n), distinct(mix(history) | np.uint64(1), n)]
    return tuple(np.concatenate(x) for x in zip(*both))


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each chunk of a task, and how many words it has."""
    for part in chunks(batches, 0, 16 << 20):
        words, _ = word_hashes(*text_buffer(part.column(0)))
        own = np.unique(words)
        n = np.zeros(len(own), np.int64)
        n[:1] = len(words)
        yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n)], ["word", "n"])


def _lots(order: int, places: np.ndarray, target: bool):
    """A row for each chunk and partition: n-grams with occurrences, and documents (-1: the target) with their numbers of n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        for number, part in enumerate(chunks(batches, 1)):
            key, of, times = ngrams(part.column(1), order)
            ids = np.full(len(part), -1, np.int64) if target else part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            kind, key = (key & np.uint64(1)), key >> np.uint64(1)
            to = (key % np.uint64(len(places))).astype(np.int64)
            by = np.lexsort((of, to))
            key, of, times, to, kind = key[by], of[by], times[by], to[by], kind[by]
            if not len(key):
                continue
            short = ((key // np.uint64(len(places))) << np.uint64(1) | kind).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY]
            edge = np.flatnonzero(np.concatenate(([True], (to[1:] != to[:-1]) | (of[1:] != of[:-1]))))
            runs, docs, times = np.diff(np.append(edge, len(key))), ids[of[edge]], np.minimum(times, 2**32 - 1)
            lots, at = np.unique(to, return_index=True)
            at, run_at = np.append(at, len(key)), np.append(np.searchsorted(edge, at), len(edge))
            rows = []
            for i, p in enumerate(lots):
                keys, runs_ = slice(at[i], at[i + 1]), slice(run_at[i], run_at[i + 1])
                rows.append(
                    (
                        int(places[p]),
                        -1 if target else task + number,
                        short[keys].tobytes(),
                        planes(times[keys], "<u4"),
                        planes(np.diff(docs[runs_], prepend=0), "<i8"),
                        planes(runs[runs_], "<u4"),
                    )
                )
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), pa.int64()] + [pa.binary()] * 4)],
                ["place", "chunk", "keys", "times", "docs", "counts"],
            )

    return run


def _losses(prior: float, vocabulary: int):
    """A partition's keys counted for both models; each lot goes back to its chunk with its documents' losses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lots, keys, times, docs, counts = [], [], [], [], []
        for batch in batches:
            lots += batch.column(1).to_pylist()
            for raw in batch.column(2).to_pylist():
                whole = np.zeros((len(raw) // KEY, 8), np.uint8)
                whole[:, :KEY] = np.frombuffer(raw, np.uint8).reshape(-1, KEY)
                keys.append(whole.view("<u8").ravel())
            docs += [np.cumsum(numbers(x, "<i8")) for x in batch.column(4).to_pylist()]
            for into, i in ((times, 3), (counts, 5)):
                into += [numbers(x, "<u4") for x in batch.column(i).to_pylist()]
        if not keys:
            return
        sizes = [len(d) for d in docs]
        keys, times, ids, counts = np.concatenate(keys), np.concatenate(times).astype(np.float64), np.concatenate(docs), np.concatenate(counts)
        of = np.repeat(np.arange(len(ids)), counts)
        distinct, which = np.unique(keys, return_inverse=True)
        history = (keys & np.uint64(1)).astype(bool)
        del keys
        aim = (ids == -1)[of]
        target = np.bincount(which[aim], times[aim], len(distinct))
        background = np.bincount(which[~aim], times[~aim], len(distinct))
        # a document's own occurrences are those of all its rows
        own = times.copy()
        _, who, rows = np.unique(ids, return_inverse=True, return_counts=True)
        several = np.flatnonzero(((rows[who] > 1) & (ids != -1))[of])
        if len(several):
            _, pair = np.unique(who[of[several]] * len(distinct) + which[several], return_inverse=True)
            own[several] = np.bincount(pair, times[several])[pair]
        # the loss of a token is log(count of its history + prior) - log(count of its n-gram + prior / V)
        more, sign = np.where(history, prior, prior / vocabulary), np.where(history, times, -times)
        lost = np.bincount(of, sign * np.log(target[which] + more), len(ids))
        base = np.bincount(of, sign * np.log(np.maximum(background[which] - own, 0) + more), len(ids))
        n = np.bincount(of, np.where(history, times, 0), len(ids))
        ends = np.cumsum([0, *sizes])
        put = lambda x: [x[a:b].astype("<f8").tobytes() for a, b in zip(ends[:-1], ends[1:])]
        whole = lambda x: [planes(np.diff(x[a:b].astype(np.int64), prepend=0), "<i8") for a, b in zip(ends[:-1], ends[1:])]
        out = [r for r in zip(lots, whole(ids), put(lost), put(base), whole(n)) if r[0] >= 0]
        for k in range(0, len(out), 256):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out[k : k + 256]), [pa.int64()] + [pa.binary()] * 4)],
                ["chunk", "docs", "target", "background", "n"],
            )

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of lots sorted by chunk, each document's sums over its chunk's lots."""

    def sums(lots):
        docs, *values = (np.concatenate(x) for x in zip(*lots))
        ids, at = np.unique(docs, return_inverse=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids), *(pa.array(np.bincount(at, v, len(ids))) for v in values)], ["row", "target", "background", "n"]
        )

    chunk, held = None, []
    for batch in batches:
        for own, docs, *values in zip(*(c.to_pylist() for c in batch.columns)):
            if own != chunk and held:
                yield sums(held)
                held = []
            chunk = own
            held.append((np.cumsum(numbers(docs, "<i8")), *(np.frombuffer(v, "<f8") for v in values[:2]), np.cumsum(numbers(values[2], "<i8"))))
    if held:
        yield sums(held)


def score(docs: DataFrame, target: DataFrame, order: int = ORDER, prior: float = PRIOR) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) of every row of docs (doc_id, text); target has a text.

    Every n-gram of every document is counted, in one exchange of as many partitions as the words call for; a hot n-gram
    is one entry a document there, next to the partition's others. Sums travel back in lots, one a chunk and partition.
    Rows with equal doc_id are one document whose texts count together; rows with a null doc_id are counted in neither
    model and have a null score, like texts without words. Without target words the target model is even over the
    vocabulary. Very long texts are counted whole. Extra columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    # ids move by one, and below zero by none: -1 is the target's
    row = F.when(F.col("doc_id") >= 0, F.col("doc_id")).otherwise(F.col("doc_id") - 1)
    mine = docs.where("doc_id is not null").select(row.cast("long").alias("row"), "text")
    aims = target.select(F.lit(-1).cast("long").alias("row"), "text")
    words = mine.unionByName(aims).select("text").mapInArrow(_vocabulary, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = words.agg(F.count("*").alias("distinct"), F.sum("n").alias("n")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * (found.n or 0) // KEYS))
    dealt = spark.range(40 * parts + 1000).groupBy(F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts)).alias("p")).agg(
        F.min("id").alias("place")
    ).collect()
    places = np.array([r.place for r in dealt])
    shape = "place int, chunk long, keys binary, times binary, docs binary, counts binary"
    lots = mine.mapInArrow(_lots(order, places, False), shape).unionByName(aims.mapInArrow(_lots(order, places, True), shape))
    lots = lots.repartition(parts, "place").mapInArrow(
        _losses(prior, max(1, found.distinct)), "chunk long, docs binary, target binary, background binary, n binary"
    )
    losses = lots.repartition(parts, "chunk").sortWithinPartitions("chunk").mapInArrow(
        _gather, "row long, target double, background double, n double"
    )
    sums = Kept(spark, "lm").put(losses.groupBy("row").agg(*(F.sum(c).alias(c) for c in ("target", "background", "n"))), "sums")
    out = docs.select("doc_id", row.alias("row")).join(sums, "row", "left")
    mean = lambda c: (F.col(c) / F.col("n")).alias(f"{c}_loss")
    return out.select("doc_id", F.coalesce(F.col("n"), F.lit(0.0)).cast("long").alias("n_tokens"), mean("target"), mean("background")).withColumn(
        "score", F.col("target_loss") - F.col("background_loss")
    )

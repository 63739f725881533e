"""Cost-balanced packing of tokenised documents into fixed-length sequences.

Attention costs a sequence a linear and a quadratic share of each piece's length. A document is cut into full sequences
and a remainder; the remainders of a task's next pool go, in descending order, each to the sequence of lowest cost that
has room for it, and are cut only where none has. A pool opens just as many sequences as its tokens fill; what is left
at a task's end is cut into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches
from .tokens import default_path, encoder

#: Tokens of a sequence; remainders packed together; cost of a token and of a pair of tokens in one piece.
CAPACITY, POOL, LINEAR, QUADRATIC = 1024, 4096, 1.0, 1.0 / 1024
#: The id that ends a document.
END = 0


def capacities(total: int, capacity: int, last: bool) -> list[int]:
    """Sizes of the sequences that a pool fills: full ones, and in a task's last pool powers of two for the rest."""
    sizes = [capacity] * (total // capacity)
    rest = total % capacity if last else 0
    return sizes + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def balance(lengths: list[int], sizes: list[int], linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[
    list[tuple[int, int, int, int, int]], list[tuple[int, int, int]]
]:
    """Placed parts (item, start in item, length, sequence, offset), and the parts (item, start, length) that are left.

    Longest part first, to the sequence of lowest cost (then lowest number) that has room for it whole; where none has,
    the one with most room takes as much as fits and the rest goes back among the parts.
    """
    room, cost = np.array(sizes, np.int64), np.zeros(len(sizes))
    used = [0] * len(sizes)
    heap = [(-n, i, 0) for i, n in enumerate(lengths) if n]
    heapq.heapify(heap)
    placed, left, free = [], [], int(room.sum())
    while heap and free:
        n, i, at = heapq.heappop(heap)
        n = -n
        fits = np.flatnonzero(room >= n)
        if len(fits):
            s = int(fits[np.argmin(cost[fits])])
            take = n
        else:
            s = int(np.argmax(room))
            take = int(room[s])
            heapq.heappush(heap, (take - n, i, at + take))
        placed.append((i, at, take, s, used[s]))
        used[s] += take
        room[s] -= take
        cost[s] += linear * take + quadratic * take * take
        free -= take
    left += [(i, at, -n) for n, i, at in heap]
    return placed, left


def _packed(batches: Iterator[pa.RecordBatch], path: str, capacity: int, pool: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    enc, base, count = encoder(path), TaskContext.get().partitionId() << 36, 0
    rows: list[tuple] = []
    waiting: list[tuple] = []  # doc_id, start, ids as uint32 bytes, tokens of the document

    def piece(doc, start, raw, tokens, sequence, offset):
        rows.append((doc, start, len(raw) // 4, zlib.crc32(raw), tokens, base + sequence, offset))

    def fill(last: bool):
        nonlocal waiting, count
        lengths = [len(w[2]) // 4 for w in waiting]
        sizes = capacities(sum(lengths), capacity, last)
        placed, left = balance(lengths, sizes)
        for i, at, n, s, offset in placed:
            doc, start, raw, tokens = waiting[i]
            piece(doc, start + at, raw[4 * at : 4 * (at + n)], tokens, count + s, offset)
        count += len(sizes)
        waiting = [(waiting[i][0], waiting[i][1] + at, waiting[i][2][4 * at : 4 * (at + n)], waiting[i][3]) for i, at, n in left]

    def out():
        done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)] if rows else [pa.array([], t) for t in TYPES], NAMES)
        rows.clear()
        return done

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = np.append(enc.ids(text.as_py()), END).astype("<u4").tobytes()
            tokens, full = len(ids) // 4, len(ids) // 4 // capacity
            for k in range(full):
                piece(doc, k * capacity, ids[4 * k * capacity : 4 * (k + 1) * capacity], tokens, count, 0)
                count += 1
            if tokens % capacity:
                waiting.append((doc, full * capacity, ids[4 * full * capacity :], tokens))
            if len(waiting) >= pool:
                fill(False)
            if len(rows) >= 20_000:
                yield out()
    fill(True)
    yield out()


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
TYPES = [pa.int64()] * 7
SCHEMA = ", ".join(f"{n} long" for n in NAMES)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, pool: int = POOL) -> DataFrame:
    """One row per piece of every row of docs (doc_id, text; further columns are ignored).

    Null and empty texts are one token, the end. Rows are packed each for itself: repeated rows and equal or null ids
    give pieces of their own. Ties are broken by arrival and sequence number. An empty table gives no rows. capacity
    must be a power of two. sequence_id holds the task's number, so no task waits for another; a task that is run again
    on the same split gives the same pieces.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    path = path or default_path()
    bounded_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(lambda it: _packed(it, path, capacity, pool), SCHEMA)

"""Best-fit-decreasing packing with a segment tree over remaining capacities.

Documents longer than a sequence are split without loss into full sequences and a rest. The pieces of a task's pool are
taken longest first; a segment tree over the capacities 0..C says in log C steps which open sequence leaves least room.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches
from .tokens import default_path, encoder

#: Tokens of a sequence; pieces packed together; the id after each document and the one that pads.
CAPACITY, POOL, END, PAD = 1024, 8192, 0, 50256


class Room:
    """Open bins by remaining capacity; the smallest capacity of at least n is found by walking a segment tree."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)  # bins below a node
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _count(self, room: int, by: int) -> None:
        node = self.size + room
        while node:
            self.tree[node] += by
            node >>= 1

    def put(self, bin_: int, room: int) -> None:
        self.bins[room].append(bin_)
        self._count(room, 1)

    def take(self, n: int) -> tuple[int, int] | None:
        """The bin with the least room of at least n, and that room; it leaves the tree."""
        node = self.size + n
        if not self.tree[node]:
            while node > 1 and (node & 1 or not self.tree[node ^ 1]):
                node >>= 1
            if node <= 1:
                return None
            node ^= 1
            while node < self.size:
                node = 2 * node if self.tree[2 * node] else 2 * node + 1
        room = node - self.size
        bin_ = self.bins[room].pop()
        self._count(room, -1)
        return bin_, room


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Items of each bin, by best fit over descending lengths (ties by position)."""
    open_, bins = Room(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = open_.take(lengths[i])
        if found is None:
            found = len(bins), capacity
            bins.append([])
        bins[found[0]].append(i)
        open_.put(found[0], found[1] - lengths[i])
    return bins


NAMES = ["sequence_id", "n_tokens", "ids", "positions", "cu_seqlens", "doc_ids", "starts"]
TYPES = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
SCHEMA = "sequence_id long, n_tokens int, ids binary, positions binary, cu_seqlens array<int>, doc_ids array<long>, starts array<long>"


def _packed(batches: Iterator[pa.RecordBatch], path: str, capacity: int, pool: int, end: int, pad: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    enc, count, pieces = encoder(path), TaskContext.get().partitionId() << 36, []
    blank = np.full(capacity, pad, "<u2").tobytes()

    def out():
        nonlocal count, pieces
        rows = []
        for items in best_fit([len(p[2]) // 2 for p in pieces], capacity):
            raw = b"".join(pieces[i][2] for i in items)
            cuts = np.cumsum([0, *(len(pieces[i][2]) // 2 for i in items)], dtype=np.int32)
            rows.append(
                (
                    count,
                    len(raw) // 2,
                    raw + blank[len(raw) :],
                    position_ids(cuts, capacity).astype("<u2").tobytes(),
                    cuts,
                    [pieces[i][0] for i in items],
                    [pieces[i][1] for i in items],
                )
            )
            count += 1
        pieces = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)] if rows else [pa.array([], t) for t in TYPES], NAMES)

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = enc.raw(text.as_py()) + end.to_bytes(2, "little")
            pieces += [(doc, at // 2, raw[at : at + 2 * capacity]) for at in range(0, len(raw), 2 * capacity)]
            if len(pieces) >= pool:
                yield out()
    yield out()


def pack_matrix(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, pool: int = POOL, end: int = END, pad: int = PAD) -> DataFrame:
    """One row per sequence: ids and positions (little-endian uint16, as many as capacity), the cumulative lengths of its
    segments, and each segment's document and start in it. Positions restart from 0 at each segment and at the padding.

    Null and empty texts are the end id alone; repeated rows and null ids are packed like any other; an empty table
    gives no rows; further columns are ignored. Pools are a task's own, so memory is bounded and nothing is shuffled.
    """
    if not 1 <= capacity <= 1 << 16:
        raise ValueError("capacity must be from 1 to 65536, so that positions fit 16 bits")
    path = path or default_path()
    bounded_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(lambda it: _packed(it, path, capacity, pool, end, pad), SCHEMA)


def position_ids(cu_seqlens: list[int], capacity: int = CAPACITY) -> np.ndarray:
    """Positions of a sequence, from 0 at each segment; padding is a segment of its own."""
    lengths = np.diff([*cu_seqlens, capacity])
    return np.arange(capacity) - np.repeat([*cu_seqlens[:-1], cu_seqlens[-1]], lengths)


def write_matrix(packed: DataFrame, path: str) -> None:
    """The rows as Parquet; a file's matrix of ids, or of positions, is np.frombuffer(b"".join(ids), "<u2").reshape(-1, capacity)."""
    packed.write.parquet(path)

"""Word and shingle hashes of many texts at once, straight from Arrow's buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at once; a longer text is a chunk of its own and hashed in segments.
CHUNK = 2 << 20
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # splitmix64's multipliers


def mix(x):
    x = np.atleast_1d(np.asarray(x, np.uint64))
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A random word for each byte; white space counts nothing.
_BYTE = mix(_LOWER.astype(np.uint64) + np.uint64(1))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE[_SPACE] = 0


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null texts are empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], text: int, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts hold about `limit` bytes, or one text."""
    for batch in batches:
        _, offsets = text_buffer(batch.column(text))
        at = 0
        while at < len(batch):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def word_hashes(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (ASCII white space apart, A-Z lowered), and how many words each text has."""
    hashes, starts, at = [], [], 0
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    while at < len(data):
        to = min(len(data), at + 2 * limit)
        if to < len(data):  # cut where a word ends
            ends = np.flatnonzero(_SPACE[data[at:to]] | first[at + 1 : to + 1])
            while not len(ends) and to < len(data):
                to = min(len(data), to + 2 * limit)
                ends = np.flatnonzero(_SPACE[data[at:to]] | first[at + 1 : to + 1])
            to = at + int(ends[-1]) + 1 if len(ends) else to
        b = data[at:to]
        space = _SPACE[b]
        start = ~space
        start[1:] &= space[:-1] | first[at + 1 : to]
        begin = np.flatnonzero(start)
        if len(begin):
            b = b[begin[0] :]
            length = np.diff(np.append(begin, to - at))
            place = np.arange(begin[0], to - at) - np.repeat(begin, length)
            power = mix(np.arange(1, int(length.max()) + 2, dtype=np.uint64)) | np.uint64(1)
            hashes.append(mix(np.add.reduceat(_BYTE[b] * power[place], begin - begin[0])))
            starts.append(begin + at)
        at = to
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    starts = np.concatenate(starts)
    return np.concatenate(hashes), np.diff(np.searchsorted(starts, offsets))


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each text's sorted distinct hashes of k-word shingles; of fewer words, the whole sequence."""
    data, offsets = text_buffer(texts)
    words, n_words = word_hashes(data, offsets)
    ends = np.cumsum(n_words)
    place = np.arange(len(words)) - np.repeat(ends - n_words, n_words)
    total = np.repeat(n_words, n_words)
    out = np.minimum(total, k).astype(np.uint64)
    power = mix(np.arange(101, 101 + k, dtype=np.uint64)) | np.uint64(1)
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    for j in range(k):
        out += np.where(place + j < total, padded[j : j + len(words)], np.uint64(0)) * power[j]
    valid = place <= np.maximum(total - k, 0)
    out = mix(out[valid])
    counts = np.where(n_words > 0, np.maximum(n_words - k, 0) + 1, 0)
    cuts = np.concatenate([[0], np.cumsum(counts)])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        out[a:b].sort()
    distinct = np.ones(len(out), bool)
    distinct[1:] = out[1:] != out[:-1]
    distinct[cuts[:-1][counts > 0]] = True
    kept = np.concatenate([[0], np.cumsum(distinct)])
    return out[distinct], kept[cuts]


def planes(x: np.ndarray, kind: str) -> bytes:
    """The numbers' first bytes, then their second ones and so on: high bytes are mostly equal and shrink in a shuffle."""
    raw = x.astype(kind)
    return raw.view(np.uint8).reshape(-1, raw.itemsize).T.tobytes()


def numbers(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()

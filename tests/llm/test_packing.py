import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assayfold.llm import bestfit_packing as bf
from assayfold.llm import cost_packing as cp
from assayfold.llm.tokens import default_path, encoder
from helpers import ODD, documents, frame


def whole_ids(text):
    return [*encoder(default_path()).whole.encode(text or "", add_special_tokens=False).ids, 0]


@given(st.text(alphabet="ab Z'é\n\t 1.,! 中s", max_size=40))
@settings(max_examples=300, deadline=None)
def test_ids_are_the_tokenizers(text):
    assert encoder(default_path()).ids(text).tolist() == whole_ids(text)[:-1]


def check_pieces(rows, docs, capacity=1024):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    padding = 0
    for seq in sequences.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert padding == 0
    texts = defaultdict(list)
    for i, t in docs:
        ids = whole_ids(t)
        texts[i, len(ids)].append(ids)
    covered = {k: np.zeros(k[1], int) for k in texts}
    for i, own in pieces.items():
        for r in own:  # of an id, texts of equal length are equal here
            ids = texts[i, r.doc_tokens][0][r.start : r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and len(ids) == r.length
            covered[i, r.doc_tokens][r.start : r.start + r.length] += 1
    assert all((covered[k] == len(t)).all() for k, t in texts.items())


def test_every_id_once(spark, sf):
    docs = [(i, t) for i, t, _ in documents(sf)]
    check_pieces(cp.pack(frame(spark, docs)).collect(), docs)


def test_odd_rows(spark):
    rows = [*ODD, (16, "z " * 5000), (16, "z " * 5000)]
    check_pieces(cp.pack(frame(spark, rows)).collect(), rows)
    check_pieces(cp.pack(frame(spark, rows).coalesce(1), pool=3).collect(), rows)
    assert cp.pack(frame(spark, ODD).where("false")).count() == 0
    with pytest.raises(ValueError):
        cp.pack(frame(spark, ODD), capacity=1000)


@given(st.lists(st.integers(1, 64), max_size=60), st.booleans())
@settings(max_examples=200, deadline=None)
def test_balance_places_all(lengths, last):
    sizes = cp.capacities(sum(lengths), 64, last)
    placed, left = cp.balance(lengths, sizes)
    assert sum(n for _, _, n, _, _ in placed) == sum(sizes) and sum(n for *_, n in left) == sum(lengths) - sum(sizes)


@given(st.lists(st.integers(1, 64), max_size=80))
@settings(max_examples=200, deadline=None)
def test_best_fit_equals_brute_force(lengths):
    room, want = [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [r for r in room if r >= lengths[i]]
        if fits:
            room[room.index(min(fits))] -= lengths[i]
        else:
            room.append(64 - lengths[i])
    bins = bf.best_fit(lengths, 64)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert sorted(64 - sum(lengths[i] for i in b) for b in bins) == sorted(room)


def test_matrix_round_trip(spark, sf):
    docs = [(i, t) for i, t, _ in documents(sf)] + [(-1, None), (-2, ""), (-3, "x y " * 4000)]
    parts = defaultdict(list)
    for r in bf.pack_matrix(frame(spark, docs)).collect():
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == 1024 and (ids[r.n_tokens :] == bf.PAD).all() and r.cu_seqlens[-1] == r.n_tokens
        position = np.frombuffer(r.positions, "<u2")
        assert (position[r.n_tokens :] == np.arange(1024 - r.n_tokens)).all()
        assert all(position[a] == 0 and position[b - 1] == b - a - 1 for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]))
        for i, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            parts[i].append((start, ids[a:b].tolist()))
    assert {i: [x for _, p in sorted(ps) for x in p] for i, ps in parts.items()} == {i: whole_ids(t) for i, t in docs}
    assert bf.pack_matrix(frame(spark, docs).where("false")).count() == 0


def test_matrix_odd_rows(spark, tmp_path):
    """Null ids and repeated rows are packed like any other; the written matrix is read back."""
    path = f"{tmp_path}/matrix"
    bf.write_matrix(bf.pack_matrix(frame(spark, ODD).coalesce(1)), path)
    got, rows = Counter(), spark.read.parquet(path).collect()
    matrix = np.frombuffer(b"".join(r.ids for r in rows), "<u2").reshape(-1, 1024)
    for line, r in zip(matrix, rows, strict=True):
        for i, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            got[i, start, tuple(line[a:b].tolist())] += 1
    want = Counter()
    for i, t in ODD:
        ids = whole_ids(t)
        want.update((i, at, tuple(ids[at : at + 1024])) for at in range(0, len(ids), 1024))
    assert got == want
    with pytest.raises(ValueError):
        bf.pack_matrix(frame(spark, ODD), capacity=1 << 17)

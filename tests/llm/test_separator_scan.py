from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from assayfold.llm import queries
from assayfold.llm import separator_scan as ss
from assayfold.llm.common import new_path
from assayfold.llm.tokens import default_path, encoder
from helpers import ODD, documents, frame


@pytest.mark.parametrize("block", [2, 6, 1 << 12, 4 << 20])
def test_stitching(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    files = {"a": [3, 0, 5, 0, 0, 7], "b": [0], "c": [40, 1, 0], "d": rng.integers(0, 9, 300).tolist()}
    for name, lengths in files.items():
        ids = np.concatenate([np.append(np.ones(n), 0) for n in lengths]).astype("<u2")
        (tmp_path / name).write_bytes((ids[:-1] if name == "c" else ids).tobytes() if name != "d" else ids.tobytes() + np.ones(11, "<u2").tobytes())
    (tmp_path / "e").write_bytes(b"")
    files["c"] = files["c"][:-1]  # its last document is empty and has no end: nothing stands there
    files["d"].append(11)
    if block == 2:
        files = {k: files[k] for k in files}
    got = {}
    for r in ss.count_tokens(spark, str(tmp_path), block).collect():
        got.setdefault(r.file, {})[r.ordinal] = r.n_tokens
    assert {f: [d[k] for k in sorted(d)] for f, d in got.items()} == files
    assert all(sorted(d) == list(range(len(d))) for d in got.values())


def test_documents(spark, sf):
    rows = [(i, t) for i, t, _ in documents(sf)] + ODD
    path = new_path(spark, "test")
    ss.write_token_files(frame(spark, rows), path)
    got = Counter((r.doc_id, r.n_tokens) for r in ss.count_by_document(spark, path, 1 << 14).collect())
    enc = encoder(default_path()).whole
    assert got == Counter((i, len(enc.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)


def test_query_counts_by_document(spark, tmp_path):
    """Every document's own count, over several splits and files."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs.repartition(5, "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op4_separator_scan(spark, str(tmp_path)).collect()
    enc = encoder(default_path()).whole
    assert len({r.part for r in got}) > 1
    assert sorted((r.doc_id, r.n_tokens) for r in got) == sorted((r.doc_id, len(enc.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())


def test_splits_may_change_in_between(spark, tmp_path):
    """Ids lie beside the tokens: how the table is split by a later scan does not matter, and a lost file is noticed."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(24)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.files.minPartitionNum", None)
    path = new_path(spark, "test")
    try:
        spark.conf.set("spark.sql.files.minPartitionNum", "4")
        ss.write_token_files(spark.read.parquet(f"{tmp_path}/documents.parquet"), path)
        spark.conf.set("spark.sql.files.minPartitionNum", "3")
        got = {r.doc_id: r.n_tokens for r in ss.count_by_document(spark, path).collect()}
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum") if before is None else spark.conf.set("spark.sql.files.minPartitionNum", before)
    enc = encoder(default_path()).whole
    assert got == {r.doc_id: len(enc.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()}
    lost = next(f for f in (Path(path.removeprefix("file:").replace("//", "/", 1)) / "kind=tokens").glob("part-*"))
    lost.unlink()
    with pytest.raises(Exception, match="differ in"):
        ss.count_by_document(spark, path).collect()


def test_query_takes_odd_rows(spark, tmp_path):
    frame(spark, ODD).write.parquet(f"{tmp_path}/documents.parquet")
    enc = encoder(default_path()).whole
    got = Counter((r.doc_id, r.n_tokens) for r in queries.op4_separator_scan(spark, str(tmp_path)).collect())
    assert got == Counter((i, len(enc.encode(t or "", add_special_tokens=False).ids)) for i, t in ODD)


def test_nothing(spark):
    path = new_path(spark, "test")
    ss.write_token_files(frame(spark, ODD).where("false"), path)
    assert ss.count_by_document(spark, path).count() == 0
    with pytest.raises(ValueError):
        ss.count_tokens(spark, path, 3)

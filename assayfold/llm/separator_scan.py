"""Token counts of flat token files that have no index: find the end-of-document ids, stitch documents across blocks.

A file is little-endian uint16 ids; id 0 ends a document. Ids of the vocabulary are stored plus one, for 0 is a sign of
the vocabulary too. Blocks are read at fixed offsets, each searched with one vectorised comparison; a block knows only
the distances between its own separators. The tokens that a document has in earlier blocks come from a prefix scan over
one small row per block. The ids of the documents lie beside the tokens, written by the same task in the same order and
committed with them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Kept, bounded_batches
from .tokens import default_path, encoder

#: Bytes of a block.
BLOCK = 4 << 20


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Flat files of the ids of docs' texts under path/kind=tokens, one a task, through Spark's own committer; and beside each
    a file of the same name under path/kind=ids, with `<ordinal> <doc_id>` for each document of it.

    The text sink writes a value's bytes as they are and then the line separator, here the two zero bytes of the
    end-of-document id. Null and empty texts are documents without ids; a null doc_id is written as nothing; repeated
    rows are documents of their own. Other columns, whatever their names, are ignored; an empty table writes no tokens.
    """
    tokenizer = tokenizer or default_path()
    bounded_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, ordinal = encoder(tokenizer), 0
        for batch in batches:
            for at in range(0, len(batch), 1000):
                ids, texts = batch.column(0).slice(at, 1000).to_pylist(), batch.column(1).slice(at, 1000)
                tokens = [(enc.ids(t.as_py()) + np.uint16(1)).astype("<u2").tobytes() for t in texts]
                names = [f"{ordinal + k} {'' if i is None else i}".encode() for k, i in enumerate(ids)]
                numbers = np.arange(ordinal, ordinal + len(ids))
                kinds = pa.array(["ids"] * len(ids) + ["tokens"] * len(ids))
                yield pa.RecordBatch.from_arrays(
                    [kinds, pa.array(np.tile(numbers, 2)), pa.array(names + tokens, pa.binary())], ["kind", "ordinal", "value"]
                )
                ordinal += len(ids)

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "kind string, ordinal long, value binary")
    # the order that the writer asks for, with the documents' own within
    dealt = dealt.sortWithinPartitions("kind", "ordinal").select("kind", F.col("value").cast("string").alias("value"))
    dealt.write.option("lineSep", "\0\0").partitionBy("kind").text(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(file, ordinal, doc_id) of every document that `write_token_files` has written under path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/kind=ids")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "file string, ordinal long, doc_id long")
    lines = spark.read.option("lineSep", "\0\0").text(f"{path}/kind=ids").select(
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.split("value", " ").alias("x")
    )
    return lines.select("file", F.col("x")[0].cast("long").alias("ordinal"), F.when(F.col("x")[1] != "", F.col("x")[1].cast("long")).alias("doc_id"))


def count_by_document(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """(doc_id, file, ordinal, n_tokens) of the documents that `write_token_files` has written under path.

    Counts come from the flat files alone, ids from beside them; a file whose counts and ids differ in number stops the
    job. Rows with a null doc_id, and repeated ones, are documents like others."""
    counts, ids = count_tokens(spark, f"{path}/kind=tokens", block), read_ids(spark, path)
    both = counts.withColumn("_c", F.lit(True)).join(ids.withColumn("_i", F.lit(True)).hint("merge"), ["file", "ordinal"], "full")
    lost = F.raise_error(F.concat(F.lit("documents and counts differ in "), "file")).cast("long")
    return both.select("doc_id", "file", "ordinal", F.when(F.col("_c") & F.col("_i"), F.col("n_tokens")).otherwise(lost).alias("n_tokens"))


def list_blocks(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """(file, block, at, length): where each file's blocks lie. Only names and lengths of files reach the driver."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    there = fs.listStatus(where) if fs.exists(where) else []
    files = [
        (str(f.getPath().toString()), f.getLen()) for f in there if f.isFile() and not f.getPath().getName().startswith(("_", ".")) and f.getLen()
    ]
    frame = spark.createDataFrame(files, "file string, bytes long")
    frame = frame.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("bytes") - 1) / block))))
    return frame.select(
        "file", "block", (F.col("block") * block).alias("at"), F.least(F.lit(block), F.col("bytes") - F.col("block") * block).alias("length")
    )


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow.fs

    for batch in batches:
        for file, block, at, length in zip(*(c.to_pylist() for c in batch.columns)):
            fs, name = pyarrow.fs.FileSystem.from_uri(file)
            with fs.open_input_file(name) as f:
                ids = np.frombuffer(f.read_at(length, at), "<u2")
            ends = np.flatnonzero(ids == 0)
            lengths = np.diff(ends, prepend=-1) - 1  # the first lacks what stands in earlier blocks
            tail = len(ids) - (int(ends[-1]) + 1 if len(ends) else 0)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([file]),
                    pa.array([block], pa.int64()),
                    pa.array([len(ends)], pa.int64()),
                    pa.array([tail], pa.int64()),
                    pa.array([lengths], pa.list_(pa.int64())),
                ],
                ["file", "block", "n_ends", "tail", "lengths"],
            )


def count_tokens(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """(file, ordinal, n_tokens) of every document of the files under path; the end ids are not counted.

    Ordinals count a file's documents from 0. Ids after a file's last separator are a document without an end and are
    returned too. Empty files, and a folder without files, give no rows. block must be even.
    """
    if block < 2 or block % 2:
        raise ValueError("block must be a positive even number of bytes")
    blocks = list_blocks(spark, path, block)
    tasks = max(1, min(blocks.count(), 4 * spark.sparkContext.defaultParallelism))
    kept = Kept(spark, "blocks")
    found = kept.put(
        blocks.repartition(tasks, "file", "block").mapInArrow(_scan, "file string, block long, n_ends long, tail long, lengths array<long>"), "found"
    )
    # the prefix scan is over two numbers a block: separators before it, and tokens since the last of them
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    since = W.partitionBy("file", "first").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    small = found.select("file", "block", "n_ends", "tail").withColumn("first", F.coalesce(F.sum("n_ends").over(before), F.lit(0)))
    small = small.withColumn("last_tail", F.lag("tail").over(W.partitionBy("file").orderBy("block")))
    small = small.withColumns(
        {
            "carried": F.coalesce(F.sum("tail").over(since), F.lit(0)),
            "opens": F.coalesce(F.first("last_tail").over(W.partitionBy("file", "first").orderBy("block")), F.lit(0)),
            "is_last": F.lead("block").over(W.partitionBy("file").orderBy("block")).isNull(),
        }
    )
    stitched = found.select("file", "block", "lengths").join(small, ["file", "block"])
    carry = F.when(F.col("n_ends") > 0, F.col("opens") + F.col("carried")).otherwise(F.col("opens") + F.col("carried") + F.col("tail"))
    rest = F.when(F.col("n_ends") > 0, F.col("tail")).otherwise(carry)
    more = lambda n, i: n + F.when(i == 0, F.col("opens") + F.col("carried")).otherwise(0)
    own = F.transform("lengths", lambda n, i: F.struct((F.col("first") + i).alias("ordinal"), more(n, i).alias("n_tokens")))
    nothing = F.expr("cast(array() as array<struct<ordinal: bigint, n_tokens: bigint>>)")
    open_end = F.when(
        F.col("is_last") & (rest > 0), F.array(F.struct((F.col("first") + F.col("n_ends")).alias("ordinal"), rest.alias("n_tokens")))
    ).otherwise(nothing)
    each = stitched.select(F.element_at(F.split("file", "/"), -1).alias("file"), F.explode(F.concat(own, open_end)).alias("d"))
    return each.select("file", F.col("d.ordinal").alias("ordinal"), F.col("d.n_tokens").alias("n_tokens"))

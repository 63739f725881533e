"""Shared pieces: table access, written intermediates in the cluster's shared folder, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words in the shingle, quality and size contracts (bytes 0x20 and 0x09-0x0D).
SPACE = "[\\x20\\x09-\\x0D]+"
#: A word of those contracts.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, set here only where it is unset (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="assayfold-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


#: Bytes of an Arrow batch between the JVM and Python.
BATCH = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to BATCH bytes: with Spark's 64 MB, or 10,000 long texts, a task's copies of one
    batch on either side take a good part of an executor's memory. A smaller setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)\s*([kmgt]?)b?", spark.conf.get(name, "64m").lower()).groups()
    size = int(number) * 1024 ** " kmgt".index(unit or " ")
    if size <= 0 or size > BATCH:
        spark.conf.set(name, str(BATCH))


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


class Kept:
    """Written intermediates of one operator run: each cuts the lineage and survives lost executors."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.tag, self.paths = spark, tag, {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, f"{self.tag}-{name}")
        df.write.parquet(path)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str, keep_last: int = 0) -> None:
        """Delete what was written under a name and is no longer read."""
        paths = self.paths.get(name, [])
        gone, self.paths[name] = paths[: len(paths) - keep_last], paths[len(paths) - keep_last :]
        for path in gone:
            delete(self.spark, path)

    def drop_but(self, *names: str) -> None:
        """Delete all that was written but what stands under these names, which the result still reads."""
        for name in self.paths:
            if name not in names:
                self.drop(name)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def free_shuffles(spark: SparkSession) -> None:
    """Ask the driver to collect garbage, so that finished shuffles' files are removed from executors now."""
    spark._jvm.System.gc()


def connected_components(edges: DataFrame, kept: Kept, max_rounds: int = 60) -> DataFrame:
    """(id, comp) of every id on an edge; comp is the smallest id reachable. edges: a, b (long, not null).

    Alternating large-star and small-star steps: each is one aggregate and one join over the edges, a hub's
    neighbours meet only its minimum, and AQE splits a hub's side of the join. Ids without an edge are not returned.
    """
    edges = kept.put(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    before = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # links to a node's minimum replace its links to larger neighbours; its own link to the minimum stays
        large = large.unionByName(low.where("m < a").select("a", F.col("m").alias("b"))).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = kept.put(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "cc")
        kept.drop("cc", 1)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    rows = edges.select(F.col("a").alias("id"), F.col("b").alias("comp")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("comp")))
    return rows.groupBy("id").agg(F.min("comp").alias("comp"))

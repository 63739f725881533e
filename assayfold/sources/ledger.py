"""Append-only ledger of answers: one JSON line a record, in any Hadoop file system; the last record of a key wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayfold.errors import AssayError

FORMAT = 5
RECORD = "ledger_format int, model string, k string, p double, l string, t string, d map<string,double>, c double, i int, n int, s double, seq long, _corrupt string"


class NotALedger(AssayError):
    """A folder that holds something else than a ledger of this format."""


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything stands at the path; an empty folder is nothing yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(where) and any(not f.getPath().getName().startswith(("_", ".")) for f in fs.listStatus(where))


def next_seq(spark: SparkSession, path: str) -> int:
    """A number above all that the ledger's batches have, whichever run wrote them."""
    if not exists(spark, path):
        return 0
    last = spark.read.schema(RECORD).json(path).agg(F.max("seq")).first()[0]
    return 0 if last is None else last + 1


def append(answers: DataFrame, path: str, seq: int, model: str) -> None:
    """Bank the usable answers of a batch; failures are never banked. The record with the largest seq wins;
    `next_seq` numbers batches across runs."""
    header = answers.sparkSession.createDataFrame([(FORMAT, model)], "ledger_format int, model string")
    rows = answers.where("error is null").select(
        F.col("key").alias("k"),
        "p",
        F.col("label").alias("l"),
        F.col("kind").alias("t"),
        F.col("distribution").alias("d"),
        F.col("confidence").alias("c"),
        F.col("position").alias("i"),
        F.col("packed").alias("n"),
        F.col("score").alias("s"),
        F.lit(seq).cast("long").alias("seq"),
    )
    rows.unionByName(header, allowMissingColumns=True).write.mode("append").json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """key and answer columns; torn lines are left out, folders without a header or of another format are refused."""
    lines = spark.read.schema(RECORD).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    formats = [r[0] for r in lines.where("ledger_format is not null").select("ledger_format").distinct().collect()]
    if formats != [FORMAT]:
        raise NotALedger(f"{path} is not a ledger of format {FORMAT}")
    last = lines.where("k is not null and l is not null and _corrupt is null").groupBy("k").agg(
        F.max_by(F.struct("p", "l", "t", "d", "c", "i", "n", "s"), "seq").alias("r")
    )
    return last.select(
        F.col("k").alias("key"),
        F.col("r.p").alias("p"),
        F.col("r.l").alias("label"),
        F.col("r.t").alias("kind"),
        F.col("r.d").alias("distribution"),
        F.col("r.c").alias("confidence"),
        F.col("r.i").alias("position"),
        F.col("r.n").alias("packed"),
        F.col("r.s").alias("score"),
    )

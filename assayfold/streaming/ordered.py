"""Rows of a stream handed on in the order of their positions, each once, as soon as all before them are there.

The state is a folder: the position up to which all is handed on, and the rows beyond it that came early. A batch reads the state
that the batch before it left and writes its own under its number, so a batch that is run again gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Positions of a block: counts of blocks say where the first gap may be, and only that block is looked at.
BLOCK = 4096


def first_gap(rows: DataFrame, start: int, block: int = BLOCK) -> int:
    """The smallest position from `start` on that rows (pos, all different) lack."""
    offset = F.col("pos") - start
    counts = rows.where(F.col("pos") >= start).groupBy(F.floor(offset / block).alias("b")).agg(F.count("*").alias("n"))
    full = counts.where(F.col("n") == block)
    # the first block that is not full: the least whose number is not among the full ones
    after = full.select((F.col("b") + 1).alias("b")).join(full.select("b"), "b", "left_anti").agg(F.min("b")).first()[0]
    begun = full.where("b = 0").limit(1).count()
    b = after if begun and after is not None else 0
    low = start + b * block
    here = [r[0] for r in rows.where((F.col("pos") >= low) & (F.col("pos") < low + block)).select("pos").collect()]  # block positions at most
    return min(set(range(low, low + block)) - set(here))


class Frontier:
    """The frontier of a stream, kept at a path."""

    def __init__(self, spark: SparkSession, path: str, start: int = 0):
        self.spark, self.path, self.begin = spark, path.rstrip("/"), start
        jvm = spark._jvm.org.apache.hadoop.fs
        self._path = lambda *parts: jvm.Path("/".join((self.path, *parts)))
        self.fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        where = self._path("state")
        found = self.fs.listStatus(where) if self.fs.exists(where) else []
        # a batch's state counts when its frontier is written, which comes last
        return sorted(
            int(f.getPath().getName().partition("=")[2])
            for f in found if self.fs.exists(self._path("state", f.getPath().getName(), "at", "_SUCCESS"))
        )

    def at(self, before: int | None = None) -> tuple[int, int | None]:
        """(first position not handed on yet, number of the batch that says so), of all batches or those before one."""
        last = max((n for n in self._numbers() if before is None or n < before), default=None)
        return (self.begin, None) if last is None else (
            self.spark.read.parquet(self._path("state", f"batch={last}", "at").toString()).first().at, last
        )

    def advance(self, rows: DataFrame, number: int) -> DataFrame:
        """The rows that batch `number` lets go, in order, out of its own (pos and more) and those held back before; they are written
        to out/batch=number. Positions that were handed on before are left out, of rows that share one the first of the
        batch's plan stays."""
        start, last = self.at(before=number)
        every = rows.where(F.col("pos") >= start).dropDuplicates(["pos"])
        if last is not None:
            held = self.spark.read.schema(rows.schema).parquet(self._path("state", f"batch={last}", "held").toString())
            every = held.unionByName(every.join(held.select("pos"), "pos", "left_anti"))
        own = self._path("state", f"batch={number}")
        every.write.mode("overwrite").parquet(f"{own.toString()}/all")
        every = self.spark.read.schema(rows.schema).parquet(f"{own.toString()}/all")
        gap = first_gap(every, start)
        out = self._path("out", f"batch={number}").toString()
        every.where(F.col("pos") < gap).orderBy("pos").write.mode("overwrite").parquet(out)
        every.where(F.col("pos") >= gap).write.mode("overwrite").parquet(f"{own.toString()}/held")
        self.spark.createDataFrame([(gap,)], "at long").coalesce(1).write.mode("overwrite").parquet(f"{own.toString()}/at")
        self.fs.delete(self._path("state", f"batch={number}", "all"), True)
        for old in self._numbers():
            if old < number - 1 and old != last:  # the last batch may be run again, and then reads the one before it
                self.fs.delete(self._path("state", f"batch={old}"), True)
        return self.spark.read.schema(rows.schema).parquet(out)

    def handed_on(self) -> DataFrame:
        """All rows handed on so far, with the batch that let them go."""
        return self.spark.read.parquet(self._path("out").toString())

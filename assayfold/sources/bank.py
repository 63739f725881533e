"""Answers by key that can be asked without being read whole.

A bank is a folder in any Hadoop file system:

    header.json            format, digits of a bucket, and the model it was begun with
    recent/seq=7/          a batch's answers as they came, one write a batch
    sorted/bucket=3f/      answers by the first digits of their keys, sorted by key, with a Bloom filter over the keys

A batch is appended to `recent` alone, so banking costs one small write. `fold` deals recent batches into buckets, and
rewrites buckets that have gathered many files, keeping the last record of each key. A lookup reads recent batches, of which `fold`
leaves few, and the buckets that its keys fall into; whether a key is there at all is read from the keys alone.

The record with the largest batch number wins, wherever it lies. So every step can be cut off and repeated: a batch that
is banked twice, and records that stand in both places because a fold ended half way, change no answer. One job at a time
may write to a bank.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayfold.errors import AssayError

#: Format of the folder; hex digits of a bucket's name; recent batches, and files of a bucket, from which a fold sets in;
#: keys that a lookup may hand to the scan by name.
FORMAT, DIGITS, RECENT, FILES, NAMED = 1, 2, 16, 8, 10
RECORD = "key string, seq long, label string, kind string, p double, distribution map<string,double>, confidence double, position int, packed int, score double"
ANSWER = [c.split()[0] for c in RECORD.split(", ")][2:]


class NotABank(AssayError):
    """A folder that holds something else than a bank of this format."""


class Bank:
    """A bank at a path, made there if nothing is; a folder with other things in it is refused."""

    def __init__(self, spark: SparkSession, path: str, model: str = "default", digits: int = DIGITS):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm.org.apache.hadoop.fs
        self._path = lambda *parts: jvm.Path("/".join((self.path, *parts)))
        self.fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())
        header = self._path("header.json")
        if self.fs.exists(header):
            try:
                found = json.loads(spark.read.text(header.toString()).first().value)
            except (ValueError, AttributeError):
                found = None
            if not isinstance(found, dict) or found.get("bank_format") != FORMAT:
                raise NotABank(f"{path} is not a bank of format {FORMAT}: {found}")
            self.digits, self.model = found["digits"], found["model"]
            return
        if self.names():
            raise NotABank(f"{path} holds something, and it is not a bank")
        self.digits, self.model = digits, model
        out = self.fs.create(header, False)
        out.write(bytearray(json.dumps({"bank_format": FORMAT, "digits": digits, "model": model}).encode()))
        out.close()

    def names(self, *below: str) -> list[str]:
        """What stands in the folder, or below it."""
        where = self._path(*below)
        found = self.fs.listStatus(where) if self.fs.exists(where) else []
        return sorted(n for n in (f.getPath().getName() for f in found) if not n.startswith(("_", ".")))

    def batches(self) -> list[int]:
        return sorted(int(n.partition("=")[2]) for n in self.names("recent"))

    def next_seq(self) -> int:
        """A number above that of every batch, folded ones too, whichever run wrote them: the names of batches, and one
        number a bucket's file, from its statistics."""
        last = max(self.batches(), default=-1)
        stored = self._stored(self.names("sorted"))
        if stored is not None:
            last = max(last, stored.agg(F.max("seq")).first()[0] or -1)
        return last + 1

    def append(self, answers: DataFrame, seq: int) -> None:
        """Bank the usable answers (key, label, kind, p, ...) of a batch under its number; failures are never banked. A batch
        that is banked again under its number takes the place of what was there."""
        rows = answers.where("error is null") if "error" in answers.columns else answers
        there = set(rows.columns)
        kinds = dict(c.split(" ", 1) for c in RECORD.split(", "))
        rows = rows.select(
            F.col("key").cast("string").alias("key"),
            F.lit(seq).cast("long").alias("seq"),
            *((F.col(c) if c in there else F.lit(None)).cast(kinds[c]).alias(c) for c in ANSWER),
        )
        rows.write.mode("overwrite").parquet(self._path("recent", f"seq={seq}").toString())

    def _recent(self) -> DataFrame | None:
        batches = self.batches()
        return self.spark.read.schema(RECORD).parquet(*(self._path("recent", f"seq={n}").toString() for n in batches)) if batches else None

    def _stored(self, buckets: Iterable[str]) -> DataFrame | None:
        """The records of buckets (names of folders); no other folder is opened or listed."""
        paths = [self._path("sorted", b).toString() for b in buckets]
        return self.spark.read.schema(RECORD).option("basePath", self._path("sorted").toString()).parquet(*paths).select(
            *[c.split()[0] for c in RECORD.split(", ")]
        ) if paths else None

    def _bucket(self, key: Column) -> Column:
        return F.substring(key, 1, self.digits)

    def _records(self, keys: DataFrame | None) -> DataFrame:
        """Records that a lookup of these keys (of all, without) has to read."""
        known = set(self.names("sorted"))
        if keys is not None and known:
            hit = {f"bucket={r[0]}" for r in keys.select(self._bucket(F.col("key"))).distinct().collect()}  # 16 ** digits at most
            known &= hit
        parts = [p for p in (self._recent(), self._stored(sorted(known))) if p is not None]
        return self.spark.createDataFrame([], RECORD) if not parts else parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    @staticmethod
    def _last(records: DataFrame) -> DataFrame:
        last = records.groupBy("key").agg(F.max_by(F.struct(*ANSWER), "seq").alias("r"))
        return last.select("key", *(F.col(f"r.{c}").alias(c) for c in ANSWER))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The last answers to keys (key and more), one row a key that is known. Buckets without any of them are not read, and a
        few keys are named to the scan, which then skips by statistics and Bloom filters."""
        keys = keys.select("key").distinct()
        few = [r.key for r in keys.limit(NAMED + 1).collect()]
        records = self._records(keys)
        if len(few) <= NAMED:
            return self._last(records.where(F.col("key").isin(few)))
        return self._last(records.join(keys, "key", "left_semi"))

    def missing(self, rows: DataFrame) -> DataFrame:
        """The rows (key and more) whose key has no answer; of the records only keys are read."""
        return rows.join(self._records(rows).select("key"), "key", "left_anti")

    def answers(self) -> DataFrame:
        """Every key's last answer."""
        return self._last(self._records(None))

    def __len__(self) -> int:
        return self._records(None).select("key").distinct().count()

    def fold(self, recent: int = RECENT, files: int = FILES) -> bool:
        """Deal recent batches into buckets where there are `recent` of them or more, then rewrite buckets of more than `files`
        files. What is replaced is deleted only when its successor is committed."""
        batches = self.batches()
        if len(batches) < max(1, recent):
            return False
        self._put(self._last_records(self._recent()))
        for n in batches:
            self.fs.delete(self._path("recent", f"seq={n}"), True)
        for bucket in self.names("sorted"):
            old = self.names("sorted", bucket)
            if len(old) > files:
                self._put(self._last_records(self._stored([bucket])))
                for name in old:
                    self.fs.delete(self._path("sorted", bucket, name), False)
        return True

    @staticmethod
    def _last_records(records: DataFrame) -> DataFrame:
        last = records.groupBy("key").agg(F.max_by(F.struct("seq", *ANSWER), "seq").alias("r"))
        return last.select("key", "r.*")

    def _put(self, records: DataFrame) -> None:
        dealt = records.withColumn("bucket", self._bucket(F.col("key"))).repartition("bucket").sortWithinPartitions("bucket", "key")
        out = dealt.write.mode("append").partitionBy("bucket").option("parquet.bloom.filter.enabled#key", "true").option(
            "parquet.bloom.filter.expected.ndv#key", "100000"
        )
        out.parquet(self._path("sorted").toString())


_open: dict[tuple[str, str], Bank] = {}


def bank_for(spark: SparkSession, path: str, model: str = "default") -> Bank:
    """The one bank of a path in this application, opened at its first use."""
    at = spark.sparkContext.applicationId, path.rstrip("/")
    if at not in _open:
        _open[at] = Bank(spark, path, model)
    return _open[at]


def from_ledger(spark: SparkSession, ledger_path: str, bank: Bank) -> None:
    """Take over a ledger of JSON lines as one batch; its own last records win, as they do there."""
    from assayfold.sources import ledger

    bank.append(ledger.read(spark, ledger_path), bank.next_seq())

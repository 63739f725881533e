"""Judging a stream: micro-batches that ask only what neither the cache nor the bank holds, banked before the next one starts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from assayfold.errors import AssayError
from assayfold.functions.stats import certainty
from assayfold.operators import judging, questions, runs
from assayfold.sources import labelled
from assayfold.sources.bank import ANSWER, Bank
from assayfold.sources.chunks import CHUNK, Chunks
from assayfold.streaming.ordered import Frontier

#: Answers that the cache holds; the oldest go first.
CACHED = 10_000


class Cache:
    """The newest answers of a stream by key, in the order they came: a bounded table that is joined before the bank is asked.

    It is written under a number at each change and read by path, and so is the same table on all executors."""

    def __init__(self, spark: SparkSession, path: str, size: int = CACHED):
        self.spark, self.path, self.size, self.number = spark, path.rstrip("/"), size, 0
        self.table: DataFrame | None = None

    def hits(self, keys: DataFrame) -> DataFrame | None:
        """The answers that are cached for keys; None while there are none."""
        if self.table is None:
            return None
        return keys.select("key").distinct().join(F.broadcast(self.table), "key").drop("inserted")  # size rows at most

    def put(self, answers: DataFrame) -> None:
        """Take new usable answers (pos, key, ...) in. A key that is there keeps its place in the order."""
        new = answers.select("key", *ANSWER, F.struct(F.lit(self.number), "pos").alias("inserted"))
        rows = new if self.table is None else self.table.unionByName(new.join(F.broadcast(self.table.select("key")), "key", "left_anti"))
        path = f"{self.path}/cache={self.number}"
        rows.orderBy(F.desc("inserted")).limit(self.size).write.mode("overwrite").parquet(path)
        if self.number:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/cache={self.number - 1}")
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        self.number += 1
        self.table = self.spark.read.parquet(path)


def answered(rows: DataFrame, origin: str, known: DataFrame) -> DataFrame:
    """Rows (pos, item, key) with the answers that are known for their keys."""
    out = rows.select("pos", "key").join(known, "key").withColumns({"origin": F.lit(origin), "error": F.lit(None).cast("string")})
    return out.withColumn("certainty", certainty(F.col("kind"), F.col("p"), F.col("error")))


OUT = ("pos", "key", *ANSWER, "certainty", "origin", "error")


def judge_batch(
    rows: DataFrame,
    post: Callable,
    bank: Bank,
    path: str,
    *,
    cache: Cache | None = None,
    dedupe: bool = True,
    model: str = "default",
    pack: int = 32,
    workers: int = 4,
    once: bool = False,
    on_error: str = "skip",
    share: float = runs.SHARE,
    longest: int | None = judging.LONGEST,
) -> DataFrame:
    """Answers (OUT) to a batch of rows (pos, item and a question), each from the cache, else from the bank, else asked for; origin says
    `cached`, `resumed`, `asked`, or `copied` from an equal row of the batch.

    What was asked is banked and cached, failures are not; of a run that is given up, what came back is banked before the
    error goes on. Requests and replies stay in path, as `runs` has them. Without dedupe every row is asked, and neither
    cache nor bank is read or written."""
    rows = judging.clean(rows, longest).withColumn("key", judging.question_key(model, pack, once))
    parts: list[DataFrame] = []
    left = rows
    if dedupe:
        hits = cache.hits(rows) if cache else None
        if hits is not None:
            parts.append(answered(rows, "cached", hits))
            left = left.join(hits.select("key"), "key", "left_anti")
        known = bank.lookup(left)
        parts.append(answered(left, "resumed", known))
        left = left.join(known.select("key"), "key", "left_anti")
    stopped = None
    try:
        run = runs.start(
            left, post, path, model=model, pack=pack, workers=workers, once=once, longest=None, dedupe=dedupe, on_error=on_error, share=share
        )
    except runs.Stopped as e:
        run, stopped = e.run, e
    run.answers().select(*OUT).write.mode("overwrite").parquet(f"{path}/answers")
    new = rows.sparkSession.read.parquet(f"{path}/answers")
    if dedupe:
        asked = new.where("origin = 'asked' and error is null")
        # parts read the bank and the cache: they are written before either changes
        out = new
        for part in parts:
            out = out.unionByName(part.select(*OUT))
        out.write.mode("overwrite").parquet(f"{path}/all")
        out = rows.sparkSession.read.parquet(f"{path}/all")
        bank.append(asked, bank.next_seq())
        if cache:
            cache.put(asked)
    else:
        out = new
    if stopped:
        raise stopped
    return out


def stream(
    items: DataFrame,
    post: Callable,
    bank_path: str,
    out: str,
    checkpoint: str,
    *,
    model: str = "default",
    pack: int = 32,
    workers: int = 4,
    once: bool = False,
    on_error: str = "skip",
    share: float = runs.SHARE,
    cached: int = CACHED,
    dedupe: bool = True,
    in_order: bool = False,
    on_batch: Callable[[int, int], None] | None = None,
    longest: int | None = judging.LONGEST,
    fold_at: int = 16,
    keep_items: bool = False,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start judging a stream of (pos, item and a question); `questions.with_defaults` gives all rows the same one.

    Answers are keyed by item, question, model and pack. They land in out/answers/batch=N, and with in_order also in
    out/ordered/out/batch=N, which has them in the order of pos up to the first that is still missing. Each batch's
    requests and attempts stay in out/runs/batch=N. A restart goes on after the last batch that was finished, and asks
    nothing that the bank holds. A batch with more failures than its budget stops the query when its usable answers are
    banked. With keep_items the texts land in out/items/batch=N. on_batch gets a batch's number and how many items it asked about."""
    missing = [c for c in ("pos", "item", *judging.QUESTION) if c not in items.columns]
    if missing:
        raise AssayError(f"a stream of items needs a question for each row; it lacks {', '.join(missing)}")
    spark = items.sparkSession
    # opened before the query starts, so that a folder that is no bank is refused at once
    bank = Bank(spark, bank_path, model)
    cache = Cache(spark, f"{out}/cache", cached) if dedupe and cached else None
    order = Frontier(spark, f"{out}/ordered") if in_order else None

    def run(batch: DataFrame, number: int) -> None:
        path = f"{out}/runs/batch={number}"
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)  # of a try that was cut off; what it banked is not asked again
        answers = judge_batch(
            batch,
            post,
            bank,
            path,
            cache=cache,
            dedupe=dedupe,
            model=model,
            pack=pack,
            workers=workers,
            once=once,
            on_error=on_error,
            share=share,
            longest=longest,
        )
        answers.write.mode("overwrite").parquet(f"{out}/answers/batch={number}")
        if keep_items:
            batch.select("pos", "item").write.mode("overwrite").parquet(f"{out}/items/batch={number}")
        if order:
            order.advance(answers, number)
        bank.fold(fold_at)
        if on_batch:
            on_batch(number, answers.where("origin = 'asked'").count())

    writer = items.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def log_of(spark: SparkSession, out: str) -> runs.Run:
    """All batches of a stream as one run: its requests, attempts, accounts and counter samples."""
    run = runs.Run(spark.read.parquet(f"{out}/answers"), f"{out}/runs/batch=*")
    run.answers = lambda: spark.read.parquet(f"{out}/answers")
    # packs are numbered from 0 in every batch
    batch = F.regexp_extract(F.col("_metadata.file_path"), "batch=([0-9]+)", 1).cast("long")
    replies = spark.read.schema(runs.REPLY).option("recursiveFileLookup", "true").parquet(f"{out}/runs/batch=*/replies")
    run._replies = lambda: replies.withColumn("pack_id", batch * (1 << 40) + F.col("pack_id"))
    return run


def soak(
    spark: SparkSession,
    post: Callable,
    out: str,
    *,
    rows: int | None = None,
    seconds: float | None = None,
    chunk: int = CHUNK,
    question: dict | None = None,
    **more,
) -> runs.Run:
    """Judge made items until there are `rows` of them, or for so many seconds, and leave the answers as CSV in out/csv.

    A soak that was cut off goes on where it stopped when it is called again with the same out."""
    spark.dataSource.register(Chunks)
    source = spark.readStream.format("chunks").option("chunk", chunk).option("state", f"{out}/source/at.json")
    for name, value in (("rows", rows), ("seconds", seconds)):
        source = source if value is None else source.option(name, value)
    items = questions.with_defaults(source.load(), **(question or {"instructions": "Is this a complaint?"}))
    query = stream(items, post, f"{out}/bank", out, f"{out}/checkpoint", keep_items=True, trigger={"processingTime": "0 seconds"}, **more)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    answers = spark.read.parquet(f"{out}/answers")
    texts = spark.read.parquet(f"{out}/items").select("pos", "item")
    labelled.write_answers_csv(answers.where("error is null").join(texts, "pos"), f"{out}/csv")
    return log_of(spark, out)

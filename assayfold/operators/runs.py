"""Judging as a run with a folder of its own: requests go out once, and answers, attempts and accounts are read from what came back.

    places/     pos, key and place in a request of every item that is asked
    replies/    round=0, 1, ...: a row a request, with what was said or why not, and each attempt's status, wait and latency

A run can be given up: every worker stops sending when its share of the error budget is used, what it has not sent goes
to the next round if the run as a whole is within its budget, and all that came back stays readable.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayfold.errors import AssayError
from assayfold.functions.stats import certainty
from assayfold.operators import judging, order, questions
from assayfold.operators.packs import CHARS_PER_TOKEN, places

#: Packs that may fail whatever the number of items, and the share of the items.
PACKS, SHARE = 5, 0.01
REPLY = "pack_id long, items int, sent boolean, said string, why string, at double, ms double, attempts array<struct<status: int, waited: double, ms: double>>"


@dataclass
class Reply:
    """What a caller's `post` may return in place of the response's text: the text, and each attempt (status, seconds waited before
    the next, milliseconds)."""

    said: str | None
    attempts: list[tuple[int, float, float]] = field(default_factory=list)


class Stopped(AssayError):
    """A run that was given up; `run` has what came back."""

    def __init__(self, message: str, run: Run):
        super().__init__(message)
        self.run = run


def budget(items: int, pack: int, share: float = SHARE) -> int:
    """Items that may fail before a run is given up."""
    return max(PACKS * pack, int(items * share))


def sender(post: Callable[[str], str | Reply], share: int, most: int):
    """Bodies (pack_id, items, body) to replies. A worker sends no more once over `share` of its items have failed, or it has sent
    `most` requests."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        failed = requests = 0
        for batch in batches:
            for number, items, body in zip(batch["pack_id"], batch["items"], batch["body"]):
                row = {
                    "pack_id": number,
                    "items": items,
                    "sent": failed <= share and requests < most,
                    "said": None,
                    "why": None,
                    "at": time.time(),
                    "ms": None,
                    "attempts": [],
                }
                if row["sent"]:
                    requests += 1
                    began = time.perf_counter()
                    try:
                        said = post(body)
                        row["said"], tries = (said.said, said.attempts) if isinstance(said, Reply) else (said, [])
                    except Exception as e:  # a request that fails is skipped, with its reason
                        row["why"], tries = str(e) or type(e).__name__, getattr(e, "attempts", [])
                        failed += items
                    row["ms"] = (time.perf_counter() - began) * 1000
                    row["attempts"] = [{"status": int(s), "waited": float(w), "ms": float(ms)} for s, w, ms in tries]
                yield pd.DataFrame([row])

    return run


class Run:
    """What a run's folder holds. rows: its items with keys and questions, as they were asked."""

    def __init__(self, rows: DataFrame, path: str):
        self.rows, self.path, self.spark = rows, path, rows.sparkSession

    def _replies(self) -> DataFrame:
        return self.spark.read.schema(REPLY).option("recursiveFileLookup", "true").parquet(f"{self.path}/replies")

    def places(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/places")

    def answers(self) -> DataFrame:
        """Every item's answer, decoded, with certainty and origin; what was not sent is an error like any other."""
        name = F.concat(F.lit("item_"), F.col("position").cast("string"))
        payload = F.try_element_at(F.from_json("said", "struct<answers: map<string, string>>")["answers"], name)
        sent = self._replies().where("sent").select("pack_id", "said", "why")
        raw = self.places().join(sent.withColumn("_sent", F.lit(True)), "pack_id", "left").withColumn("payload", payload)
        why = F.coalesce(
            "why",
            F.when(F.col("_sent").isNull(), "not sent, the run was given up").when(
                F.col("payload").isNull(), F.concat(name, F.lit(" has no answer"))
            ),
        )
        return judging.finished(self.rows, raw.withColumn("why", why).select("pos", "key", "position", "packed", "payload", "why"))

    def requests(self) -> DataFrame:
        """(pack_id, items, at, ms, status, input_tokens, output_tokens, retries, waited) of every request that went out; tokens that
        a response does not tell count 0. status is that of the last attempt, 200 where a caller tells none."""
        told = F.from_json("said", "struct<usage: struct<input_tokens: bigint, output_tokens: bigint>>")["usage"]
        status = F.coalesce(F.try_element_at("attempts", F.lit(-1))["status"], F.when(F.col("why").isNull(), 200).otherwise(0))
        tokens = [F.coalesce(told[c], F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens")]
        retries = F.greatest(F.size("attempts") - 1, F.lit(0)).cast("long")
        waited = F.aggregate("attempts", F.lit(0.0), lambda a, x: a + x["waited"])
        return self._replies().where("sent").select(
            "pack_id", "items", "at", "ms", status.alias("status"), *tokens, retries.alias("retries"), waited.alias("waited")
        )

    def attempts(self) -> DataFrame:
        """(pack_id, attempt, status, waited, ms): every attempt that a caller told of, the last of a request too."""
        each = self._replies().where("sent").select("pack_id", F.posexplode("attempts").alias("attempt", "a"))
        return each.select("pack_id", "attempt", "a.status", "a.waited", "a.ms")

    def retried(self) -> DataFrame:
        """Attempts that were followed by another, for `reports.retries`."""
        each = self._replies().where("sent").select(
            "pack_id", F.explode(F.slice("attempts", F.lit(1), F.greatest(F.size("attempts") - 1, F.lit(0)))).alias("a")
        )
        return each.select("pack_id", "a.status", "a.waited")

    def samples(self, every: float = 0.5) -> DataFrame:
        """Counter samples of the run for `experiments.rate_windows`: t in seconds, and growing totals, one sample for every span of
        `every` seconds in which a request came back. pushback counts retries that a status was told for."""
        done = (F.ceil((F.col("at") + F.coalesce("ms", F.lit(0.0)) / 1000) / every) * every).cast("double").alias("t")
        told = F.filter("attempts", lambda a: a["status"] != 0)
        requests = self.requests().join(
            self._replies().where("sent").select("pack_id", F.greatest(F.size(told) - 1, F.lit(0)).cast("long").alias("pushback")), "pack_id"
        )
        sums = {
            "requests": F.count("*"),
            "input_tokens": F.sum("input_tokens"),
            "retries": F.sum("retries"),
            "pushback": F.sum("pushback"),
            "waited": F.sum("waited"),
        }
        per = requests.groupBy(done).agg(*(x.alias(f"_{k}") for k, x in sums.items()))
        return order.running(per, "t", {k: F.col(f"_{k}") for k in sums}).select("t", *sums)

    def usage(self, answers: DataFrame | None = None) -> DataFrame:
        """One row of accounts (`judging.usage`) of the run's requests and answers, or of all answers that it had a part in."""
        return judging.usage(self.requests(), self.answers() if answers is None else answers)

    def partial(self) -> DataFrame:
        """The usable answers, of a run that was given up too."""
        return self.answers().where("error is null")


def start(
    rows: DataFrame,
    post: Callable[[str], str | Reply],
    path: str,
    *,
    model: str = "default",
    pack: int = 32,
    workers: int = 4,
    once: bool = False,
    longest: int | None = judging.LONGEST,
    dedupe: bool = True,
    on_error: str = "skip",
    share: float = SHARE,
    chars_per_token: float = CHARS_PER_TOKEN,
) -> Run:
    """Ask about rows (pos, item and a question, as for `judging.judge_questions`; a key of theirs is kept) and wait for the run.

    Requests go out once and are written to path; whatever is read of the run afterwards sends nothing. on_error `skip`
    makes errors of a failing request's items until more than `budget` of them have failed, `raise` gives up at the first.
    A run that is given up raises Stopped, whose `run` has everything that came back; in vain were sent no more items than
    the budget and a request a worker."""
    if on_error not in ("skip", "raise"):
        raise AssayError("on_error must be skip or raise")
    spark = rows.sparkSession
    rows = judging.clean(rows, longest)
    if "key" not in rows.columns:
        rows = rows.withColumn("key", judging.question_key(model, pack, once))
    if not dedupe:
        rows = rows.withColumn("key", F.concat_ws("#", "key", F.col("pos").cast("string")))
    overhead = questions.overhead(*[F.col(c) for c in judging.QUESTION], once=once)
    sizes = rows.select("key", "pos", F.length("item").alias("length"), overhead.alias("overhead"))
    firsts = sizes.groupBy("key").agg(
        F.min("pos").alias("pos"), F.min_by("length", "pos").alias("length"), F.min_by("overhead", "pos").alias("overhead")
    )
    of = places(firsts, pack, chars_per_token)
    firsts.select("pos", "key").join(of, "pos").write.parquet(f"{path}/places")
    run = Run(rows, path)
    unique = run.places().count()
    allowed = budget(unique, pack, share) if on_error == "skip" else 0
    packs = run.places().join(rows.select("pos", "item", *judging.QUESTION), "pos")
    bodies = questions.bodies(packs, model, once).select("pack_id", F.col("items").cast("int").alias("items"), "body")
    failed, left, number = 0, bodies, 0
    while True:
        # a worker's share of what may still fail; what it does not send comes round again. Where the first failure ends the
        # run, workers hear of each other's between rounds, which double
        most = 8 << number if on_error == "raise" else 1 << 62
        dealt = left.repartition(workers, "pack_id").mapInPandas(sender(post, (allowed - failed) // workers, most), REPLY)
        dealt.write.parquet(f"{path}/replies/round={number}")
        seen = run._replies()
        failed, unsent = seen.agg(
            F.coalesce(F.sum(F.when(F.col("sent") & F.col("why").isNotNull(), F.col("items"))), F.lit(0)), F.count("*") - F.count_if("sent")
        ).first()
        out = seen.where(F.col("sent")).select("pack_id").distinct()
        unsent = bodies.select("pack_id").join(out, "pack_id", "left_anti").limit(1).count() if unsent else 0
        if failed > allowed:
            raise Stopped(f"{failed} of {unique} items failed, {allowed} may; {'the run was given up' if unsent else 'all were sent'}", run)
        if not unsent:
            return run
        left, number = bodies.join(out, "pack_id", "left_anti"), number + 1

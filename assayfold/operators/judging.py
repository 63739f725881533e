"""The dataflow around a judge: keys, dedupe, resume, packing, decoding, fan-back and accounts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayfold.functions.stats import certainty
from assayfold.operators import questions
from assayfold.operators.packs import CHARS_PER_TOKEN, places, plan_packs  # noqa: F401

#: Characters of an item at most.
LONGEST = 20_000
#: Input price in dollars a million tokens.
USD_PER_MILLION = 0.042


def shape(model: str, pack: int, guidance: str, instructions: Column, criteria: Column, options: Column, levels: Column) -> Column:
    """A question's identity by value; maps count by sorted entries."""
    put = lambda m: F.to_json(F.array_sort(F.map_entries(m)))
    parts = [F.lit(model), F.lit(str(pack)), F.lit(guidance), instructions, put(criteria), put(options), F.to_json(levels)]
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(x, F.lit("\x00")) for x in parts]), 256)


def key(text: Column, of_shape: Column) -> Column:
    """The ledger's 128-bit key of an item under a question."""
    return F.substring(F.sha2(F.concat_ws("\x1f", text, of_shape), 256), 1, 32)


def clean(items: DataFrame, longest: int | None = LONGEST) -> DataFrame:
    """Texts as strings; an item over the limit stops the run before anything is sent, with its place in the message."""
    text = F.coalesce(F.col("item").cast("string"), F.lit("None"))
    refuse = F.raise_error(
        F.concat(F.lit("item "), (F.col("pos") + 1).cast("string"), F.lit(f" is over {longest} characters; nothing was sent"))
    ).cast("string")
    return items.withColumn("item", text if longest is None else F.when(F.length(text) > longest, refuse).otherwise(text))


def oversize(items: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(pos, length) of the items that `clean` refuses, to be looked at before a run."""
    return items.select("pos", F.length(F.coalesce(F.col("item").cast("string"), F.lit("None"))).alias("length")).where(F.col("length") > longest)


def todo(items: DataFrame, ledger: DataFrame) -> DataFrame:
    """First occurrences of keys that the ledger does not hold. items: pos, item, key."""
    return items.groupBy("key").agg(F.min_by(F.struct("pos", "item"), "pos").alias("f")).select("key", "f.pos", "f.item").join(
        ledger.select("key"), "key", "left_anti"
    )


def fan_back(items: DataFrame, answers: DataFrame) -> DataFrame:
    """One answer for every item; origin says whether it was asked for it or for an equal one before."""
    first = answers.select("key", F.col("pos").alias("_first"), *[c for c in answers.columns if c not in ("key", "pos", "item")])
    return items.join(first, "key", "left").withColumn("origin", F.when(F.col("_first") == F.col("pos"), "asked").otherwise("copied")).drop("_first")


ANSWER = "struct<noul: double, choice: string, score: double, legend: map<string, string>, probabilities: map<string, double>, confidence: double>"


def decode(entries: DataFrame) -> DataFrame:
    """Typed answers of JSON entries (pos, payload): yes/no before score before choice; what is none of them is an error."""
    e = F.from_json("payload", ANSWER)
    out = entries.withColumn("e", e)
    # the highest level is that of the probabilities; a legend may be short, or missing
    top = F.coalesce(F.array_max(F.transform(F.map_keys("e.probabilities"), lambda k: k.try_cast("int"))), F.lit(0))
    nearest = F.greatest(F.lit(0), F.least(top, F.bround("e.score").cast("int"))).cast("string")
    by_legend = F.transform_keys("e.probabilities", lambda k, _: F.coalesce(F.element_at("e.legend", k), k))
    kind = F.when(F.col("e.noul").isNotNull(), "noul").when(F.col("e.score").isNotNull(), "score").when(
        F.col("e.choice").isNotNull(), "choice"
    ).otherwise("error")
    out = out.withColumn("kind", kind)
    is_ = lambda k: F.col("kind") == k
    label = F.when(is_("noul"), F.when(F.col("e.noul") >= 0.5, "yes").otherwise("no")).when(
        is_("score"), F.coalesce(F.element_at("e.legend", nearest), nearest)
    ).when(is_("choice"), F.col("e.choice")).otherwise("")
    p = F.when(is_("noul"), F.col("e.noul")).when(is_("score"), F.coalesce(F.element_at("e.probabilities", nearest), F.lit(0.0))).when(
        is_("choice"), F.coalesce(F.element_at("e.probabilities", F.col("e.choice")), F.lit(0.0))
    ).otherwise(0.0)
    spread = F.when(is_("noul"), F.create_map(F.lit("yes"), F.col("e.noul"), F.lit("no"), F.lit(1.0) - F.col("e.noul"))).when(
        is_("score"), by_legend
    ).when(is_("choice"), F.col("e.probabilities"))
    return out.withColumns(
        {
            "label": label,
            "p": p,
            "distribution": spread,
            "confidence": F.col("e.confidence"),
            "score": F.col("e.score"),
            "error": F.when(is_("error"), "unreadable answer"),
        }
    ).drop("e")


def in_order(items: DataFrame, known: DataFrame) -> DataFrame:
    """known (pos and more) up to the first of the items (pos) that it lacks: what may be handed on in order."""
    gap = items.join(known.select("pos"), "pos", "left_anti").agg(F.min("pos").alias("_gap"))
    return known.join(F.broadcast(gap), F.coalesce(F.col("pos") < F.col("_gap"), F.lit(True))).drop("_gap")  # one row


def usage(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """One row of accounts. requests: input_tokens, output_tokens, retries, waited; answers: origin (asked, copied,
    cached, resumed), error."""
    req = requests.agg(
        F.count("*").alias("requests"),
        F.coalesce(F.sum("retries"), F.lit(0)).alias("retries"),
        F.coalesce(F.sum("waited"), F.lit(0.0)).alias("waited"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
    )
    ans = answers.agg(
        F.count("*").alias("items"),
        F.count_if(F.col("origin").isin("copied", "cached") & F.col("error").isNull()).alias("cached"),
        F.count_if(F.col("origin") == "resumed").alias("resumed"),
        F.count_if(F.col("error").isNotNull()).alias("skipped"),
    )
    out = req.crossJoin(F.broadcast(ans))  # one row each
    return out.withColumns(
        {
            "answered": F.greatest(F.lit(0), F.col("items") - F.col("cached") - F.col("resumed")),
            "usd": F.col("input_tokens") * USD_PER_MILLION / 1e6,
            "tokens_per_item": F.try_divide(F.col("input_tokens"), F.greatest(F.lit(0), F.col("items") - F.col("cached") - F.col("resumed"))),
        }
    )


def judge(
    items: DataFrame,
    ask: Callable[[list[str]], list[str]],
    ledger: DataFrame | None = None,
    pack: int = 32,
    workers: int | None = None,
    longest: int | None = LONGEST,
) -> DataFrame:
    """One decoded answer for every item (pos, item, key), with `certainty` and `origin`: asked, copied or resumed.

    ask gets a pack's texts and returns a JSON entry for each; an exception makes that pack's items errors. Equal items
    share an answer; what the ledger holds is answered from it, and only the rest is asked. An item over the limit
    stops the run before anything is sent (longest None: no limit). For workers see `dealt`."""
    return resumed(clean(items, longest), ledger, lambda rest: asked(rest, ask, pack, workers))


#: The columns of a question.
QUESTION = ("instructions", "criteria", "options", "levels")


def question_key(model: str, pack: int, once: bool = False) -> Column:
    """The key of an item under its row's question."""
    return key(F.col("item"), shape(model, pack, "once" if once else "repeat", *[F.col(c) for c in QUESTION]))


def judge_questions(
    rows: DataFrame,
    post: Callable[[str], str],
    model: str = "default",
    ledger: DataFrame | None = None,
    pack: int = 32,
    workers: int | None = None,
    once: bool = False,
    longest: int | None = LONGEST,
    dedupe: bool = True,
    chars_per_token: float = CHARS_PER_TOKEN,
) -> DataFrame:
    """`judge` for rows (pos, item and a question, see `questions.with_defaults`), with the key of item and question.

    post gets a pack's body as JSON and returns the response's JSON. Requests go out whenever the result is evaluated;
    `runs.start` sends them once and keeps the replies. An exception, a response
    that cannot be read and an item without an answer make errors of the items they concern. Without dedupe every row is
    asked, equal or not, and the ledger is not read. For workers see `dealt`."""
    rows, own = clean(rows, longest), question_key(model, pack, once)
    rows = rows.withColumn("key", own if dedupe else F.concat_ws("#", own, "pos"))
    return resumed(rows, ledger if dedupe else None, lambda rest: posted(rest, post, model, pack, workers, once, chars_per_token))


def resumed(items: DataFrame, ledger: DataFrame | None, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What the ledger holds is answered from it; `ask` gets the rest."""
    if ledger is None:
        return ask(items)
    new = ask(items.join(ledger.select("key"), "key", "left_anti"))
    old = items.join(ledger, "key").withColumns({"origin": F.lit("resumed"), "error": F.lit(None).cast("string")})
    return new.unionByName(old.withColumn("certainty", certainty(F.col("kind"), F.col("p"), F.col("error"))).select(*new.columns))


def dealt(packs: DataFrame, workers: int | None) -> DataFrame:
    """Packs over the tasks that ask; each task has one request in flight. `workers` bounds the tasks, whatever each then has to
    read; without it they are the session's partitions. Not dealt by pack_id itself, which packs are grouped by already."""
    tasks = int(packs.sparkSession.conf.get("spark.sql.shuffle.partitions")) if workers is None else max(1, workers)
    return packs.repartition(tasks, F.xxhash64("pack_id"))


def posted(
    rows: DataFrame, post: Callable[[str], str], model: str, pack: int, workers: int | None, once: bool, chars_per_token: float
) -> DataFrame:
    """Answers to all rows (pos, item, key and a question), of equal ones asked for the first, one body a pack."""
    overhead = questions.overhead(*[F.col(c) for c in QUESTION], once=once)
    sizes = rows.select("key", "pos", F.length("item").alias("length"), overhead.alias("overhead"))
    firsts = sizes.groupBy("key").agg(
        F.min("pos").alias("pos"), F.min_by("length", "pos").alias("length"), F.min_by("overhead", "pos").alias("overhead")
    )
    packs = rows.select("pos", "key", "item", *QUESTION).join(places(firsts, pack, chars_per_token), "pos")

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            for number, body in zip(batch["pack_id"], batch["body"]):
                try:
                    said, why = post(body), None
                except Exception as e:  # a pack that fails is skipped, with its reason
                    said, why = None, str(e) or type(e).__name__
                yield pd.DataFrame({"pack_id": [number], "said": [said], "why": [why]})

    bodies = dealt(questions.bodies(packs, model, once).select("pack_id", "body"), workers)
    replies = bodies.mapInPandas(run, "pack_id long, said string, why string")
    name = F.concat(F.lit("item_"), F.col("position").cast("string"))
    payload = F.try_element_at(F.from_json("said", "struct<answers: map<string, string>>")["answers"], name)
    why = F.coalesce("why", F.when(F.col("payload").isNull(), F.concat(name, F.lit(" has no answer"))))
    raw = packs.select("pos", "key", "pack_id", "position", "packed").join(replies, "pack_id").withColumn("payload", payload).withColumn("why", why)
    return finished(rows, raw.drop("pack_id", "said"))


def asked(items: DataFrame, ask: Callable[[list[str]], list[str]], pack: int = 32, workers: int | None = None) -> DataFrame:
    """Answers to all items (pos, item, key), of equal ones asked for the first."""
    firsts = items.groupBy("key").agg(F.min("pos").alias("pos"), F.min_by(F.length("item"), "pos").alias("length"))
    packs = items.select("pos", "key", "item").join(places(firsts.withColumn("overhead", F.lit(0)), pack), "pos")
    grouped = packs.groupBy("pack_id").agg(F.array_sort(F.collect_list(F.struct("position", "pos", "key", "item"))).alias("rows"))

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            for rows in batch["rows"]:
                try:
                    said = ask([r["item"] for r in rows])
                except Exception as e:  # a pack that fails is skipped, with its reason
                    said = [None] * len(rows)
                    why = str(e) or type(e).__name__
                else:
                    why = None
                yield pd.DataFrame(
                    {
                        "pos": [r["pos"] for r in rows],
                        "key": [r["key"] for r in rows],
                        "position": [r["position"] for r in rows],
                        "packed": len(rows),
                        "payload": said,
                        "why": why,
                    }
                )

    raw = dealt(grouped, workers).mapInPandas(run, "pos long, key string, position int, packed int, payload string, why string")
    return finished(items, raw)


def finished(items: DataFrame, raw: DataFrame) -> DataFrame:
    """Every item's answer out of the entries (pos, key, position, packed, payload, why) of those that were asked."""
    answers = fan_back(items, decode(raw).withColumn("error", F.coalesce("why", "error")).drop("payload", "why"))
    return answers.withColumn("certainty", certainty(F.col("kind"), F.col("p"), F.col("error")))

"""Banks, runs with an error budget, caches, and streams that resume, in order."""

import json

import pytest
from pyspark.sql import functions as F

from assayfold.errors import AssayError
from assayfold.operators import experiments as ex
from assayfold.operators import judging, questions, reports, runs, selective
from assayfold.sources import bank as banks
from assayfold.sources import labelled, ledger
from assayfold.streaming import jobs
from assayfold.streaming.ordered import Frontier, first_gap


def rows(spark, *texts, start=0, **question):
    made = spark.createDataFrame([(start + k, t) for k, t in enumerate(texts)], "pos long, item string")
    return questions.with_defaults(made, **({"instructions": "Is it good?"} | question))


def reply(body, p=0.9):
    names = [n for n in json.loads(body)["state"] if n.startswith("item_")]
    return json.dumps({"answers": {n: {"noul": p} for n in names}, "usage": {"input_tokens": 7 * len(names)}})


def said(spark, pairs, label="yes"):
    return spark.createDataFrame([(k, p, label, "noul") for k, p in pairs], "key string, p double, label string, kind string")


def test_bank_last_wins_and_folds(spark, tmp_path):
    bank = banks.Bank(spark, f"file://{tmp_path}/bank", "m", digits=1)
    assert len(bank) == 0 and bank.next_seq() == 0 and bank.answers().count() == 0
    keys = [f"{k:x}" * 4 for k in range(16)]
    bank.append(said(spark, [(k, 0.1) for k in keys]), bank.next_seq())
    bank.append(said(spark, [(k, 0.2) for k in keys[:8]]).withColumn("error", F.when(F.col("key") == "0000", "x")), bank.next_seq())
    want = {k: 0.2 if 0 < i < 8 else 0.1 for i, k in enumerate(keys)}
    value = lambda b: {r.key: r.p for r in b.answers().collect()}
    assert value(bank) == want and len(bank) == 16
    assert not bank.fold(recent=3) and bank.fold(recent=2) and value(bank) == want
    assert bank.batches() == [] and bank.names("sorted") == [f"bucket={k:x}" for k in range(16)] and bank.next_seq() == 2
    bank.append(said(spark, [(keys[3], 0.3)]), bank.next_seq())
    want[keys[3]] = 0.3
    assert value(bank) == want
    # an older record that is banked again, as by a fold that was cut off, changes nothing
    bank._put(bank._last_records(bank._recent()))
    assert value(bank) == want
    for n in range(4):
        bank.append(said(spark, [(keys[3], 0.4 + n)]), bank.next_seq())
        bank.fold(recent=1, files=2)
    assert len(bank.names("sorted", "bucket=3")) <= 2 and value(bank)[keys[3]] == 3.4 and len(bank) == 16
    again = banks.Bank(spark, f"file://{tmp_path}/bank", "other")
    assert (again.model, again.digits, len(again)) == ("m", 1, 16) and again.next_seq() == bank.next_seq()
    assert banks.bank_for(spark, f"file://{tmp_path}/bank") is banks.bank_for(spark, f"file://{tmp_path}/bank/")


def test_lookup_reads_only_the_buckets_it_hits(spark, tmp_path):
    bank = banks.Bank(spark, f"file://{tmp_path}/bank")
    key = F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 32)
    some = spark.range(20_000).select(key.alias("key"), (F.col("id") / 20_000).alias("p"), F.lit("yes").alias("label"), F.lit("noul").alias("kind"))
    bank.append(some, 0)
    bank.fold(recent=1)
    asked = spark.range(3).select(key.alias("key"), F.col("id"))
    found = bank.lookup(asked)
    assert sorted(r.p for r in found.collect()) == [0, 1 / 20_000, 2 / 20_000]
    files = {f.rpartition("bucket=")[2][:2] for f in bank._records(asked).inputFiles()}
    assert files == {r.key[:2] for r in asked.collect()} and len(bank.names("sorted")) == 256
    plan = bank.missing(asked)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<key:string>" in plan
    many = spark.range(15_000, 25_000).select(key.alias("key"))
    assert (bank.lookup(many).count(), bank.missing(many).count(), len(bank)) == (5000, 5000, 20_000)
    scan = bank.lookup(spark.range(1).select(key.alias("key")))._jdf.queryExecution().toString()
    assert "PushedFilters: [" in scan and "EqualTo(key" in scan or "In(key" in scan


def test_foreign_folders_are_refused(spark, tmp_path):
    spark.range(3).write.json(f"file://{tmp_path}/foreign")
    with pytest.raises(banks.NotABank):
        banks.Bank(spark, f"file://{tmp_path}/foreign")
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "header.json").write_text('{"bank_format": 0}')
    with pytest.raises(AssayError, match="format"):
        banks.Bank(spark, f"file://{tmp_path}/old")
    ledger.append(
        said(spark, [("k1", 0.5)]).withColumns(
            {
                "error": F.lit(None).cast("string"),
                "distribution": F.lit(None).cast("map<string,double>"),
                "confidence": F.lit(0.5),
                "position": F.lit(1),
                "packed": F.lit(1),
                "score": F.lit(None).cast("double"),
            }
        ),
        f"file://{tmp_path}/lines",
        0,
        "m",
    )
    bank = banks.Bank(spark, f"file://{tmp_path}/taken")
    banks.from_ledger(spark, f"file://{tmp_path}/lines", bank)
    assert [(r.key, r.p) for r in bank.answers().collect()] == [("k1", 0.5)]


def test_run_sends_once_and_keeps_attempts(spark, tmp_path):
    def post(body):
        with open(tmp_path / "sent", "a") as f:
            f.write("x\n")
        if "bad" in body:
            raise OSError("the line is dead")
        return runs.Reply(reply(body), [(429, 0.5, 3.0), (200, 0.0, 4.0)] if "slow" in body else [(200, 0.0, 4.0)])

    run = runs.start(rows(spark, "a", "slow", "a", "bad", "b"), post, f"file://{tmp_path}/run", pack=1, workers=2)
    for _ in range(2):
        answers = {r.pos: r for r in run.answers().collect()}
    assert (tmp_path / "sent").read_text().count("x") == 4  # equal items once, and reading sends nothing
    assert [answers[k].origin for k in range(5)] == ["asked", "asked", "copied", "asked", "asked"]
    assert answers[3].error == "the line is dead" and answers[2].p == 0.9 and answers[3].certainty == 0
    u = run.usage().first()
    assert (u.requests, u.retries, u.waited, u.input_tokens, u["items"], u.cached, u.skipped, u.answered) == (4, 1, 0.5, 21, 5, 1, 1, 4)
    assert reports.retries(run.retried()).first().why == "1x429, 0.5s waiting"
    assert sorted((r.attempt, r.status) for r in run.attempts().collect()) == [(0, 200), (0, 200), (0, 429), (1, 200)]
    assert run.requests().where("ms >= 0 and at > 0").count() == 4 and {r.status for r in run.requests().collect()} == {0, 200}
    assert reports.latest(run.requests().select("at", "ms"), 2).count() == 2
    assert reports.failures(run.answers()).count() == 1 and {r.pos for r in run.partial().collect()} == {0, 1, 2, 4}


def test_error_budget_stops_a_run(spark, tmp_path):
    """Of 2,000 items that fail after the first hundred, under twice the budget and a request a worker are sent."""

    def post(body):
        with open(tmp_path / "sent", "a") as f:
            f.write("x\n")
        if "fine" not in body:
            raise OSError("down")
        return reply(body)

    texts = [f"fine {k}" if k < 100 else f"item {k}" for k in range(2000)]
    with pytest.raises(runs.Stopped, match="given up") as e:
        runs.start(rows(spark, *texts), post, f"file://{tmp_path}/run", pack=10, workers=4)
    sent = (tmp_path / "sent").read_text().count("x") * 10
    assert runs.budget(2000, 10) == 50 and sent <= 100 + 50 + 4 * 10
    kept = e.value.run.partial().count()
    assert kept > 0 and e.value.run.answers().where("error = 'not sent, the run was given up'").count() >= 1700
    # failures that stay within the budget end no run, whichever worker meets them
    fine = runs.start(rows(spark, *[f"fine {k}" if k % 100 else f"item {k}" for k in range(500)]), post, f"file://{tmp_path}/fine", pack=1, workers=4)
    assert fine.answers().where("error is not null").count() == 5
    (tmp_path / "sent").unlink()
    with pytest.raises(runs.Stopped):
        runs.start(rows(spark, *texts[100:]), post, f"file://{tmp_path}/first", pack=10, workers=4, on_error="raise")
    assert (tmp_path / "sent").read_text().count("x") <= 4
    with pytest.raises(AssayError):
        runs.start(rows(spark, "a"), post, f"file://{tmp_path}/x", on_error="hope")


def test_cache_before_bank_before_asking(spark, tmp_path):
    asked = []
    root = f"file://{tmp_path}"
    bank = banks.Bank(spark, f"{root}/bank")
    cache = jobs.Cache(spark, f"{root}/cache", 3)

    def post(body):
        with open(tmp_path / "sent", "a") as f:
            f.write("".join(f"{v}\n" for n, v in sorted(json.loads(body)["state"].items()) if n.startswith("item_")))
        return reply(body)

    def batch(number, *texts, **more):
        (tmp_path / "sent").write_text("")
        out = jobs.judge_batch(rows(spark, *texts), post, bank, f"{root}/run{number}", **{"cache": cache} | more)
        asked.append(sorted((tmp_path / "sent").read_text().split()))
        return [r.origin for r in out.orderBy("pos").collect()]

    assert batch(0, "a", "b", "a") == ["asked", "asked", "copied"] and asked[-1] == ["a", "b"]
    assert batch(1, "b", "c", "d", "c") == ["cached", "asked", "asked", "copied"] and asked[-1] == ["c", "d"]
    # three are cached, the oldest went: "a" comes from the bank, and does not enter the cache from there
    assert batch(2, "a", "b", "c", "d") == ["resumed", "cached", "cached", "cached"] and asked[-1] == []
    assert batch(3, "a", "a") == ["resumed", "resumed"]
    assert batch(4, "a", "b", "a", dedupe=False) == ["asked"] * 3 and asked[-1] == ["a", "a", "b"] and len(bank) == 4
    assert batch(5, "b", cache=None) == ["resumed"]


def test_gaps(spark):
    frame = lambda *p: spark.createDataFrame([(x,) for x in p], "pos long")
    assert first_gap(frame(), 5) == 5 and first_gap(frame(0, 1, 3), 0) == 2 and first_gap(frame(6, 7), 5) == 5
    for missing in (0, 3, 4, 7, 11, 12):
        assert first_gap(frame(*(k for k in range(12) if k != missing)), 0, block=4) == missing


def test_stream_is_in_order_over_a_restart(spark, tmp_path):
    """Each position once and in order, whatever order batches bring them in, and over a batch that is run twice."""
    root = f"file://{tmp_path}"
    part = lambda *p: spark.createDataFrame([(x, f"t{x}") for x in p], "pos long, item string")
    order = Frontier(spark, f"{root}/o")
    out = lambda df: [r.pos for r in df.collect()]
    assert out(order.advance(part(1, 2, 5), 0)) == []
    assert out(order.advance(part(0, 3), 1)) == [0, 1, 2, 3]
    order = Frontier(spark, f"{root}/o")  # a new driver
    assert order.at() == (4, 1)
    assert out(order.advance(part(0, 3), 1)) == [0, 1, 2, 3]  # the batch is run again
    assert out(order.advance(part(3, 4, 7), 2)) == [4, 5]
    assert out(order.advance(part(6), 3)) == [6, 7]
    assert sorted((r.pos, r.item) for r in order.handed_on().collect()) == [(k, f"t{k}") for k in range(8)]


def test_stream_resumes_by_question(spark, tmp_path):
    root, seen = f"file://{tmp_path}", []

    def post(body):
        return reply(body, 0.9 if "good" in body else 0.2)

    def run(name, **more):
        items = questions.with_defaults(
            spark.readStream.schema("pos long, item string").option("maxFilesPerTrigger", 1).parquet(f"{root}/in"),
            **({"instructions": "Is it good?"} | more.pop("question", {})),
        )
        jobs.stream(
            items,
            post,
            f"{root}/bank",
            f"{root}/{name}",
            f"{root}/{name}-ckpt",
            pack=more.pop("pack", 2),
            in_order=True,
            on_batch=lambda n, k: seen.append((n, k)),
            **more,
        ).awaitTermination()
        return {r.pos: (r.label, r.origin) for r in spark.read.parquet(f"{root}/{name}/answers").collect()}

    spark.createDataFrame([(2, "c"), (3, "a")], "pos long, item string").coalesce(1).write.mode("append").parquet(f"{root}/in")
    first = run("one")
    assert first == {2: ("yes", "asked"), 3: ("yes", "asked")} and Frontier(spark, f"{root}/one/ordered").at()[0] == 0
    spark.createDataFrame([(0, "a"), (1, "b")], "pos long, item string").coalesce(1).write.mode("append").parquet(f"{root}/in")
    # a restart asks only what is new: its cache is empty, the bank is not
    assert run("one")[0] == ("yes", "resumed") and seen[-1][1] == 1
    assert [r.pos for r in Frontier(spark, f"{root}/one/ordered").handed_on().orderBy("pos").collect()] == [0, 1, 2, 3]
    # another question, and another pack, are asked anew on the same bank, and leave the answers of the first
    other = run("two", question={"instructions": "Is it bad?"})
    assert {x for x, _ in other.values()} == {"no"} and sum(o == "asked" for _, o in other.values()) == 3
    assert {o for _, o in run("three", pack=3).values()} <= {"asked", "cached"}
    assert {o for _, o in run("four").values()} == {"resumed"}
    assert jobs.log_of(spark, f"{root}/one").usage().first().requests >= 2
    with pytest.raises(AssayError, match="question"):
        jobs.stream(spark.readStream.schema("pos long, item string").parquet(f"{root}/in"), post, f"{root}/bank", f"{root}/x", f"{root}/y")


def test_stream_banks_before_it_stops(spark, tmp_path):
    root = f"file://{tmp_path}"
    spark.createDataFrame([(k, f"fine {k}" if k < 3 else f"item {k}") for k in range(40)], "pos long, item string").coalesce(1).write.parquet(
        f"{root}/in"
    )

    def post(body):
        if "fine" not in body:
            raise OSError("down")
        return reply(body)

    items = questions.with_defaults(spark.readStream.schema("pos long, item string").parquet(f"{root}/in"), instructions="Is it good?")
    query = jobs.stream(items, post, f"{root}/bank", f"{root}/out", f"{root}/ckpt", pack=1)
    with pytest.raises(Exception, match="items failed"):
        query.awaitTermination()
    assert 1 <= len(banks.Bank(spark, f"{root}/bank")) <= 3  # what came back of the three that can


def test_judging_keeps_the_key_of_questions(spark):
    a, b = rows(spark, "x").withColumn("key", judging.question_key("m", 4)), rows(spark, "x", instructions="Is it bad?").withColumn(
        "key", judging.question_key("m", 4)
    )
    assert a.first().key != b.first().key != rows(spark, "x").withColumn("key", judging.question_key("m", 5)).first().key


def test_soak_goes_on_where_it_stopped(spark, tmp_path):
    """Chunks of a bounded source, its answers as CSV, and the stream's own counters, over two calls."""
    out = f"file://{tmp_path}/soak"
    more = {"question": {"instructions": "Is it good?"}, "pack": 8, "workers": 2, "longest": None}
    run = jobs.soak(spark, reply, out, rows=100, chunk=40, **more)
    assert sorted(r.pos for r in run.answers().collect()) == list(range(100))
    assert sorted(r.batch for r in run.answers().select("batch").distinct().collect()) == [0, 1, 2]
    run = jobs.soak(spark, reply, out, rows=130, chunk=40, **more)
    assert sorted(r.pos for r in run.answers().collect()) == list(range(130))
    assert spark.read.option("header", True).csv(f"{out}/csv").count() == 130
    samples = run.samples(0.001).orderBy("t").collect()
    u = run.usage().first()
    assert (u.requests, u["items"], u.input_tokens) == (5 + 5 + 3 + 4, 130, 7 * 130)
    assert (samples[-1].requests, samples[-1].input_tokens) == (u.requests, u.input_tokens) and len(samples) > 3
    windows = ex.rate_windows(run.samples(0.001), (samples[-1].t - samples[0].t) / 3, 8).collect()
    assert windows and sum(w.requests_per_minute * w.seconds / 60 for w in windows) <= u.requests
    timed = jobs.soak(spark, reply, f"file://{tmp_path}/timed", seconds=0.5, chunk=8, **more)
    assert timed.answers().count() >= 8 and timed.answers().count() % 8 == 0


def test_texts_of_reports(spark):
    rows = [(k, (k % 97) / 97, (k * 31) % 97 < (k % 97) + 20, "ab"[k % 2]) for k in range(400)]
    judged = spark.createDataFrame(rows, "pos long, certainty double, right boolean, label string")
    line = selective.calibrate(judged, accuracy=0.8).select(reports.gain_text().alias("t")).first().t
    assert line.startswith("from 0.") and "points over" in line and line.endswith("of 400 rows")
    texts = [selective.blocked(selective.resolution(judged, bar)).select(reports.blocked_text().alias("t")).first().t for bar in (0.8, 0.99999, None)]
    assert "reached on" in texts[0] and "97 levels" in texts[1] and ";" not in texts[2]
    assert all(": 200 rows, " in r.t for r in selective.routing(judged, 0.8).select(reports.verdict_text().alias("t")).collect())


def test_shuffled_runs_are_joined_back(spark):
    items = spark.range(50).select("id", F.concat(F.lit("t"), "id").alias("item"))
    mixed = labelled.shuffled(items)
    places = [r.place for r in mixed.orderBy("id").collect()]
    assert sorted(places) == list(range(50)) != places
    back = labelled.in_their_places(mixed.select("place", F.length("item").alias("said")), mixed)
    assert {r.id: r.said for r in back.collect()} == {k: len(f"t{k}") for k in range(50)}

"""Queries of runs with a folder of their own, banks of answers, ordered streams, and of certainty with as many levels as rows.

Judgements of the last kind are those of a nearest-centroid judge over `embeddings`: its label is that of the nearest of
the labels' mean vectors, its certainty the softmax of the distances.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayfold.operators import experiments as ex
from assayfold.operators import questions, runs
from assayfold.operators import selective as sel
from assayfold.plans.registry import AUC, BOUND, items, query, table
from assayfold.sources.bank import Bank
from assayfold.streaming.ordered import Frontier

DIGITS = 9


def folder(spark: SparkSession, tag: str) -> str:
    """A new folder that driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="assayfold-")
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def nearest(spark: SparkSession, sf: str) -> DataFrame:
    """Judged rows: pos, gold, label, certainty and right, of the vectors of `embeddings`."""
    x = table(spark, sf, "embeddings").where("label is not null").select(
        F.col("vec_id").alias("pos"), F.col("label").cast("int").alias("gold"), F.col("embedding").cast("array<double>").alias("v")
    )
    axes = x.select("gold", F.posexplode("v").alias("axis", "x")).groupBy("gold", "axis").agg(F.avg("x").alias("m"))
    means = axes.groupBy("gold").agg(F.transform(F.array_sort(F.collect_list(F.struct("axis", "m"))), lambda s: s["m"]).alias("c"))
    all_ = means.agg(F.array_sort(F.collect_list(F.struct("gold", "c"))).alias("all"))  # one vector a label
    far = F.transform("all", lambda m: F.sqrt(F.aggregate(F.zip_with("v", m["c"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)))
    d = x.crossJoin(F.broadcast(all_)).withColumn("d", far).withColumn("least", F.array_min("d"))
    label = F.element_at("all", F.array_position("d", F.col("least")).cast("int"))["gold"]
    share = 1 / F.aggregate(F.transform("d", lambda y: F.exp(F.col("least") - y)), F.lit(0.0), lambda s, y: s + y)
    out = d.select("pos", "gold", label.alias("label"), F.round(share, DIGITS).alias("certainty"))
    return out.withColumn("right", F.col("label") == F.col("gold"))


#: The same as CTE j(pos, gold, label, certainty, right).
NEAREST = f"""x AS (SELECT vec_id AS pos, label AS gold, embedding AS v FROM embeddings WHERE label IS NOT NULL),
ax AS (SELECT gold, i, avg(CAST(v[i] AS DOUBLE)) AS m FROM x, range(1, 65) r(i) GROUP BY 1, 2), c AS (SELECT gold AS k, list(m ORDER BY i) AS c
 FROM ax GROUP BY 1),
d AS (SELECT pos, gold, k, sqrt(list_sum(list_transform(range(1, 65), lambda i: (CAST(v[i] AS DOUBLE) - c[i]) * (CAST(v[i] AS DOUBLE) - c[i])))) AS d
 FROM x, c),
l AS (SELECT pos, gold, min(d) AS least, arg_min(k, d) AS label FROM d GROUP BY 1, 2),
j AS MATERIALIZED (SELECT l.pos, l.gold, l.label, round(1 / sum(exp(least - d)), {DIGITS}) AS certainty, l.label = l.gold AS "right" FROM l
 JOIN d USING (pos) GROUP BY ALL)"""
LEVELS = f"""{NEAREST}, h AS (SELECT certainty, count(*) AS n, count(*) FILTER ("right") AS r FROM j GROUP BY 1),
s AS (SELECT *, sum(n) OVER (ORDER BY certainty DESC) AS kept, sum(r) OVER (ORDER BY certainty DESC) AS kr, sum(n) OVER () AS total, sum(n)
 OVER (ORDER BY certainty) - n + (n + 1) / 2.0 AS rk FROM h)"""


@query(
    f"WITH {LEVELS}, x2 AS (SELECT sum(n) AS n, sum(r) AS r, sum(r * rk) AS ranks FROM s), y AS (SELECT n, r, {AUC} AS z FROM x2) SELECT CAST(n AS "
    f"BIGINT) AS count, CAST(r AS BIGINT) AS n_right, z AS auroc, greatest(z - {BOUND}, 0) AS low, least(z + {BOUND}, 1) AS high FROM y"
)
def discrimination_continuous(spark, sf):
    return sel.discrimination(nearest(spark, sf))


@query(
    f"WITH {LEVELS} SELECT certainty, CAST(kept AS BIGINT) AS kept, CAST(total AS BIGINT) AS total, CAST(kr AS DOUBLE) / kept AS accuracy, CAST(kr "
    f"AS DOUBLE) / kept AS reached FROM s WHERE kept >= 30"
)
def rungs_continuous(spark, sf):
    return sel.rungs(nearest(spark, sf))


@query(
    f"WITH {NEAREST} SELECT pos, row_number() OVER (ORDER BY certainty DESC, pos) <= floor(count(*) OVER () * CAST(0.37 AS DOUBLE)) AS trusted FROM j"
)
def triage_continuous(spark, sf):
    return sel.triage(nearest(spark, sf).withColumn("error", F.lit(None).cast("string")), keep=0.37).select("pos", "trusted")


@query(f"""WITH {NEAREST}, o AS (SELECT *, row_number() OVER (ORDER BY certainty DESC, pos) AS rn, count(*) OVER () AS total FROM j),
 w AS (SELECT CAST(unnest([1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.3]) AS DOUBLE) AS coverage)
SELECT coverage, CAST(greatest(1, floor(any_value(total) * coverage)) AS BIGINT) AS kept, avg(CAST("right" AS DOUBLE)) AS accuracy,
 min(certainty) AS edge FROM w, o WHERE rn <= greatest(1, floor(total * coverage)) GROUP BY 1""")
def risk_coverage_continuous(spark, sf):
    return ex.risk_coverage(nearest(spark, sf))


def banked(spark: SparkSession, sf: str) -> Bank:
    """A bank of answers to all documents' texts: of every third twice, and a seventh a third time; folded between."""
    rows = items(spark, sf).select("key", "pos", F.lit("noul").alias("kind"))
    bank = Bank(spark, folder(spark, "bank"))
    for number, some in enumerate((rows, rows.where("pos % 3 = 0"), rows.where("pos % 7 = 0"))):
        last = some.groupBy("key").agg(F.min("pos").alias("pos"), F.min("kind").alias("kind"))
        said = last.select(
            "key",
            "kind",
            F.lit(f"answer {number}").alias("label"),
            ((F.col("pos") % 100) / 100.0).alias("p"),
            F.lit(None).cast("string").alias("error"),
        )
        bank.append(said, bank.next_seq())
        if number == 1:
            bank.fold(recent=2)
    return bank


#: What each text was last told, and by which position.
TOLD = "t AS (SELECT text, min(doc_id) AS a, min(doc_id) FILTER (doc_id % 3 = 0) AS b, min(doc_id) FILTER (doc_id % 7 = 0) AS c FROM documents GROUP BY 1), k AS (SELECT text, CASE WHEN c IS NOT NULL THEN 'answer 2' WHEN b IS NOT NULL THEN 'answer 1' ELSE 'answer 0' END AS label, CAST(coalesce(c, b, a) % 100 AS DOUBLE) / 100 AS p FROM t)"


@query(f"WITH {TOLD} SELECT doc_id AS pos, label, p FROM documents JOIN k USING (text)")
def ledger_last_wins(spark, sf):
    return items(spark, sf).select("pos", "key").join(banked(spark, sf).answers(), "key").select("pos", "label", "p")


@query(
    f"WITH {TOLD}, q AS (SELECT text FROM documents WHERE doc_id % 50 = 0 GROUP BY 1) SELECT sha256(text)[1:32] AS key, label, p FROM k JOIN q "
    f"USING (text)"
)
def ledger_lookup(spark, sf):
    """Answers to a fiftieth of the texts: buckets without any of them are not read."""
    return banked(spark, sf).lookup(items(spark, sf).where("pos % 50 = 0")).select("key", "label", "p")


@query("SELECT count(DISTINCT text) AS known, 0 AS missing FROM documents")
def ledger_size(spark, sf):
    bank = banked(spark, sf)
    return bank.missing(items(spark, sf)).agg(F.count("*").cast("int").alias("missing")).withColumn("known", F.lit(len(bank)).cast("long"))


def told(body: str) -> runs.Reply:
    """A service of its own: every item of even length is right; usage by items, and a first attempt that fails for odd packs."""
    asked = json.loads(body)["state"]
    answers = {name: {"noul": 0.875 if len(text) % 2 == 0 else 0.125} for name, text in asked.items() if name.startswith("item_")}
    said = json.dumps({"answers": answers, "usage": {"input_tokens": 10 * len(answers), "output_tokens": 3}})
    return runs.Reply(said, [(503, 0.25, 1.0), (200, 0.0, 2.0)] if len(answers) % 2 else [(200, 0.0, 2.0)])


@query("""WITH u AS (SELECT text, min(doc_id) AS pos FROM documents GROUP BY 1), n AS (SELECT count(*) AS items, (SELECT count(*) FROM u) AS u
 FROM documents), p AS (SELECT *, (u + 7) // 8 AS packs, u % 8 AS tail FROM n)
SELECT packs AS requests, CASE WHEN tail % 2 = 1 THEN 1 ELSE 0 END AS retries, CASE WHEN tail % 2 = 1 THEN CAST(0.25 AS DOUBLE) ELSE 0 END AS waited,
 CAST(10 * u AS BIGINT) AS input_tokens, CAST(3 * packs AS BIGINT) AS output_tokens,
 items, items - u AS cached, 0 AS resumed, 0 AS skipped, u AS answered, 10 * u * 0.042 / 1e6 AS usd, CAST(10 AS DOUBLE) AS tokens_per_item FROM p""")
def run_usage(spark, sf):
    """Accounts of a run over all documents, from its own replies; texts are cut to ids' lengths, so that eight fit a request."""
    rows = questions.with_defaults(items(spark, sf).drop("key").withColumn("item", F.sha2("item", 256)), instructions="Is it good?")
    run = runs.start(rows, told, folder(spark, "run"), pack=8)
    return run.usage()


@query(
    "SELECT doc_id AS pos, n_chars, 1 + CASE WHEN doc_id >= (SELECT min(doc_id) FROM documents WHERE doc_id % 5 = 3) THEN 1 ELSE 0 END AS batch "
    "FROM documents"
)
def ordered_stream(spark, sf):
    """Rows that come in three batches, out of order, each handed on by the first batch that leaves no gap before it: batch 0 lacks
    position 0, batch 1 brings it and all else but every fifth from 3 on, which batch 2 brings."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), "n_chars")
    order = Frontier(spark, folder(spark, "ordered"))
    late = F.col("pos") % 5 == 3
    parts = (docs.where((F.col("pos") % 2 == 1) & ~late), docs.where((F.col("pos") % 2 == 0) & ~late), docs.where(late))
    for number, part in enumerate(parts):
        order.advance(part, number)
    return order.handed_on().select("pos", "n_chars", F.col("batch").cast("int").alias("batch"))

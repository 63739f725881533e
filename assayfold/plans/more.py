"""Queries of reports and questions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayfold.operators import experiments as ex
from assayfold.operators import judging
from assayfold.operators import questions as qs
from assayfold.operators import reports
from assayfold.operators import selective as sel
from assayfold.plans.registry import BANDS, DRAWS, LOG, RESAMPLED, A, answers, judged, log, query, table
from assayfold.sources import labelled

RIGHT = "CAST(label = gold AS DOUBLE)"


@query(f"""WITH {LOG()}, i AS (SELECT source, avg({RIGHT}) AS acc, source % 5 <> 0 AS easy FROM l GROUP BY 1)
SELECT count(*) FILTER (easy) AS easy_items, avg(acc) FILTER (easy) AS easy_accuracy, count(*) FILTER (NOT easy) AS hard_items,
 avg(acc) FILTER (NOT easy) AS hard_accuracy, sum(1 - acc) FILTER (NOT easy) / sum(1 - acc) AS hard_share FROM i""")
def annotator_split(spark, sf):
    agreed = F.when(F.col("source") % 5 != 0, True).when(F.col("source") % 2 == 0, False)  # null counts as not agreed
    return reports.annotators(log(spark, sf).withColumn("agreed", agreed))


@query(
    f"WITH {LOG()}, h AS (SELECT arm, position <= 16 AS front, {RIGHT} AS ok FROM l) SELECT arm, avg(ok) FILTER (front) AS front, avg(ok) FILTER "
    f"(NOT front) AS back, count(*) AS n, avg(ok) FILTER (front) - avg(ok) FILTER (NOT front) AS gap FROM h GROUP BY 1"
)
def request_halves(spark, sf):
    return reports.request_halves(log(spark, sf))


SCORED = f"d AS (SELECT *, abs(x - round_even(x, 0)) AS far FROM (SELECT *, certainty * 2 + CAST(pos % 10 AS DOUBLE) / CAST(10 AS DOUBLE) AS x, {RIGHT} AS ok FROM l))"


@query(
    f"WITH {LOG()}, b AS (SELECT floor((position - 1) / 8) AS band, avg({RIGHT}) AS accuracy FROM l GROUP BY 1) SELECT count(*) AS bands, "
    f"max(accuracy) - min(accuracy) AS spread FROM b"
)
def position_spread(spark, sf):
    return ex.spread(ex.position_bands(log(spark, sf)))


@query("""WITH s AS (SELECT doc_id AS pos, ['low', 'mid', 'high'][doc_id % 3 + 1] AS gold, CASE
 WHEN doc_id % 11 <> 0 THEN CAST(n_chars % 25 AS DOUBLE) / 10 END AS x FROM documents)
SELECT pos, CASE WHEN x IS NOT NULL THEN ['low', 'mid', 'high'][1 + CAST(least(2, greatest(0, round_even(x, 0))) AS INTEGER)] END AS said, CASE
 WHEN x IS NOT NULL THEN ['low', 'mid', 'high'][1 + CAST(least(2, greatest(0, round_even(x, 0))) AS INTEGER)] END = gold AS "right",
 abs(x - round_even(x, 0)) AS between FROM s""")
def score_log(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("pos"),
        F.element_at(F.array(*map(F.lit, ("low", "mid", "high"))), (F.col("doc_id") % 3 + 1).cast("int")).alias("gold"),
        F.when(F.col("doc_id") % 11 != 0, (F.col("n_chars") % 25) / 10.0).alias("score"),
    )
    return reports.scored(docs, ("low", "mid", "high")).select("pos", "said", "right", "between")


def scored(spark, sf):
    return log(spark, sf).withColumn("score", F.col("certainty") * 2 + (F.col("pos") % 10) / 10.0)


@query(
    f"WITH {LOG()}, {SCORED}, b AS (SELECT ok, CASE WHEN far < CAST(0.05 AS DOUBLE) THEN CAST(0 AS DOUBLE) WHEN far < CAST(0.15 AS DOUBLE) THEN "
    f"0.05 WHEN far < CAST(0.3 AS DOUBLE) THEN 0.15 WHEN far < CAST(0.5001 AS DOUBLE) THEN 0.3 END AS band FROM d) SELECT band, count(*) AS n, "
    f"avg(ok) AS accuracy FROM b WHERE band IS NOT NULL GROUP BY 1"
)
def distance_bands(spark, sf):
    return reports.distance_bands(scored(spark, sf))


@query(
    f"WITH {LOG()}, {SCORED} SELECT avg(ok) FILTER (far < CAST(0.05 AS DOUBLE)) AS settled, avg(ok) FILTER (far >= CAST(0.3 AS DOUBLE)) AS astride "
    f"FROM d"
)
def settled_scores(spark, sf):
    return reports.settled(scored(spark, sf))


@query(f"""WITH {A}, k AS (SELECT pos, "right", least(certainty, CAST(0.8 AS DOUBLE)) AS c FROM j), n AS (SELECT c, count(*) AS n, min(pos) AS f
 FROM k GROUP BY 1), t AS (SELECT * FROM n ORDER BY n DESC, f LIMIT 1)
SELECT (SELECT count(*) FROM n) AS levels, t.c AS crowd, CAST(t.n AS DOUBLE) / (SELECT count(*) FROM k) AS share, (SELECT avg(CAST("right" AS DOUBLE))
 FROM k WHERE k.c >= t.c) AS crowd_accuracy FROM t""")
def crowding(spark, sf):
    return sel.crowding(judged(spark, sf).withColumn("certainty", F.least("certainty", F.lit(0.8))), 0.97)


def COVERED(z: float) -> str:
    share, zz = "CAST(kr AS DOUBLE) / kept", z * z
    bound = f"({share} + {zz} / (2 * kept) - {z} * sqrt({share} * (1 - {share}) / kept + {zz} / (4.0 * kept * kept))) / (1 + {zz} / kept)" if z else share
    return f"(SELECT coalesce(max(CAST(kept AS DOUBLE) / total), 0) FROM s WHERE kept >= 30 AND {bound} >= 0.85)"


@query(f"""WITH {A}, h AS (SELECT certainty, count(*) AS n, count(*) FILTER ("right") AS r FROM j GROUP BY 1), s AS (SELECT sum(n)
 OVER (ORDER BY certainty DESC) AS kept, sum(r) OVER (ORDER BY certainty DESC) AS kr, sum(n) OVER () AS total FROM h),
o AS (SELECT CAST({COVERED(0)} AS DOUBLE) AS plain, CAST({COVERED(1.645)} AS DOUBLE) AS bound) SELECT plain, bound, plain - bound AS headroom FROM o""")
def headroom(spark, sf):
    return sel.headroom(judged(spark, sf), 0.85, 0.95)


@query("""WITH t AS (SELECT [429, 503, 0, 500][event_id % 4 + 1] AS status, CAST(event_id % 10 AS DOUBLE) / 2 AS waited FROM events
 WHERE event_type = 'click'), n AS (SELECT status, count(*) AS n, sum(waited) AS w FROM t GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS retries, sum(w) AS waited, string_agg(n || 'x' || CASE status
 WHEN 0 THEN 'transport' ELSE CAST(status AS VARCHAR) END, ', ' ORDER BY status) || printf(', %.1fs waiting', sum(w)) AS why FROM n""")
def retry_breakdown(spark, sf):
    status = F.element_at(F.array(*map(F.lit, (429, 503, 0, 500))), (F.col("event_id") % 4 + 1).cast("int"))
    return reports.retries(
        table(spark, sf, "events").where("event_type = 'click'").select(status.alias("status"), ((F.col("event_id") % 10) / 2).alias("waited"))
    )


@query(f"""WITH {LOG()}, k AS (SELECT arm, count(*) AS n, avg(CAST(certainty >= 0.8 AS DOUBLE)) AS kept FROM l GROUP BY 1), i(arm, pack, usd,
 mean_chars) AS (VALUES ('arm0', 32, CAST(0.25 AS DOUBLE), CAST(700 AS DOUBLE)))
SELECT arm, n, kept, coalesce(pack, 1) * CAST(1000 AS DOUBLE) / 60 AS items_per_second, coalesce(pack,
 1) * CAST(1000 AS DOUBLE) / 60 * kept AS trusted_per_second, coalesce(usd, 0) / n * 1000 / kept AS usd_per_1000,
 CAST(floor(98000 / mean_chars) AS BIGINT) AS pack_that_fits FROM k LEFT JOIN i USING (arm)""")
def ceilings(spark, sf):
    return reports.ceilings(
        log(spark, sf), spark.createDataFrame([("arm0", 32, 0.25, 700.0)], "arm string, pack int, usd double, mean_chars double"), 0.8
    )


def HELD(name: str, coverages: str = "1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.3") -> str:
    """CTEs of held-out cuts over the log `name`; held_<name> is the result."""
    return f"""item_{name} AS (SELECT source, row_number() OVER (ORDER BY md5(source || ':29')) <= count(*) OVER () // 2 AS fit
 FROM (SELECT DISTINCT source FROM {name})), half_{name} AS (SELECT l.*, fit FROM {name} l JOIN item_{name} USING (source)),
 rank_{name} AS (SELECT certainty, row_number() OVER (ORDER BY certainty DESC, pos) AS i, count(*) OVER () AS n FROM half_{name} WHERE fit),
 edge_{name} AS (SELECT coverage, certainty AS edge FROM (SELECT CAST(unnest([{coverages}]) AS DOUBLE) AS coverage), rank_{name} WHERE i = greatest(1,
 floor(n * coverage))),
 held_{name} AS (SELECT coverage, edge, CAST(count(*) FILTER (certainty >= edge) AS DOUBLE) / count(*) AS kept,
 avg({RIGHT}) FILTER (certainty >= edge) AS accuracy FROM edge_{name}, half_{name} WHERE NOT fit GROUP BY 1, 2
 HAVING count(*) FILTER (certainty >= edge) > 0)"""


@query(f"WITH {LOG()}, {HELD('l')} SELECT coverage, edge, kept, accuracy FROM held_l")
def held_out(spark, sf):
    return reports.held_out(log(spark, sf))


@query(f"""WITH {LOG()}, it AS (SELECT source, row_number() OVER (ORDER BY md5(source || ':29')) <= count(*) OVER () // 2 AS fit
 FROM (SELECT DISTINCT source FROM l)), h AS (SELECT l.*, fit, {RIGHT} AS ok FROM l JOIN it USING (source)), r AS (SELECT certainty, row_number()
 OVER w AS i, avg(ok) OVER w AS acc, count(*) OVER () AS n FROM h WHERE fit WINDOW w AS (ORDER BY certainty DESC, pos ROWS UNBOUNDED PRECEDING)),
b AS (SELECT arg_max(certainty, i) AS edge FROM r WHERE (n - i) % greatest(1, n // 200) = 0 AND acc >= 0.85) SELECT edge,
 CAST(count(*) FILTER (certainty >= edge) AS DOUBLE) / count(*) AS kept, avg(ok) FILTER (certainty >= edge) AS accuracy FROM b, h WHERE NOT fit
 GROUP BY 1""")
def coverage_grid(spark, sf):
    return reports.coverage_at(log(spark, sf), 0.85)


def CORPUS(name: str) -> str:
    return f"""SELECT '{name}' AS corpus, (SELECT count(*) FROM unit_{name}) AS items, (SELECT avg(value) FROM unit_{name}) AS accuracy, (SELECT low
 FROM bounds_{name}) AS low, (SELECT high FROM bounds_{name}) AS high,
 (SELECT max(accuracy) FROM held_{name} WHERE coverage = 0.9) AS at_90, (SELECT max(accuracy) FROM held_{name} WHERE coverage = 0.8) AS at_80,
 (SELECT max(accuracy) FROM held_{name} WHERE coverage = 0.7) AS at_70,
 (SELECT sum(n * gap) / sum(n) FROM (SELECT {BANDS} AS band, count(*) AS n, avg({RIGHT}) - avg(certainty) AS gap FROM {name} GROUP BY 1)) AS gap,
 (SELECT avg(value) FROM unit_{name} WHERE firm) AS firm, (SELECT avg(value) FROM unit_{name} WHERE NOT firm) AS split"""


def UNITS(name: str) -> str:
    units = f"SELECT source AS unit, avg({RIGHT}) AS value, count(DISTINCT label) = 1 AS firm FROM {name} GROUP BY 1"
    return f"unit_{name} AS ({units}), {DRAWS(f'unit_{name}', 200, f'_{name}')}, {HELD(name)}"


@query(f"WITH {LOG('l')}, {LOG('m', 3)}, {UNITS('l')}, {UNITS('m')} {CORPUS('l')} UNION ALL {CORPUS('m')}")
def corpora(spark, sf):
    return reports.corpora({"l": log(spark, sf), "m": log(spark, sf, salt=3)}, draws=200)


@query(f"""WITH {LOG('l')}, {LOG('m', 3)}, a AS (SELECT source, avg({RIGHT}) AS x FROM l GROUP BY 1), b AS (SELECT source, avg({RIGHT}) AS y FROM m
 GROUP BY 1), d AS (SELECT source AS unit, y - x AS value FROM a JOIN b USING (source)), {RESAMPLED('d')}
SELECT count(*) AS items, avg(value) AS difference, any_value(low) AS low, any_value(high) AS high, any_value(low > -0.02 AND high < 0.02) AS within
 FROM d, bounds""")
def paired_interval(spark, sf):
    return reports.paired_interval(log(spark, sf), log(spark, sf, salt=3))


@query(
    "WITH p AS (SELECT text, CAST(n_chars % 101 AS DOUBLE) / 100 AS p, CAST((n_chars * 7) % 101 AS DOUBLE) / 100 AS q, doc_id FROM documents) "
    "SELECT count(*) AS items, avg(CAST((a.p >= 0.5) = (b.q >= 0.5) AS DOUBLE)) AS same, avg(abs(a.p - b.q)) AS moved FROM p a JOIN p b ON a.text = "
    "b.text AND b.doc_id % 2 = 0 WHERE a.doc_id % 3 = 0"
)
def baseline_shift(spark, sf):
    docs = table(spark, sf, "documents").withColumn("item", F.col("text"))
    run = docs.where("doc_id % 3 = 0").withColumn("p", (F.col("n_chars") % 101) / 100.0)
    return reports.against_baseline(run, docs.where("doc_id % 2 = 0").withColumn("p", (F.col("n_chars") * 7 % 101) / 100.0))


@query(f"WITH {LOG()} SELECT arm, label, count(*) AS n, avg(certainty) AS certainty FROM l GROUP BY 1, 2")
def label_counts(spark, sf):
    return reports.label_counts(log(spark, sf))


@query(
    "SELECT doc_id AS pos, CASE WHEN doc_id % 3 = 0 THEN 0.25 WHEN doc_id % 2 = 0 THEN greatest(CAST(n_chars % 101 AS DOUBLE) / 100, 1 - "
    "CAST(n_chars % 101 AS DOUBLE) / 100) ELSE CAST(n_chars % 101 AS DOUBLE) / 100 END AS certainty FROM documents"
)
def legacy_certainty(spark, sf):
    docs = table(spark, sf, "documents").withColumns(
        {
            "p": (F.col("n_chars") % 101) / 100.0,
            "kind": F.when(F.col("doc_id") % 2 == 0, "noul").otherwise("choice"),
            "certainty": F.when(F.col("doc_id") % 3 == 0, 0.25),
        }
    )
    return docs.select(F.col("doc_id").alias("pos"), reports.legacy_certainty().alias("certainty"))


@query(
    f"WITH {A}, f AS (SELECT pos, error FROM a WHERE error IS NOT NULL) SELECT pos, error, (SELECT count(*) FROM f) AS failed FROM f ORDER BY pos "
    f"LIMIT 1000"
)
def failures(spark, sf):
    return reports.failures(answers(spark, sf))


@query("SELECT event_id AS at, value AS ms FROM events ORDER BY event_id DESC, value DESC LIMIT 10000")
def latest_latencies(spark, sf):
    return reports.latest(table(spark, sf, "events").select(F.col("event_id").alias("at"), F.col("value").alias("ms")))


@query("SELECT doc_id AS id FROM documents ORDER BY md5(doc_id || ':7'), doc_id LIMIT 150")
def seeded_sample(spark, sf):
    return labelled.sample(table(spark, sf, "documents").select(F.col("doc_id").alias("id")), 150)


@query("SELECT doc_id AS id, row_number() OVER (ORDER BY substr(md5(doc_id || ':7'), 1, 12), doc_id) - 1 AS place FROM documents")
def seeded_order(spark, sf):
    return labelled.shuffled(table(spark, sf, "documents").select(F.col("doc_id").alias("id")))


@query("SELECT doc_id AS id, c AS copy, doc_id || '#' || c AS \"case\" FROM documents, range(0, 3) t(c)")
def repeated_cases(spark, sf):
    return labelled.case_ids(table(spark, sf, "documents").select(F.col("doc_id").alias("id")), 3).withColumn("copy", F.col("copy").cast("long"))


@query("SELECT count(*) AS items, count(DISTINCT text) AS keys FROM documents")
def distinct_keys(spark, sf):
    keyed = table(spark, sf, "documents").withColumn("key", F.sha2("text", 256))
    return keyed.groupBy("key").agg(F.count("*").alias("n")).agg(F.sum("n").alias("items"), F.count("*").alias("keys"))


@query("SELECT doc_id AS pos, length(text) AS length FROM documents WHERE length(text) > 20000")
def oversize_guard(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), F.col("text").alias("item"))
    return judging.oversize(docs).withColumn("length", F.col("length").cast("long"))


@query(f"WITH {A} SELECT pos, label, label = gold AS \"right\" FROM a WHERE error IS NULL")
def answers_with_gold(spark, sf):
    rows = answers(spark, sf)
    return sel.score(rows.drop("gold"), rows.select("pos", "gold")).select("pos", "label", "right")


def asks(spark, sf):
    """A question a document: a third have instructions of their own, the kinds take turns, packs hold eight."""
    k = F.col("doc_id") % 4
    rows = table(spark, sf, "documents").select(
        F.col("doc_id").alias("pos"),
        F.col("text").alias("item"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Is it "), "lang", F.lit("?"))).alias("instructions"),
        F.when(k == 1, F.create_map(F.lit("a"), F.lit("one"), F.lit("b"), F.lit("two"))).alias("options"),
        F.when(k == 2, F.array(F.lit("low"), F.lit("high"))).alias("levels"),
        F.when(k == 3, F.create_map(F.lit("yes"), F.lit("it is"))).alias("criteria"),
    )
    return qs.with_defaults(rows, instructions="Is it good?")


ASKS = """q AS (SELECT doc_id AS pos, CASE WHEN doc_id % 3 = 0 THEN 'Is it ' || lang || '?' ELSE 'Is it good?' END AS told, doc_id % 4 AS k FROM documents)"""
MORE = """CASE k WHEN 1 THEN ',"criteria":{"a":"one","b":"two"}' WHEN 2 THEN ',"criteria":["low","high"]' WHEN 3 THEN ',"criteria":{"yes":"it is"}' ELSE '' END || '}'"""
KIND = "CASE k WHEN 1 THEN 'choice' WHEN 2 THEN 'score' ELSE 'noul' END"


@query(
    f"""WITH {ASKS} SELECT pos, '{{"type":"' || {KIND} || '","instructions":"' || told || '"' || {MORE} AS question, told || CASE k WHEN 3 THEN chr(10) || 'yes: it is' ELSE '' END AS guidance FROM q"""
)
def ask_defaults(spark, sf):
    parts = [F.col(c) for c in ("instructions", "criteria", "options", "levels")]
    return asks(spark, sf).select("pos", qs.typed(*parts).alias("question"), qs.guidance(*parts).alias("guidance"))


@query(f"""WITH {ASKS} SELECT pos, CAST(length('{{"type": "", "instructions": ""}}') + length({KIND}) + length(told) + CASE k
 WHEN 1 THEN length(', "criteria": {{"a": "one", "b": "two"}}') WHEN 2 THEN length(', "criteria": ["low", "high"]')
 WHEN 3 THEN length(', "criteria": {{"yes": "it is"}}') ELSE 0 END AS BIGINT) AS chars,
 CAST(length('{{"type": "", "instructions": ""}}') + length({KIND}) + length('Answer the question in guidance for item_00 alone; no other item matters.') + CASE k WHEN 1 THEN length(', "criteria": {{"a": "one", "b": "two"}}') WHEN 2 THEN length(', "criteria": ["low", "high"]') ELSE 0 END AS BIGINT) AS once FROM q""")
def token_costs(spark, sf):
    parts = [F.col(c) for c in ("instructions", "criteria", "options", "levels")]
    return asks(spark, sf).select("pos", qs.overhead(*parts).cast("long").alias("chars"), qs.overhead(*parts, once=True).cast("long").alias("once"))


@query(f"""WITH {ASKS} SELECT pos, CASE k WHEN 1 THEN 'choice' WHEN 2 THEN 'score' ELSE 'noul' END AS kind, CASE k WHEN 1 THEN 'b'
 WHEN 2 THEN 'high' ELSE CASE WHEN length(told) % 2 = 0 THEN 'yes' ELSE 'no' END END AS label,
 CASE k WHEN 1 THEN CAST(0.75 AS DOUBLE) WHEN 2 THEN CAST(0.625 AS DOUBLE) ELSE CAST(0.875 AS DOUBLE) END AS certainty FROM q""")
def judge_questions(spark, sf):
    """Every document under its question, through whole request bodies; a yes/no answer depends on its instructions."""

    def post(body):
        import json

        answers = {}
        for name, q in json.loads(body)["questions"].items():
            told = q["instructions"].split(" Answer for item_")[0]
            yes = 0.875 if len(told) % 2 == 0 else 0.125
            given = {
                "choice": {"choice": "b", "probabilities": {"a": 0.25, "b": 0.75}},
                "score": {"score": 0.9, "legend": {"0": "low", "1": "high"}, "probabilities": {"0": 0.375, "1": 0.625}},
                "noul": {"noul": yes},
            }
            answers[name] = given[q["type"]]
        return json.dumps({"answers": answers})

    return judging.judge_questions(asks(spark, sf), post, longest=None).select("pos", "kind", "label", "certainty")


def packs(spark, sf):
    """Packs of eight that ask one thing where their number is even; items are ids, so that the SQL needs no escapes."""
    rows = asks(spark, sf).withColumns(
        {"pack_id": F.floor(F.col("pos") / 8), "position": (F.col("pos") % 8 + 1).cast("int"), "item": F.concat(F.lit("text "), "pos")}
    )
    even = F.col("pack_id") % 2 == 0
    none = F.lit(None)
    return rows.withColumns(
        {
            "instructions": F.when(even, "Is it fine?").otherwise(F.col("instructions")),
            "options": F.when(even, none).otherwise(F.col("options")),
            "levels": F.when(even, none).otherwise(F.col("levels")),
            "criteria": F.when(even, F.create_map(F.lit("yes"), F.lit("it is"))).otherwise(F.col("criteria")),
        }
    )


@query(f"""WITH {ASKS}, p AS (SELECT *, pos // 8 AS pack_id, pos % 8 + 1 AS position, count(*) OVER (PARTITION BY pos // 8) AS n FROM q),
r AS (SELECT *, pack_id % 2 = 0 AND n > 1 AS shared, CASE WHEN pack_id % 2 = 0 THEN 'Is it fine?' ELSE told END AS i, CASE
 WHEN pack_id % 2 = 0 THEN 3 ELSE k END AS kk FROM p),
t AS (SELECT *, CASE WHEN n = 1 THEN i WHEN shared THEN 'Answer the question in guidance for item_' || position || ' alone; no other item matters.' ELSE i || ' Answer for item_' || position || ' alone; no other item matters.' END AS words FROM r),
b AS (SELECT pack_id, n, shared, string_agg('"item_' || position || '":"text ' || pos || '"', ',' ORDER BY position) AS state,
 string_agg('"item_' || position || '":{{"type":"' || {KIND.replace('CASE k', 'CASE kk')} || '","instructions":"' || words || '"' || CASE
 WHEN shared THEN '}}' ELSE {MORE.replace('CASE k', 'CASE kk')} END, ',' ORDER BY position) AS qs FROM t GROUP BY 1, 2, 3)
SELECT pack_id, n AS items, shared, '{{"model":"m","state":{{' || state || CASE
 WHEN shared THEN ',"guidance":"Is it fine?\\nyes: it is"' ELSE '' END || '}},"questions":{{' || qs || '}}}}' AS body FROM b""")
def packed_body(spark, sf):
    return qs.bodies(packs(spark, sf), "m", once=True)


@query(
    "SELECT printf('read-%05d', doc_id) AS id, 'Passage:' || chr(10) || text || chr(10) || chr(10) || 'Question: ' || lang || '?' AS input, CASE "
    "WHEN quality = 1 THEN 'yes' ELSE 'no' END AS target FROM documents JOIN labels USING (doc_id)"
)
def reading_corpus(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    return labelled.reading_corpus(
        rows.select(
            F.col("doc_id").alias("number"), F.col("text").alias("passage"), F.col("lang").alias("question"), (F.col("quality") == 1).alias("answer")
        ),
        "read",
    )


@query(
    "SELECT printf('topic-%05d', doc_id) AS id, text AS input, ['world', 'sports', 'business', 'science'][doc_id % 4 + 1] AS target FROM documents "
    "ORDER BY md5(doc_id || ':7'), doc_id LIMIT 3270"
)
def topic_corpus(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("number"), "text", (F.col("doc_id") % 4).alias("label"))
    return labelled.topic_corpus(rows, "topic", ("world", "sports", "business", "science"))


@query("SELECT doc_id AS pos, ['a', 'b', 'c'][doc_id % 3 + 1] AS way FROM documents")
def in_turn(spark, sf):
    return labelled.in_turn(table(spark, sf, "documents").select(F.col("doc_id").alias("pos")), ("a", "b", "c"))


@query(
    "SELECT doc_id AS pos, n_chars FROM documents WHERE n_chars % 997 <> 0 AND doc_id < coalesce((SELECT min(doc_id) FROM documents WHERE n_chars % "
    "997 = 0), 9223372036854775807)"
)
def answers_in_order(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), "n_chars")
    return judging.in_order(docs.select("pos"), docs.where("n_chars % 997 <> 0"))


@query(f"""WITH {A}, h AS (SELECT certainty, count(*) AS n, count(*) FILTER ("right") AS r FROM j GROUP BY 1), s AS (SELECT sum(n)
 OVER (ORDER BY certainty DESC) AS kept, sum(r) OVER (ORDER BY certainty DESC) AS kr FROM h),
b(bar) AS (VALUES (CAST(0.85 AS DOUBLE)), (CAST(0.9999 AS DOUBLE))) SELECT bar, NOT EXISTS (SELECT 1 FROM s WHERE kept >= 30
 AND CAST(kr AS DOUBLE) / kept >= bar) AS blocked FROM b""")
def blocked_bars(spark, sf):
    rows = judged(spark, sf)
    asked = [sel.blocked(sel.resolution(rows, bar)).select(F.lit(bar).alias("bar"), "blocked") for bar in (0.85, 0.9999)]
    return asked[0].unionByName(asked[1])

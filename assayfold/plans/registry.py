"""Queries of the library's own operators, by name, with their SQL.

Judgements here are those of a deterministic judge over labels: its certainty has 50 levels from 0.50 to 0.99, and it is
right about as often as it says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayfold.operators import experiments as ex
from assayfold.operators import judging
from assayfold.operators import selective as sel


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def answers(spark: SparkSession, sf_dir: str, salt: int = 0) -> DataFrame:
    k = (F.col("doc_id") * 7919 + 104729 + salt) % 50
    right = (F.col("doc_id") * 31 + 7 + salt * 3) % 100 < k + 50
    label = F.when(right, F.col("quality")).otherwise(1 - F.col("quality"))
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("pos"),
        F.col("quality").alias("gold"),
        label.alias("label"),
        (F.lit(0.5) + k / 100.0).alias("certainty"),
        F.when(F.col("doc_id") % 97 == 0, "unreadable answer").alias("error"),
    )


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).where("error is null").withColumn("right", F.col("label") == F.col("gold"))


def log(spark: SparkSession, sf_dir: str, copies: int = 6, salt: int = 0) -> DataFrame:
    """Every labelled document asked `copies` times, in packs of 32."""
    rows = table(spark, sf_dir, "labels").select(
        "doc_id", F.col("quality").alias("gold"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))).alias("c")
    )
    k = (F.col("doc_id") * 7919 + 104729 + salt) % 50
    right = (F.col("doc_id") * 31 + F.col("c") * 17 + 7 + salt * 3) % 100 < k + 50
    pos = F.col("doc_id") * copies + F.col("c")
    return rows.select(
        F.col("doc_id").alias("source"),
        pos.alias("pos"),
        "gold",
        F.when(right, F.col("gold")).otherwise(1 - F.col("gold")).alias("label"),
        (F.lit(0.5) + k / 100.0).alias("certainty"),
        (pos % 32 + 1).alias("position"),
        F.lit(32).alias("packed"),
        F.concat(F.lit("arm"), F.col("c") % 2).alias("arm"),
    )


A = """a AS (SELECT doc_id AS pos, quality AS gold, CASE WHEN (doc_id * 31 + 7) % 100 < (doc_id * 7919 + 104729) % 50 + 50 THEN quality ELSE 1 - quality END AS label,
 CAST(0.5 AS DOUBLE) + CAST((doc_id * 7919 + 104729) % 50 AS DOUBLE) / CAST(100 AS DOUBLE) AS certainty, CASE
 WHEN doc_id % 97 = 0 THEN 'unreadable answer' END AS error FROM labels),
j AS (SELECT *, label = gold AS "right" FROM a WHERE error IS NULL)"""
H = A + """, h AS (SELECT certainty, count(*) AS n, count(*) FILTER ("right") AS r, min(pos) AS f FROM j GROUP BY 1),
s AS (SELECT *, sum(n) OVER (ORDER BY certainty DESC) AS kept, sum(r) OVER (ORDER BY certainty DESC) AS kr, sum(n) OVER () AS total, sum(n)
 OVER (ORDER BY certainty) - n + (n + 1) / 2.0 AS rk FROM h)"""


def LOG(name: str = "l", salt: int = 0) -> str:
    return f"""{name} AS (SELECT doc_id AS source, doc_id * 6 + c AS pos, quality AS gold, CASE
 WHEN (doc_id * 31 + c * 17 + 7 + {salt} * 3) % 100 < (doc_id * 7919 + 104729 + {salt}) % 50 + 50 THEN quality ELSE 1 - quality END AS label,
 CAST(0.5 AS DOUBLE) + CAST((doc_id * 7919 + 104729 + {salt}) % 50 AS DOUBLE) / CAST(100 AS DOUBLE) AS certainty,
 (doc_id * 6 + c) % 32 + 1 AS position, 'arm' || (c % 2) AS arm FROM labels, range(0, 6) t(c))"""


AUC = "CASE WHEN r > 0 AND n > r THEN (ranks - r * (r + 1) / 2.0) / (CAST(r AS DOUBLE) * (n - r)) END"
BOUND = "1.96 * sqrt(greatest((z * (1 - z) + (r - 1) * (z / (2 - z) - z * z) + (n - r - 1) * (2 * z * z / (1 + z) - z * z)) / (CAST(r AS DOUBLE) * (n - r)), 0))"

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


@query(f"WITH {A} SELECT pos, certainty, certainty >= 0.8 AND error IS NULL AS trusted FROM a")
def triage_at_least(spark, sf):
    return sel.triage(answers(spark, sf), at_least=0.8).select("pos", "certainty", "trusted")


@query(
    f"WITH {A} SELECT a.pos, certainty, coalesce(rn <= floor(total * CAST(0.7 AS DOUBLE)), false) AS trusted FROM a LEFT JOIN (SELECT pos, "
    f"row_number() OVER (ORDER BY certainty DESC, pos) AS rn, count(*) OVER () AS total FROM j) t ON t.pos = a.pos"
)
def triage_keep(spark, sf):
    return sel.triage(answers(spark, sf), keep=0.7).select("pos", "certainty", "trusted")


@query(
    f"WITH {H}, x AS (SELECT sum(n) AS n, sum(r) AS r, sum(r * rk) AS ranks FROM s), y AS (SELECT n, r, {AUC} AS z FROM x) SELECT CAST(n AS BIGINT) "
    f"AS count, CAST(r AS BIGINT) AS n_right, z AS auroc, greatest(z - {BOUND}, 0) AS low, least(z + {BOUND}, 1) AS high FROM y"
)
def discrimination(spark, sf):
    return sel.discrimination(judged(spark, sf))


@query(
    f"WITH {H} SELECT (SELECT count(*) FROM h) AS levels, certainty AS crowd, CAST(n AS DOUBLE) / total AS share, CAST(r AS DOUBLE) / n AS "
    f"crowd_accuracy, (SELECT coalesce(max(CAST(kept AS DOUBLE) / total), 0) FROM s WHERE kept >= 30 AND CAST(kr AS DOUBLE) / kept >= 0.85) AS "
    f"reachable FROM s ORDER BY n DESC, f LIMIT 1"
)
def resolution(spark, sf):
    return sel.resolution(judged(spark, sf), 0.85)


@query(
    f"WITH {H} SELECT certainty, CAST(kept AS BIGINT) AS kept, CAST(total AS BIGINT) AS total, CAST(kr AS DOUBLE) / kept AS accuracy, "
    f"greatest((CAST(kr AS DOUBLE) / kept + 1.645 * 1.645 / (2 * kept) - 1.645 * sqrt(CAST(kr AS DOUBLE) / kept * (1 - CAST(kr AS DOUBLE) / kept) / "
    f"kept + 1.645 * 1.645 / (4.0 * kept * kept))) / (1 + 1.645 * 1.645 / kept), 0) AS reached FROM s WHERE kept >= 30"
)
def rungs(spark, sf):
    return sel.rungs(judged(spark, sf), z=1.645)


@query(
    f"WITH {H} SELECT certainty AS cut, CAST(kept AS DOUBLE) / total AS coverage, CAST(kr AS DOUBLE) / kept AS accuracy FROM s WHERE kept >= 30 AND "
    f"CAST(kr AS DOUBLE) / kept >= 0.85 ORDER BY certainty LIMIT 1"
)
def cut_for_accuracy(spark, sf):
    return sel.cut_for_accuracy(judged(spark, sf), 0.85)


@query(f"WITH {H} SELECT max(certainty) AS cut FROM s WHERE kept >= least(total - 1, greatest(0, floor(total * CAST(0.7 AS DOUBLE)) - 1)) + 1")
def cut_for_keep(spark, sf):
    return sel.cut_for_keep(judged(spark, sf), 0.7)


@query(f"""WITH {A}, h AS (SELECT label, certainty, count(*) AS n, count(*) FILTER ("right") AS r FROM j GROUP BY 1, 2),
s AS (SELECT *, sum(n) OVER d AS kept, sum(r) OVER d AS kr, sum(n) OVER (PARTITION BY label) AS total, sum(n) OVER (PARTITION BY label
 ORDER BY certainty) - n + (n + 1) / 2.0 AS rk FROM h WINDOW d AS (PARTITION BY label ORDER BY certainty DESC)),
x AS (SELECT label, sum(n) AS n, sum(r) AS r, sum(r * rk) AS ranks FROM s GROUP BY 1), y AS (SELECT label, n, r, {AUC} AS z FROM x),
b AS (SELECT *, greatest(z - {BOUND}, 0) AS low, least(z + {BOUND}, 1) AS high, CAST(r AS DOUBLE) / n AS acc FROM y),
c AS (SELECT label, min(certainty) AS cut, arg_min(CAST(kept AS DOUBLE) / total, certainty) AS coverage FROM s WHERE kept >= 30
 AND CAST(kr AS DOUBLE) / kept >= 0.85 GROUP BY 1),
t AS (SELECT *, CASE WHEN n < 100 THEN 'unknown' WHEN acc >= 0.85 THEN 'take' WHEN high < 0.5 THEN 'inverted'
 WHEN z IS NULL OR low <= 0.5 OR z < 0.6 OR cut IS NULL THEN 'send' ELSE 'cut' END AS action FROM b LEFT JOIN c USING (label))
SELECT label, CAST(n AS BIGINT) AS count, acc AS accuracy, acc AS floor, z AS auroc, low, high, CASE WHEN action = 'cut' THEN cut END AS cut, CASE
 WHEN action = 'cut' THEN coverage END AS coverage, action,
 CASE action WHEN 'unknown' THEN 'only ' || n || ' answers, fewer than routing needs' WHEN 'take' THEN 'right often enough without a cut: ' || printf('%.1f%%', 100 * acc)
  WHEN 'inverted' THEN printf('surer answers are wrong more often, AUROC at most %.3f: never cut here', high)
  WHEN 'send' THEN CASE WHEN z IS NULL OR low <= 0.5 OR z < 0.6 THEN 'its certainty says nothing about being right' ELSE 'no cut reaches the accuracy asked for' END
  ELSE printf('from %.3f on, %.1f%% of its answers', cut, 100 * coverage) END AS why FROM t ORDER BY count DESC, label""")
def calibration_by_label(spark, sf):
    return sel.routing(judged(spark, sf), 0.85)


def CALIBRATE(splits: int) -> str:
    """CTEs of a calibration at 0.85; e has the held-out scores of the splits, in order."""
    return f"""{H}, x AS (SELECT sum(n) AS n, sum(r) AS r, sum(r * rk) AS ranks FROM s), y AS (SELECT n, r, {AUC} AS z FROM x),
sp AS (SELECT j.*, split, row_number() OVER (PARTITION BY split ORDER BY md5(pos || ':' || split || ':7')) <= (SELECT n // 2 FROM y) AS fit FROM j,
 range(0, {splits}) t(split)),
hv AS (SELECT split, fit, certainty, count(*) AS n, count(*) FILTER ("right") AS r FROM sp GROUP BY ALL),
f AS (SELECT split, certainty, sum(n) OVER d AS kept, sum(r) OVER d AS kr FROM hv WHERE fit WINDOW d AS (PARTITION BY split ORDER BY certainty DESC)),
c AS (SELECT split, min(certainty) AS cut FROM f WHERE kept >= 30 AND CAST(kr AS DOUBLE) / kept >= 0.85 GROUP BY 1),
e0 AS (SELECT split, CAST(sum(n) FILTER (certainty >= cut) AS DOUBLE) / sum(n) AS coverage,
 CAST(sum(r) FILTER (certainty >= cut) AS DOUBLE) / sum(n) FILTER (certainty >= cut) AS accuracy FROM hv JOIN c USING (split) WHERE NOT fit GROUP BY 1),
e AS (SELECT *, row_number() OVER (ORDER BY accuracy) - 1 AS i, count(*) OVER () AS m FROM e0 WHERE coverage > 0),
g AS (SELECT *, CASE WHEN m >= 20 THEN greatest(0, CAST(floor(m * CAST(0.05 AS DOUBLE)) AS BIGINT) - 1) ELSE 0 END AS edge FROM e),
o AS (SELECT median(coverage) AS coverage, median(accuracy) AS accuracy, max(accuracy) FILTER (i = edge) AS low,
 max(accuracy) FILTER (i = m - 1 - edge) AS high, count(*) AS splits FROM g)
SELECT o.*, (SELECT min(certainty) FROM s WHERE kept >= 30 AND CAST(kr AS DOUBLE) / kept >= 0.85) AS cut, CAST(r AS DOUBLE) / n AS baseline,
 CAST(n AS BIGINT) AS items,
 z AS discrimination, CAST(0 AS DOUBLE) AS headroom, accuracy - CAST(r AS DOUBLE) / n AS gain FROM o, y"""


@query(f"WITH {CALIBRATE(20)}")
def calibrate(spark, sf):
    return sel.calibrate(judged(spark, sf), accuracy=0.85).drop("notes")


@query(f"WITH {CALIBRATE(60)}")
def calibrate_60(spark, sf):
    """60 splits, of which the two lowest and the two highest scores are beyond the interval."""
    return sel.calibrate(judged(spark, sf), accuracy=0.85, splits=60).drop("notes")


@query(f"""WITH {A} SELECT count(*) FILTER (error IS NOT NULL) || ' answers were not usable and are left out; triage sends them to review' AS note
 FROM a HAVING count(error) > 0
UNION ALL SELECT count(*) || ' rows are few; from 200 on the interval is narrower' FROM j HAVING count(*) < 200
UNION ALL SELECT printf('%.1f%%', 100 * avg(CAST("right" AS DOUBLE))) || ' are right without any cut, so none may be needed' FROM j
 HAVING avg(CAST("right" AS DOUBLE)) >= 0.7""")
def calibrate_notes(spark, sf):
    """The notes of a calibration of all answers, failures too, at a bar that they pass without a cut."""
    out = sel.calibrate(answers(spark, sf), accuracy=0.7)
    return out.select(F.explode("notes").alias("note"))


@query(
    f"WITH {LOG()}, v AS (SELECT source, label, count(*) AS n, sum(CAST(label = gold AS INT)) AS r FROM l GROUP BY 1, 2), i AS (SELECT source, "
    f"CAST(sum(r) AS DOUBLE) / sum(n) AS acc, CAST(max(n) AS DOUBLE) / sum(n) AS mode FROM v GROUP BY 1) SELECT count(*) AS items, avg(acc) AS "
    f"accuracy, avg(mode) AS steady FROM i"
)
def macro_accuracy(spark, sf):
    return ex.macro_accuracy(log(spark, sf))


@query(f"""WITH {LOG()}, v AS (SELECT source, gold, label, count(*) AS n, min(pos) AS f FROM l GROUP BY 1, 2, 3),
i AS (SELECT source, gold, first(label ORDER BY n DESC, f) AS major, arg_min(label, f) AS one, count(*) = 1 AS firm, CAST(sum(CASE
 WHEN label = gold THEN n ELSE 0 END) AS DOUBLE) / sum(n) AS acc FROM v GROUP BY 1, 2)
SELECT count(*) AS items, count(*) FILTER (firm) AS firm, avg(acc) FILTER (firm) AS firm_accuracy, avg(acc) FILTER (NOT firm) AS split_accuracy,
 avg(CAST(major = gold AS DOUBLE)) AS majority, avg(CAST(one = gold AS DOUBLE)) AS first_ask FROM i""")
def votes(spark, sf):
    return ex.votes(log(spark, sf))


BANDS = "CASE " + " ".join(
    f"WHEN certainty >= CAST({a} AS DOUBLE) AND certainty < CAST({b} AS DOUBLE) THEN CAST({a} AS DOUBLE)" for a, b in zip(ex.BANDS, ex.BANDS[1:])
) + " END"


@query(
    f"WITH {LOG()} SELECT {BANDS} AS band, count(*) AS n, avg(certainty) AS said, avg(CAST(label = gold AS DOUBLE)) AS happened, avg(CAST(label = "
    f"gold AS DOUBLE)) - avg(certainty) AS gap FROM l GROUP BY 1"
)
def reliability(spark, sf):
    return ex.reliability(log(spark, sf))


@query(
    f"WITH {LOG()}, b AS (SELECT {BANDS} AS band, count(*) AS n, avg(CAST(label = gold AS DOUBLE)) - avg(certainty) AS gap FROM l GROUP BY 1) "
    f"SELECT sum(n * abs(gap)) / sum(n) AS absolute, sum(n * gap) / sum(n) AS signed FROM b"
)
def calibration_gap(spark, sf):
    return ex.calibration_gap(log(spark, sf))


@query(
    f"WITH {LOG()}, o AS (SELECT *, row_number() OVER (ORDER BY certainty DESC, pos) AS rn, count(*) OVER () AS total FROM l), c AS (SELECT "
    f"CAST(unnest([1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.3]) AS DOUBLE) AS coverage) SELECT coverage, CAST(greatest(1, floor(any_value(total) * "
    f"coverage)) AS BIGINT) AS kept, avg(CAST(label = gold AS DOUBLE)) AS accuracy, min(certainty) AS edge FROM c, o WHERE rn <= greatest(1, "
    f"floor(total * coverage)) GROUP BY 1"
)
def risk_coverage(spark, sf):
    return ex.risk_coverage(log(spark, sf))


@query(
    f"WITH {LOG()} SELECT CAST(floor((position - 1) / 8) AS BIGINT) AS band, count(*) AS n, avg(CAST(label = gold AS DOUBLE)) AS accuracy FROM l "
    f"GROUP BY 1"
)
def position_bands(spark, sf):
    return ex.position_bands(log(spark, sf))


@query(
    f"WITH {LOG('l')}, {LOG('m', 3)}, a AS (SELECT source, avg(CAST(label = gold AS DOUBLE)) AS x FROM l GROUP BY 1), b AS (SELECT source, "
    f"avg(CAST(label = gold AS DOUBLE)) AS y FROM m GROUP BY 1) SELECT count(*) AS items, avg(y - x) AS difference, avg(CAST(x <> y AS DOUBLE)) AS "
    f"moved FROM a JOIN b USING (source)"
)
def paired_arms(spark, sf):
    return ex.paired(log(spark, sf), log(spark, sf, salt=3))


def COIN(text: str, at: int = 1) -> str:
    """The number from 0 to 1 that a text's hash gives from that digit on."""
    return f"CAST(CAST('0x' || substr(md5({text}), {at}, 8) AS BIGINT) AS DOUBLE) / 4294967296"


def POISSON(u: str) -> str:
    """How often a Poisson(1) count of quantile u draws."""
    return " + ".join(f"CAST({u} >= CAST({below!r} AS DOUBLE) AS INT)" for below in ex.poisson_table()[0])


def RESAMPLED(of: str, draws: int = 2000) -> str:
    """CTE bounds(low, high): the interval of the mean of `of`(unit, value), every unit drawn for itself."""
    return f"""drawn AS (SELECT draw, value, {COIN("concat_ws(':', unit, draw, 1)")} AS u FROM {of}, range(0, {draws}) t(draw)),
 weighed AS (SELECT draw, value, {POISSON("u")} AS w FROM drawn),
 means AS (SELECT sum(w * value) / sum(w) FILTER (value IS NOT NULL) AS m FROM weighed GROUP BY draw HAVING sum(w) FILTER (value IS NOT NULL) > 0),
 ranked AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS i, count(*) OVER () AS n FROM means),
 bounds AS (SELECT max(m) FILTER (i = floor(n * 0.025)) AS low, max(m) FILTER (i = floor(n * 0.975)) AS high FROM ranked)"""


def DRAWS(of: str, draws: int = 2000, tag: str = "") -> str:
    """CTE bounds<tag>(low, high): the interval of the mean of `of`(unit, value)."""
    table = ", ".join(f"({m + 1}, [{', '.join(f'CAST({x!r} AS DOUBLE)' for x in own)}])" for m, own in enumerate(ex.poisson_table()))
    number = "kind || ':' || draw || ':1'"
    return f"""kinds{tag} AS (SELECT CAST(round(value * 1e12) AS BIGINT) AS kind, count(*) AS m, avg(value) AS value FROM {of} GROUP BY 1),
 below{tag}(m, below) AS (VALUES {table}),
 drawn{tag} AS (SELECT draw, value, m, {COIN(number)} AS u, {COIN(number, 9)} AS v FROM kinds{tag}, range(0, {draws}) t(draw)),
 normal{tag} AS (SELECT *, sqrt(-2 * ln(1 - u)) * cos(2 * pi() * v) AS z FROM drawn{tag}),
 weighed{tag} AS (SELECT draw, value, CASE WHEN below IS NULL THEN greatest(0, round(n.m + sqrt(n.m) * z + (z * z - 1) / 6))
  ELSE len(list_filter(below, lambda b: b <= u)) END AS w FROM normal{tag} n LEFT JOIN below{tag} t ON t.m = n.m),
 means{tag} AS (SELECT sum(w * value) / sum(w) AS m FROM weighed{tag} GROUP BY draw HAVING sum(w) > 0),
 ranked{tag} AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS i, count(*) OVER () AS n FROM means{tag}),
 bounds{tag} AS (SELECT max(m) FILTER (i = floor(n * 0.025)) AS low, max(m) FILTER (i = floor(n * 0.975)) AS high FROM ranked{tag})"""


@query(
    f"WITH {LOG()}, units AS (SELECT source AS unit, avg(CAST(label = gold AS DOUBLE)) AS value FROM l GROUP BY 1), "
    f"{RESAMPLED('units')} SELECT low, high FROM bounds"
)
def bootstrap(spark, sf):
    return ex.bootstrap(log(spark, sf))


@query(
    f"WITH {LOG()}, r(arm, usd) AS (VALUES ('arm0', CAST(0.25 AS DOUBLE)), ('arm1', CAST(0.5 AS DOUBLE))) SELECT arm, count(*) AS n, "
    f"avg(CAST(certainty >= 0.8 AS DOUBLE)) AS kept, avg(CAST(label = gold AS DOUBLE)) FILTER (certainty >= 0.8) AS accuracy, max(usd) / count(*) * "
    f"1000 / avg(CAST(certainty >= 0.8 AS DOUBLE)) AS usd_per_1000 FROM l JOIN r USING (arm) GROUP BY 1"
)
def price_of_trust(spark, sf):
    return ex.price(log(spark, sf), spark.createDataFrame([("arm0", 0.25), ("arm1", 0.5)], "arm string, usd double"), 0.8)


#: Counter samples, one a minute that has events.
SAMPLES = """m AS (SELECT CAST(floor(epoch_us(ts) / 60000000) * 60 AS DOUBLE) AS t, count(*) AS requests, sum(event_id % 100) AS input_tokens,
 count(*) FILTER (event_type = 'click') AS retries,
 count(*) FILTER (event_id % 7 = 0) AS pushback, CAST(count(*) * 0.5 AS DOUBLE) AS waited FROM events GROUP BY 1),
c AS MATERIALIZED (SELECT row_number() OVER w - 1 AS i, t, CAST(sum(requests) OVER w AS BIGINT) AS requests, sum(input_tokens) OVER w AS input_tokens,
 sum(retries) OVER w AS retries, sum(pushback) OVER w AS pushback, sum(waited) OVER w AS waited FROM m WINDOW w AS (ORDER BY t)),
s(k, i) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION ALL SELECT s.k + 1, min(c.i) FROM s JOIN c ON c.i > s.i AND c.t >= (SELECT min(t)
 FROM c) + (s.k + 1) * 3600 GROUP BY s.k),
r AS (SELECT b.t - (SELECT min(t) FROM c) AS "from", a.t - b.t AS seconds,
 CAST(a.requests - b.requests AS DOUBLE) / (a.t - b.t) * 60 AS requests_per_minute,
 CAST(a.requests - b.requests AS DOUBLE) / (a.t - b.t) * 32 AS items_per_second,
 CAST(a.input_tokens - b.input_tokens AS DOUBLE) / (a.t - b.t) AS tokens_per_second, CAST(a.retries - b.retries AS BIGINT) AS retries,
 CAST(a.pushback - b.pushback AS BIGINT) AS pushback, a.waited - b.waited AS waited
 FROM s x JOIN s y ON y.k = x.k - 1 JOIN c a ON a.i = x.i JOIN c b ON b.i = y.i)"""


def samples(spark, sf):
    e = table(spark, sf, "events")
    per = e.groupBy((F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000) * 60).cast("double").alias("t"))
    per = per.agg(
        F.count("*").alias("requests"),
        F.sum(F.col("event_id") % 100).alias("input_tokens"),
        F.count_if(F.col("event_type") == "click").alias("retries"),
        F.count_if(F.col("event_id") % 7 == 0).alias("pushback"),
        (F.count("*") * 0.5).alias("waited"),
    )
    upto = W.orderBy("t")
    return per.select("t", *(F.sum(c).over(upto).alias(c) for c in ex.COUNTERS))


@query(f'WITH RECURSIVE {SAMPLES} SELECT "from", seconds, requests_per_minute, items_per_second, tokens_per_second, retries, pushback, waited FROM r')
def rate_windows(spark, sf):
    return ex.rate_windows(samples(spark, sf), 3600, 32)


@query(f"""WITH RECURSIVE {SAMPLES}, w AS (SELECT *, row_number() OVER (ORDER BY "from") - 1 AS k, count(*) OVER () - 1 AS rest FROM r),
x AS (SELECT max(rest) AS windows, avg(requests_per_minute) FILTER (k = 0) AS burst, avg(requests_per_minute) FILTER (k > 0) AS held,
 median(requests_per_minute) FILTER (k > 0) AS middle, min(requests_per_minute) FILTER (k > 0) AS least,
 max(requests_per_minute) FILTER (k > 0) AS most, avg(items_per_second) FILTER (k > 0) AS items_per_second,
 avg(tokens_per_second) FILTER (k > 0) AS tokens_per_second,
 avg(requests_per_minute) FILTER (k BETWEEN 1 AND rest // 2) AS early, avg(requests_per_minute) FILTER (k > rest // 2) AS late FROM w)
SELECT *, CASE WHEN windows >= 4 THEN (late - early) / early END AS drift FROM x""")
def sustained(spark, sf):
    return ex.sustained(ex.rate_windows(samples(spark, sf), 3600, 32))


@query(
    "WITH e AS (SELECT epoch_us(ts) AS t FROM events), n AS (SELECT t, count(*) OVER w AS n, min(t) OVER w AS start FROM e WINDOW w AS (ORDER BY t "
    "RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW)) SELECT max(n) AS most, (SELECT CAST(start - (SELECT min(t) FROM e) AS DOUBLE) / 1e6 FROM n "
    "ORDER BY n DESC, t LIMIT 1) AS began FROM n"
)
def worst_window(spark, sf):
    return ex.worst_window(table(spark, sf, "events"))


@query(
    "WITH v AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL) SELECT "
    "count(*) AS n, avg(value) AS mean, median(value) AS median, max(value) FILTER (i = least(n - 1, CAST(round_even((n - 1) * CAST(0.95 AS "
    "DOUBLE), 0) AS BIGINT))) AS p95, max(value) FILTER (i = least(n - 1, floor(n * CAST(0.95 AS DOUBLE)))) AS tail FROM v"
)
def latency_percentiles(spark, sf):
    return ex.percentiles(table(spark, sf, "events"), "value")


def items(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), F.col("text").alias("item"))
    return docs.withColumn("key", F.substring(F.sha2("item", 256), 1, 32))


@query("SELECT text AS item, min(doc_id) AS pos, count(*) AS copies FROM documents GROUP BY 1")
def dedupe_first(spark, sf):
    return items(spark, sf).groupBy("key").agg(F.min_by("item", "pos").alias("item"), F.min("pos").alias("pos"), F.count("*").alias("copies")).drop(
        "key"
    )


@query("SELECT min(doc_id) AS pos, text AS item FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 3 = 0) GROUP BY text")
def resume_anti_join(spark, sf):
    ledger = items(spark, sf).where("pos % 3 = 0").select("key").distinct()
    return judging.todo(items(spark, sf), ledger).select("pos", "item")


@query(
    "SELECT doc_id AS pos, min(doc_id) OVER (PARTITION BY text) AS answered_by, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY text) THEN "
    "'asked' ELSE 'copied' END AS origin FROM documents"
)
def fan_back(spark, sf):
    first = items(spark, sf).groupBy("key").agg(F.min("pos").alias("pos")).withColumn("answered_by", F.col("pos"))
    return judging.fan_back(items(spark, sf), first).select("pos", "answered_by", "origin")


@query("""WITH RECURSIVE d AS (SELECT doc_id AS pos, row_number() OVER (ORDER BY doc_id) AS i, length(text) + 12 AS c FROM documents),
r AS (SELECT pos, i, CAST(0 AS BIGINT) AS pack_id, 1 AS position, c AS used FROM d WHERE i = 1
UNION ALL SELECT d.pos, d.i, CASE WHEN position < 32 AND used + c < 98000 THEN pack_id ELSE pack_id + 1 END, CASE WHEN position < 32
 AND used + c < 98000 THEN position + 1 ELSE 1 END, CASE WHEN position < 32 AND used + c < 98000 THEN used + c ELSE c END FROM r
 JOIN d ON d.i = r.i + 1)
SELECT pos, pack_id, CAST(position AS INTEGER) AS position, CAST(count(*) OVER (PARTITION BY pack_id) AS INTEGER) AS packed FROM r""")
def plan_packs(spark, sf):
    return judging.plan_packs(items(spark, sf).select("pos", "item")).drop("item")


P = "CAST(n_chars % 101 AS DOUBLE) / 100"


@query(f"""WITH d AS (SELECT doc_id AS pos, doc_id % 4 AS k, {P} AS p, CAST(n_chars % 25 AS DOUBLE) / 10 AS s FROM documents)
SELECT pos, CASE k WHEN 0 THEN 'noul' WHEN 1 THEN 'choice' WHEN 2 THEN 'score' ELSE 'error' END AS kind,
 CASE k WHEN 0 THEN CASE WHEN p >= 0.5 THEN 'yes' ELSE 'no' END WHEN 1 THEN 'b' WHEN 2 THEN CASE CAST(round_even(s, 0) AS INT) WHEN 0 THEN 'low'
 WHEN 1 THEN 'mid' ELSE 'high' END ELSE '' END AS label,
 CASE k WHEN 0 THEN p WHEN 1 THEN p WHEN 2 THEN CASE CAST(round_even(s, 0) AS INT) WHEN 0 THEN CAST(0.2 AS DOUBLE)
 WHEN 1 THEN CAST(0.3 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END ELSE 0 END AS p,
 CASE WHEN k = 3 THEN 'unreadable answer' END AS error FROM d""")
def decode_answers(spark, sf):
    p, s, k = (F.col("n_chars") % 101) / 100.0, (F.col("n_chars") % 25) / 10.0, F.col("doc_id") % 4
    payload = F.when(k == 0, F.format_string('{"noul": %s}', p.cast("string"))).when(
        k == 1, F.format_string('{"choice": "b", "probabilities": {"b": %s, "a": 0.1}}', p.cast("string"))
    )
    payload = payload.when(
        k == 2,
        F.format_string(
            '{"score": %s, "legend": {"0": "low", "1": "mid", "2": "high"}, "probabilities": {"0": 0.2, "1": 0.3, "2": 0.5}}', s.cast("string")
        ),
    ).otherwise('{"surprise": 1}')
    out = judging.decode(table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), payload.alias("payload")))
    return out.select("pos", "kind", "label", "p", "error")


@query("SELECT doc_id AS pos, left(text, 300) AS head, right(text, 300) AS tail FROM documents")
def trim(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("pos"), F.left("text", F.lit(300)).alias("head"), F.right("text", F.lit(300)).alias("tail")
    )


@query("""WITH r AS (SELECT event_id, event_id % 100 AS input_tokens, event_id % 10 AS output_tokens, CASE
 WHEN event_type = 'click' THEN 1 ELSE 0 END AS retries, value AS waited FROM events),
t AS (SELECT CASE event_id % 4 WHEN 0 THEN 'asked' WHEN 1 THEN 'copied' WHEN 2 THEN 'cached' ELSE 'resumed' END AS origin, CASE
 WHEN event_id % 11 = 0 THEN 'e' END AS error FROM events),
q AS (SELECT count(*) AS requests, CAST(sum(retries) AS BIGINT) AS retries, sum(waited) AS waited, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
 CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM r),
w AS (SELECT count(*) AS items, count(*) FILTER (origin IN ('copied', 'cached') AND error IS NULL) AS cached,
 count(*) FILTER (origin = 'resumed') AS resumed, count(error) AS skipped FROM t)
SELECT *, greatest(0, items - cached - resumed) AS answered, input_tokens * 0.042 / 1e6 AS usd, CAST(input_tokens AS DOUBLE) / greatest(0,
 items - cached - resumed) AS tokens_per_item FROM q, w""")
def usage(spark, sf):
    e = table(spark, sf, "events")
    requests = e.select(
        (F.col("event_id") % 100).alias("input_tokens"),
        (F.col("event_id") % 10).alias("output_tokens"),
        (F.col("event_type") == "click").cast("int").alias("retries"),
        F.col("value").alias("waited"),
    )
    k = F.col("event_id") % 4
    origin = F.when(k == 0, "asked").when(k == 1, "copied").when(k == 2, "cached").otherwise("resumed")
    return judging.usage(requests, e.select(origin.alias("origin"), F.when(F.col("event_id") % 11 == 0, "e").alias("error")))


@query("SELECT doc_id AS pos, CASE WHEN n_chars % 2 = 0 THEN 'yes' ELSE 'no' END AS label FROM documents")
def judge_end_to_end(spark, sf):
    def ask(texts):
        import json

        return [json.dumps({"noul": 0.9 if len(t) % 2 == 0 else 0.1}) for t in texts]

    return judging.judge(items(spark, sf), ask, longest=None).select("pos", "label")


@query("""WITH d AS (SELECT doc_id AS pos, text, n_chars, min(doc_id) OVER (PARTITION BY text) AS first FROM documents), k AS (SELECT DISTINCT text
 FROM d WHERE pos % 3 = 0)
SELECT pos, CASE WHEN k.text IS NOT NULL THEN 'no' WHEN length(d.text) % 2 = 0 THEN 'yes' ELSE 'no' END AS label, CASE
 WHEN k.text IS NOT NULL THEN CAST(0.75 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END AS certainty,
 CASE WHEN k.text IS NOT NULL THEN 'resumed' WHEN pos = first THEN 'asked' ELSE 'copied' END AS origin FROM d LEFT JOIN k ON k.text = d.text""")
def judge_resumed(spark, sf):
    def ask(texts):
        import json

        return [json.dumps({"noul": 0.9 if len(t) % 2 == 0 else 0.1}) for t in texts]

    rows = items(spark, sf)
    none = F.lit(None)
    known = rows.where("pos % 3 = 0").select("key").distinct().select(
        "key",
        F.lit(0.25).alias("p"),
        F.lit("no").alias("label"),
        F.lit("noul").alias("kind"),
        none.cast("map<string,double>").alias("distribution"),
        none.cast("double").alias("confidence"),
        F.lit(1).alias("position"),
        F.lit(1).alias("packed"),
        none.cast("double").alias("score"),
    )
    return judging.judge(rows, ask, known, longest=None).select("pos", "label", "certainty", "origin")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from assayfold.plans import more, runs  # noqa: F401  register their own

    return {name: f for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    from assayfold.plans import more, runs  # noqa: F401

    return {name: sql for name, (_, sql) in QUERIES.items() if sql}

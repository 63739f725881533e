"""Labelled corpora and logs as JSON lines and CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayfold.operators import order


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """id, input, target, agreed of a labelled JSONL corpus; notices and half-written rows are dropped.

    A row without an id gets its text's hash. agreed is the truth of the value that stands there: empty text, 0, false
    and empty lists or objects are not, any other text is, the word "false" too; null where nothing stands."""
    rows = spark.read.schema("id string, input string, target string, metadata struct<agreement: string>, _line string").option(
        "columnNameOfCorruptRecord", "_line"
    ).json(path)
    value = F.col("metadata.agreement")
    agreed = F.when(value.isNotNull(), ~value.isin("", "0", "0.0", "false", "[]", "{}"))
    rows = rows.where("_line is null and input is not null and coalesce(target, '') <> ''")
    return rows.select(F.coalesce("id", F.sha2("input", 256)).alias("id"), "input", "target", agreed.alias("agreed"))


def write_answers_csv(answers: DataFrame, path: str) -> None:
    """item, label, p with four decimals."""
    answers.select("item", "label", F.format_string("%.4f", F.col("p")).alias("p")).write.mode("overwrite").option("header", True).csv(path)


def repeats(items: DataFrame, copies: int) -> DataFrame:
    """Every item `copies` times, numbered."""
    return items.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))


def workload(spark: SparkSession, n: int, parts: tuple[tuple[str, ...], ...]) -> DataFrame:
    """n deterministic texts (pos, item) put together from lists of words."""
    pick = [F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(words))) + 1).cast("int")) for k, words in enumerate(parts)]
    return spark.range(n).select(F.col("id").alias("pos"), F.concat_ws(" ", *pick).alias("item"))


def reading_corpus(rows: DataFrame, name: str) -> DataFrame:
    """id, input, target of yes/no reading (number, passage, question, answer): the passage, then what is asked of it."""
    said = F.concat(F.lit("Passage:\n"), "passage", F.lit("\n\nQuestion: "), "question", F.lit("?"))
    return rows.select(corpus_id(name), said.alias("input"), F.when(F.col("answer"), "yes").otherwise("no").alias("target"))


def topic_corpus(rows: DataFrame, name: str, topics: tuple[str, ...], n: int = 3270, seed: int = 7) -> DataFrame:
    """id, input, target of n of the rows (number, text, label), the same ones for a seed; label counts topics from 0."""
    some = sample(rows.withColumn("id", F.col("number")), n, seed)
    target = F.element_at(F.array(*map(F.lit, topics)), (F.col("label") + 1).cast("int"))
    return some.select(corpus_id(name), F.col("text").alias("input"), target.alias("target"))


def corpus_id(name: str) -> Column:
    """Ids that sort as their numbers do, up to five digits."""
    return F.format_string(f"{name}-%05d", F.col("number")).alias("id")


def in_turn(items: DataFrame, ways: tuple[str, ...]) -> DataFrame:
    """items with `way`: those of the list in turn, by pos."""
    return items.withColumn("way", F.element_at(F.array(*map(F.lit, ways)), (F.pmod("pos", F.lit(len(ways))) + 1).cast("int")))


def case_ids(items: DataFrame, copies: int) -> DataFrame:
    """Every item `copies` times, with `case`: its id and the number of the copy."""
    return repeats(items, copies).withColumn("case", F.concat_ws("#", "id", "copy"))


def sample(items: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """n items without replacement, the same ones for a seed, by a hash of their ids."""
    return items.orderBy(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed)))), "id").limit(n)


def shuffled(items: DataFrame, seed: int = 7) -> DataFrame:
    """items with `place`, their rank from 0 in a seeded order of work that does not depend on theirs: the key to join answers
    of a shuffled run back on. Ids are all different."""
    hashed = items.withColumn(
        "_h", F.conv(F.substring(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed)))), 1, 12), 16, 10).cast("long")
    )
    return order.running(hashed, "_h", {"place": F.lit(1)}, then=("id",)).withColumn("place", F.col("place") - 1).drop("_h")


def in_their_places(answers: DataFrame, shuffled_items: DataFrame) -> DataFrame:
    """Answers of a shuffled run (place and more) with the items' own columns."""
    return shuffled_items.join(answers, "place")


def write_noted(rows: DataFrame, path: str, note: str) -> None:
    """Rows as JSON lines, with one line that holds the note alone; `read_labelled` and `read_log` step over it."""
    rows.write.mode("overwrite").json(path)
    rows.sparkSession.createDataFrame([(note,)], "note string").coalesce(1).write.mode("append").json(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Rows of measurements as JSON lines, added to those that are there; columns without a value are left out of a line."""
    metrics.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, row: str, head: str = "") -> tuple[DataFrame, DataFrame]:
    """(rows, heads) of a run log of JSON lines in which heads, or notes, stand among rows.

    row and head are schemas; a line is a row where the first column of `row` is there, a head where it is not."""
    first = row.split()[0]
    lines = spark.read.schema(", ".join(x for x in (row, head, "_line string") if x)).option("columnNameOfCorruptRecord", "_line").json(path).where(
        "_line is null"
    )
    names = lambda schema: [x.strip().split()[0] for x in schema.split(",")]
    return lines.where(F.col(first).isNotNull()).select(*names(row)), lines.where(F.col(first).isNull()).select(*(names(head) if head else []))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Counter samples (t, requests, input_tokens, retries, pushback, waited) of a sustained run. Older logs hold
    pushback as counts by status, which are added up; lines without t are heads."""
    lines = spark.read.schema("t double, requests long, input_tokens long, retries long, pushback string, waited double").json(path).where(
        "t is not null"
    )
    by_status = F.aggregate(F.map_values(F.from_json("pushback", "map<string, long>")), F.lit(0).cast("long"), lambda a, x: a + x)
    return lines.withColumn("pushback", F.when(F.col("pushback").startswith("{"), by_status).otherwise(F.col("pushback").cast("long")))

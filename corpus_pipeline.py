"""From raw documents to packed training sequences, stage by stage; each stage's rows are written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayfold.llm import compression_classifier, cost_packing, entropy_mixing, parity_join, quality_rules
from assayfold.llm.common import delete, new_path, table


def free_name(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have yet."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, fitted on the labelled ones of sf_dir, does not call bad.

    Every row is scored for itself, on its whole text: null texts as empty ones, repeated rows alike, ids that are null
    or unknown to the labels like others. An empty table stays empty; all columns come back as they were."""
    model = compression_classifier.fit(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "score")
    return compression_classifier.score(docs, model, score).where(F.col(score) >= 0.5).drop(score)


def ruled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule.

    A filter on one column, so no name can clash: null and empty texts have no words and go, repeated rows stay or go
    together, very long texts are judged whole, an empty table stays empty."""
    return docs.where(quality_rules.verdict(docs["text"])["kept"])


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id, with every text it has.

    Documents without an id stay, and so do those without words, which link with nothing. Rows of equal id and text (null
    ids are equal here) become one, the smallest by its other columns. An empty table stays empty."""
    groups = parity_join.near_duplicates(docs)
    firsts = groups.where("doc_id = component_id").select("doc_id").distinct()
    taken = docs.join(firsts, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where("doc_id is null"))
    other = [c for c in docs.columns if c not in ("doc_id", "text")]
    one = taken.groupBy("doc_id", "text").agg(F.min(F.struct(*other)).alias("o"))
    return one.select(*[F.col("o")[c].alias(c) if c in other else c for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, which may be never.

    Rows of equal id, source and text are taken together as often as the mix takes them all: each equally often, and
    what is left over as copies of the smallest of them by its other columns. Texts without words count nothing and
    stay. An empty table stays empty; all columns come back as they were."""
    hash_, id_, n, each, more = (free_name(docs, c) for c in ("_hash", "_id", "_n", "_each", "_more"))
    copies = entropy_mixing.mix(docs).groupBy(F.col("doc_id").alias(id_), F.col("row_hash").alias(hash_)).agg(
        F.sum("copies").alias(more), F.count("*").alias(n)
    )
    copies = copies.select(id_, hash_, n, F.floor(F.col(more) / F.col(n)).cast("int").alias(each), (F.col(more) % F.col(n)).cast("int").alias(more))
    on = F.col("doc_id").eqNullSafe(F.col(id_)) & (entropy_mixing.row_hash() == F.col(hash_))
    often = lambda rows, times: rows.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
    whole = often(docs.join(copies.where(F.col(each) > 0), on), each)
    # a left-over exists only among repeated rows: few, and one row a group is enough
    rest = docs.join(copies.where(F.col(more) > 0), on).groupBy(id_, hash_, more).agg(F.min(F.struct(*docs.columns)).alias("o"))
    return whole.unionByName(often(rest.select(more, "o.*"), more))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens, dealt into sequences of balanced cost.

    Null and empty texts are one piece, the end id; repeated rows and null ids are packed like any other, very long texts
    in full sequences; an empty table gives no rows; other columns are left out."""
    return cost_packing.pack(docs)


STAGES = [
    ("quality classifier", classified),
    ("quality rules", ruled),
    ("n-gram jaccard join", deduplicated),
    ("source mixing", mixed),
    ("cost-balanced packing", packed),
]
#: The classifier's compressed sizes and the tokenizer have no SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents; a stage's rows are deleted when the next one's are written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"stage-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs

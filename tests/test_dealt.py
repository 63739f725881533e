"""How many tasks ask, and so how much of the texts one of them reads."""

import json

from assayfold.operators import judging, questions


def task():
    from pyspark import TaskContext

    return str(TaskContext.get().partitionId())


def chosen():
    at = task()
    return {"choice": at, "probabilities": {at: 1.0}}


def partitions(spark, number, judged):
    """How many tasks answered, with so many partitions in the session."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(number))
    try:
        return len({r.label for r in judged().select("label").collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_questions_go_over_the_sessions_partitions(spark):
    rows = spark.range(300).selectExpr("id AS pos", "concat('text ', id) AS item")
    rows = questions.with_defaults(rows, instructions="Is it good?")
    post = lambda body: json.dumps({"answers": {"item_1": chosen()}})
    asked = lambda **more: lambda: judging.judge_questions(rows, post, pack=1, **more)
    assert partitions(spark, 16, asked()) == 16
    assert partitions(spark, 3, asked(workers=3)) == 3 and partitions(spark, 16, asked(workers=2)) == 2  # a bound that is given holds


def test_items_go_over_the_sessions_partitions(spark):
    items = spark.range(300).selectExpr("id AS pos", "concat('text ', id) AS item", "cast(id AS string) AS key")
    ask = lambda texts: [json.dumps(chosen()) for _ in texts]
    asked = lambda **more: lambda: judging.judge(items, ask, pack=1, **more)
    assert partitions(spark, 16, asked()) == 16
    assert partitions(spark, 3, asked(workers=3)) == 3 and partitions(spark, 16, asked(workers=2)) == 2

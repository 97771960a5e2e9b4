import random

from pyspark.sql import functions as F

from marketlens.operators.ordered import numbered


def test_numbers_follow_the_order(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(40)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(5)
    got = numbered(df, [F.asc_nulls_first("k"), F.desc("v")]).orderBy("row_number").collect()
    assert [r["row_number"] for r in got] == list(range(3000))
    assert [(r["k"], r["v"]) for r in got] == sorted(rows, key=lambda r: (r[0] or "", -r[1]))
    assert numbered(df.limit(0), ["v"]).count() == 0


def test_equal_rows_are_dealt_to_many_tasks(spark):
    df = spark.range(20000).select(F.lit("one").alias("k"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        numbers = numbered(df, ["k"])
        assert numbers.agg(F.min("row_number"), F.max("row_number"), F.countDistinct("row_number")).first()[:] == (0, 19999, 20000)
        assert len(numbers.inputFiles()) > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")

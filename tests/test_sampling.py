"""Positional operators are exact and independent of the partitioning."""
from pyspark.sql import functions as F

from siftwise.operators import sampling as Q


def test_with_position_matches_sort(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("k"), F.col("id"))
    for parts in (1, 4, 16):
        got = Q.with_position(df.repartition(parts), ["k", "id"], partitions=parts)
        rows = got.orderBy("pos").select("k", "id", "pos").collect()
        assert [r["pos"] for r in rows] == list(range(5000))
        assert [(r["k"], r["id"]) for r in rows] == sorted((r["k"], r["id"]) for r in rows)


def test_head_ratio_counts(spark):
    df = spark.range(0, 1001).withColumnRenamed("id", "seq").withColumn("src", F.col("seq") % 3)
    assert Q.head_ratio(df, ["src", "seq"], 0.1).count() == 101
    assert Q.head_ratio(df, ["src", "seq"], 0.0001).count() == 1
    try:
        Q.head_ratio(df, ["src", "seq"], 1.5)
        raise AssertionError("ratio above 1 must be rejected")
    except ValueError:
        pass


def test_seed_sample_falls_back_to_pool(spark):
    pool = spark.range(0, 100)
    few = spark.range(0, 10)
    got = Q.seed_sample(few, pool, 25)
    assert got.count() == 25
    many = spark.range(0, 60)
    assert {r["id"] for r in Q.seed_sample(many, pool, 25).collect()} <= set(range(60))

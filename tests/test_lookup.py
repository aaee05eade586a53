"""Derived tables join the same way whether they may be broadcast or not."""

import pytest
from pyspark.sql import functions as F

from loanloom.operators.lookup import attach_lookup, null_safe_join, small_or_lazy, split_by_size


@pytest.fixture(scope="module")
def sides(spark):
    big = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id"))
    return big, big.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@pytest.mark.parametrize("max_rows", [5, 100_000])
def test_attach(sides, max_rows):
    big, groups = sides
    spark = big.sparkSession
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = attach_lookup(big, groups, ["k"], max_rows=max_rows)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" in plan) == (max_rows > 5)
        assert joined.count() == 1000 and joined.filter("k = 0").first()["n"] == 334
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_only_the_limit_is_read(sides):
    table, small = small_or_lazy(sides[1], 10)
    assert not small and table is sides[1]
    table, small = small_or_lazy(sides[1], 10_000)
    assert small and table.count() == sides[1].count()


def test_split_by_size(sides):
    big, _ = sides
    small, large = split_by_size(big, ["k"], 100)
    assert large.select("k").distinct().collect()[0]["k"] == 0 and large.count() == 334 and small.count() == 666
    assert split_by_size(big, ["k"], 1000)[1] is None


def test_a_null_key_is_a_group(sides):
    big = sides[0].withColumn("k", F.when(F.col("k") == 0, None).otherwise(F.col("k")))
    small, large = split_by_size(big, ["k"], 100)
    assert large.count() == large.filter("k IS NULL").count() == 334 and small.count() == 666
    assert null_safe_join(big, big.groupBy("k").agg(F.count(F.lit(1)).alias("n")), ["k"]).filter("n = 334").count() == 334

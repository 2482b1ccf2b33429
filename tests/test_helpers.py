"""Helpers behind the scale design: size checks, partitioning, materialising, one-row values."""

import pytest
from pyspark.sql import functions as F

from clientele.functions.partitioning import materialize, sized, spread
from clientele.functions.scalars import row_values


def test_spread_only_when_short_of_partitions(spark):
    par = spark.sparkContext.defaultParallelism
    many = spark.range(0, 1000, numPartitions=par * 2)
    assert spread(many) is many
    one = spark.range(0, 1000, numPartitions=1)
    assert spread(one).rdd.getNumPartitions() == par


def test_spread_starts_no_job(spark):
    """Also on an input with a shuffle, whose partitions could only be known by running it."""
    grouped = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    spark.sparkContext.setJobGroup("spread", "spread")
    assert spread(grouped) is grouped
    spread(spark.range(0, 1000, numPartitions=1))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("spread")
    spark.sparkContext.setJobGroup("rest", "rest")
    assert not jobs


def test_sized_coalesces_without_losing_rows(spark):
    df = spark.range(0, 1000, numPartitions=8).persist()
    s = sized(df, rows_per_partition=300)
    assert s.rdd.getNumPartitions() == 4 and s.count() == 1000
    df.unpersist()


def test_materialize_keeps_data_and_cuts_lineage(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    m = materialize(df)
    assert sorted(r.x for r in m.collect()) == [2 * i for i in range(100)]
    assert "Scan ExistingRDD" in m._jdf.queryExecution().executedPlan().toString()


def test_row_values_one_subquery(spark):
    one = spark.range(10).agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    v = row_values(one)
    r = spark.range(3).select((F.col("id") + v["lo"] + v["hi"]).alias("s")).collect()
    assert [x.s for x in r] == [9, 10, 11]


def test_half_even_profile(spark):
    from clientele.operators.segment_stats import segment_profile
    df = spark.createDataFrame([(0, 1.0), (0, 1.5), (1, 2.0), (1, 2.5)], "c int, v double")
    got = {r.c: r.v for r in segment_profile(df, "c", ["v"], digits=1, half_even=True).collect()}
    assert got == {0: 1.2, 1: 2.2}  # 1.25 -> 1.2 and 2.25 -> 2.2 (half to even)

"""Hand-written edge rows (FIXTURES section 3) not covered elsewhere."""

import datetime as dt

from pyspark.sql import functions as F

from clientele.operators.churn_stats import safest_option
from clientele.operators.customer import percentile_profile
from clientele.operators.rfm import rfm
from clientele.operators.segment_model import segment


def test_recency_whole_days(spark):
    last = dt.datetime(2021, 3, 10, 12, 0)
    # snapshot = max date + 1 day: the hours before it are 24, 47, 48 and 71
    rows = [(1, last, 1.0), (2, last - dt.timedelta(hours=23), 1.0), (3, last - dt.timedelta(hours=24), 1.0),
            (4, last - dt.timedelta(hours=47), 1.0), (None, last, 5.0)]
    df = spark.createDataFrame(rows, "CustomerID long, InvoiceDate timestamp_ntz, TotalAmount double")
    got = {r.CustomerID: r.Recency for r in rfm(df).collect()}
    # whole 24-hour days, not calendar days; the NULL id is no customer
    assert got == {1: 1, 2: 1, 3: 2, 4: 2}


def test_rfm_single_customer(spark):
    df = spark.createDataFrame([(7, dt.datetime(2020, 1, 1), 2.5)], "CustomerID long, InvoiceDate timestamp_ntz, TotalAmount double")
    r = rfm(df).first()
    assert (r.Recency, r.Frequency, r.Monetary) == (1, 1, 2.5)


def test_percentile_profile_null_metric_and_single_row(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 2.0, None), (3, 2.0, 7.0), (4, 4.0, 9.0)],
                               "id long, a double, b double")
    got = {(r.id, r.metric): r.percentile for r in percentile_profile(df, "id", ["a", "b"]).collect()}
    # row 2 has a missing metric: 50 for both; the others rank among rows 1, 3, 4
    assert got[(2, "a")] == 50.0 and got[(2, "b")] == 50.0
    assert round(got[(1, "a")], 6) == round(100 / 3, 6) and got[(4, "b")] == 100.0
    one = spark.createDataFrame([(1, 3.0)], "id long, a double")
    assert percentile_profile(one, "id", ["a"]).first().percentile == 100.0


def test_safest_option_null_and_single_value(spark):
    df = spark.createDataFrame([("Yes", None, "x"), ("No", "a", "x"), ("Yes", "b", "x"), ("No", "a", "x")],
                               "Churn string, c1 string, c2 string")
    got = {r.feature: (r.best_option, r.churn_rate) for r in safest_option(df, ["c1", "c2"]).collect()}
    assert got == {"c1": ("a", 0.0)}  # NULL is no group; c2 has one value only


def test_clustering_null_rows_and_small_k(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 3.0), (3, 1.0, 2.0), (4, 5.0, 6.0), (5, 5.0, 6.0)],
                               "id long, x double, y double")
    mode, out, feats = segment(df, k=4, restarts=2)
    assert mode == "generic" and feats == ["id", "x", "y"]
    assert out.count() == 4 and out.where(F.col("Cluster").isNull()).count() == 0

"""Rows-only queries checked against brute force on small fixtures."""

import difflib
import hashlib

from pyspark.sql import functions as F

import __spark_entry__ as E
from clientele.operators.churn_model import score_one, train_churn
from clientele.operators.geo import clean_location, distinct_locations, fuzzy_tier_ratio
from clientele.sources import fixtures as fx
from clientele.sources.dimensions import gazetteer, gazetteer_rows, iata

SF = "/root/testdata/sf0.001"


def test_ratio_tier_accepts_what_get_close_matches_accepts(spark):
    vals = ["Mnchester", "Lndon", "Pariss", "Atlantis", "Zurik", "Sidney", "Tokio", "New Yrok", "Rom", "Dubln"]
    df = spark.createDataFrame([(v,) for v in vals], "loc string")
    cities = distinct_locations(clean_location(df, "loc", iata(spark)))
    got = {r.city: r.key for r in fuzzy_tier_ratio(cities, gazetteer(spark)).collect()}
    keys = [r[1] for r in gazetteer_rows()]
    want = {}
    for c in [r.city for r in cities.collect()]:
        m = difflib.get_close_matches(c, keys, n=1, cutoff=0.75)
        if m:
            want[c] = m[0]
    assert got == want and len(want) >= 5


def test_sample_is_smallest_hashes(spark):
    got = [r.CustomerID for r in E.queries()["customer_sample"](spark, SF).collect()]
    ids = [r.o_custkey for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_custkey").distinct().collect()]
    want = sorted(ids, key=lambda v: (hashlib.md5(str(v).encode()).hexdigest(), v))[:1000]
    assert got == want


def test_score_one_equals_batch(spark):
    cust = fx.churn_customers(spark, "/root/testdata/sf0.01")
    fitted, _ = train_churn(cust, max_iter=3)
    one_id = cust.select("customerID").orderBy("customerID").first()[0]
    from clientele.operators.churn_model import score_churn
    a = score_one(fitted, cust, one_id).select("Churn_Probability").first()[0]
    b = score_churn(fitted, cust).where(F.col("customerID") == one_id).select("Churn_Probability").first()[0]
    assert a == b

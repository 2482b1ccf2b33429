"""Results stay whole and right when one key holds a third of all rows."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from clientele.operators.geo import analyze_locations, substring_tier
from clientele.operators.rfm import rfm
from clientele.sources.dimensions import gazetteer, iata


def test_rfm_hot_customer(spark):
    rng = np.random.default_rng(3)
    n = 3000
    cust = np.where(np.arange(n) < n // 3, 1, rng.integers(2, 200, n))
    base = dt.datetime(2020, 1, 1)
    dates = [base + dt.timedelta(hours=int(h)) for h in rng.integers(0, 24 * 400, n)]
    amt = np.round(rng.uniform(1, 500, n), 2)
    pdf = pd.DataFrame({"CustomerID": cust.astype("int64"), "InvoiceDate": dates, "TotalAmount": amt})
    df = spark.createDataFrame(pdf).withColumn("InvoiceDate", F.col("InvoiceDate").cast("timestamp_ntz"))
    got = rfm(df).toPandas().set_index("CustomerID").sort_index()
    snap = pdf.InvoiceDate.max() + pd.Timedelta(days=1)
    want = pdf.groupby("CustomerID").agg(last=("InvoiceDate", "max"), Frequency=("CustomerID", "size"),
                                         Monetary=("TotalAmount", "sum"))
    want["Recency"] = (snap - want["last"]).dt.days
    assert (got["Frequency"] == want["Frequency"]).all()
    assert (got["Recency"] == want["Recency"]).all()
    assert np.allclose(got["Monetary"], want["Monetary"])
    assert got.loc[1, "Frequency"] == n // 3


def test_geo_hot_location_keeps_all_rows(spark):
    vals = ["London"] * 1000 + ["Paris", "Mnchester", "Xyzzy"] * 700
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id int, loc string")
    out = analyze_locations(df, "loc", gazetteer(spark), iata(spark))
    assert out.count() == len(vals)
    assert out.where("Mapped_Location = 'London' and match_tier = 'exact'").count() == 1000
    assert out.where("lat is null").count() == 700


def test_word_boundary_option(spark):
    cities = spark.createDataFrame([("limassol",), ("greater dublin area",)], "city string")
    loose = {r.city: r.key for r in substring_tier(cities, gazetteer(spark)).collect()}
    strict = {r.city: r.key for r in substring_tier(cities, gazetteer(spark), word_boundary=True).collect()}
    assert loose == {"limassol": "lima", "greater dublin area": "dublin"}
    assert strict == {"greater dublin area": "dublin"}

"""Queries: sources, RFM, quartiles, RFM personas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators.rfm import monetary_quartiles, rfm
from ..operators.rules import persona_rfm
from ..sources import fixtures as fx
from ..sources.io import TABLES, read_table, standardise_columns
from .registry import query

# Monetary limit of the rfm persona query: near the median customer spend of the
# test data, so that all five personas occur (the default 1000 is below everyone).
RFM_BIG_SPEND = 2_500_000.0


@query("load_tables")
def q_load_tables(spark, sf_dir):
    parts = [read_table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n_rows"))
             .select(F.lit(t).alias("table_name"), "n_rows") for t in TABLES]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("standardise_columns")
def q_standardise_columns(spark, sf_dir):
    mapping = {"CustomerID": "o_custkey", "InvoiceDate": "o_orderdate", "TotalAmount": "o_totalprice"}
    return standardise_columns(read_table(spark, sf_dir, "orders"), mapping)


@query("rfm")
def q_rfm(spark, sf_dir):
    return rfm(fx.transactions(spark, sf_dir), scale=2)


@query("monetary_quartiles")
def q_monetary_quartiles(spark, sf_dir):
    return monetary_quartiles(rfm(fx.transactions(spark, sf_dir), scale=2))


@query("persona_rfm")
def q_persona_rfm(spark, sf_dir):
    return persona_rfm(rfm(fx.transactions(spark, sf_dir), scale=2), big_spend=RFM_BIG_SPEND)

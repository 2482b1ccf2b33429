"""Derived inputs over the driver's tables.

The reference reads customer tables shaped like a telecom churn export, a
demographic table, transactions, reviews and routes. These builders derive
tables of those shapes from the TPC-H-like test tables by fixed formulas, so
every query's work grows with the source tables. The same definitions are
written as SQL in ``clientele.plans.oracle`` for the DuckDB check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.partitioning import materialize, spread
from ..operators.sentiment import raw_tokens
from .io import read_table

MONEY = "decimal(18,2)"


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("CustomerID"),
                    F.col("o_orderdate").alias("InvoiceDate"),
                    F.col("o_totalprice").alias("TotalAmount"))


def churn_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telecom-style churn table; Churn = no order in the last 180 days."""
    o = read_table(spark, sf_dir, "orders")
    mx = o.select(F.max("o_orderdate")).scalar()
    t = (o.groupBy("o_custkey")
          .agg(F.min("o_orderdate").alias("f"), F.max("o_orderdate").alias("l"),
               F.sum(F.col("o_totalprice").cast(MONEY)).cast("double").alias("m")))
    tenure = (F.year("l") - F.year("f")) * 12 + F.month("l") - F.month("f")
    t = t.withColumn("tenure", tenure)
    c = read_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    # both sides grow with the customers: never sent through the driver as a broadcast
    return (c.join(t.hint("merge"), k == F.col("o_custkey"))
             .select(k.alias("customerID"), F.col("c_mktsegment").alias("Segment"),
                     F.when(k % 3 == 0, "Month-to-month").when(k % 3 == 1, "One year")
                      .otherwise("Two year").alias("Contract"),
                     F.when(k % 4 == 0, "No").otherwise("Yes").alias("Support"),
                     F.col("tenure").cast("bigint").alias("Tenure"),
                     (F.floor(F.col("m") * 100 / F.greatest(F.col("tenure"), F.lit(1))) / 100)
                      .alias("MonthlyCharges"),
                     F.when(k % 97 == 0, F.lit(" "))
                      .otherwise(F.col("m").cast(MONEY).cast("string")).alias("TotalCharges"),
                     F.when(F.col("l") < mx - F.expr("INTERVAL 180 DAYS"), "Yes")
                      .otherwise("No").alias("Churn")))


def demographics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    k, bal = F.col("c_custkey"), F.col("c_acctbal")
    return c.select(k.alias("CustomerID"),
                    (18 + (k * 7) % 60).cast("bigint").alias("Age"),
                    F.when(bal < 2000, "Low").when(bal < 6000, "Average")
                     .when(bal < 9500, "High").otherwise("Other").alias("Spending_Score"),
                    (1 + k % 6).cast("bigint").alias("Family_Size"),
                    F.col("c_mktsegment").alias("Profession"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("ReviewID"), F.col("text").alias("ReviewBody"), "lang", "source")


# The route strings of the location fixture, by o_orderkey % 15.
# The 3rd is replaced by a misspelt name, the 10th and the 15th get a number, so
# that the distinct places grow with the orders.
ROUTE_VALUES = [
    "London to Paris", "LHR", "", "Manchester Airport", "New York City", "Zürich",
    "Sao Paulo", "", None, "Atlantis ", "St Lucia via Barbados", "Orlando, Florida",
    "Leeds (LBA)", "Rome-Milan", "Greater Dublin Area ",
]
MISSPELT = "manchester"


def _route_case(key: Column) -> Column:
    expr = None
    for i, v in enumerate(ROUTE_VALUES):
        val = F.lit(v).cast("string")
        expr = F.when(key == i, val) if expr is None else expr.when(key == i, val)
    return expr


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    n = F.floor(k / 15).cast("bigint")
    at = (n % len(MISSPELT)).cast("int")
    one_letter_less = F.concat(F.substring(F.lit(MISSPELT), F.lit(1), at), F.substring(F.lit(MISSPELT), at + 2, F.lit(len(MISSPELT))))
    return o.select(k.alias("TripID"), F.col("o_custkey").alias("CustomerID"),
                    F.col("o_totalprice").alias("Amount"),
                    (1 + k % 5).cast("bigint").alias("OverallRating"),
                    F.when(k % 15 == 2, one_letter_less).when(k % 15 == 9, F.concat(F.lit(ROUTE_VALUES[9]), n.cast("string")))
                     .when(k % 15 == 14, F.concat(F.lit(ROUTE_VALUES[14]), (n % 1000).cast("string")))
                     .otherwise(_route_case(k % 15)).alias("Route"))


# Phrases and emoticons of the test lexicon.
LEXICON_EXTRAS = [("of the", 1.5), ("the and the", -2.5), ("the and", 0.5), ("de la", -1.0), ("et de la", 2.0), ("in the that", 1.0), (":)", 2.0), (":(", -1.9)]


def test_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent tokens of the test prose with a formula valence (no real lexicon is installed), and a few phrases. Computed once."""
    d = spread(read_table(spark, sf_dir, "documents").select("text"))
    w = d.select(F.explode_outer(raw_tokens(F.col("text"))).alias("w")).select(F.lower("w").alias("w"))
    freq = w.where(F.length("w") > 3).groupBy("w").count().where(F.col("count") >= 20)
    val = F.length("w") * 7 % 9 - 4
    words = freq.where(val != 0).select(F.col("w").alias("token"), val.cast("double").alias("valence"))
    return materialize(words.unionByName(spark.createDataFrame(LEXICON_EXTRAS, "token string, valence double")))


def rule_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A churn probability without a model: 1 / (1 + Tenure/12)."""
    c = churn_customers(spark, sf_dir)
    return c.select("customerID", "Tenure", "MonthlyCharges",
                    (F.lit(1.0) / (F.lit(1.0) + F.col("Tenure").cast("double") / F.lit(12.0))).alias("probability"))

"""Queries: scalar cleaning and rule personas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.clean import (align_features, churn_flag, clean_numbers, clean_text, is_blank,
                               risk_band, spending_ordinal, string_columns, feature_columns)
from ..operators.encode import encode, fit_dictionary
from ..operators.rfm import rfm
from ..operators.rules import (persona_churn, persona_demographic, persona_geo, segment_heuristic)
from ..sources import fixtures as fx
from .registry import query


@query("clean_charges")
def q_clean_charges(spark, sf_dir):
    c = clean_numbers(fx.churn_customers(spark, sf_dir))
    return c.select("customerID", "Tenure", "MonthlyCharges", "TotalCharges")


@query("churn_flag")
def q_churn_flag(spark, sf_dir):
    c = fx.churn_customers(spark, sf_dir)
    return c.select("customerID", "Churn", churn_flag(c, "Churn").alias("churn_flag"))


@query("spending_ordinal")
def q_spending_ordinal(spark, sf_dir):
    d = fx.demographics(spark, sf_dir)
    return d.select("CustomerID", "Spending_Score", spending_ordinal(d).alias("Spending_Score_Num"))


@query("encode_categories")
def q_encode_categories(spark, sf_dir):
    c = clean_numbers(fx.churn_customers(spark, sf_dir))
    cats = string_columns(c.select(*feature_columns(c)))
    out = encode(fit_dictionary(c, cats), c, cats)
    return out.select("customerID", *[F.col(k + "_code").alias(k) for k in cats])


# A stored feature list; "Discount" is absent from the table and reads 0.
ALIGN_FEATURES = ["Tenure", "MonthlyCharges", "TotalCharges", "Discount"]


@query("align_features")
def q_align_features(spark, sf_dir):
    c = clean_numbers(fx.churn_customers(spark, sf_dir))
    return align_features(c, ALIGN_FEATURES, keep=["customerID"])


@query("risk_band")
def q_risk_band(spark, sf_dir):
    r = fx.rule_score(spark, sf_dir)
    return r.select("customerID", "probability", risk_band("probability").alias("Risk_Group"))


@query("clean_text")
def q_clean_text(spark, sf_dir):
    r = fx.reviews(spark, sf_dir)
    return r.select("ReviewID", F.when(is_blank("ReviewBody"), "").otherwise(clean_text("ReviewBody"))
                    .alias("Clean_Text"))


@query("persona_demographic")
def q_persona_demographic(spark, sf_dir):
    d = fx.demographics(spark, sf_dir)
    d = d.withColumn("Spending_Score_Num", spending_ordinal(d))
    return persona_demographic(d).select("CustomerID", "Age", "Family_Size", "Spending_Score_Num",
                                         "Persona", "Strategy", "Next_Best_Action")


@query("persona_churn")
def q_persona_churn(spark, sf_dir):
    return persona_churn(fx.rule_score(spark, sf_dir)).select(
        "customerID", "probability", "Persona", "Strategy", "Next_Best_Action")


@query("persona_geo")
def q_persona_geo(spark, sf_dir):
    r = fx.routes(spark, sf_dir)
    s = r.groupBy("Route").agg(F.count(F.lit(1)).alias("Traffic"),
                               F.round(F.avg("OverallRating"), 6).alias("OverallRating"))
    return persona_geo(s)


@query("persona_geo_value")
def q_persona_geo_value(spark, sf_dir):
    r = fx.routes(spark, sf_dir)
    s = r.groupBy("Route").agg(F.round(F.avg(F.col("Amount") - 150000.0), 6).alias("Value"))
    return persona_geo(s)


@query("segment_heuristic")
def q_segment_heuristic(spark, sf_dir):
    return segment_heuristic(rfm(fx.transactions(spark, sf_dir), scale=2))

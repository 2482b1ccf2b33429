"""Boundary values of the rule columns (PRJ-1..9, RUL-2..7)."""

import math

import pytest
from pyspark.sql import functions as F

from clientele.functions.clean import (churn_flag, clean_numbers, clean_text, risk_band, sentiment_label,
                                       spending_ordinal, to_number)
from clientele.operators.rules import (apply_personas, persona_churn, persona_demographic, persona_geo,
                                       persona_rfm, segment_heuristic, segment_labels)


def col(spark, values, typ):
    return spark.createDataFrame([(v,) for v in values], f"x {typ}")


def test_to_number(spark):
    df = col(spark, [" ", "abc", " 12 ", "12.5", None, "NaN"], "string")
    assert [r[0] for r in df.select(to_number("x")).collect()] == [0.0, 0.0, 12.0, 12.5, 0.0, 0.0]


def test_clean_numbers_numeric_nan(spark):
    df = spark.createDataFrame([(float("nan"),), (3.0,), (None,)], "Tenure double")
    assert [r[0] for r in clean_numbers(df).collect()] == [0.0, 3.0, 0.0]


def test_churn_flag_exact_spelling(spark):
    df = col(spark, ["Yes", "No", "TRUE", "FALSE", "1", "0", "true", None, "maybe"], "string").withColumnRenamed("x", "Churn")
    assert [r[0] for r in df.select(churn_flag(df, "Churn")).collect()] == [1, 0, 1, 0, 1, 0, 0, 0, 0]
    n = spark.createDataFrame([(1,), (0,), (None,)], "Churn int")
    assert [r[0] for r in n.select(churn_flag(n, "Churn")).collect()] == [1, 0, 0]


def test_risk_band_right_closed(spark):
    df = col(spark, [0.0, 0.4, 0.4000001, 0.7, 0.71, 1.0, None], "double")
    assert [r[0] for r in df.select(risk_band("x")).collect()] == ["Low", "Low", "Medium", "Medium", "High", "High", None]


def test_sentiment_label_edges(spark):
    df = col(spark, [0.05, -0.05, 0.0499, 0.0], "double")
    assert [r[0] for r in df.select(sentiment_label("x")).collect()] == ["Positive", "Negative", "Neutral", "Neutral"]


def test_spending_ordinal(spark):
    df = col(spark, ["Low", "Average", "High", "Other", None], "string").withColumnRenamed("x", "Spending_Score")
    assert [r[0] for r in df.select(spending_ordinal(df)).collect()] == [1.0, 2.0, 3.0, 1.0, 1.0]


def test_clean_text(spark):
    df = col(spark, ["Hi!!", "a1b2", "Café olé", "no break", "ok", None], "string")
    got = [r[0] for r in df.select(clean_text("x")).collect()]
    assert got == ["hi", "ab", "caf ol", "no break", "ok", ""]


@pytest.mark.parametrize("fam,age,spend,persona,strategy", [
    (1.5, 29, 2.6, "Solo / Gen Z / Spender", "Trend & FOMO"),
    (1.51, 30, 1.49, "Small Fam / Pro / Saver", "Value Bundles"),
    (3.5, 50, 2.0, "Small Fam / Senior", "Trust & Loyalty"),
    (3.51, 49.99, 2.5, "Large Fam / Pro", "Standard"),
    (4.0, 40, 3.0, "Large Fam / Pro / Spender", "Exclusivity"),
])
def test_persona_demographic(spark, fam, age, spend, persona, strategy):
    df = spark.createDataFrame([(float(fam), float(age), float(spend))], "Family_Size double, Age double, Spending_Score_Num double")
    r = persona_demographic(df).first()
    assert (r.Persona, r.Strategy) == (persona, strategy)


def test_persona_demographic_missing_and_nan(spark):
    df = spark.createDataFrame([(float("nan"),)], "Age double")
    r = persona_demographic(df).first()
    # Family_Size missing -> 0 -> Solo; NaN age compares false -> Senior; spend missing -> 0 -> Saver
    assert r.Persona == "Solo / Senior / Saver"


@pytest.mark.parametrize("rec,mon,persona", [
    (29.99, 1000.01, "Champion"), (30, 5000, "Standard"), (90.01, 1000.01, "At-Risk Whale"),
    (90, 1000.01, "Standard"), (10, 1000, "New/Active"), (100, 999, "Hibernating"), (None, 5000, "Standard"),
])
def test_persona_rfm(spark, rec, mon, persona):
    df = spark.createDataFrame([(None if rec is None else float(rec), float(mon))], "Recency double, Monetary double")
    assert persona_rfm(df).first().Persona == persona


@pytest.mark.parametrize("p,value,persona", [
    (0.81, None, "Flight Risk (Critical)"), (0.8, None, "At Risk"), (0.5, None, "Neutral"),
    (0.2, None, "Neutral"), (0.19, None, "Loyalist"), (0.9, 0.1, "Loyalist"), (0.1, 5.0, "Loyalist"),
])
def test_persona_churn(spark, p, value, persona):
    if value is None:
        df = spark.createDataFrame([(p,)], "probability double")
    else:
        df = spark.createDataFrame([(p, value)], "probability double, Value double")
    assert persona_churn(df).first().Persona == persona


def test_persona_churn_null_probability_is_neutral(spark):
    df = spark.createDataFrame([(None,)], "probability double")
    assert persona_churn(df).first().Persona == "Neutral"


@pytest.mark.parametrize("t,r,persona", [
    (51, 3.9, "High Vol / Low Sat"), (51, 4, "Flagship Route"), (50, 1, "Standard Route"),
    (9, 5, "Niche / Low Volume"), (10, 5, "Standard Route"),
])
def test_persona_geo_routes(spark, t, r, persona):
    df = spark.createDataFrame([(float(t), float(r))], "Traffic double, OverallRating double")
    assert persona_geo(df).first().Persona == persona


@pytest.mark.parametrize("v,persona", [(1000.01, "Power Region"), (1000, "Key Location"), (-0.01, "Detractor Zone"), (0, "Key Location")])
def test_persona_geo_value(spark, v, persona):
    df = spark.createDataFrame([(float(v),)], "Value double")
    assert persona_geo(df).first().Persona == persona


def test_apply_personas_dispatch(spark):
    df = spark.createDataFrame([(10.0, 2000.0)], "Recency double, Monetary double")
    assert apply_personas(df, "RFM").first().Persona == "Champion"
    with pytest.raises(ValueError):
        apply_personas(df, "unknown")


def test_segment_labels_modes(spark):
    s = spark.createDataFrame([(0, 29.0, 1.4, 3.6), (1, 50.0, 2.6, 2.0)], "Cluster int, Age double, Spending_Score_Num double, Family_Size double")
    got = [r.Cluster_Label for r in segment_labels(s, "demographic").orderBy("Cluster").collect()]
    assert got == ["Young Saver (Fam)", "Senior Spender"]
    r = spark.createDataFrame([(0, 20.0, 10.0), (1, 95.0, 1.0), (2, 60.0, 5.0)], "Cluster int, Recency double, Monetary double")
    got = [x.Cluster_Label for x in segment_labels(r, "rfm", q1=2.0, q3=8.0).orderBy("Cluster").collect()]
    assert got == ["Active Whale", "Lost LowVal", "Regular MidVal"]
    g = segment_labels(r, "generic").orderBy("Cluster").first().Cluster_Label
    assert g == "Group 0"


def test_segment_heuristic(spark):
    df = spark.createDataFrame([(2000.0, 10.0), (2000.0, 95.0), (10.0, 10.0)], "Monetary double, Recency double")
    got = [(r.Segment_Id, r.Segment_Name) for r in segment_heuristic(df).collect()]
    assert got == [(1, "Champion (Heuristic)"), (2, "Lost (Heuristic)"), (3, "Standard (Heuristic)")]
    lab = df.withColumn("Cluster_Label", F.lit("X"))
    assert segment_heuristic(lab).first().Segment_Name == "X"
    assert segment_heuristic(df.select(F.lit(1).alias("a"))).first().Segment_Name == "Unsegmented"

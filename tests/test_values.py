"""No data is lost: sub-cent, huge and missing amounts, many values, NaN, zero spread, odd texts."""

import math

import pytest
from pyspark.sql import functions as F

from clientele.functions.clean import clean_text, is_blank, to_number
from clientele.functions.ranking import exact_quantiles, percentile_ranks
from clientele.operators.churn_stats import churn_kpis, safest_option, typical_customer
from clientele.operators.customer import customer_index, percentile_profile
from clientele.operators.encode import encode, fit_dictionary
from clientele.operators.rfm import rfm
from clientele.operators.rules import persona_churn
from clientele.operators.segment_model import squared_silhouette
from clientele.operators.segment_stats import segment_profile, standardise
from clientele.operators.sentiment import analyze_sentiment, raw_tokens

NAN = float("nan")


def amounts(spark, values):
    rows = [(1, v) for v in values]
    df = spark.createDataFrame(rows, "CustomerID long, TotalAmount double")
    return df.withColumn("InvoiceDate", F.lit("2024-01-01").cast("timestamp_ntz"))


@pytest.mark.parametrize("values,want", [([0.004] * 1000, 4.0), ([1e17, 1e17], 2e17), ([NAN, NAN], 0.0), ([None], 0.0), ([NAN, 2.5], 2.5)])
def test_amounts_are_whole(spark, values, want):
    assert rfm(amounts(spark, values)).first().Monetary == pytest.approx(want)


def test_stated_scale_sums_exactly(spark):
    assert rfm(amounts(spark, [0.1] * 10), scale=2).first().Monetary == 1.0


def test_revenue_keeps_small_amounts(spark):
    df = spark.createDataFrame([("High", 0.9, 0.004)] * 1000, "Risk_Group string, probability double, MonthlyCharges double")
    assert churn_kpis(df).first().revenue_at_risk == pytest.approx(4.0)


def test_small_medians_and_nan(spark):
    df = spark.createDataFrame([(1e-7, "a"), (NAN, "b"), (3e-7, "b")], "x double, s string")
    t = typical_customer(df).first()
    assert t.x == pytest.approx(2e-7) and t.s == "b"


def test_all_ids(spark):
    assert customer_index(spark.range(15000), "id").count() == 15000
    assert customer_index(spark.range(15000), "id", limit=7).count() == 7


def test_nan_is_missing_in_ranks(spark):
    df = spark.createDataFrame([(1, 1.0), (2, NAN), (3, 3.0)], "id long, a double")
    got = {r.id: r.percentile for r in percentile_profile(df, "id", ["a"]).collect()}
    assert got == {1: 50.0, 2: 50.0, 3: 100.0}
    assert {r.a for r in percentile_ranks(df, "a").collect()} == {1.0, 3.0}
    assert exact_quantiles(df, "a", [0.5]).first().q50 == 2.0
    means = segment_profile(df.withColumn("c", F.lit(0)), "c", ["a"]).first()
    assert means.a == 2.0


def test_constant_feature_and_duplicate_points(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0)], "a double, b double")
    assert [r.b_z for r in standardise(df, ["a", "b"]).collect()] == [0.0, 0.0]
    same = spark.createDataFrame([(0.0, 0), (0.0, 0), (0.0, 1), (0.0, 1)], "x double, c int")
    assert squared_silhouette(same, ["x"], "c").first().silhouette == 0.0


@pytest.mark.parametrize("text,want", [("1d", 0.0), ("1f", 0.0), (" 12.5\n", 12.5), ("1e3", 1000.0), ("NaN", 0.0), ("Infinity", 0.0),
                                       (".5", 0.5), ("-3.", -3.0), ("", 0.0), (None, 0.0), ("0x10", 0.0)])
def test_number_text(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(to_number("t").alias("n")).first().n == want


def test_blank_white_space(spark):
    df = spark.createDataFrame([("\n\t",), ("\u00a0",), ("a",)], "t string")
    assert [r[0] for r in df.select(is_blank("t")).collect()] == [True, True, False]
    assert df.select(clean_text("t")).count() == 3


def test_decimal_value_stands_in_for_the_probability(spark):
    df = spark.createDataFrame([(0.9,)], "v double").select(F.col("v").cast("decimal(5,2)").alias("Value"), F.lit(0.0).alias("probability"))
    double = df.withColumn("Value", F.col("Value").cast("double"))
    assert persona_churn(df).first().Persona == persona_churn(double).first().Persona


def test_unseen_categories_and_many_values(spark):
    df = spark.range(2000).select(F.concat(F.lit("v"), F.lpad("id", 5, "0")).alias("c"))
    d = fit_dictionary(df, ["c"])
    codes = sorted(r[0] for r in encode(d, df, ["c"]).select("c_code").collect())
    assert codes == list(range(2000))
    odd = spark.createDataFrame([("zzz",), (None,)], "c string")
    assert {r[0] for r in encode(d, odd, ["c"]).select("c_code").collect()} == {-1}


def test_options_of_all_text_columns(spark):
    df = spark.createDataFrame([("1", "Yes", "a", 1), ("2", "No", "b", 2)], "customerID string, Churn string, Plan string, n int")
    assert [(r.feature, r.best_option) for r in safest_option(df).collect()] == [("Plan", "b")]


def test_words_with_accents(spark):
    df = spark.createDataFrame([("Très déçu, café fermé! well-made don't",)], "t string")
    assert df.select(raw_tokens(F.col("t")).alias("w")).first().w == ["Très", "déçu", "café", "fermé", "well-made", "dont"]


def test_sentiment_of_phrases(spark):
    lex = spark.createDataFrame([("good", 2.0), ("kind", 1.5), ("not", -1.0)], "token string, valence double")
    docs = [(1, "the least good"), (2, "at least good"), (3, "kind of good"), (4, "not good"), (5, "")]
    got = {r.id: r.Sentiment_Score for r in analyze_sentiment(spark.createDataFrame(docs, "id int, t string"), "t", lex, "id").collect()}
    norm = lambda s: round(s / math.sqrt(s * s + 15), 4)
    assert got[1] == norm(2.0 * -0.74) and got[2] == norm(2.0) and got[3] == norm(2.0)
    assert got[4] == norm(-1.0 + 2.0)  # a word with a valence of its own negates nothing
    assert got[5] == 0.0

"""Queries: model-based segmentation, churn and value models, topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.clean import clean_numbers
from ..functions.scalars import row_values
from ..operators.churn_model import (attribute, directional_importance, expand_scenarios, score_churn,
                                     score_scenarios, score_value, train_churn, train_value)
from ..operators.churn_stats import typical_customer
from ..operators.rfm import rfm
from ..operators.segment_model import k_sweep, sample_rows, segment, segment_rules, squared_silhouette
from ..operators.segment_stats import standardise
from ..sources import fixtures as fx
from .registry import query
from .reports import RFM_FEATURES, rfm_segments

SEGMENT_RESTARTS = 10


_CACHE: dict = {}


def fingerprint(df):
    """Row count and sum of row hashes: data rewritten at the same path gives another key."""
    return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first())


def fitted_once(kind, df, fit):
    """What ``fit`` gives for this data in this session; models are fitted once however many queries use them."""
    key = (kind, df.sparkSession.sparkContext.applicationId, fingerprint(df))
    if key not in _CACHE:
        _CACHE[key] = fit(df)
    return _CACHE[key]


def segmented(spark, sf_dir):
    return fitted_once("segments", fx.transactions(spark, sf_dir), lambda df: segment(df, k=4, restarts=SEGMENT_RESTARTS))


def swept(spark, sf_dir):
    return fitted_once("k_sweep", fx.transactions(spark, sf_dir), lambda df: k_sweep(df, restarts=SEGMENT_RESTARTS))


@query("segments")
def q_segments(spark, sf_dir):
    mode, out, feats = segmented(spark, sf_dir)
    return out.select("CustomerID", *feats, "Cluster", "Cluster_Label")


@query("segments_demographic")
def q_segments_demographic(spark, sf_dir):
    mode, out, feats = segment(fx.demographics(spark, sf_dir), k=4, restarts=SEGMENT_RESTARTS)
    return out.select("CustomerID", *feats, "Cluster", "Cluster_Label")


@query("k_sweep")
def q_k_sweep(spark, sf_dir):
    return swept(spark, sf_dir)


@query("silhouette")
def q_silhouette(spark, sf_dir):
    seg = standardise(rfm_segments(spark, sf_dir), RFM_FEATURES)
    return squared_silhouette(seg, [f + "_z" for f in RFM_FEATURES], "Cluster").select(F.round("silhouette", 6).alias("silhouette"))


@query("segment_rules")
def q_segment_rules(spark, sf_dir):
    mode, out, feats = segmented(spark, sf_dir)
    return segment_rules(out, feats).withColumn("purity", F.round("purity", 6))


# --- churn and value models -------------------------------------------------------------

# Boosting rounds of the registered queries: the operators' full settings.
CHURN_ROUNDS = 100
VALUE_ROUNDS = 50
# Fixed what-if scenarios of the scenario queries (absolute overrides).
SCENARIOS = [
    {"scenario_id": "two_year_contract", "Contract": "Two year"},
    {"scenario_id": "with_support", "Support": "Yes"},
    {"scenario_id": "tenure_48", "Tenure": 48.0},
    {"scenario_id": "charges_50k", "MonthlyCharges": 50000.0},
]


def churn_model(spark, sf_dir):
    return fitted_once(("churn", CHURN_ROUNDS), fx.churn_customers(spark, sf_dir), lambda df: train_churn(df, max_iter=CHURN_ROUNDS))


def value_model(spark, sf_dir):
    return fitted_once(("value", VALUE_ROUNDS), fx.churn_customers(spark, sf_dir), lambda df: train_value(df, max_iter=VALUE_ROUNDS))


@query("churn_train_accuracy")
def q_churn_train_accuracy(spark, sf_dir):
    return churn_model(spark, sf_dir)[1]


@query("churn_scores")
def q_churn_scores(spark, sf_dir):
    fitted, _ = churn_model(spark, sf_dir)
    return score_churn(fitted, fx.churn_customers(spark, sf_dir)).select(
        "customerID", "Churn_Probability", "Risk_Group")


@query("churn_drivers")
def q_churn_drivers(spark, sf_dir):
    fitted, _ = churn_model(spark, sf_dir)
    scored = score_churn(fitted, fx.churn_customers(spark, sf_dir))
    return directional_importance(fitted, scored)


@query("scenario_grid")
def q_scenario_grid(spark, sf_dir):
    c = clean_numbers(fx.churn_customers(spark, sf_dir))
    return expand_scenarios(c, SCENARIOS, "customerID").select(
        "customerID", "scenario_id", "Contract", "Support", "Tenure", "MonthlyCharges")


@query("churn_scenarios")
def q_churn_scenarios(spark, sf_dir):
    fitted, _ = churn_model(spark, sf_dir)
    return score_scenarios(fitted, fx.churn_customers(spark, sf_dir), SCENARIOS)


@query("churn_attribution")
def q_churn_attribution(spark, sf_dir):
    fitted, _ = churn_model(spark, sf_dir)
    cust = fx.churn_customers(spark, sf_dir)
    typ = typical_customer(clean_numbers(cust))
    neutral = row_values(typ, [f for f in fitted.features if f in typ.columns])
    return attribute(fitted, cust, neutral)


@query("value_model")
def q_value_model(spark, sf_dir):
    return value_model(spark, sf_dir)[1]


@query("value_scores")
def q_value_scores(spark, sf_dir):
    fitted, _ = value_model(spark, sf_dir)
    return score_value(fitted, fx.churn_customers(spark, sf_dir)).select("customerID", "Predicted_Value")


@query("customer_sample")
def q_customer_sample(spark, sf_dir):
    """TOP-4: a repeatable sample of 1,000 customers (the k sweep itself reads all)."""
    return sample_rows(rfm(fx.transactions(spark, sf_dir), scale=2), "CustomerID", 1000)

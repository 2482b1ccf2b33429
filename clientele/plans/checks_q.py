"""Queries that measure what model and sink operators must hold; their SQL twins
state the expected values (an operator that breaks one gives other numbers)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.clean import clean_numbers
from ..functions.partitioning import remove_folder
from ..functions.scalars import row_values
from ..operators.churn_model import (FittedModel, attribute, directional_importance, score_churn, score_one, score_scenarios, score_value)
from ..operators.churn_stats import typical_customer
from ..operators.segment_model import segment_rules
from ..operators.topics import assign_topics, describe_topics
from ..session import ensure_checkpoint_dir
from ..sources import fixtures as fx
from ..sources.io import load_table, save_table
from .model_q import SCENARIOS, churn_model, segmented, swept, value_model
from .registry import query
from .text_q import TOPIC_K, cleaned_reviews, scored_reviews, topic_model


def _folder(spark):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/clientele-saved/{uuid.uuid4().hex}"


def _n(cond):
    """Rows for which the condition holds (NULL counts as not)."""
    return F.count_if(F.coalesce(cond, F.lit(False)))


@query("saved_table")
def q_saved_table(spark, sf_dir):
    """SNK-1, SRC-1: a table saved and loaded again in three formats."""
    df = fx.churn_customers(spark, sf_dir)
    out = None
    for fmt in ("parquet", "json", "csv"):
        path = save_table(df, f"{_folder(spark)}.{fmt}", fmt, **({"partition_by": "Segment"} if fmt == "parquet" else {}))
        again = load_table(spark, path, schema=df.schema, header="false", **({"multiLine": "false"} if fmt == "json" else {})) \
            if fmt != "parquet" else load_table(spark, path)
        part = again.agg(F.lit(fmt).alias("format"), F.count(F.lit(1)).alias("rows"), F.count_distinct("customerID").alias("customers"),
                         F.sum("Tenure").alias("tenure"), _n(F.col("Churn") == "Yes").alias("churned"))
        out = part if out is None else out.unionByName(part)
    return out


@query("churn_score_check")
def q_churn_score_check(spark, sf_dir):
    """ML-1, ML-2: every customer scored, probabilities in range, bands that follow from them."""
    fitted, accuracy = churn_model(spark, sf_dir)
    s = score_churn(fitted, fx.churn_customers(spark, sf_dir))
    p, band = F.col("Churn_Probability"), F.col("Risk_Group")
    want = F.when(p <= 0.4, "Low").when(p <= 0.7, "Medium").otherwise("High")
    acc = row_values(accuracy)
    return s.agg(F.count(F.lit(1)).alias("rows"), _n((p < 0) | (p > 1) | p.isNull()).alias("out_of_range"),
                 _n(~band.eqNullSafe(want)).alias("band_mismatches")).select(
        "*", ((acc["accuracy"] >= 0.5) & (acc["accuracy"] <= 1)).alias("better_than_chance"))


@query("saved_model_check")
def q_saved_model_check(spark, sf_dir):
    """SNK-2, ML-3: the model saved, loaded and applied gives the same scores; one customer alone as well."""
    fitted, _ = churn_model(spark, sf_dir)
    cust, path = fx.churn_customers(spark, sf_dir), _folder(spark)
    fitted.save(path)
    again = FittedModel.load(spark, path)
    a = score_churn(fitted, cust).select("customerID", F.col("Churn_Probability").alias("a"))
    b = score_churn(again, cust).select(F.col("customerID").alias("id"), F.col("Churn_Probability").alias("b"))
    one_id = cust.agg(F.min("customerID")).first()[0]
    one = score_one(again, cust, one_id).select(F.col("customerID").alias("one_id"), F.col("Churn_Probability").alias("one"))
    j = a.join(b, F.col("customerID") == F.col("id")).join(one, F.col("customerID") == F.col("one_id"), "left")
    return j.agg(F.count(F.lit(1)).alias("rows"), _n(F.abs(F.col("a") - F.col("b")) > 1e-12).alias("different"),
                 F.count("one").alias("single"), _n(F.abs(F.col("a") - F.col("one")) > 1e-12).alias("single_different"))


@query("churn_driver_check")
def q_churn_driver_check(spark, sf_dir):
    """ML-4, TOP-1: at most five drivers, ordered by gain, each with the direction of its correlation."""
    fitted, _ = churn_model(spark, sf_dir)
    d = directional_importance(fitted, score_churn(fitted, fx.churn_customers(spark, sf_dir)))
    numeric = F.col("Feature").isin(fitted.numeric)
    up = F.col("Impact").startswith("Increases")
    return d.agg((F.count(F.lit(1)) <= 5).alias("at_most_five"), _n(~F.col("Feature").isin(fitted.features)).alias("unknown"),
                 _n(F.col("Importance") <= 0).alias("without_gain"),
                 _n(numeric & (up != F.coalesce(F.col("correlation") > 0, F.lit(False)))).alias("wrong_directions"),
                 _n(~numeric & ~F.col("Impact").startswith("Key")).alias("wrong_key_drivers"))


@query("scenario_check")
def q_scenario_check(spark, sf_dir):
    """ML-5: a row per customer and scenario; deltas are score minus base, bands change where they differ."""
    fitted, _ = churn_model(spark, sf_dir)
    s = score_scenarios(fitted, fx.churn_customers(spark, sf_dir), SCENARIOS)
    return s.groupBy("scenario_id").agg(
        F.count(F.lit(1)).alias("rows"),
        _n(F.abs(F.col("delta") - (F.col("Churn_Probability") - F.col("base_probability"))) > 1e-12).alias("wrong_deltas"),
        _n(F.col("band_changed") != (F.col("Risk_Group") != F.col("base_risk_group"))).alias("wrong_band_flags"))


@query("attribution_check")
def q_attribution_check(spark, sf_dir):
    """ML-6: a row per customer and feature, ranked by size without gaps."""
    fitted, _ = churn_model(spark, sf_dir)
    cust = fx.churn_customers(spark, sf_dir)
    typical = typical_customer(clean_numbers(cust))
    a = attribute(fitted, cust, row_values(typical, [f for f in fitted.features if f in typical.columns]))
    per = a.groupBy("customerID").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("rank").alias("ranks"), F.max("rank").alias("last"),
                                      F.max(F.abs("contribution")).alias("most"), F.max(F.when(F.col("rank") == 1, F.abs("contribution"))).alias("first"))
    return per.agg(F.count(F.lit(1)).alias("customers"), F.sum("n").alias("rows"),
                   _n((F.col("ranks") != F.col("n")) | (F.col("last") != F.col("n")) | (F.col("most") != F.col("first"))).alias("wrong_ranks"))


@query("value_check")
def q_value_check(spark, sf_dir):
    """ML-12, ML-13: every customer gets a value; the fit explains the hold-out better than its mean."""
    fitted, metrics = value_model(spark, sf_dir)
    m = row_values(metrics)
    return score_value(fitted, fx.churn_customers(spark, sf_dir)).agg(
        F.count(F.lit(1)).alias("rows"), _n(F.col("Predicted_Value").isNull() | F.isnan("Predicted_Value")).alias("missing")).select(
        "*", m["target"].alias("target"), (m["r2"] > 0).alias("better_than_mean"))


@query("segment_check")
def q_segment_check(spark, sf_dir):
    """ML-7, ML-9: one of four clusters per customer, numbered by size; the rules' leaves hold the whole table."""
    _, out, feats = segmented(spark, sf_dir)
    sizes = out.groupBy("Cluster").agg(F.count(F.lit(1)).alias("n"))
    s = row_values(sizes.agg(F.sort_array(F.collect_list(F.struct("Cluster", "n"))).alias("by_id")))["by_id"]
    leaves = row_values(segment_rules(out, feats).agg(F.sum("rows").alias("rows"), _n((F.col("purity") < 0) | (F.col("purity") > 1)).alias("bad")))
    checked = out.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("CustomerID").alias("customers"),
                      _n(F.col("Cluster").isNull() | F.col("Cluster_Label").isNull()).alias("unassigned")).withColumn("s", s)
    falling = F.forall(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.get("s", i - 1)["n"] >= F.get("s", i)["n"])
    return checked.select("rows", "customers", "unassigned", F.size("s").alias("clusters"), falling.alias("by_size"),
                          leaves["rows"].alias("leaf_rows"), leaves["bad"].alias("bad_purities"))


@query("k_sweep_check")
def q_k_sweep_check(spark, sf_dir):
    """ML-8: one row per k, silhouettes in [-1, 1], the best one flagged, costs that fall with k."""
    s = swept(spark, sf_dir)
    best = F.max(F.struct("silhouette", (-F.col("k")).alias("k")))
    order = F.sort_array(F.collect_list(F.struct("k", "training_cost")))
    t = s.agg(F.count(F.lit(1)).alias("ks"), _n(F.abs("silhouette") > 1).alias("out_of_range"), _n(F.col("best")).alias("flagged"),
              (F.max(F.when(F.col("best"), F.col("silhouette"))) == F.max("silhouette")).alias("flag_on_best"), order.alias("o"), best.alias("b"))
    falling = F.forall(F.sequence(F.lit(1), F.size("o") - 1), lambda i: F.get("o", i - 1)["training_cost"] >= F.get("o", i)["training_cost"])
    return t.select("ks", "out_of_range", "flagged", "flag_on_best", falling.alias("costs_fall"))


@query("topic_check")
def q_topic_check(spark, sf_dir):
    """ML-10, ML-11, TOP-2: ten terms a topic by falling weight; a topic for each usable text, Unknown for the others."""
    model = topic_model(spark, sf_dir)
    terms = row_values(describe_topics(model).agg(F.count(F.lit(1)).alias("terms"), F.count_distinct("topic").alias("topics"),
                                                  _n((F.col("weight") <= 0) | (F.col("weight") > 1)).alias("bad")))
    a = assign_topics(model, cleaned_reviews(spark, sf_dir))
    return a.agg(F.count(F.lit(1)).alias("rows"), _n((F.col("Topic_ID") == -1) & (F.col("Topic_Label") == "Unknown")).alias("unknown"),
                 _n((F.col("Topic_ID") < -1) | (F.col("Topic_ID") >= TOPIC_K)
                    | ((F.col("Topic_ID") >= 0) & (F.col("Topic_Label") != F.concat(F.lit("Topic "), (F.col("Topic_ID") + 1).cast("string"))))
                    ).alias("bad_topics")).select("*", terms["terms"].alias("terms"), terms["topics"].alias("topics"), terms["bad"].alias("bad_weights"))


@query("sentiment_by_fixed_topic")
def q_sentiment_by_fixed_topic(spark, sf_dir):
    """AGG-7 with topics that SQL can state: the length of the text in thousands, none for texts of up to two characters."""
    topic = F.when(F.length("ReviewBody") > 2, F.concat(F.lit("Topic "), (F.length("ReviewBody") / 1000).cast("int").cast("string"))).otherwise("Unknown")
    # labelled before the scoring, so that the texts are not moved by its join
    t = scored_reviews(spark, sf_dir, Topic_Label=topic)
    return (t.where(F.col("Topic_Label") != "Unknown").groupBy("Topic_Label", "Sentiment_Label")
             .agg(F.count(F.lit(1)).alias("count")))

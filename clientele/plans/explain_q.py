"""Queries that explain models: exact attribution (ML-6), exact rule trees (ML-9), Euclidean silhouettes (ML-8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.clean import clean_numbers
from ..operators.attribution import NODES, explain, shapley, with_covers
from ..operators.churn_model import score_churn
from ..operators.rules_tree import tree_table
from ..operators.segment_model import euclidean_silhouette, k_sweep_sample, segment
from ..operators.segment_stats import standardise
from ..sources import fixtures as fx
from .model_q import SEGMENT_RESTARTS, churn_model, value_model
from .registry import query
from .reports import RFM_FEATURES, rfm_segments

#: Two trees over Tenure, MonthlyCharges and Support for ``shapley_fixed_trees``: tree, id, left, right, feature, threshold, value.
FIXED_FEATURES = ("Tenure", "MonthlyCharges", "Support")
FIXED_TREES = [
    (0, 0, 1, 2, 0, 60.0, 0.0), (0, 1, 3, 4, 1, 40000.0, 0.0), (0, 2, 5, 6, 2, 0.5, 0.0), (0, 3, -1, -1, -1, None, 0.3), (0, 4, 7, 8, 0, 30.0, 0.0),
    (0, 5, -1, -1, -1, None, 0.2), (0, 6, 9, 10, 1, 60000.0, 0.0), (0, 7, -1, -1, -1, None, 0.8), (0, 8, -1, -1, -1, None, 0.5),
    (0, 9, -1, -1, -1, None, -0.4), (0, 10, -1, -1, -1, None, -0.7),
    (1, 0, 1, 2, 1, 50000.0, 0.0), (1, 1, 3, 4, 0, 50.0, 0.0), (1, 2, -1, -1, -1, None, -0.3), (1, 3, -1, -1, -1, None, 0.25), (1, 4, -1, -1, -1, None, -0.1),
]


@query("shapley_fixed_trees")
def q_shapley_fixed_trees(spark, sf_dir):
    """ML-6 with trees that SQL can state: contributions by value, branch shares counted on all customers."""
    c = fx.churn_customers(spark, sf_dir)
    x = F.array(F.col("Tenure").cast("double"), "MonthlyCharges", (F.col("Support") == "Yes").cast("double"))
    rows = c.select("customerID", x.alias("x"))
    nodes = with_covers(spark.createDataFrame([(*t, None) for t in FIXED_TREES], NODES), rows, "x")
    out = shapley(rows, "x", FIXED_FEATURES, nodes, ["customerID"])
    return out.select("customerID", "feature", *[F.round(f, 9).alias(f) for f in ("contribution", "base_value", "score")])


@query("churn_shapley")
def q_churn_shapley(spark, sf_dir):
    """ML-6: why each customer has its churn score, in log odds per feature."""
    fitted, _ = churn_model(spark, sf_dir)
    return explain(fitted, fx.churn_customers(spark, sf_dir))


@query("shapley_check")
def q_shapley_check(spark, sf_dir):
    """ML-6: contributions of both models sum to the score less the base value, and the score is the model's own."""
    out = None
    for name, (fitted, _) in (("churn", churn_model(spark, sf_dir)), ("value", value_model(spark, sf_dir))):
        df = fx.churn_customers(spark, sf_dir)
        per = explain(fitted, df).groupBy("customerID").agg(F.count(F.lit(1)).alias("n"), F.sum("contribution").alias("all"),
                                                              F.first("score").alias("score"), F.first("base_value").alias("base"))
        if name == "churn":
            p = F.col("Churn_Probability")
            own, near = score_churn(fitted, df).select(F.col("customerID").alias("id"), p.alias("own")), F.lit(1.0) / (1 + F.exp(-F.col("score")))
        else:
            own, near = fitted.transform(clean_numbers(df)).select(F.col("customerID").alias("id"), F.col("__pred").alias("own")), F.col("score")
        j = per.join(own, F.col("customerID") == F.col("id"))
        # scores near 0 are the base value less about as much: what the sums round by is measured against both
        size = F.greatest(F.lit(1.0), F.abs("score"), F.abs("own"), F.abs("base"))
        part = j.agg(F.lit(name).alias("model"), F.count(F.lit(1)).alias("customers"), F.count_if(F.col("n") != len(fitted.features)).alias("features_missing"),
                     F.count_if(F.abs(F.col("all") - (F.col("score") - F.col("base"))) > 1e-9 * size).alias("wrong_sums"),
                     F.count_if(F.abs(near - F.col("own")) > 1e-9 * size).alias("wrong_scores"), F.count_distinct(F.round("base", 6)).alias("base_values"))
        out = part if out is None else out.unionByName(part)
    return out


@query("segment_tree")
def q_segment_tree(spark, sf_dir):
    """ML-9: the exact rules tree of the customer segments, node by node."""
    t = tree_table(rfm_segments(spark, sf_dir), RFM_FEATURES, "Cluster", 3)
    return t.withColumns({"gini": F.round("gini", 9), "purity": F.round("purity", 9), "threshold": F.round("threshold", 6)}).drop("condition")


@query("silhouette_exact")
def q_silhouette_exact(spark, sf_dir):
    """ML-8: Euclidean silhouette of the segments on the sample of 1,000 customers."""
    z = standardise(rfm_segments(spark, sf_dir), RFM_FEATURES)
    s = euclidean_silhouette(z, [f + "_z" for f in RFM_FEATURES], "Cluster", "CustomerID", 1000)
    return s.withColumn("silhouette", F.round("silhouette", 6))


@query("k_sweep_sample")
def q_k_sweep_sample(spark, sf_dir):
    """ML-8: the reference's own sweep: k-means and Euclidean silhouette on 1,000 customers."""
    return k_sweep_sample(fx.transactions(spark, sf_dir), "CustomerID", restarts=SEGMENT_RESTARTS)


@query("segments_generic")
def q_segments_generic(spark, sf_dir):
    """ML-7 without known columns: the first three numeric ones are clustered."""
    t = fx.churn_customers(spark, sf_dir).select("Segment", "Tenure", "MonthlyCharges", F.col("customerID").cast("string").alias("Account"))
    _, out, feats = segment(t, k=4, restarts=SEGMENT_RESTARTS)
    return out.select("Account", *feats, "Cluster", "Cluster_Label")

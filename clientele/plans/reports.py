"""Queries: segment statistics, narratives, churn reports, customer views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.clean import clean_numbers, risk_band, spending_ordinal
from ..functions.partitioning import materialize
from ..functions.scalars import row_values
from ..operators.churn_stats import (churn_kpis, class_balance, driver_direction, risk_histogram,
                                     safest_option, typical_customer)
from ..operators.customer import customer_index, customer_vs_segment, percentile_profile
from ..operators.narrative import churn_headline, segment_narrative
from ..operators.rules import apply_personas
from ..operators.rfm import monetary_quartiles, rfm
from ..operators.segment_stats import (attach_labels, label_segments, nearest_centroid, segment_profile,
                                       segment_sizes, standardise)
from ..sources import fixtures as fx
from .registry import query

RFM_FEATURES = ["Recency", "Frequency", "Monetary"]
# Fixed centres in standardised RFM space, so segment statistics are checkable
# by SQL; the model-based segmentation is the ``segments`` query.
RFM_CENTRES = [(-1.0, 1.0, 1.0), (1.0, -1.0, -1.0), (0.0, 0.0, 0.0), (2.0, 0.0, 0.0)]


def rounded(df, *cols, digits=6):
    """Display rounding of a registered query (the operators do not round)."""
    return df.withColumns({c: F.round(c, digits) for c in cols})


def rfm_segments(spark, sf_dir):
    # the RFM table feeds the moments, the assignment and the later statistics
    r = materialize(rfm(fx.transactions(spark, sf_dir), scale=2))
    z = standardise(r, RFM_FEATURES)
    seg = nearest_centroid(z, [f + "_z" for f in RFM_FEATURES], RFM_CENTRES)
    return seg.select("CustomerID", *RFM_FEATURES, "Cluster")


def scored_rule(spark, sf_dir):
    """Cleaned churn customers with the rule probability and its band."""
    c = clean_numbers(fx.churn_customers(spark, sf_dir))
    p = F.lit(1.0) / (F.lit(1.0) + F.col("Tenure") / F.lit(12.0))
    return c.withColumn("probability", p).withColumn("Risk_Group", risk_band("probability"))


@query("nearest_centroid")
def q_nearest_centroid(spark, sf_dir):
    return rfm_segments(spark, sf_dir)


@query("segment_profile")
def q_segment_profile(spark, sf_dir):
    return segment_profile(rfm_segments(spark, sf_dir), "Cluster", RFM_FEATURES, digits=6)


@query("segment_sizes")
def q_segment_sizes(spark, sf_dir):
    return rounded(segment_sizes(rfm_segments(spark, sf_dir), "Cluster"), "share")


@query("segment_labels")
def q_segment_labels(spark, sf_dir):
    seg = rfm_segments(spark, sf_dir)
    q = monetary_quartiles(seg)
    qv = row_values(q)
    labels = label_segments(seg, "rfm", "Cluster", RFM_FEATURES, q1=qv["q1"], q3=qv["q3"])
    return attach_labels(seg, labels).select("CustomerID", "Cluster", "Cluster_Label")


@query("segment_narrative")
def q_segment_narrative(spark, sf_dir):
    return segment_narrative(rfm_segments(spark, sf_dir), "Cluster", RFM_FEATURES)


@query("customer_vs_segment")
def q_customer_vs_segment(spark, sf_dir):
    return rounded(customer_vs_segment(rfm_segments(spark, sf_dir), "CustomerID", "Cluster", RFM_FEATURES),
                   "segment_avg", "global_avg")


@query("percentile_profile")
def q_percentile_profile(spark, sf_dir):
    return rounded(percentile_profile(rfm(fx.transactions(spark, sf_dir), scale=2), "CustomerID"), "percentile")


@query("customer_index")
def q_customer_index(spark, sf_dir):
    return customer_index(fx.churn_customers(spark, sf_dir), "customerID")


@query("churn_kpis")
def q_churn_kpis(spark, sf_dir):
    r = fx.rule_score(spark, sf_dir)
    return rounded(churn_kpis(r.withColumn("Risk_Group", risk_band("probability")), scale=2),
                   "avg_probability", "high_risk_share")


@query("risk_histogram")
def q_risk_histogram(spark, sf_dir):
    r = fx.rule_score(spark, sf_dir)
    return risk_histogram(r.withColumn("Risk_Group", risk_band("probability")))


@query("churn_headline")
def q_churn_headline(spark, sf_dir):
    r = fx.rule_score(spark, sf_dir)
    return rounded(churn_headline(r.withColumn("Risk_Group", risk_band("probability"))), "high_risk_pct")


@query("safest_option")
def q_safest_option(spark, sf_dir):
    return rounded(safest_option(fx.churn_customers(spark, sf_dir), ["Segment", "Contract", "Support"]), "churn_rate")


@query("typical_customer")
def q_typical_customer(spark, sf_dir):
    t = typical_customer(clean_numbers(fx.churn_customers(spark, sf_dir)))
    return rounded(t, *[c for c, kind in t.dtypes if kind == "double"])


@query("driver_direction")
def q_driver_direction(spark, sf_dir):
    return rounded(driver_direction(scored_rule(spark, sf_dir), ["Tenure", "MonthlyCharges", "TotalCharges", "Contract"]),
                   "correlation")


@query("class_balance")
def q_class_balance(spark, sf_dir):
    return class_balance(fx.churn_customers(spark, sf_dir))


DEMOGRAPHIC_FEATURES = ["Age", "Spending_Score_Num", "Family_Size"]


def demographic_groups(spark, sf_dir):
    """Demographics with a rule group: 3 age bands x 3 spending levels, so the
    labels and narratives reach every branch (young / middle / senior and
    saver / standard / spender)."""
    d = fx.demographics(spark, sf_dir)
    d = d.withColumn("Spending_Score_Num", spending_ordinal(d))
    band = F.least(F.floor((F.col("Age") - 18) / 20), F.lit(2))
    return d.withColumn("Cluster", (band * 3 + F.col("Spending_Score_Num") - 1).cast("int"))


@query("segment_labels_demographic")
def q_segment_labels_demographic(spark, sf_dir):
    g = demographic_groups(spark, sf_dir)
    labels = label_segments(g, "demographic", "Cluster", DEMOGRAPHIC_FEATURES)
    return labels.select("Cluster", *[F.round(f, 6).alias(f) for f in DEMOGRAPHIC_FEATURES], "Cluster_Label")


@query("segment_narrative_demographic")
def q_segment_narrative_demographic(spark, sf_dir):
    return segment_narrative(demographic_groups(spark, sf_dir), "Cluster", DEMOGRAPHIC_FEATURES)


@query("persona_segments")
def q_persona_segments(spark, sf_dir):
    """RUL-1/RUL-2 on a segment summary, as the reference applies them: the
    personas read the means rounded half to even to one decimal (Q-16)."""
    g = demographic_groups(spark, sf_dir)
    summary = segment_profile(g, "Cluster", DEMOGRAPHIC_FEATURES, digits=1, half_even=True)
    return apply_personas(summary, "demographic")

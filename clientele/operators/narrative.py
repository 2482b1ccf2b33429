"""Narratives (RUL-8, RUL-9, AGG-18)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tenths(num: Column, den: Column) -> Column:
    """100*num/den as text with one decimal, rounded half up in exact integer
    arithmetic (so every engine prints the same digits)."""
    t = F.floor((num * 2000 + den) / (den * 2)).cast("bigint")
    return F.concat((t / 10).cast("bigint").cast("string"), F.lit("."), (t % 10).cast("string"))


# Narrative strategies.
NARRATIVE_ACTIONS = {
    "young_high": "Strategy: Promote trending, premium items on social channels (Instagram/TikTok).",
    "senior_high": "Strategy: Focus on loyalty rewards and high-touch customer service.",
    "budget": "Strategy: Target with bulk discounts, bundles, or seasonal sales.",
    "default": "Strategy: Maintain engagement with regular newsletters.",
}


def segment_narrative(df: DataFrame, cluster: str, features: Sequence[str]) -> DataFrame:
    """RUL-8: one paragraph per segment from its share, size and mean profile.

    Age adjectives if ``Age`` is a feature; spend adjectives from the first
    feature whose name contains 'spend' or 'monetary', compared with the
    global mean (+-20 %).
    """
    total = df.select(F.count(F.lit(1))).scalar()
    aggs = [F.count(F.lit(1)).alias("size")]
    aggs += [F.avg(F.col(f).cast("double")).alias(f) for f in features]
    s = df.groupBy(cluster).agg(*aggs)
    desc = []
    flags = {}
    if "Age" in features:
        a = F.col("Age")
        age = F.when(a < 30, "younger").when(a > 50, "senior").otherwise("middle-aged")
        desc.append(age)
        flags["younger"], flags["senior"] = a < 30, ~(a < 30) & (a > 50)
    spend = next((f for f in features if "spend" in f.lower() or "monetary" in f.lower()), None)
    if spend:
        g = df.select(F.avg(F.col(spend).cast("double"))).scalar()
        v = F.col(spend)
        sp = F.when(v > g * 1.2, "high-value").when(v < g * 0.8, "budget-conscious").otherwise("average-spending")
        desc.append(sp)
        flags["high"], flags["budget"] = v > g * 1.2, ~(v > g * 1.2) & (v < g * 0.8)
    adj = F.concat_ws(", ", *desc) if desc else F.lit("standard")
    summary = F.concat(F.lit("**Segment Overview:** This group represents **"),
                       tenths(F.col("size"), F.lit(total)),
                       F.lit("%** of your customer base ("), F.col("size").cast("string"),
                       F.lit(" users). They are predominantly **"), adj, F.lit("** customers."))
    false = F.lit(False)
    hi, yo, se, bu = (flags.get(k, false) for k in ("high", "younger", "senior", "budget"))
    A = NARRATIVE_ACTIONS
    action = (F.when(hi & yo, A["young_high"]).when(hi & se, A["senior_high"])
               .when(bu, A["budget"]).otherwise(A["default"]))
    return s.select(cluster, "size", adj.alias("adjectives"), summary.alias("summary"), action.alias("action"))


# Headline texts before and after the rate.
HEADLINES = {
    "critical": ("⚠️ **Critical Alert:** ", "% of your customers are High Risk. Immediate retention campaigns required."),
    "warning": ("⚠️ **Warning:** Churn risk is elevated (", "%). Investigate 'Contract' and 'Support' issues."),
    "healthy": ("✅ **Healthy:** Only ", "% of customers are High Risk. Focus on acquisition."),
}


def churn_headline(bands: DataFrame, band: str = "Risk_Group") -> DataFrame:
    """AGG-18 + RUL-9: High share of all banded rows and a one-line status."""
    s = bands.agg(F.count_if(F.col(band) == "High").alias("high_risk"),
                  F.count(F.col(band)).alias("total"))
    rate = tenths(F.col("high_risk"), F.col("total"))
    r = F.when(F.col("total") > 0, F.col("high_risk") * 100.0 / F.col("total")).otherwise(F.lit(0.0))
    rate_txt = F.when(F.col("total") > 0, rate).otherwise(F.lit("0.0"))
    H = HEADLINES
    text = (F.when(r > 30, F.concat(F.lit(H["critical"][0]), rate_txt, F.lit(H["critical"][1])))
             .when(r > 15, F.concat(F.lit(H["warning"][0]), rate_txt, F.lit(H["warning"][1])))
             .otherwise(F.concat(F.lit(H["healthy"][0]), rate_txt, F.lit(H["healthy"][1]))))
    return s.select("high_risk", "total", r.alias("high_risk_pct"), text.alias("headline"))

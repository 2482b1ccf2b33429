"""Rule personas and segment labels (RUL-1..7) as CASE columns.

Each function adds columns to any DataFrame (a per-customer table or a
per-segment summary); a missing input column reads as 0, as in the reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import col_or, is_numeric

PERSONA_COLS = ("Persona", "Strategy", "Next_Best_Action")


def _cases(branches: list[tuple[Column | None, tuple[str, str, str]]]) -> dict[str, Column]:
    """Build the three output columns from ordered (condition, values) branches;
    the branch with condition None is the default."""
    out = {}
    for i, name in enumerate(PERSONA_COLS):
        e = None
        default = None
        for cond, vals in branches:
            if cond is None:
                default = vals[i]
                continue
            e = F.when(cond, vals[i]) if e is None else e.when(cond, vals[i])
        out[name] = e.otherwise(default) if e is not None else F.lit(default)
    return out


# Persona, strategy and action texts per rule.
DEMOGRAPHIC_STRATEGIES = {
    "solo_genz": ("Trend & FOMO", "Push: 'Trending Now'"),
    "fam_saver": ("Value Bundles", "Email: 'Buy 2 Get 1'"),
    "senior": ("Trust & Loyalty", "Mail: Loyalty Club"),
    "spender": ("Exclusivity", "Invite: VIP Early Access"),
    "default": ("Standard", "Newsletter"),
}
RFM_PERSONAS = {
    "champion": ("Champion", "Reward", "VIP Tier Upgrade"),
    "whale": ("At-Risk Whale", "Win-Back", "Personal Call + Gift"),
    "active": ("New/Active", "Nurture", "Cross-sell Recommendation"),
    "hibernating": ("Hibernating", "Re-engage", "Automated Drip Campaign"),
    "default": ("Standard", "Maintain", "Weekly Update"),
}
CHURN_PERSONAS = {
    "critical": ("Flight Risk (Critical)", "Immediate Intervention", "Call: Offer 20% Retention Discount"),
    "at_risk": ("At Risk", "Value Reinforcement", "Email: Highlight Premium Features"),
    "loyalist": ("Loyalist", "Advocacy", "Ask for Referral"),
    "default": ("Neutral", "Monitor", "No Action"),
}
GEO_PERSONAS = {
    "hi_vol_low_sat": ("High Vol / Low Sat", "Operational Fix", "Audit Ground Staff & Delays"),
    "flagship": ("Flagship Route", "Maximize Yield", "Increase Business Class Prices"),
    "niche": ("Niche / Low Volume", "Efficiency Check", "Evaluate Route Profitability"),
    "standard_route": ("Standard Route", "Growth", "Seasonal Promotion"),
    "power": ("Power Region", "Logistics Priority", "Scale support operations"),
    "detractor": ("Detractor Zone", "Quality Control", "Investigate local reviews"),
    "default": ("Key Location", "Maintain", "Monitor Metrics"),
}


def persona_demographic(df: DataFrame, family: str = "Family_Size", age: str = "Age",
                        spend: str = "Spending_Score_Num") -> DataFrame:
    """RUL-2: traits 'Solo|Small Fam|Large Fam / Gen Z|Pro|Senior [/ Spender|Saver]' and a tactic."""
    f, a, s = col_or(df, family, 0), col_or(df, age, 0), col_or(df, spend, 0)
    fam = F.when(f <= 1.5, "Solo").when(f <= 3.5, "Small Fam").otherwise("Large Fam")
    gen = F.when(a < 30, "Gen Z").when(a < 50, "Pro").otherwise("Senior")
    sp = F.when(s > 2.5, "Spender").when(s < 1.5, "Saver")
    df = df.withColumn("Persona", F.concat_ws(" / ", fam, gen, sp))
    p = F.col("Persona")
    st = DEMOGRAPHIC_STRATEGIES
    branches = [
        (p.contains("Solo") & p.contains("Gen Z"), st["solo_genz"]),
        (p.contains("Fam") & p.contains("Saver"), st["fam_saver"]),
        (p.contains("Senior"), st["senior"]),
        (p.contains("Spender"), st["spender"]),
    ]
    strat = act = None
    for cond, (t, a_) in branches:
        strat = F.when(cond, t) if strat is None else strat.when(cond, t)
        act = F.when(cond, a_) if act is None else act.when(cond, a_)
    return df.withColumns({"Strategy": strat.otherwise(st["default"][0]),
                           "Next_Best_Action": act.otherwise(st["default"][1])})


def persona_rfm(df: DataFrame, recency: str = "Recency", monetary: str = "Monetary",
                recent_days: float = 30, lost_days: float = 90, big_spend: float = 1000) -> DataFrame:
    """RUL-3: Champion / At-Risk Whale / New-Active / Hibernating / Standard."""
    r, m = col_or(df, recency, 0), col_or(df, monetary, 0)
    recent, lost, big = r < recent_days, r > lost_days, m > big_spend
    p = RFM_PERSONAS
    return df.withColumns(_cases([(recent & big, p["champion"]), (lost & big, p["whale"]),
                                  (recent, p["active"]), (lost, p["hibernating"]), (None, p["default"])]))


def persona_churn(df: DataFrame, probability: str = "probability", value: str = "Value") -> DataFrame:
    """RUL-4: a numeric ``Value`` <= 1 stands in for the probability."""
    prob = col_or(df, probability, 0.0)
    if value in df.columns and is_numeric(df, value):
        v = col_or(df, value, None)
        risk = F.when(v <= 1.0, v).otherwise(prob)
    else:
        risk = prob
    p = CHURN_PERSONAS
    return df.withColumns(_cases([(risk > 0.8, p["critical"]), (risk > 0.5, p["at_risk"]),
                                  (risk < 0.2, p["loyalist"]), (None, p["default"])]))


def persona_geo(df: DataFrame, traffic: str = "Traffic", rating: str = "OverallRating",
                value: str = "Value") -> DataFrame:
    """RUL-5: route rules when traffic and rating columns exist, else value rules."""
    p = GEO_PERSONAS
    if traffic in df.columns and rating in df.columns:
        t, r = col_or(df, traffic, None), col_or(df, rating, None)
        branches = [((t > 50) & (r < 4), p["hi_vol_low_sat"]), (t > 50, p["flagship"]),
                    (t < 10, p["niche"]), (None, p["standard_route"])]
    else:
        v = col_or(df, value, 0)
        branches = [(v > 1000, p["power"]), (v < 0, p["detractor"]), (None, p["default"])]
    return df.withColumns(_cases(branches))


def apply_personas(df: DataFrame, context: str, **kwargs) -> DataFrame:
    """RUL-1: dispatch by context; an unknown context is an error."""
    fn = {"demographic": persona_demographic, "rfm": persona_rfm,
          "churn": persona_churn, "geo": persona_geo}.get(context.lower())
    if fn is None:
        raise ValueError(f"unknown persona context {context!r}")
    return fn(df, **kwargs)


def segment_labels(summary: DataFrame, mode: str, cluster: str = "Cluster",
                   q1: Column | float | None = None, q3: Column | float | None = None) -> DataFrame:
    """RUL-6: a label per cluster from its mean features.

    ``summary`` holds one row per cluster with mean feature columns. For RFM,
    ``q1``/``q3`` are the customers' Monetary quartiles (columns or numbers).
    """
    mode = mode.lower()
    if mode == "demographic":
        a, s, f = (col_or(summary, "Age", 0), col_or(summary, "Spending_Score_Num", 0),
                   col_or(summary, "Family_Size", 0))
        parts = [F.when(a < 30, "Young").when(a < 50, "Mid-Age").otherwise("Senior"),
                 F.when(s < 1.5, "Saver").when(s > 2.5, "Spender").otherwise("Standard"),
                 F.when(f > 3.5, "(Fam)")]
    elif mode == "rfm":
        r, m = col_or(summary, "Recency", 0), col_or(summary, "Monetary", 0)
        hi = q3 if isinstance(q3, Column) else F.lit(q3)
        lo = q1 if isinstance(q1, Column) else F.lit(q1)
        parts = [F.when(r < 30, "Active").when(r > 90, "Lost").otherwise("Regular"),
                 F.when(m > hi, "Whale").when(m < lo, "LowVal").otherwise("MidVal")]
    else:
        parts = [F.concat(F.lit("Group "), F.col(cluster).cast("string"))]
    return summary.withColumn("Cluster_Label", F.concat_ws(" ", *parts))


def segment_heuristic(df: DataFrame, label: str = "Cluster_Label", segment: str = "Segment",
                      monetary: str = "Monetary", recency: str = "Recency") -> DataFrame:
    """RUL-7: existing label, else Segment, else RFM heuristic, else Unsegmented.

    Adds ``Segment_Id`` (0 label/segment, 1 Champion, 2 Lost, 3 Standard, -1 none)
    and ``Segment_Name``.
    """
    if label in df.columns:
        return df.withColumns({"Segment_Id": F.lit(0), "Segment_Name": F.col(label).cast("string")})
    if segment in df.columns:
        return df.withColumns({"Segment_Id": F.lit(0), "Segment_Name": F.col(segment).cast("string")})
    if monetary in df.columns and recency in df.columns:
        m = F.col(monetary).cast("string").try_cast("double")
        r = F.col(recency).cast("string").try_cast("double")
        m = F.when(~F.isnan(m), m)
        r = F.when(~F.isnan(r), r)
        champ, lost = (m > 1000) & (r < 30), r > 90
        return df.withColumns({
            "Segment_Id": F.when(champ, 1).when(lost, 2).otherwise(3),
            "Segment_Name": F.when(champ, "Champion (Heuristic)").when(lost, "Lost (Heuristic)")
                             .otherwise("Standard (Heuristic)")})
    return df.withColumns({"Segment_Id": F.lit(-1), "Segment_Name": F.lit("Unsegmented")})

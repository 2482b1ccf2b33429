"""Churn reporting aggregates over a scored table (AGG-8..13)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clean import ID_COLUMNS, churn_flag, is_numeric, string_columns, total
from ..functions.partitioning import materialize
from ..functions.ranking import exact_quantiles, modes
from ..functions.scalars import row_values

# Driver direction texts.
IMPACT_UP, IMPACT_DOWN, IMPACT_KEY = "Increases Risk 🔴", "Decreases Risk 🟢", "Key Risk Driver ⚠️"


def churn_kpis(scored: DataFrame, probability: str = "probability", band: str = "Risk_Group",
               revenue: str | None = "MonthlyCharges", scale: int | None = None) -> DataFrame:
    """AGG-8: mean probability, High count and share, revenue held by High rows
    (summed in its own type; ``scale`` as in ``rfm``)."""
    high = F.col(band) == "High"
    aggs = [F.avg(probability).alias("avg_probability"),
            F.count_if(high).alias("high_risk_count"),
            F.try_divide(F.count_if(high), F.count(F.lit(1))).alias("high_risk_share")]
    if revenue and revenue in scored.columns:
        aggs.append(total(scored, revenue, scale, high).alias("revenue_at_risk"))
    return scored.agg(*aggs)


def risk_histogram(scored: DataFrame, probability: str = "probability", band: str = "Risk_Group",
                   bins: int = 20) -> DataFrame:
    """AGG-9: equal-width probability bins on [0, 1] split by band."""
    b = F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1)).cast("bigint")
    return (scored.groupBy(F.col(band).alias(band), b.alias("bin"))
                  .agg(F.count(F.lit(1)).alias("customers"))
                  .withColumns({"bin_low": F.col("bin") / bins, "bin_high": (F.col("bin") + 1) / bins}))


def safest_option(df: DataFrame, cols: Sequence[str] | None = None, label: str = "Churn",
                  min_count: int = 1) -> DataFrame:
    """AGG-10: per column (default: every text column but ids and the label), the
    value with the lowest churn rate (lower value on ties), where the column has
    at least two values. Nulls are no group."""
    cols = list(cols) if cols is not None else [c for c in string_columns(df, (*ID_COLUMNS, label))]
    if not cols:
        return df.sparkSession.createDataFrame([], "feature string, best_option string, churn_rate double")
    y = churn_flag(df, label)
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("option"))
                                for c in cols]))
    long = df.select(y.alias("__y"), stack.alias("s")).select("s.feature", "s.option", "__y")
    rates = (long.where(F.col("option").isNotNull())
                 .groupBy("feature", "option")
                 .agg(F.avg("__y").alias("churn_rate"), F.count(F.lit(1)).alias("customers"))
                 .where(F.col("customers") >= min_count))
    # lowest rate per feature (lower option on ties) as a grouped min_by: partial
    # aggregation, so a column with very many values is not one task
    best = rates.groupBy("feature").agg(
        F.count(F.lit(1)).alias("__n"),
        F.min_by(F.struct("option", "churn_rate"), F.struct("churn_rate", "option")).alias("__b"))
    return best.where(F.col("__n") > 1).select(
        "feature", F.col("__b.option").alias("best_option"), F.col("__b.churn_rate").alias("churn_rate"))


def typical_customer(df: DataFrame, exclude: Sequence[str] = ("customerID", "Churn")) -> DataFrame:
    """AGG-11: median of every numeric column, most frequent value (lowest on
    ties) of every other column, as one row. Both are computed distributed."""
    ex = {e.lower() for e in exclude}
    cols = [c for c in df.columns if c.lower() not in ex]
    nums = [c for c in cols if is_numeric(df, c)]
    cats = [c for c in cols if c not in nums]
    # medians and modes read the input several times: compute it once
    df = materialize(df.select(*cols))
    out = {}
    if nums:
        long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).cast("double").alias("v"))
                                             for c in nums])).alias("s")).select("s.*")
        med = exact_quantiles(long, "v", [0.5], group="f", names=["median"])
        row = med.groupBy().pivot("f", nums).agg(F.first("median"))
        vals = row_values(row.select(*[F.col(c) for c in nums]))
        out.update(vals)
    if cats:
        long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).cast("string").alias("v"))
                                             for c in cats])).alias("s")).select("s.*")
        row = modes(long, "v", group="f").groupBy().pivot("f", cats).agg(F.first("v"))
        out.update(row_values(row, cats))
    # every value is a scalar subquery over a tiny result; one output row
    return df.sparkSession.range(1).select(*[out[c].alias(c) for c in cols])


def driver_direction(scored: DataFrame, drivers: Sequence[str], probability: str = "probability") -> DataFrame:
    """AGG-12: sign of corr(feature, probability); non-numeric features are key
    drivers; a correlation that is not above 0 (also NaN) reads as decreasing."""
    nums = [d for d in drivers if d in scored.columns and is_numeric(scored, d)]
    corr = row_values(scored.agg(*[F.corr(F.col(d).cast("double"), F.col(probability)).alias(d)
                                   for d in nums])) if nums else {}
    rows = []
    for i, d in enumerate(drivers):
        if d in nums:
            c = corr[d]
            impact = F.when(~F.isnan(c) & (c > 0), IMPACT_UP).otherwise(IMPACT_DOWN)
            rows.append(F.struct(F.lit(i).alias("rank"), F.lit(d).alias("Feature"),
                                 c.alias("correlation"), impact.alias("Impact")))
        else:
            rows.append(F.struct(F.lit(i).alias("rank"), F.lit(d).alias("Feature"),
                                 F.lit(None).cast("double").alias("correlation"), F.lit(IMPACT_KEY).alias("Impact")))
    return scored.sparkSession.range(1).select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def class_balance(df: DataFrame, label: str = "Churn") -> DataFrame:
    """AGG-13: negatives / positives (1 when there are no positives)."""
    y = churn_flag(df, label)
    s = df.agg(F.count_if(y == 0).alias("negatives"), F.count_if(y == 1).alias("positives"))
    return s.withColumn("pos_weight", F.when(F.col("positives") > 0, F.col("negatives") / F.col("positives"))
                        .otherwise(F.lit(1.0)))

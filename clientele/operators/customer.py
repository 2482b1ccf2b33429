"""Single-customer views computed for every customer (WIN-1, AGG-17, TOP-3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clean import nan_to_null, numeric_columns
from ..functions.ranking import percentile_ranks

# Metrics compared on the customer view, in priority order.
PROFILE_PRIORITY = ["Recency", "Frequency", "Monetary", "Age", "Spending_Score_Num",
                    "Tenure", "MonthlyCharges", "TotalCharges"]


def profile_metrics(df: DataFrame, id_col: str, cluster: str = "Cluster") -> list[str]:
    """Priority metrics present (numeric); fewer than three -> first five numeric."""
    nums = [c for c in numeric_columns(df) if c not in (id_col, cluster)]
    chosen = [c for c in PROFILE_PRIORITY if c in nums]
    return chosen if len(chosen) >= 3 else nums[:5]


def _long(df: DataFrame, id_col: str, metrics: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    complete = None
    for m in metrics:
        c = nan_to_null(df, m).isNotNull()
        complete = c if complete is None else complete & c
    s = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), nan_to_null(df, m).cast("double").alias("value"))
                            for m in metrics]))
    return df.select(id_col, *extra, complete.alias("__complete"), s.alias("s")).select(
        id_col, *extra, "__complete", "s.metric", "s.value")


def percentile_profile(df: DataFrame, id_col: str, metrics: Sequence[str] | None = None) -> DataFrame:
    """WIN-1: per customer and metric, 100 x (average rank of ties / count) among
    the rows with no missing metric; rows with a missing metric get 50.

    Ranks come from ``percentile_ranks`` (distributed, no single-task window);
    the per-value result joins back on (metric, value).
    """
    metrics = list(metrics or profile_metrics(df, id_col))
    long = _long(df, id_col, metrics)
    ranks = percentile_ranks(long.where("__complete"), "value", group="metric")
    j = long.join(ranks, ["metric", "value"], "left")
    pct = F.when(F.col("__complete"), F.col("pct") * 100).otherwise(F.lit(50.0))
    return j.select(id_col, "metric", "value", pct.alias("percentile"))


def customer_vs_segment(df: DataFrame, id_col: str, cluster: str,
                        metrics: Sequence[str] | None = None) -> DataFrame:
    """AGG-17: each customer's metric next to its segment mean and the global mean.

    Segment means are one grouped aggregate (k rows, broadcast back); global
    means are scalar subqueries. No window over a whole segment.
    """
    metrics = list(metrics or profile_metrics(df, id_col, cluster))
    long = _long(df, id_col, metrics, extra=[cluster])
    seg = long.groupBy(cluster, "metric").agg(F.avg("value").alias("segment_avg"))
    glob = long.groupBy("metric").agg(F.avg("value").alias("global_avg"))
    # seg has k x metrics rows and glob has one row per metric: bounded, broadcast.
    j = long.join(F.broadcast(seg), [cluster, "metric"], "left").join(F.broadcast(glob), "metric", "left")
    return j.select(id_col, cluster, "metric", "value",
                    "segment_avg", "global_avg")


def customer_index(df: DataFrame, id_col: str, limit: int | None = None) -> DataFrame:
    """TOP-3: the distinct ids as text, ordered by the text; ``limit`` for the first ones only."""
    ids = (df.select(F.col(id_col).cast("string").alias("customer_id")).where(F.col("customer_id").isNotNull())
             .distinct().orderBy("customer_id"))
    return ids.limit(limit) if limit is not None else ids

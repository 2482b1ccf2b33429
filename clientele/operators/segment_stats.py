"""Segment statistics: scaling, assignment to centres, profiles, sizes, labels
(AGG-2, AGG-3, JOIN-8, RUL-6, ML-7 assignment)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import nan_to_null
from .rules import segment_labels


def standardise(df: DataFrame, features: Sequence[str], suffix: str = "_z") -> DataFrame:
    """(x - mean) / sample std per feature (0 for a constant one; NaN is missing). All moments come from one aggregate
    pass, returned as one struct-valued scalar subquery (evaluated once)."""
    m = df.select(F.struct(*[F.avg(nan_to_null(df, f).cast("double")).alias(f"mu{i}") for i, f in enumerate(features)],
                           *[F.stddev_samp(nan_to_null(df, f).cast("double")).alias(f"sd{i}") for i, f in enumerate(features)])
                  ).scalar()
    def z(i, f):
        d = nan_to_null(df, f).cast("double") - m[f"mu{i}"]
        return F.when(m[f"sd{i}"] > 0, d / m[f"sd{i}"]).when(d.isNotNull(), 0.0)
    return df.withColumns({f + suffix: z(i, f) for i, f in enumerate(features)})


def nearest_centroid(df: DataFrame, features: Sequence[str], centres: Sequence[Sequence[float]],
                     out: str = "Cluster") -> DataFrame:
    """Index of the nearest centre (squared Euclidean; lowest index on ties)."""
    dists = []
    for c in centres:
        d = None
        for f, v in zip(features, c):
            t = (F.col(f) - F.lit(float(v))) ** 2
            d = t if d is None else d + t
        dists.append(d)
    best = F.least(*dists)
    e = None
    for i, d in enumerate(dists):
        e = F.when(d == best, i) if e is None else e.when(d == best, i)
    return df.withColumn(out, e.cast("int"))


def segment_profile(df: DataFrame, cluster: str, features: Sequence[str], digits: int | None = None,
                    half_even: bool = False) -> DataFrame:
    """AGG-2: mean of each feature per segment (one small aggregate).

    ``digits=1, half_even=True`` gives the display table the personas read
    (means rounded half to even to one decimal)."""
    aggs = []
    for f in features:
        m = F.avg(nan_to_null(df, f).cast("double"))
        r = (F.bround(m, digits) if half_even else F.round(m, digits)) if digits is not None else m
        aggs.append(r.alias(f))
    return df.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"), *aggs)


def segment_sizes(df: DataFrame, cluster: str) -> DataFrame:
    """AGG-3: size, share and size rank (largest first, lower id on ties)."""
    total = df.select(F.count(F.lit(1))).scalar()
    s = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("customers"))
    # s has one row per segment: the unpartitioned window is over a handful of rows.
    w = Window.orderBy(F.desc("customers"), F.asc(cluster))
    return s.select(cluster, "customers", (F.col("customers") / total).alias("share"),
                    F.row_number().over(w).alias("size_rank"))


def attach_labels(df: DataFrame, labels: DataFrame, cluster: str = "Cluster") -> DataFrame:
    """JOIN-8: cluster id -> label for every row; the label table has one row
    per cluster (k rows), so it is broadcast."""
    return df.join(F.broadcast(labels.select(cluster, "Cluster_Label")), cluster, "left")


def label_segments(df: DataFrame, mode: str, cluster: str, features: Sequence[str],
                   q1: Column | float | None = None, q3: Column | float | None = None) -> DataFrame:
    """RUL-6 on the per-segment means of ``df``."""
    summary = segment_profile(df, cluster, features, digits=None)
    return segment_labels(summary, mode, cluster, q1, q3)

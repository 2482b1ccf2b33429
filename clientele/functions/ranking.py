"""Exact ranks and quantiles without a single-task merge.

Spark's exact ``percentile``/``median``/``mode`` and an unpartitioned
``rank() OVER ()`` all funnel every distinct value into one task. Here the
work is spread instead:

1. ``groupBy(group, value).count()``: one row per distinct value (partial
   aggregation absorbs hot values, however many rows they hold).
2. These rows are dealt out by ranges of (group, value) into the session's
   shuffle partitions; the partition's number, kept with the rows, is the
   bucket. The rows are checkpointed, so every later step sees the same buckets.
3. Bucket totals (at most one row per bucket and group in it) give each
   bucket's offset; the running count inside a bucket is a window partitioned
   by (group, bucket).

Nothing is collected, and the plan does not grow with groups or buckets. The
result holds, for every distinct value, ``cnt`` (rows with that value),
``before`` (rows with a smaller value in the group) and ``n`` (rows in the
group). Values are ranked as doubles; NULL and NaN are missing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .partitioning import materialize


def running_counts(counts: DataFrame, keys: Sequence[str], value: str, n_buckets: int | None = None) -> DataFrame:
    """(keys, value, cnt, before, n) from one row ``(keys, value, cnt)`` per distinct value."""
    keys = list(keys)
    ranges = [*[F.col(k) for k in keys], F.col(value)]
    dealt = counts.repartitionByRange(n_buckets, *ranges) if n_buckets else counts.repartitionByRange(*ranges)
    b = materialize(dealt.withColumn("__b", F.spark_partition_id()))
    totals = b.groupBy(*keys, "__b").agg(F.sum("cnt").alias("__bt"))
    wg = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    offsets = (totals
               .withColumn("__off", F.coalesce(F.sum("__bt").over(
                   wg.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
               .withColumn("n", F.sum("__bt").over(wg))
               .select(*keys, "__b", "__off", "n"))
    wb = Window.partitionBy(*keys, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    within = b.withColumn("__in", F.coalesce(F.sum("cnt").over(wb), F.lit(0)))
    out = within.join(offsets, [*keys, "__b"])
    return out.select(*keys, value, "cnt", (F.col("__off") + F.col("__in")).alias("before"), "n")


def value_ranks(df: DataFrame, value: str, group: str | None = None, n_buckets: int | None = None) -> DataFrame:
    """(group?, value, cnt, before, n) for every distinct value that is not missing.

    ``n_buckets``: ranges the values are dealt into (default: the session's
    shuffle partitions)."""
    keys = [group] if group else []
    v = F.col(value).cast("double")
    counts = (df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys, v.alias("__v"))
              .agg(F.count(F.lit(1)).alias("cnt")))
    return running_counts(counts, keys, "__v", n_buckets).withColumnRenamed("__v", value)


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], group: str | None = None,
                    names: Sequence[str] | None = None, n_buckets: int | None = None) -> DataFrame:
    """Quantiles with linear interpolation between order statistics (pandas' default).

    Returns one row (per group) with one double column per probability.
    """
    names = list(names or [f"q{int(round(p * 100))}" for p in probs])
    keys = [group] if group else []
    r = value_ranks(df, value, group, n_buckets)
    aggs = []
    for p, nm in zip(probs, names):
        pos = F.lit(float(p)) * (F.col("n") - 1)
        lo, hi = F.floor(pos), F.ceil(pos)
        at_lo = (F.col("before") <= lo) & (lo < F.col("before") + F.col("cnt"))
        at_hi = (F.col("before") <= hi) & (hi < F.col("before") + F.col("cnt"))
        aggs += [F.max(F.when(at_lo, F.col(value))).alias(f"__lo_{nm}"),
                 F.max(F.when(at_hi, F.col(value))).alias(f"__hi_{nm}"),
                 F.max(pos - lo).alias(f"__fr_{nm}")]
    hits = None
    for p in probs:
        pos = F.lit(float(p)) * (F.col("n") - 1)
        h = (F.col("before") <= F.ceil(pos)) & (F.floor(pos) < F.col("before") + F.col("cnt"))
        hits = h if hits is None else hits | h
    g = r.where(hits).groupBy(*keys).agg(*aggs)
    return g.select(*keys, *[(F.col(f"__lo_{nm}") + (F.col(f"__hi_{nm}") - F.col(f"__lo_{nm}"))
                              * F.col(f"__fr_{nm}")).alias(nm) for nm in names])


def percentile_ranks(df: DataFrame, value: str, group: str | None = None,
                     n_buckets: int | None = None) -> DataFrame:
    """(group?, value, pct): average rank of ties / non-null count, in (0, 1]."""
    keys = [group] if group else []
    r = value_ranks(df, value, group, n_buckets)
    avg_rank = F.col("before") + (F.col("cnt") + 1) / 2.0
    return r.select(*keys, value, (avg_rank / F.col("n")).alias("pct"))


def modes(df: DataFrame, value: str, group: str | None = None) -> DataFrame:
    """Most frequent non-null value (lowest on ties), per group; a distributed ``mode``."""
    keys = [group] if group else []
    v = F.col(value)
    there = v.isNotNull() & ~F.isnan(v) if dict(df.dtypes)[value] in ("double", "float") else v.isNotNull()
    c = df.where(there).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("cnt"))
    return c.groupBy(*keys).agg(F.min_by(F.col(value), F.struct(-F.col("cnt"), F.col(value))).alias(value))


def running_totals(counts: DataFrame, keys: Sequence[str], value: str, cols: Sequence[str], n_buckets: int | None = None) -> DataFrame:
    """(keys, value, cols, ``before_<col>``, ``all_<col>``, ``next``) from one row per (keys, value): per column the sum
    over the group's smaller values and over the whole group, and the next larger value (null at the end). Dealt out by
    ranges as in ``running_counts``, so a group of any size is spread over the session's partitions."""
    keys, cols = list(keys), list(cols)
    ranges = [*[F.col(k) for k in keys], F.col(value)]
    dealt = counts.repartitionByRange(n_buckets, *ranges) if n_buckets else counts.repartitionByRange(*ranges)
    b = materialize(dealt.withColumn("__b", F.spark_partition_id()))
    wg = Window.partitionBy(*keys)
    behind = wg.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    parts = b.groupBy(*keys, "__b").agg(F.min(value).alias("__first"), *[F.sum(c).alias(f"__t_{c}") for c in cols])
    parts = parts.select(*keys, "__b", F.lead("__first").over(wg.orderBy("__b")).alias("__later"),
                         *[F.coalesce(F.sum(f"__t_{c}").over(behind), F.lit(0)).alias(f"__off_{c}") for c in cols],
                         *[F.sum(f"__t_{c}").over(wg).alias(f"all_{c}") for c in cols])
    wb = Window.partitionBy(*keys, "__b").orderBy(value)
    inside = b.withColumns({"__next": F.lead(value).over(wb), **{f"__in_{c}": F.coalesce(F.sum(c).over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for c in cols}})
    out = inside.join(parts, [*keys, "__b"])
    return out.select(*keys, value, *cols, *[(F.col(f"__off_{c}") + F.col(f"__in_{c}")).alias(f"before_{c}") for c in cols],
                      *[f"all_{c}" for c in cols], F.coalesce("__next", "__later").alias("next"))

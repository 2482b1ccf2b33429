"""Partition helpers."""

from __future__ import annotations

import gc
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Give CPU-heavy per-row work (tokenising long texts) at least one
    partition per core.

    Only repartitions a plain scan (with projections and filters) that has
    fewer partitions than the cluster's default parallelism: a large table read
    from many files already has far more, so at scale this is a no-op and adds
    no shuffle. A plan with a shuffle is left as it is (its partitions are the
    session's); asking it for its partitions would run its stages.
    """
    if df._jdf.queryExecution().executedPlan().nodeName().startswith("AdaptiveSparkPlan"):
        return df
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target)


def sized(persisted: DataFrame, rows_per_partition: int = 100_000) -> DataFrame:
    """Match the partition count of a persisted training table to its size.

    Iterative fits run one job per tree level or pass, each with one task per
    partition; a small table spread over hundreds of shuffle partitions spends
    its time scheduling. Counting materialises the cache; ``coalesce`` then
    merges cached partitions without a shuffle. Larger tables get one
    partition per ``rows_per_partition`` rows, at most two a core (and never
    more than they had): every task of a pass reports to the driver, so what
    the driver receives in thousands of passes must not grow with the rows.
    """
    n = persisted.count()
    most = 2 * persisted.sparkSession.sparkContext.defaultParallelism
    target = max(1, min(-(-n // rows_per_partition), most))
    return persisted.coalesce(target) if target < persisted.rdd.getNumPartitions() else persisted


def materialize(df: DataFrame) -> DataFrame:
    """Compute a derived table once and cut its lineage (reliable checkpoint).

    Used where one intermediate feeds several passes (the tiers of the
    location cascade, the cut points and running counts of the ranking):
    without it each pass would re-read and re-aggregate the source table,
    since the copies differ in pushed-down filters and cannot share an
    exchange. The files go to the shared folder in ``spark.checkpoint.dir``
    (``session.ensure_checkpoint_dir``) and survive the loss of an executor.
    """
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def computed_once(df: DataFrame, keep: Column) -> DataFrame:
    """The rows that ``keep``, whose condition is on costly columns. Spark would else move the filter below the projection
    that makes these columns, and so make them once for each mention in the filter and again for the rows that stay; it
    does not below a projection with a row's number."""
    return df.withColumn("__row", F.monotonically_increasing_id()).where(keep & (F.col("__row") >= 0)).drop("__row")


def sweep(spark: SparkSession) -> None:
    """Let go of shuffle and checkpoint files of finished rounds: Spark removes them when the driver's JVM collects their
    plans, which it is asked to do here. Twice, as a plan is held for a moment after its job (measured: one collection, or
    two at once, free nothing of the last round)."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder of one's own on whatever file system it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

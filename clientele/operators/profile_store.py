"""Mergeable table profiles (PRF-5, PRF-6): a new delivery is profiled alone and merged.

A profile has one row per column: rows, nulls, least and largest value (as number and as
text) and a HyperLogLog sketch of the distinct values. Merging adds, takes extremes and
unites sketches, so the order and grouping of deliveries do not matter. A sketch only
estimates; columns whose estimate is near the limit are counted exactly on the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clean import is_numeric

SKETCH_BITS = 12  # 4,096 registers, about 1.6 % error
NEAR = 0.2  # estimates within this part of the limit are counted exactly


def profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column_name, kind, row_count, nulls, least, most, least_text, most_text, sketch``, one pass over the table.
    NaN counts as missing in numeric columns."""
    columns = list(columns or df.columns)
    aggs, rows = [F.count(F.lit(1)).alias("n")], []
    for i, c in enumerate(columns):
        numeric = is_numeric(df, c)
        v = F.col(f"`{c}`")
        x = F.when(~F.isnan(v.cast("double")), v.cast("double")) if numeric else F.lit(None).cast("double")
        there = F.when(~F.isnan(v.cast("double")), v) if numeric else v
        text = F.lit(None).cast("string") if numeric else v.cast("string")
        aggs += [F.count(there).alias(f"c{i}"), F.min(x).alias(f"a{i}"), F.max(x).alias(f"z{i}"), F.min(text).alias(f"ta{i}"), F.max(text).alias(f"tz{i}"),
                 F.hll_sketch_agg(there.cast("string"), SKETCH_BITS).alias(f"h{i}")]
        rows.append(F.struct(F.lit(c).alias("column_name"), F.lit("numeric" if numeric else "text").alias("kind"), F.col("n").alias("row_count"),
                             (F.col("n") - F.col(f"c{i}")).alias("nulls"), F.col(f"a{i}").alias("least"), F.col(f"z{i}").alias("most"),
                             F.col(f"ta{i}").alias("least_text"), F.col(f"tz{i}").alias("most_text"), F.col(f"h{i}").alias("sketch")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def merge(profiles: DataFrame) -> DataFrame:
    """One profile from the rows of any number of profiles of the same columns."""
    return profiles.groupBy("column_name", "kind").agg(
        F.sum("row_count").alias("row_count"), F.sum("nulls").alias("nulls"), F.min("least").alias("least"), F.max("most").alias("most"),
        F.min("least_text").alias("least_text"), F.max("most_text").alias("most_text"), F.hll_union_agg("sketch").alias("sketch"))


def groupable(merged: DataFrame, data: DataFrame, limit: int = 50) -> DataFrame:
    """PRF-5 from a stored profile: columns with fewer than ``limit`` distinct values, the exact number where the data was
    read again (only columns whose estimate is near the limit), else the estimate: ``column_name, distinct_values, exact``."""
    guesses = merged.select("column_name", F.hll_sketch_estimate("sketch").alias("d")).collect()  # a row a column
    near = sorted(r.column_name for r in guesses if abs(r.d - limit) <= NEAR * limit)
    sure = {r.column_name: (int(r.d), False) for r in guesses if r.column_name not in near}
    if near:
        row = data.agg(*[F.count_distinct(F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`")) if is_numeric(data, c) else F.col(f"`{c}`")).alias(f"d{i}")
                         for i, c in enumerate(near)]).first()
        sure |= {c: (row[i], True) for i, c in enumerate(near)}
    rows = [(c, n, exact) for c, (n, exact) in sorted(sure.items()) if n < limit]
    return data.sparkSession.createDataFrame(rows, "column_name string, distinct_values long, exact boolean")

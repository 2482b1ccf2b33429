"""Category encoding (PRJ-5) with a distributed dictionary.

The dictionary is a table ``(feature, value, code)``: codes are the places of a
column's distinct values in sorted order. It is ranked by ranges, never
collected, and joined to encode, so a column of very many values (names,
addresses) costs a join, not driver memory. A small one is broadcast by its
measured size. The models and the ``encode_categories`` query share it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.partitioning import materialize
from ..functions.ranking import running_counts

MISSING = "nan"


def category(c: Column) -> Column:
    """Category as text; missing reads as the text 'nan' (as the reference encodes it)."""
    return F.coalesce(c.cast("string"), F.lit(MISSING))


def fit_dictionary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(feature, value, code)`` for every distinct value of each column."""
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "feature string, value string, code bigint")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), category(F.col(c)).alias("value")) for c in cols]))
    distinct = df.select(pairs.alias("s")).select("s.*").distinct().withColumn("cnt", F.lit(1).cast("bigint"))
    return materialize(running_counts(distinct, ["feature"], "value")
                       .select("feature", "value", F.col("before").cast("bigint").alias("code")))


def encode(dictionary: DataFrame, df: DataFrame, cols: Sequence[str], suffix: str = "_code") -> DataFrame:
    """Add each column's code; a value that the dictionary does not have gets -1."""
    out = df
    for i, c in enumerate(cols):
        codes = dictionary.where(F.col("feature") == c).select(F.col("value").alias(f"__v{i}"), F.col("code").alias(c + suffix))
        out = out.join(codes, category(F.col(c)) == F.col(f"__v{i}"), "left").drop(f"__v{i}")
    return out.withColumns({c + suffix: F.coalesce(F.col(c + suffix), F.lit(-1)).cast("bigint") for c in cols}) if cols else out

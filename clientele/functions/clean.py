"""Scalar cleaning columns (PRJ-1..13). All return native Column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)
STRING_TYPES = (T.StringType, T.VarcharType, T.CharType)

# Identifier and label columns left out of model features.
ID_COLUMNS = ("customerid", "customer_id", "id")
LABEL_COLUMNS = ("churn",)


def strip(c: Column) -> Column:
    """Python's str.strip(): Unicode white space plus the separators U+001C..U+001F."""
    return F.regexp_replace(c, r"(?U)^[\s\x{1c}-\x{1f}]+|[\s\x{1c}-\x{1f}]+$", "")


def col_or(df: DataFrame, name: str, default) -> Column:
    """Column ``name`` if present (NaN read as NULL), else a literal default."""
    if name in df.columns:
        return nan_to_null(df, name)
    return F.lit(default)


def nan_to_null(df: DataFrame, name: str) -> Column:
    """Pandas compares NaN as false; SQL compares NaN as the largest value.
    Reading NaN as NULL makes every rule fall through to its ELSE as in pandas."""
    c = F.col(name)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c)
    return c


def total(df: DataFrame, name: str, scale: int | None = None, where: Column | None = None) -> Column:
    """Sum of a column as double, 0 without values. Decimals add up exactly;
    doubles too if the caller states their decimal places as ``scale``."""
    c = nan_to_null(df, name) if is_numeric(df, name) else F.col(name).try_cast("double")
    if scale is not None:
        c = c.try_cast(f"decimal(38,{scale})")
    if where is not None:
        c = F.when(where, c)
    return F.coalesce(F.sum(c).cast("double"), F.lit(0.0))


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, NUMERIC_TYPES)


def is_string(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, STRING_TYPES)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """PRJ-13: numeric columns in schema order."""
    ex = {e.lower() for e in exclude}
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_TYPES) and f.name.lower() not in ex]


def string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = {e.lower() for e in exclude}
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, STRING_TYPES) and f.name.lower() not in ex]


def to_number(c: Column | str) -> Column:
    """PRJ-1: bad or missing number -> 0 (text is stripped first; NaN -> 0)."""
    c = F.col(c) if isinstance(c, str) else c
    text = strip(c.cast("string"))
    # plain decimal numbers only: Java also reads suffixes such as "1d"
    v = F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text).try_cast("double")
    v = F.when(v.isin(float("inf"), float("-inf")), None).otherwise(v)
    return F.coalesce(F.nanvl(v, F.lit(None).cast("double")), F.lit(0.0))


def clean_numbers(df: DataFrame, cols: Sequence[str] = ("TotalCharges", "MonthlyCharges", "Tenure", "tenure")) -> DataFrame:
    """PRJ-1 over the usual charge/tenure columns that are present."""
    out = {}
    for c in cols:
        if c not in df.columns:
            continue
        if is_numeric(df, c):
            out[c] = F.coalesce(nan_to_null(df, c).cast("double"), F.lit(0.0))
        else:
            out[c] = to_number(c)
    return df.withColumns(out)


def churn_flag(df: DataFrame, col: str = "Churn") -> Column:
    """PRJ-2: Yes/TRUE/1 -> 1, No/FALSE/0 -> 0, anything else -> 0 (exact spelling)."""
    dt = df.schema[col].dataType
    c = F.col(col)
    if isinstance(dt, T.BooleanType):
        return F.coalesce(c.cast("int"), F.lit(0))
    if isinstance(dt, NUMERIC_TYPES):
        return F.when(c == 1, 1).otherwise(0)
    return F.when(c.isin("Yes", "TRUE", "1"), 1).otherwise(0)


# Ordinal codes of the spending score.
SPENDING_ORDINAL = {"Low": 1, "Average": 2, "High": 3}


def spending_ordinal(df: DataFrame, col: str = "Spending_Score") -> Column:
    """PRJ-3: Low/Average/High -> 1/2/3, unknown or missing -> 1; numbers pass through."""
    c = F.col(col)
    if is_numeric(df, col):
        return nan_to_null(df, col).cast("double")
    e = F.when(c == "Low", 1.0).when(c == "Average", 2.0).when(c == "High", 3.0).otherwise(1.0)
    return e


def feature_columns(df: DataFrame, drop: Iterable[str] = ()) -> list[str]:
    """PRJ-4: all columns but ids and labels, case-insensitively."""
    ex = {d.lower() for d in (*ID_COLUMNS, *LABEL_COLUMNS, *drop)}
    return [c for c in df.columns if c.lower() not in ex]


def align_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """PRJ-6: select a stored feature list in order; absent features read 0."""
    out = [F.col(k) for k in keep]
    for f in features:
        out.append(F.col(f) if f in df.columns else F.lit(0.0).alias(f))
    return df.select(*out)


def risk_band(p: Column | str) -> Column:
    """PRJ-7: right-closed bands (-0.1,0.4] Low, (0.4,0.7] Medium, (0.7,1.1] High."""
    p = F.col(p) if isinstance(p, str) else p
    return (F.when((p > -0.1) & (p <= 0.4), "Low").when((p > 0.4) & (p <= 0.7), "Medium")
             .when((p > 0.7) & (p <= 1.1), "High"))


def clean_text(c: Column | str) -> Column:
    """PRJ-8: NULL -> ''; lower case; keep only a-z and white space."""
    c = F.col(c) if isinstance(c, str) else c
    # Python's Unicode \s also holds the separators U+001C..U+001F; Java's does not.
    return F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), r"(?U)[^a-z\s\x{1c}-\x{1f}]+", "")


def is_blank(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    # as ``strip(c) == ""``, but ends at the first character that stays
    return c.isNull() | ~c.cast("string").rlike(r"(?U)[^\s\x{1c}-\x{1f}]")


def sentiment_label(score: Column | str) -> Column:
    """PRJ-9: >= 0.05 Positive, <= -0.05 Negative, else Neutral."""
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s >= 0.05, "Positive").when(s <= -0.05, "Negative").otherwise("Neutral")

"""Recency / frequency / monetary aggregation (AGG-1, JOIN-7, AGG-4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clean import total
from ..functions.ranking import exact_quantiles


def rfm(tx: DataFrame, customer: str = "CustomerID", date: str = "InvoiceDate",
        amount: str = "TotalAmount", scale: int | None = None) -> DataFrame:
    """Per customer: Recency (whole days from last purchase to max date + 1 day),
    Frequency (rows) and Monetary (sum of amount; missing and NaN amounts add 0).

    Amounts are summed in their own type. ``scale`` states the decimal places
    that all amounts have: then the sum is exact, whatever the order.

    One hash aggregate on the customer key (partial + final, so a customer with
    a third of all rows costs one partial row per map task). The snapshot is a
    scalar subquery: computed once, then a literal in the projection.
    """
    ts = F.col(date).cast("timestamp_ntz") if dict(tx.dtypes)[date] == "string" else F.col(date)
    snap = tx.select(F.max(ts)).scalar() + F.expr("INTERVAL 1 DAY")
    agg = (tx.where(F.col(customer).isNotNull())
             .groupBy(customer)
             .agg(F.max(ts).alias("__last"),
                  F.count(F.lit(1)).alias("Frequency"),
                  total(tx, amount, scale).alias("Monetary")))
    # whole days of the difference (24-hour units, as pandas' Timedelta.days);
    # interval arithmetic on the values themselves, so no session time zone enters
    days = F.extract(F.lit("DAY"), snap - F.col("__last")).cast("bigint")
    return agg.select(customer, days.alias("Recency"), "Frequency", "Monetary")


def monetary_quartiles(rfm_df: DataFrame, col: str = "Monetary") -> DataFrame:
    """AGG-4: exact 25th and 75th percentiles (linear interpolation)."""
    return exact_quantiles(rfm_df, col, [0.25, 0.75], names=["q1", "q3"])

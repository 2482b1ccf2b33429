"""One-row results used as values in other queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_values(one_row: DataFrame, cols: list[str] | None = None) -> dict[str, Column]:
    """Columns of a one-row DataFrame as values usable in any expression.

    All of them come from a single struct-valued scalar subquery, so the
    one-row plan runs once however many values are used (a subquery per
    column would re-run it per column). No join, no cross product.
    """
    cols = list(cols or one_row.columns)
    s = one_row.select(F.struct(*[F.col(c) for c in cols])).scalar()
    return {c: s[c] for c in cols}

"""Queries: table profiling."""

from __future__ import annotations

from functools import reduce

from ..functions.clean import clean_numbers
from ..operators.profile import capability_report, column_domains, groupable_columns, readiness_report
from ..sources import fixtures as fx
from .registry import query

PROFILED = {"churn_customers": fx.churn_customers, "demographics": fx.demographics,
            "transactions": fx.transactions, "reviews": fx.reviews, "routes": fx.routes}


def _union(parts):
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("readiness_report")
def q_readiness_report(spark, sf_dir):
    return _union([readiness_report(fn(spark, sf_dir), name) for name, fn in PROFILED.items()])


@query("capability_report")
def q_capability_report(spark, sf_dir):
    return _union([capability_report(fn(spark, sf_dir), name) for name, fn in PROFILED.items()])


@query("groupable_columns")
def q_groupable_columns(spark, sf_dir):
    return _union([groupable_columns(fx.reviews(spark, sf_dir), "reviews", exclude=["ReviewBody"]),
                   groupable_columns(fx.churn_customers(spark, sf_dir), "churn_customers")])


@query("column_domains")
def q_column_domains(spark, sf_dir):
    c = clean_numbers(fx.churn_customers(spark, sf_dir))
    return column_domains(c, ["Tenure", "MonthlyCharges", "TotalCharges"], ["Segment", "Contract", "Support"])

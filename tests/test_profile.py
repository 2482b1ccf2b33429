"""Profiling rules (PRF-1..7): name matching is metadata, measures are data."""

from pyspark.sql import functions as F

from clientele.operators.profile import (capability_report, column_domains, evaluate_capabilities,
                                         evaluate_readiness, groupable_columns, readiness_report)


def test_patterns_and_types():
    cols = [("customer_id", "numeric"), ("TARGET", "string"), ("tenure_months", "numeric"),
            ("Monthly Charges", "string")]
    rows = {(r["module"], r["standard_column"]): r for r in evaluate_readiness(cols, ["churn"])}
    assert rows[("churn", "Churn")]["source_column"] == "TARGET"  # (?i) applies to every alternative
    assert rows[("churn", "Tenure")]["source_column"] == "tenure_months"
    mc = rows[("churn", "MonthlyCharges")]
    assert mc["source_column"] == "Monthly Charges" and mc["type_ok"] is False
    assert mc["ready"] is False and mc["module_ready"] is False
    assert {r["module"] for r in evaluate_readiness(cols, ["churn"])} == {"churn", "role"}


def test_last_ready_flavour_wins():
    cols = [("Age", "numeric"), ("Profession", "string"), ("CustomerID", "numeric"),
            ("InvoiceDate", "datetime"), ("TotalAmount", "numeric"), ("Spending_Score", "string")]
    seg = [r for r in evaluate_readiness(cols) if r["module"] == "segmentation"]
    assert all(r["ready"] and r["module_ready"] for r in seg)
    assert {r["chosen_flavor"] for r in seg} == {"rfm"}


def test_first_match_in_schema_order():
    # the amount pattern also matches 'Spending_Score' ('spend'); the first column wins
    cols = [("Age", "numeric"), ("Spending_Score", "string"), ("Profession", "string"),
            ("CustomerID", "numeric"), ("InvoiceDate", "datetime"), ("TotalAmount", "numeric")]
    rfm = {r["standard_column"]: r for r in evaluate_readiness(cols) if r["flavor"] == "rfm"}
    assert rfm["TotalAmount"]["source_column"] == "Spending_Score" and rfm["TotalAmount"]["type_ok"] is False
    assert {r["chosen_flavor"] for r in rfm.values()} == {"demographic"}


def test_roles():
    cols = [("CustID", "numeric"), ("Review Body", "string"), ("Sales", "numeric"), ("City", "string")]
    roles = {r["flavor"]: r["source_column"] for r in evaluate_readiness(cols) if r["module"] == "role"}
    assert roles["id"] == "CustID" and roles["review_text"] == "Review Body"
    assert roles["location"] == "City" and roles["value_target"] == "Sales" and roles["revenue"] == "Sales"
    assert roles["contract"] is None


def test_capabilities():
    caps = {(r["rule_set"], r["capability"]): r["detected"]
            for r in evaluate_capabilities([("ReviewBody", "string"), ("a", "numeric"), ("b", "numeric"),
                                            ("c", "numeric"), ("d", "numeric"), ("Tenure", "numeric")])}
    assert caps[("substring", "sentiment")] and caps[("exact", "churn")] and caps[("exact", "segmentation")]
    assert not caps[("exact", "sentiment")] and not caps[("substring", "geo")]


def test_measures(spark):
    df = spark.createDataFrame([("Yes", " 3 ", 1.0), (None, "x", None), ("No", None, 2.0)],
                               "Churn string, tenure string, MonthlyCharges double")
    r = {x.standard_column: x for x in readiness_report(df, "t", ["churn"]).collect()}
    assert r["Churn"].rows == 3 and r["Churn"].nulls == 1
    assert r["Tenure"].type_ok is False and r["Tenure"].non_numeric == 1
    assert r["MonthlyCharges"].nulls == 1 and r["MonthlyCharges"].non_numeric == 0
    c = {(x.rule_set, x.capability): x for x in capability_report(df, "t").collect()}
    assert c[("exact", "churn")].evidence_non_null == 2


def test_groupable_and_domains(spark):
    df = spark.createDataFrame([(i, f"g{i % 3}", float(i)) for i in range(200)], "id int, g string, v double")
    got = {r.column_name: r.distinct_values for r in groupable_columns(df, "t").collect()}
    assert got == {"g": 3}
    d = {(r.column_name, r.value): r for r in column_domains(df, ["v"], ["g"]).collect()}
    assert d[("v", None)].slider_max == 199.0 * 1.2
    assert {v for c, v in d if c == "g"} == {"g0", "g1", "g2"} and d[("g", "g1")].distinct_values == 3


def test_domains_have_no_cap(spark):
    df = spark.range(2000).select(F.concat(F.lit("v"), "id").alias("g"))
    out = column_domains(df, [], ["g"])
    assert out.count() == 2000 and out.first().distinct_values == 2000

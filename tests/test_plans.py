"""Plan shape: pushdown, pruning, one exchange, broadcasts, no Python in the hot path."""

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rfm_prunes_and_shuffles_once(spark):
    p = plan(E.queries()["rfm"](spark, SF))
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz>" in p
    assert "PushedFilters: [IsNotNull(o_custkey)]" in p
    assert p.count("Exchange hashpartitioning") == 1
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_no_python_udf(spark):
    for name in ("sentiment_score", "geo_resolve", "geo_fuzzy_ratio", "percentile_profile", "clean_text", "segment_labels"):
        p = plan(E.queries()[name](spark, SF))
        assert "ArrowEvalPython" not in p and "BatchEvalPython" not in p, name


def test_no_cartesian_products(spark):
    """No registered query plans a cross product or a nested loop (those that fit models or write first are tested in test_models)."""
    from clientele.plans import QUERIES
    slow = ("churn_", "value_", "segment_check", "segments", "k_sweep", "topic", "saved_", "scenario_check", "attribution", "sentiment_by_topic",
            "segment_rules", "shapley_check")
    for name, fn in QUERIES.items():
        if name.startswith(slow) and not name.startswith(("churn_flag", "churn_kpis", "churn_headline")):
            continue
        p = plan(fn(spark, SF))
        assert "CartesianProduct" not in p, name
        assert "NestedLoopJoin" not in p, name


def test_sentiment_shares_move_no_text(spark):
    """With broadcasts off, no exchange of the scores holds a text column."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = E.queries()["sentiment_shares"](spark, SF)
        exchanges = [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line or "Project" in line]
        p = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    assert exchanges and "SortMergeJoin" in p
    below = p[p.index("Join"):]
    for project in (line for line in below.splitlines() if "Project [" in line and "__amp" in line):
        columns = project[project.index("["):]
        assert "ReviewBody#" not in columns.split(" AS ")[-1] and "Clean_Text" not in columns


def test_segment_means_broadcast_back(spark):
    p = plan(E.queries()["customer_vs_segment"](spark, SF))
    assert "BroadcastHashJoin" in p

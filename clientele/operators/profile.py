"""Table profiling: which analyses a table fits, and whether its data is
usable (PRF-1..7).

Column names are matched against rules on the driver (schema metadata only);
every data measure (rows, nulls, values that are not numbers, distinct counts,
ranges) is one aggregate pass over the table.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clean import NUMERIC_TYPES, STRING_TYPES

# Readiness rules (module, flavor, standard column, name pattern, expected type).
READINESS_RULES = [
    ("churn", None, "Churn", r"(?i)^churn$|^target$|^exited$", "string"),
    ("churn", None, "Tenure", r"(?i)tenure|months?|duration", "numeric"),
    ("churn", None, "MonthlyCharges", r"(?i)monthly\s*[_.]?(charge|fee|bill|amt)", "numeric"),
    ("segmentation", "demographic", "Age", r"(?i)\bage\b", "numeric"),
    ("segmentation", "demographic", "Spending_Score", r"(?i)spending\s*[_.]?score", None),
    ("segmentation", "demographic", "Profession", r"(?i)profession|job|occupation", "string"),
    ("segmentation", "rfm", "CustomerID", r"(?i)(customer|client|user|account)\s*[_.]?(id|no|code|key)", None),
    ("segmentation", "rfm", "InvoiceDate", r"(?i)(invoice|txn|transaction|purchase)\s*[_.]?date", None),
    ("segmentation", "rfm", "TotalAmount", r"(?i)(total)?\s*[_.]?(amount|amt|price|value|spend|cost)", "numeric"),
    ("sentiment", None, "ReviewText", r"(?i)review|comment|feedback|body|text|content", "string"),
    ("geo", None, "Location",
     r"(?i)route|destination|flight\s*path|country|region|state|city|province|zip|postal", "string"),
]
# Role columns (role, match, keywords, string columns only).
#   match: "exact" lower-case name in keywords; "contains" a keyword inside the
#   lower-case name; "list" first present name in list order.
ROLE_RULES = [
    ("revenue", "exact", ["monthlycharges", "amount", "totalamount", "sales"], False),
    ("id", "contains", ["id", "customer", "cust"], False),
    ("contract", "exact", ["contract", "tenure", "subscription"], False),
    ("spend", "contains", ["monetary", "amount", "sales", "spend", "charge"], False),
    ("review_text", "contains", ["body", "content", "text"], True),
    ("customer_text", "contains", ["review", "comment", "text", "body"], False),
    ("location", "contains", ["location", "route", "city", "country"], False),
    ("map_metric", "contains", ["sentiment_score"], False),
    ("map_metric", "contains", ["churn probability"], False),
    ("map_metric", "contains", ["total", "amount", "sales", "charge"], False),
    ("value_target", "list", ["TotalCharges", "Monetary", "Spend", "Sales", "Amount", "LTV"], False),
]
# Capability keywords, substring rule set (module -> keywords).
CAPABILITY_SUBSTRING = [
    ("sentiment", ["review", "text", "comment", "feedback", "body", "content", "rating", "star"]),
    ("geo", ["lat", "lon", "city", "country", "airport", "location", "route", "destination", "origin"]),
    ("segmentation", ["amount", "sales", "profit", "quantity", "total", "spend", "value", "type", "class"]),
    ("churn", ["churn", "exited", "status", "retention"]),
]
# Capability names, exact rule set (module -> names).
CAPABILITY_EXACT = [
    ("churn", ["churn", "tenure"]),
    ("sentiment", ["review", "comment", "text", "feedback"]),
    ("geo", ["city", "country", "latitude", "longitude", "lat", "lon", "location", "region", "airport"]),
]
NUMERIC_ROUTE_MIN = 3  # more than this many numeric columns routes a table to segmentation


def column_kinds(df: DataFrame) -> list[tuple[str, str]]:
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, NUMERIC_TYPES):
            k = "numeric"
        elif isinstance(f.dataType, STRING_TYPES):
            k = "string"
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            k = "datetime"
        else:
            k = "other"
        out.append((f.name, k))
    return out


def evaluate_readiness(cols: Sequence[tuple[str, str]], modules: Sequence[str] | None = None) -> list[dict]:
    """Rule rows for one table's (name, kind) list; pure metadata. ``modules``
    limits the report to some modules (roles are always included)."""
    rows = []
    for module, flavor, std, pattern, expected in READINESS_RULES:
        if modules is not None and module not in modules:
            continue
        src = next((c for c, _ in cols if re.search(pattern, c)), None)
        kind = dict(cols).get(src)
        type_ok = None if src is None else (expected is None or kind == expected)
        rows.append(dict(module=module, flavor=flavor, standard_column=std, source_column=src,
                         expected_type=expected, actual_type=kind, type_ok=type_ok))
    groups: dict[tuple, list[dict]] = {}
    for r in rows:
        groups.setdefault((r["module"], r["flavor"]), []).append(r)
    ready = {k: all(r["source_column"] is not None and r["type_ok"] for r in v) for k, v in groups.items()}
    chosen: dict[str, str | None] = {}
    for (m, fl), ok in ready.items():
        chosen.setdefault(m, None)
        if ok and fl is not None:
            chosen[m] = fl  # the last ready flavour wins
    for r in rows:
        m = r["module"]
        r["ready"] = ready[(m, r["flavor"])]
        r["module_ready"] = any(ok for (mm, _), ok in ready.items() if mm == m)
        r["chosen_flavor"] = chosen[m]
    for role, match, keys, strings_only in ROLE_RULES:
        cands = [(c, k) for c, k in cols if not strings_only or k == "string"]
        if match == "exact":
            src = next((c for c, _ in cands if c.lower() in keys), None)
        elif match == "contains":
            src = next((c for c, _ in cands if any(k in c.lower() for k in keys)), None)
        else:
            names = {c for c, _ in cands}
            src = next((k for k in keys if k in names), None)
        rows.append(dict(module="role", flavor=role, standard_column=role, source_column=src,
                         expected_type=None, actual_type=dict(cols).get(src), type_ok=None if src is None else True,
                         ready=src is not None,
                         module_ready=src is not None, chosen_flavor=None))
    return rows


def _lit_struct(d: dict, schema: list[tuple[str, str]]):
    return [F.lit(d[k]).cast(t).alias(k) for k, t in schema]


_REPORT_META = [("module", "string"), ("flavor", "string"), ("standard_column", "string"),
                ("source_column", "string"), ("expected_type", "string"), ("actual_type", "string"), ("type_ok", "boolean"),
                ("ready", "boolean"), ("module_ready", "boolean"), ("chosen_flavor", "string")]


def readiness_report(df: DataFrame, table_name: str, modules: Sequence[str] | None = None) -> DataFrame:
    """PRF-1, PRF-2, PRF-7: one row per rule and role, with data measures of the
    matched column (rows, nulls, non-null values that do not read as numbers)."""
    rows = evaluate_readiness(column_kinds(df), modules)
    used = sorted({r["source_column"] for r in rows if r["source_column"]})
    numeric = {r["source_column"] for r in rows if r["source_column"] and r["expected_type"] == "numeric"}
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(used):
        col = F.col(c)
        aggs.append(F.count_if(col.isNull()).alias(f"__n{i}"))
        if c in numeric:
            aggs.append(F.count_if(col.isNotNull() & F.trim(col.cast("string")).try_cast("double").isNull())
                        .alias(f"__b{i}"))
    m = df.agg(*aggs)
    structs = []
    for r in rows:
        i = used.index(r["source_column"]) if r["source_column"] else None
        nulls = F.col(f"__n{i}") if i is not None else F.lit(None).cast("bigint")
        bad = F.col(f"__b{i}") if i is not None and r["expected_type"] == "numeric" else F.lit(None).cast("bigint")
        structs.append(F.struct(F.lit(table_name).alias("table_name"), *_lit_struct(r, _REPORT_META),
                                F.col("__rows").alias("rows"), nulls.alias("nulls"), bad.alias("non_numeric")))
    return m.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def evaluate_capabilities(cols: Sequence[tuple[str, str]]) -> list[dict]:
    names = [c for c, _ in cols]
    out = []
    for cap, keys in CAPABILITY_SUBSTRING:
        src = next((c for c in names if any(k in c.lower() for k in keys)), None)
        out.append(dict(rule_set="substring", capability=cap, detected=src is not None, evidence_column=src))
    for cap, keys in CAPABILITY_EXACT:
        src = next((c for c in names if c.lower() in keys), None)
        out.append(dict(rule_set="exact", capability=cap, detected=src is not None, evidence_column=src))
    nums = [c for c, k in cols if k == "numeric"]
    out.append(dict(rule_set="exact", capability="segmentation", detected=len(nums) > NUMERIC_ROUTE_MIN,
                    evidence_column=None))
    return out


def capability_report(df: DataFrame, table_name: str) -> DataFrame:
    """PRF-3, PRF-4: capabilities by column-name rules, with the non-null count
    of the evidence column."""
    rows = evaluate_capabilities(column_kinds(df))
    used = sorted({r["evidence_column"] for r in rows if r["evidence_column"]})
    m = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(F.col(c)).alias(f"__v{i}") for i, c in enumerate(used)])
    structs = []
    for r in rows:
        i = used.index(r["evidence_column"]) if r["evidence_column"] else None
        v = F.col(f"__v{i}") if i is not None else F.lit(None).cast("bigint")
        structs.append(F.struct(F.lit(table_name).alias("table_name"), F.lit(r["rule_set"]).alias("rule_set"),
                                F.lit(r["capability"]).alias("capability"), F.lit(r["detected"]).alias("detected"),
                                F.lit(r["evidence_column"]).cast("string").alias("evidence_column"),
                                F.col("__rows").alias("rows"), v.alias("evidence_non_null")))
    return m.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def groupable_columns(df: DataFrame, table_name: str, exclude: Sequence[str] = (), limit: int = 50) -> DataFrame:
    """PRF-5: columns with fewer than ``limit`` distinct non-null values.

    One HyperLogLog pass (5 % relative error) prunes the high-cardinality
    columns: a column under ``limit`` reads far below the ``2 x limit`` cut, so
    no candidate is lost. Only the survivors (whose distinct sets are small by
    construction) get an exact count.
    """
    cols = [c for c in df.columns if c not in set(exclude)]
    approx = df.agg(*[F.approx_count_distinct(c, 0.05).alias(c) for c in cols]).first()
    cand = [c for c in cols if approx[c] < 2 * limit]
    if not cand:
        return df.sparkSession.createDataFrame([], "table_name string, column_name string, distinct_values bigint")
    exact = df.agg(*[F.count_distinct(c).alias(c) for c in cand])
    structs = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("distinct_values")) for c in cand]
    out = exact.select(F.explode(F.array(*structs)).alias("s")).select("s.*")
    return out.where(F.col("distinct_values") < limit).select(F.lit(table_name).alias("table_name"), "*")


def column_domains(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """PRF-6: per numeric column min, max and max x 1.2 (slider range); per
    categorical column a row for each distinct value, with their number."""
    parts = []
    if numeric:
        m = df.agg(*[F.min(F.col(c).cast("double")).alias(f"__mn{i}") for i, c in enumerate(numeric)],
                   *[F.max(F.col(c).cast("double")).alias(f"__mx{i}") for i, c in enumerate(numeric)])
        structs = [F.struct(F.lit(c).alias("column_name"), F.lit("numeric").alias("kind"),
                            F.col(f"__mn{i}").alias("min_value"), F.col(f"__mx{i}").alias("max_value"),
                            (F.col(f"__mx{i}") * 1.2).alias("slider_max"),
                            F.lit(None).cast("bigint").alias("distinct_values"),
                            F.lit(None).cast("string").alias("value"))
                   for i, c in enumerate(numeric)]
        parts.append(m.select(F.explode(F.array(*structs)).alias("s")).select("s.*"))
    if categorical:
        long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"),
                                                      F.col(c).cast("string").alias("v"))
                                             for c in categorical])).alias("s")).select("s.*")
        d = long.where(F.col("v").isNotNull()).distinct()
        n = d.groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct_values"))
        # n has a row for each column that was named
        cat = d.join(F.broadcast(n), "column_name").select(
            "column_name", F.lit("category").alias("kind"), F.lit(None).cast("double").alias("min_value"),
            F.lit(None).cast("double").alias("max_value"), F.lit(None).cast("double").alias("slider_max"),
            "distinct_values", F.col("v").alias("value"))
        parts.append(cat)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

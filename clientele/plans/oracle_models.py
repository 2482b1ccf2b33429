"""DuckDB twins of ``explain_q``: Shapley values by their definition, a tree level by level, pairwise silhouettes; rounds of topic EM."""

from __future__ import annotations

import itertools
import math

from .oracle import CLEAN_TEXT_SQL, _STOP, register

# The trees of explain_q.FIXED_TREES, stated once more: (feature, threshold, below, above) or a leaf's value.
_T, _M, _S = "t", "m", "s"
TREES = [
    (_T, 60.0, (_M, 40000.0, 0.3, (_T, 30.0, 0.8, 0.5)), (_S, 0.5, 0.2, (_M, 60000.0, -0.4, -0.7))),
    (_M, 50000.0, (_T, 50.0, 0.25, -0.1), -0.3),
]


def _counts(tree, where, name, out):
    """Numbers of customers at every node, as columns."""
    out.append((name, " and ".join(where) or "true"))
    if isinstance(tree, tuple):
        f, t, low, high = tree
        _counts(low, [*where, f"{f} <= {t}"], name + "l", out)
        _counts(high, [*where, f"{f} > {t}"], name + "r", out)


def _value(tree, name, known):
    """The tree's value when the features ``known`` are."""
    if not isinstance(tree, tuple):
        return f"({tree}::double)"
    f, t, low, high = tree
    a, b = _value(low, name + "l", known), _value(high, name + "r", known)
    if f in known:
        return f"(case when {f} <= {t} then {a} else {b} end)"
    return f"(({name}l * {a} + {name}r * {b}) / {name})"


def _shapley_sql() -> str:
    counts = []
    for i, tree in enumerate(TREES):
        _counts(tree, [], f"n{i}", counts)
    v = lambda known: "(" + " + ".join(_value(tree, f"n{i}", known) for i, tree in enumerate(TREES)) + ")"
    parts = []
    for f, label in ((_T, "Tenure"), (_M, "MonthlyCharges"), (_S, "Support")):
        rest = [g for g in (_T, _M, _S) if g != f]
        terms = [f"{math.factorial(len(s)) * math.factorial(2 - len(s))} / 6.0::double * ({v({*s, f})} - {v(set(s))})"
                 for n in range(3) for s in itertools.combinations(rest, n)]
        parts.append(f"select customerID, '{label}' as feature, round({' + '.join(terms)}, 9) as contribution, round({v(set())}, 9) as base_value, "
                     f"round({v({_T, _M, _S})}, 9) as score from x, n")
    columns = ", ".join(f"count_if({w})::double as {c}" for c, w in counts)
    return (f"select * from (with x as (select customerID, Tenure::double as t, MonthlyCharges as m, (Support = 'Yes')::int::double as s from churn_customers), "
            f"n as (select {columns} from x) {' union all '.join(parts)})")


register("shapley_fixed_trees", _shapley_sql(), ["churn_customers"])
register("shapley_check", """select model, count(*) as customers, 0::bigint as features_missing, 0::bigint as wrong_sums, 0::bigint as wrong_scores,
    1::bigint as base_values from churn_customers, (select unnest(['churn', 'value']) as model) group by model""", ["churn_customers"])


def _tree_sql(classes: int, depth: int) -> str:
    cs = range(classes)
    total = lambda p: " + ".join(f"{p}{c}" for c in cs)
    squares = lambda p: " + ".join(f"{p}{c} * {p}{c}" for c in cs)
    steps = ["r0 as (select CustomerID as id, Cluster as y, 1 as node from segments)",
             "l as (select CustomerID as id, unnest([0, 1, 2]) as f, unnest([Recency::double, Frequency::double, Monetary::double]) as v from segments)"]
    for d in range(depth):
        open_ = f"select node from r{d} group by node having count(distinct y) > 1"
        counts = ", ".join(f"count_if(y = {c}) as n{c}" for c in cs)
        run = ", ".join(f"sum(n{c}) over w as l{c}, sum(n{c}) over (partition by node, f) - sum(n{c}) over w as r{c}" for c in cs)
        steps += [f"c{d} as (select node, f, v, {counts} from r{d} join l using (id) where node in ({open_}) group by node, f, v)",
                  f"g{d} as (select node, f, v, lead(v) over w as above, {run} from c{d} window w as (partition by node, f order by v))",
                  f"b{d} as (select node, f, case when (v + above) / 2 >= above then v else (v + above) / 2 end as t from g{d} where above is not null "
                  f"qualify row_number() over (partition by node order by (({squares('l')})::double / ({total('l')})::double + ({squares('r')})::double / ({total('r')})::double) desc, f, v) = 1)",
                  f"r{d + 1} as (select r.id, r.y, case when l.v <= b.t then 2 * r.node else 2 * r.node + 1 end as node "
                  f"from r{d} r join b{d} b using (node) join l on l.id = r.id and l.f = b.f)"]
    sizes = ", ".join(f"count_if(y = {c}) as n{c}" for c in cs)
    top = f"greatest({', '.join(f'n{c}' for c in cs)})"
    first = "case " + " ".join(f"when n{c} = {top} then {c}" for c in cs) + " end"
    levels = []
    for d in range(depth + 1):
        split = (f"left join b{d} b using (node)", "b.f", "b.t") if d < depth else ("", "null::int", "null::double")
        levels.append(f"select node::int as node, {d}::int as depth, case {split[1]} when 0 then 'Recency' when 1 then 'Frequency' when 2 then 'Monetary' end as feature, "
                      f"round({split[2]}, 6) as threshold, ({total('n')})::bigint as rows, "
                      f"round(1.0::double - ({squares('n')})::double / (({total('n')}) * ({total('n')}))::double, 9) as gini, ({first})::int as predicted, "
                      f"round({top}::double / ({total('n')})::double, 9) as purity from (select node, {sizes} from r{d} group by node) {split[0]}")
    return f"select * from (with {', '.join(steps)} {' union all '.join(levels)})"


register("segment_tree", _tree_sql(4, 3), ["segments"])
register("silhouette_exact", """select * from (with z as (select CustomerID as id, Cluster as c,
      (Recency - avg(Recency) over ()) / stddev_samp(Recency) over () as a, (Frequency - avg(Frequency) over ()) / stddev_samp(Frequency) over () as b,
      (Monetary - avg(Monetary) over ()) / stddev_samp(Monetary) over () as m from segments),
    x as (select * from z order by md5(id::varchar), id limit 1000),
    n as (select c, count(*) as size from x group by c),
    d as (select p.id, p.c, q.c as oc, sum(sqrt((p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b) + (p.m - q.m) * (p.m - q.m))) as d from x p, x q group by all),
    s as (select id, max(case when d.c = oc and size > 1 then d / (size - 1) end) as own, min(case when d.c <> oc then d / size end) as other
          from d join n on n.c = d.oc group by id)
  select round(case when (select count(*) from n) >= 2 then avg(coalesce(case when own is null then 0.0 when greatest(own, other) = 0 then 0.0
      else (other - own) / greatest(own, other) end, 0.0)) end, 6) as silhouette, count(*) as rows, (select count(*) from n) as clusters from s)""", ["segments"])


def _topics_sql(k: int, rounds: int, alpha: float, beta: float) -> str:
    ks = range(k)
    steps = [f"""r as (select ReviewID, {CLEAN_TEXT_SQL.format(c='ReviewBody')} as c from reviews where not (ReviewBody is null or trim(ReviewBody) = ''))""",
             r"w as (select ReviewID as doc, unnest(regexp_extract_all(c, '\w\w+')) as term from r where length(c) > 2)",
             f"c0 as (select doc, term, count(*)::double as n from w where term not in {_STOP} group by doc, term)",
             "kept as (select term from c0 group by term having count(*) >= 2 and count(*) <= 0.95 * (select count(*) from r where length(c) > 2))",
             "c as (select * from c0 where term in (select term from kept))",
             f"s0 as (select term, {', '.join(f'0.5::double + (' + chr(39) + '0x' + chr(39) + f' || substr(md5(term || {chr(39)}:{j}{chr(39)}), 1, 4))::int / 65536.0::double as w{j}' for j in ks)} from kept)",
             f"q0 as (select distinct doc, {', '.join(f'1.0::double / {k} as q{j}' for j in ks)} from c)"]
    for r in range(rounds):
        p = ", ".join(f"(w{j} + {beta}::double) / ((select sum(w{j}) from s{r}) + (select count(*) from s{r}) * {beta}::double) as p{j}" for j in ks)
        steps += [f"p{r} as materialized (select term, {p} from s{r})",
                  f"x{r} as materialized (select doc, term, n, {', '.join(f'p{j} * q{j} as x{j}' for j in ks)} from c join p{r} using (term) join q{r} using (doc))",
                  f"z{r} as materialized (select doc, term, n, {' + '.join(f'x{j}' for j in ks)} as s, {', '.join(f'x{j}' for j in ks)} from x{r})",
                  f"s{r + 1} as materialized (select term, {', '.join(f'sum(n * x{j} / s) as w{j}' for j in ks)} from z{r} group by term)",
                  f"q{r + 1} as materialized (select doc, {', '.join(f'(sum(n * x{j} / s) + {alpha}::double) / (sum(n) + {k} * {alpha}::double) as q{j}' for j in ks)} from z{r} group by doc)",
                  f"t{r} as (select {r} as round, (select sum(n * ln(s)) from z{r}) + {beta}::double * (select sum({' + '.join(f'ln(p{j})' for j in ks)}) from p{r})"
                  f" + {alpha}::double * (select sum({' + '.join(f'ln(q{j})' for j in ks)}) from q{r}) as v)"]
    p = ", ".join(f"(w{j} + {beta}::double) / ((select sum(w{j}) from s{rounds}) + (select count(*) from s{rounds}) * {beta}::double) as p{j}" for j in ks)
    steps += [f"p{rounds} as (select term, {p} from s{rounds})"]
    return ", ".join(steps)


_EM = _topics_sql(3, 3, 0.1, 0.01)
register("topic_em_trace", f"""select * from (with {_EM} select round::int as round, round(v, 3) as log_posterior, false as fell
  from (select * from t0 union all select * from t1 union all select * from t2))""", ["reviews"])
register("topic_em_terms", f"""select * from (with {_EM} select topic, cast(rank as int) as rank, term, round(weight, 9) as weight from (
    select *, row_number() over (partition by topic order by weight desc, term) as rank
    from ({' union all '.join(f"select 'Topic {j + 1}' as topic, term, p{j} as weight from p3" for j in range(3))})) where rank <= 10)""", ["reviews"])

register("quarantined_records", """select format, count_if(customerID % 10 <> 0)::bigint as good, sum(case when customerID % 10 <> 0 then Tenure end)::bigint as tenure,
    sum(case when customerID % 10 <> 0 then customerID end)::bigint as ids, count_if(customerID % 10 = 0)::bigint as quarantined
  from churn_customers, (select unnest(['csv', 'json']) as format) group by format""", ["churn_customers"])
register("resolution_store", """select h.city, h.key, h.match_tier, g.lat, g.lon
  from (select * from t1 union all select * from t2 union all select * from t3) h join gaz g on h.key = g.key""", ["t3"])
_COLUMNS = {"customerID": "n", "Segment": "t", "Contract": "t", "Support": "t", "Tenure": "n", "MonthlyCharges": "n", "TotalCharges": "t", "Churn": "t"}
register("merged_profile", " union all ".join(
    f"""select '{c}' as column_name, count(*) as row_count, (count(*) - count({c}))::bigint as nulls, {f'min({c})::double' if k == 'n' else 'null::double'} as least,
    {f'max({c})::double' if k == 'n' else 'null::double'} as most, {f'min({c})' if k == 't' else 'null::varchar'} as least_text,
    {f'max({c})' if k == 't' else 'null::varchar'} as most_text, case when count(distinct {c}) <= 20 then count(distinct {c}) end as distinct_values from churn_customers"""
    for c, k in _COLUMNS.items()), ["churn_customers"])

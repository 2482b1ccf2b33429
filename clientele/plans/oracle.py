"""DuckDB twins of the registered queries (used only by the correctness check).

Derived inputs are spelled as CTEs over the driver's tables; ``sql(name)``
prefixes a query body with the CTEs it names.
"""

from __future__ import annotations

from ..sources.dimensions import gazetteer_rows, iata_rows
from .expected import BOOSTERS_DOWN, BOOSTERS_UP, CAPABILITIES, EMOTICONS, LEXICON_EXTRAS, NEGATORS, READINESS, STOP_WORDS

# Words as written: by white space, stripped of punctuation, without apostrophes.
TOKENS_SQL = (r"list_filter(list_transform(regexp_split_to_array(regexp_replace({c}, '[''’]', '', 'g'), '\s+'),"
              r" lambda w: case when lower(w) in (" + ", ".join(f"'{e}'" for e in EMOTICONS) + r") then w"
              r" else regexp_replace(w, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g') end), lambda w: w <> '')")
# Derived inputs, DuckDB spelling of clientele.sources.fixtures.
CTES = {
    "transactions": """select o_custkey as CustomerID, o_orderdate as InvoiceDate,
        o_totalprice as TotalAmount from orders""",
    "churn_customers": """select c_custkey as customerID, c_mktsegment as Segment,
        case when c_custkey % 3 = 0 then 'Month-to-month' when c_custkey % 3 = 1 then 'One year' else 'Two year' end as Contract,
        case when c_custkey % 4 = 0 then 'No' else 'Yes' end as Support,
        cast(tenure as bigint) as Tenure,
        floor(m*100/greatest(tenure,1))/100 as MonthlyCharges,
        case when c_custkey % 97 = 0 then ' ' else cast(cast(m as decimal(18,2)) as varchar) end as TotalCharges,
        case when l < mx - interval '180' day then 'Yes' else 'No' end as Churn
      from customer join (
        select t.*, g.mx, (year(l)-year(f))*12 + month(l)-month(f) as tenure
        from (select o_custkey, min(o_orderdate) f, max(o_orderdate) l,
                     cast(sum(cast(o_totalprice as decimal(18,2))) as double) m
              from orders group by o_custkey) t,
             (select max(o_orderdate) mx from orders) g) u on c_custkey = o_custkey""",
    "demographics": """select c_custkey as CustomerID, cast(18 + (c_custkey*7) % 60 as bigint) as Age,
        case when c_acctbal<2000 then 'Low' when c_acctbal<6000 then 'Average'
             when c_acctbal<9500 then 'High' else 'Other' end as Spending_Score,
        cast(1 + c_custkey % 6 as bigint) as Family_Size, c_mktsegment as Profession
      from customer""",
    "reviews": "select doc_id as ReviewID, text as ReviewBody, lang, source from documents",
    "routes": """select o_orderkey as TripID, o_custkey as CustomerID, o_totalprice as Amount,
        cast(1 + o_orderkey % 5 as bigint) as OverallRating,
        case o_orderkey % 15 when 0 then 'London to Paris' when 1 then 'LHR'
          when 2 then substr('manchester', 1, (o_orderkey // 15 % 10)::int) || substr('manchester', (o_orderkey // 15 % 10)::int + 2)
          when 3 then 'Manchester Airport' when 4 then 'New York City' when 5 then 'Zürich'
          when 6 then 'Sao Paulo' when 7 then '' when 8 then null when 9 then 'Atlantis ' || (o_orderkey // 15)::varchar
          when 10 then 'St Lucia via Barbados' when 11 then 'Orlando, Florida'
          when 12 then 'Leeds (LBA)' when 13 then 'Rome-Milan' else 'Greater Dublin Area ' || (o_orderkey // 15 % 1000)::varchar end as Route
      from orders""",
    "test_lexicon": f"""select w as token, cast(length(w)*7 % 9 - 4 as double) as valence
      from (select w, count(*) n from (select lower(unnest({TOKENS_SQL.format(c='text')})) w from documents)
            where length(w) > 3 group by w having count(*) >= 20)
      where length(w)*7 % 9 - 4 <> 0
      union all select * from (values {", ".join(f"('{t}', {v}::double)" for t, v in LEXICON_EXTRAS.items())})""",
    "rule_score": """select customerID, Tenure, MonthlyCharges,
        cast(1 as double)/(cast(1 as double) + cast(Tenure as double)/cast(12 as double)) as probability
      from churn_customers""",
    "rfm": """select CustomerID,
        date_sub('day', max(InvoiceDate), (select max(InvoiceDate) from transactions) + interval 1 day) as Recency,
        count(*) as Frequency,
        cast(sum(cast(TotalAmount as decimal(18,2))) as double) as Monetary
      from transactions where CustomerID is not null group by CustomerID""",
}
# CTE dependencies (emitted before their users).
DEPS = {"rule_score": ["churn_customers"], "rfm": ["transactions"]}


def _with(names: list[str]) -> str:
    order: list[str] = []

    def visit(n):
        for d in DEPS.get(n, []):
            visit(d)
        if n not in order:
            order.append(n)
    for n in names:
        visit(n)
    if not order:
        return ""
    return "with " + ",\n".join(f"{n} as ({CTES[n]})" for n in order) + "\n"


def quantile_sql(src: str, col: str, probs: dict[str, float]) -> str:
    """Linear-interpolation quantiles of ``col`` over ``src`` (rows with col not null)."""
    sel = []
    for name, p in probs.items():
        pos = f"({p}*(n-1))"
        lo = f"max(case when i = floor{pos} then v end)"
        hi = f"max(case when i = ceil{pos} then v end)"
        sel.append(f"{lo} + ({hi} - {lo}) * max({pos} - floor{pos}) as {name}")
    return (f"select {', '.join(sel)} from (select cast({col} as double) v, "
            f"row_number() over (order by {col}) - 1 as i, count(*) over () as n "
            f"from {src} where {col} is not null)")


ORACLE: dict[str, str] = {}


def register(name: str, body: str, ctes: list[str] | None = None) -> None:
    ORACLE[name] = _with(ctes or []) + body


register("load_tables", " union all ".join(
    f"select '{t}' as table_name, count(*) as n_rows from {t}" for t in
    ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
     "documents", "embeddings", "pages", "benchmark", "labels", "conversations")))
register("standardise_columns", """select o_orderkey, o_custkey as CustomerID, o_orderstatus,
    o_totalprice as TotalAmount, o_orderdate as InvoiceDate, o_orderpriority from orders""")
register("rfm", "select * from rfm", ["rfm"])
register("monetary_quartiles", quantile_sql("rfm", "Monetary", {"q1": 0.25, "q3": 0.75}), ["rfm"])
register("persona_rfm", """select *,
    case when Recency < 30 and Monetary > 2500000.0 then 'Champion'
         when Recency > 90 and Monetary > 2500000.0 then 'At-Risk Whale'
         when Recency < 30 then 'New/Active' when Recency > 90 then 'Hibernating' else 'Standard' end as Persona,
    case when Recency < 30 and Monetary > 2500000.0 then 'Reward'
         when Recency > 90 and Monetary > 2500000.0 then 'Win-Back'
         when Recency < 30 then 'Nurture' when Recency > 90 then 'Re-engage' else 'Maintain' end as Strategy,
    case when Recency < 30 and Monetary > 2500000.0 then 'VIP Tier Upgrade'
         when Recency > 90 and Monetary > 2500000.0 then 'Personal Call + Gift'
         when Recency < 30 then 'Cross-sell Recommendation' when Recency > 90 then 'Automated Drip Campaign'
         else 'Weekly Update' end as Next_Best_Action
  from rfm""", ["rfm"])

# ---- cleaning and rule personas -------------------------------------------------
register("clean_charges", """select customerID,
    coalesce(cast(Tenure as double), 0) as Tenure, coalesce(cast(MonthlyCharges as double), 0) as MonthlyCharges,
    coalesce(try_cast(trim(TotalCharges) as double), 0) as TotalCharges from churn_customers""", ["churn_customers"])
register("churn_flag", """select customerID, Churn,
    case when Churn in ('Yes', 'TRUE', '1') then 1 else 0 end as churn_flag from churn_customers""", ["churn_customers"])
register("spending_ordinal", """select CustomerID, Spending_Score,
    cast(case Spending_Score when 'Low' then 1 when 'Average' then 2 when 'High' then 3 else 1 end as double)
      as Spending_Score_Num from demographics""", ["demographics"])
register("encode_categories", """select customerID,
    dense_rank() over (order by coalesce(Segment, 'nan')) - 1 as Segment,
    dense_rank() over (order by coalesce(Contract, 'nan')) - 1 as Contract,
    dense_rank() over (order by coalesce(Support, 'nan')) - 1 as Support
  from churn_customers""", ["churn_customers"])
register("align_features", """select customerID,
    coalesce(cast(Tenure as double), 0) as Tenure, coalesce(cast(MonthlyCharges as double), 0) as MonthlyCharges,
    coalesce(try_cast(trim(TotalCharges) as double), 0) as TotalCharges, cast(0 as double) as Discount
  from churn_customers""", ["churn_customers"])
register("risk_band", """select customerID, probability,
    case when probability > -0.1 and probability <= 0.4 then 'Low'
         when probability > 0.4 and probability <= 0.7 then 'Medium'
         when probability > 0.7 and probability <= 1.1 then 'High' end as Risk_Group
  from rule_score""", ["rule_score"])
CLEAN_TEXT_SQL = r"""regexp_replace(lower(coalesce({c}, '')), '[^a-z\t\n\x0b\f\r \x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]', '', 'g')"""
register("clean_text", f"""select ReviewID,
    case when ReviewBody is null or trim(ReviewBody) = '' then '' else {CLEAN_TEXT_SQL.format(c='ReviewBody')} end
      as Clean_Text from reviews""", ["reviews"])
register("persona_demographic", """select CustomerID, Age, Family_Size, Spending_Score_Num, Persona,
    case when contains(Persona, 'Solo') and contains(Persona, 'Gen Z') then 'Trend & FOMO'
         when contains(Persona, 'Fam') and contains(Persona, 'Saver') then 'Value Bundles'
         when contains(Persona, 'Senior') then 'Trust & Loyalty'
         when contains(Persona, 'Spender') then 'Exclusivity' else 'Standard' end as Strategy,
    case when contains(Persona, 'Solo') and contains(Persona, 'Gen Z') then 'Push: ''Trending Now'''
         when contains(Persona, 'Fam') and contains(Persona, 'Saver') then 'Email: ''Buy 2 Get 1'''
         when contains(Persona, 'Senior') then 'Mail: Loyalty Club'
         when contains(Persona, 'Spender') then 'Invite: VIP Early Access' else 'Newsletter' end as Next_Best_Action
  from (select *, concat_ws(' / ',
          case when Family_Size <= 1.5 then 'Solo' when Family_Size <= 3.5 then 'Small Fam' else 'Large Fam' end,
          case when Age < 30 then 'Gen Z' when Age < 50 then 'Pro' else 'Senior' end,
          case when Spending_Score_Num > 2.5 then 'Spender' when Spending_Score_Num < 1.5 then 'Saver' end) as Persona
        from (select CustomerID, Age, Family_Size,
                cast(case Spending_Score when 'Low' then 1 when 'Average' then 2 when 'High' then 3 else 1 end as double)
                  as Spending_Score_Num from demographics))""", ["demographics"])
register("persona_churn", """select customerID, probability,
    case when probability > 0.8 then 'Flight Risk (Critical)' when probability > 0.5 then 'At Risk'
         when probability < 0.2 then 'Loyalist' else 'Neutral' end as Persona,
    case when probability > 0.8 then 'Immediate Intervention' when probability > 0.5 then 'Value Reinforcement'
         when probability < 0.2 then 'Advocacy' else 'Monitor' end as Strategy,
    case when probability > 0.8 then 'Call: Offer 20% Retention Discount'
         when probability > 0.5 then 'Email: Highlight Premium Features'
         when probability < 0.2 then 'Ask for Referral' else 'No Action' end as Next_Best_Action
  from rule_score""", ["rule_score"])
register("persona_geo", """select Route, Traffic, OverallRating,
    case when Traffic > 50 and OverallRating < 4 then 'High Vol / Low Sat' when Traffic > 50 then 'Flagship Route'
         when Traffic < 10 then 'Niche / Low Volume' else 'Standard Route' end as Persona,
    case when Traffic > 50 and OverallRating < 4 then 'Operational Fix' when Traffic > 50 then 'Maximize Yield'
         when Traffic < 10 then 'Efficiency Check' else 'Growth' end as Strategy,
    case when Traffic > 50 and OverallRating < 4 then 'Audit Ground Staff & Delays'
         when Traffic > 50 then 'Increase Business Class Prices'
         when Traffic < 10 then 'Evaluate Route Profitability' else 'Seasonal Promotion' end as Next_Best_Action
  from (select Route, count(*) as Traffic, round(avg(OverallRating), 6) as OverallRating from routes group by Route)""",
         ["routes"])
register("persona_geo_value", """select Route, Value,
    case when Value > 1000 then 'Power Region' when Value < 0 then 'Detractor Zone' else 'Key Location' end as Persona,
    case when Value > 1000 then 'Logistics Priority' when Value < 0 then 'Quality Control' else 'Maintain' end as Strategy,
    case when Value > 1000 then 'Scale support operations' when Value < 0 then 'Investigate local reviews'
         else 'Monitor Metrics' end as Next_Best_Action
  from (select Route, round(avg(Amount - 150000.0), 6) as Value from routes group by Route)""", ["routes"])
register("segment_heuristic", """select *,
    case when Monetary > 1000 and Recency < 30 then 1 when Recency > 90 then 2 else 3 end as Segment_Id,
    case when Monetary > 1000 and Recency < 30 then 'Champion (Heuristic)' when Recency > 90 then 'Lost (Heuristic)'
         else 'Standard (Heuristic)' end as Segment_Name
  from rfm""", ["rfm"])

# ---- segment statistics, narratives, churn reports, customer views -------------------
CTES["segments"] = """select CustomerID, Recency, Frequency, Monetary,
    case when d0 = least(d0, d1, d2, d3) then 0 when d1 = least(d0, d1, d2, d3) then 1
         when d2 = least(d0, d1, d2, d3) then 2 else 3 end as Cluster
  from (select *, power(rz + 1.0, 2) + power(fz - 1.0, 2) + power(mz - 1.0, 2) as d0,
               power(rz - 1.0, 2) + power(fz + 1.0, 2) + power(mz + 1.0, 2) as d1,
               power(rz, 2) + power(fz, 2) + power(mz, 2) as d2,
               power(rz - 2.0, 2) + power(fz, 2) + power(mz, 2) as d3
        from (select *, (Recency - avg(Recency) over ()) / stddev_samp(Recency) over () as rz,
                     (Frequency - avg(Frequency) over ()) / stddev_samp(Frequency) over () as fz,
                     (Monetary - avg(Monetary) over ()) / stddev_samp(Monetary) over () as mz from rfm))"""
DEPS["segments"] = ["rfm"]
CTES["cleaned"] = """select customerID, Segment, Contract, Support,
    coalesce(cast(Tenure as double), 0) as Tenure, coalesce(cast(MonthlyCharges as double), 0) as MonthlyCharges,
    coalesce(try_cast(trim(TotalCharges) as double), 0) as TotalCharges, Churn from churn_customers"""
DEPS["cleaned"] = ["churn_customers"]
CTES["banded"] = """select *, case when probability > -0.1 and probability <= 0.4 then 'Low'
         when probability > 0.4 and probability <= 0.7 then 'Medium'
         when probability > 0.7 and probability <= 1.1 then 'High' end as Risk_Group from rule_score"""
DEPS["banded"] = ["rule_score"]


def tenths_sql(num: str, den: str) -> str:
    t = f"floor(({num} * 2000 + {den}) / ({den} * 2))"
    return f"(cast(floor({t} / 10) as bigint)::varchar || '.' || (cast({t} as bigint) % 10)::varchar)"


register("nearest_centroid", "select * from segments", ["segments"])
register("segment_profile", """select Cluster, count(*) as size, round(avg(Recency), 6) as Recency,
    round(avg(Frequency), 6) as Frequency, round(avg(Monetary), 6) as Monetary from segments group by Cluster""",
         ["segments"])
register("segment_sizes", """select Cluster, customers, round(customers / sum(customers) over (), 6) as share,
    cast(row_number() over (order by customers desc, Cluster) as integer) as size_rank
  from (select Cluster, count(*) as customers from segments group by Cluster)""", ["segments"])
register("segment_labels", f"""select s.CustomerID, s.Cluster, concat_ws(' ',
      case when p.r < 30 then 'Active' when p.r > 90 then 'Lost' else 'Regular' end,
      case when p.m > q.q3 then 'Whale' when p.m < q.q1 then 'LowVal' else 'MidVal' end) as Cluster_Label
  from segments s join (select Cluster, avg(Recency) r, avg(Monetary) m from segments group by Cluster) p
    on s.Cluster = p.Cluster,
    ({quantile_sql('segments', 'Monetary', {'q1': 0.25, 'q3': 0.75})}) q""", ["segments"])
register("segment_narrative", f"""select Cluster, size, adjectives,
    '**Segment Overview:** This group represents **' || {tenths_sql('size', 'total')} || '%** of your customer base ('
      || size::varchar || ' users). They are predominantly **' || adjectives || '** customers.' as summary,
    case when adjectives = 'budget-conscious' then 'Strategy: Target with bulk discounts, bundles, or seasonal sales.'
         else 'Strategy: Maintain engagement with regular newsletters.' end as action
  from (select Cluster, count(*) as size, (select count(*) from segments) as total,
          case when avg(Monetary) > (select avg(Monetary) from segments) * 1.2 then 'high-value'
               when avg(Monetary) < (select avg(Monetary) from segments) * 0.8 then 'budget-conscious'
               else 'average-spending' end as adjectives
        from segments group by Cluster)""", ["segments"])


def _long_sql(src: str, id_col: str, metrics: list[str], extra: str = "") -> str:
    complete = " and ".join(f"{m} is not null" for m in metrics)
    return " union all ".join(
        f"select {id_col},{extra} '{m}' as metric, cast({m} as double) as value, ({complete}) as complete from {src}"
        for m in metrics)


register("customer_vs_segment", f"""select CustomerID, Cluster, metric, value,
    round(avg(value) over (partition by Cluster, metric), 6) as segment_avg,
    round(avg(value) over (partition by metric), 6) as global_avg
  from ({_long_sql('segments', 'CustomerID', ['Recency', 'Frequency', 'Monetary'], ' Cluster,')})""", ["segments"])
register("percentile_profile", f"""select CustomerID, metric, value,
    round(case when complete then (rank() over (partition by metric, complete order by value)
              + (count(*) over (partition by metric, complete, value) - 1) / 2.0)
              / count(*) over (partition by metric, complete) * 100 else 50.0 end, 6) as percentile
  from ({_long_sql('rfm', 'CustomerID', ['Recency', 'Frequency', 'Monetary'])})""", ["rfm"])
register("customer_index", """select distinct cast(customerID as varchar) as customer_id from churn_customers
  where customerID is not null""", ["churn_customers"])
register("churn_kpis", """select round(avg(probability), 6) as avg_probability,
    cast(count_if(Risk_Group = 'High') as bigint) as high_risk_count,
    round(count_if(Risk_Group = 'High') / count(*), 6) as high_risk_share,
    cast(sum(case when Risk_Group = 'High' then cast(MonthlyCharges as decimal(18,2)) end) as double) as revenue_at_risk
  from banded""", ["banded"])
register("risk_histogram", """select Risk_Group, bin, count(*) as customers, bin / 20 as bin_low, (bin + 1) / 20 as bin_high
  from (select Risk_Group, cast(least(floor(probability * 20), 19) as bigint) as bin from banded)
  group by Risk_Group, bin""", ["banded"])
register("churn_headline", f"""select high_risk, total, round(r, 6) as high_risk_pct,
    case when r > 30 then '⚠️ **Critical Alert:** ' || rt || '% of your customers are High Risk. Immediate retention campaigns required.'
         when r > 15 then '⚠️ **Warning:** Churn risk is elevated (' || rt || '%). Investigate ''Contract'' and ''Support'' issues.'
         else '✅ **Healthy:** Only ' || rt || '% of customers are High Risk. Focus on acquisition.' end as headline
  from (select *, case when total > 0 then high_risk * 100.0 / total else 0.0 end as r,
          case when total > 0 then {tenths_sql('high_risk', 'total')} else '0.0' end as rt
        from (select cast(count_if(Risk_Group = 'High') as bigint) as high_risk, count(Risk_Group) as total from banded))""",
         ["banded"])
register("safest_option", """select feature, option as best_option, round(rate, 6) as churn_rate
  from (select *, count(*) over (partition by feature) as nn,
               row_number() over (partition by feature order by rate, option) as rk
        from (select feature, option, avg(y) as rate from (
                select 'Segment' as feature, Segment as option, y from cc union all
                select 'Contract', Contract, y from cc union all
                select 'Support', Support, y from cc) where option is not null group by feature, option))
  where rk = 1 and nn > 1""".replace(
    "from cc", "from (select *, case when Churn in ('Yes', 'TRUE', '1') then 1 else 0 end as y from churn_customers)"),
    ["churn_customers"])


def _mode_sql(src: str, c: str) -> str:
    return (f"(select v from (select {c} as v, count(*) as n from {src} where {c} is not null group by 1) "
            f"order by n desc, v limit 1)")


register("typical_customer", "select " + ", ".join(
    [f"(select round(q, 6) from ({quantile_sql('cleaned', c, {'q': 0.5})})) as {c}"
     for c in ("Tenure", "MonthlyCharges", "TotalCharges")]
    + [f"{_mode_sql('cleaned', c)} as {c}" for c in ("Segment", "Contract", "Support")]), ["cleaned"])
register("driver_direction", " union all ".join(
    [f"""select {i} as rank, '{c}' as Feature, round(corr({c}, probability), 6) as correlation,
         case when corr({c}, probability) > 0 then 'Increases Risk 🔴' else 'Decreases Risk 🟢' end as Impact
       from (select *, 1.0 / (1.0 + Tenure / 12.0) as probability from cleaned)"""
     for i, c in enumerate(("Tenure", "MonthlyCharges", "TotalCharges"))]
    + ["select 3, 'Contract', cast(null as double), 'Key Risk Driver ⚠️'"]), ["cleaned"])
register("class_balance", """select negatives, positives,
    case when positives > 0 then negatives / positives else 1.0 end as pos_weight
  from (select cast(count_if(y = 0) as bigint) as negatives, cast(count_if(y = 1) as bigint) as positives
        from (select case when Churn in ('Yes', 'TRUE', '1') then 1 else 0 end as y from churn_customers))""",
         ["churn_customers"])

# ---- locations ----------------------------------------------------------------------


def _values(rows, cols):
    def lit(v):
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return repr(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"select * from (values {body}) as t({', '.join(cols)})"


CTES["gaz"] = ("select cast(ord as integer) as ord, key, cast(lat as double) as lat, cast(lon as double) as lon, iso3 "
               f"from ({_values(gazetteer_rows(), ['ord', 'key', 'lat', 'lon', 'iso3'])})")
CTES["iata"] = _values(iata_rows(), ["code", "city"])
_STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_ROUTE = r"(?i)^(.*?)(?:\s+to\s+|-|\s+via\s+)"
_v = _STRIP.format(x="cast(Route as varchar)")
CTES["routes_o"] = f"""select *, case when v is null or v = '' or lower(v) = 'nan' then null
    when regexp_matches(v, '{_ROUTE}') then {_STRIP.format(x=f"regexp_extract(v, '{_ROUTE}', 1)")} else v end as o
  from (select *, {_v} as v from routes)"""
DEPS["routes_o"] = ["routes"]
_w = r"regexp_replace(o, '(?i)\b(airport|intl|international|hub|city|ft|fort)\b', '', 'g')"
_w = rf"regexp_replace({_w}, '\(.*?\)', '', 'g')"
_w = f"regexp_replace({_w}, ',.*', '')"
_w = f"lower({_STRIP.format(x=f'translate({_w}, ' + chr(39) + 'İüãé' + chr(39) + ', ' + chr(39) + 'Iuae' + chr(39) + ')')})"
CTES["cleaned_routes"] = f"""select r.* exclude (v, o), i.iata_city,
    case when i.iata_city is not null then i.iata_city else {_w} end as clean_loc
  from routes_o r left join (select code, lower(city) as iata_city from iata) i
    on length(r.o) = 3 and upper(r.o) = i.code"""
DEPS["cleaned_routes"] = ["routes_o", "iata"]
INITCAP = "array_to_string(list_transform(string_split(lower({x}), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ')"
CTES["dloc"] = "select distinct clean_loc as city from cleaned_routes where clean_loc is not null and clean_loc <> ''"
DEPS["dloc"] = ["cleaned_routes"]
SUBSTRING_SQL = """select city, key from (select d.city, g.key, row_number() over (partition by d.city order by g.ord) rn
  from {src} d join gaz g on contains(d.city, g.key)) where rn = 1"""
FUZZY_SQL = """select city, key, score from (select *, row_number() over (partition by city order by score desc, key desc) rn
  from (select d.city, g.key, 1.0 - levenshtein(d.city, g.key) / greatest(length(d.city), length(g.key)) as score
        from {src} d join gaz g on abs(length(d.city) - length(g.key)) <= 0.25 * greatest(length(d.city), length(g.key))))
  where rn = 1 and score >= 0.75"""
_LCS = ("list_reduce(string_split(city, ''), lambda old, x: list_reduce(range(1, length(key) + 1), lambda acc, j:"
        " list_append(acc, case when x = substr(key, j, 1) then old[j] + 1 else greatest(old[j + 1], acc[j]) end), [0::bigint]),"
        " list_transform(range(0, length(key) + 1), lambda i: 0::bigint))[length(key) + 1]")
# The longest common block of parts of key and city (earliest in the key, then in the city), then left and right of it.
_SAME = "list_max(list_filter(range(0, least(ahi - i, bhi - j) + 1), lambda l: substr(key, i + 1, l) = substr(city, j + 1, l)))"
_BLOCK = ("list_max(flatten(list_transform(range(alo, ahi), lambda i: list_transform(range(blo, bhi), lambda j: "
          "{{'k': " + _SAME + ", 'i': -i, 'j': -j}}))))")
RATIO_SQL = f"""select city, key, score from (select *, row_number() over (partition by city order by score desc, key desc) rn
  from (with recursive pairs as (select city, key, 2.0::double * {_LCS} / (length(city) + length(key)) as most
        from {{src}} d join gaz g on 2.0 * least(length(d.city), length(g.key)) >= 0.75 * (length(d.city) + length(g.key))),
      whole as (select city, key, 0::bigint as alo, length(key)::bigint as ahi, 0::bigint as blo, length(city)::bigint as bhi from pairs where most >= 0.75),
      blocks as (select *, {_BLOCK} as m from whole
        union all
        select *, {_BLOCK} as m from (select city, key, unnest([alo, m.k - m.i]) as alo, unnest([-m.i, ahi]) as ahi,
            unnest([blo, m.k - m.j]) as blo, unnest([-m.j, bhi]) as bhi from blocks where m.k > 0) where alo < ahi and blo < bhi)
      select city, key, 2.0::double * sum(m.k)::double / (length(city) + length(key)) as score from blocks group by city, key))
  where rn = 1 and score >= 0.75"""
CTES["t1"] = "select d.city, g.key, 'exact' as match_tier from dloc d join gaz g on d.city = g.key"
DEPS["t1"] = ["dloc", "gaz"]
CTES["t2"] = SUBSTRING_SQL.format(src="(select * from dloc where city not in (select city from t1))").replace(
    "select city, key from", "select city, key, 'substring' as match_tier from")
DEPS["t2"] = ["t1"]
CTES["t3"] = RATIO_SQL.format(
    src="(select * from dloc where city not in (select city from t1) and city not in (select city from t2))").replace(
    "select city, key, score from", "select city, key, 'fuzzy' as match_tier from")
DEPS["t3"] = ["t2"]
CTES["resolved"] = f"""select c.TripID, c.Route, c.Amount, c.clean_loc, g.lat, g.lon, g.iso3,
    case when h.match_tier is not null then h.match_tier when c.clean_loc is not null and c.clean_loc <> '' then 'none'
    end as match_tier, {INITCAP.format(x='c.clean_loc')} as Mapped_Location
  from cleaned_routes c left join (select * from t1 union all select * from t2 union all select * from t3) h
    on c.clean_loc = h.city left join gaz g on h.key = g.key"""
DEPS["resolved"] = ["t3"]

register("clean_location", f"""select TripID, Route, clean_loc, {INITCAP.format(x='clean_loc')} as Mapped_Location
  from cleaned_routes""", ["cleaned_routes"])
register("geo_iata", "select TripID, Route, iata_city from cleaned_routes", ["cleaned_routes"])
register("geo_exact", """select c.TripID, c.clean_loc, g.key, g.lat, g.lon from cleaned_routes c
  left join gaz g on c.clean_loc = g.key""", ["cleaned_routes", "gaz"])
register("geo_substring", SUBSTRING_SQL.format(src="dloc"), ["dloc", "gaz"])
register("geo_fuzzy", FUZZY_SQL.format(src="dloc").replace("select city, key, score from",
                                                            "select city, key, round(score, 6) as score from"),
         ["dloc", "gaz"])
register("geo_fuzzy_ratio", RATIO_SQL.format(src="dloc").replace("select city, key, score from",
                                                                  "select city, key, round(score, 6) as score from", 1),
         ["dloc", "gaz"])
register("geo_resolve", """select TripID, Route, clean_loc, lat, lon, iso3, match_tier, Mapped_Location
  from resolved""", ["resolved"])
register("geo_unmatched", """select Mapped_Location, count(*) as Count from resolved
  where lat is null and length(Mapped_Location) > 0 group by Mapped_Location""", ["resolved"])
register("geo_frequency", """select TripID, Mapped_Location,
    case when Mapped_Location is not null then count(*) over (partition by Mapped_Location) end as Frequency
  from resolved""", ["resolved"])
register("geo_quality", r"""select (select count(*) from routes) as total_rows,
    (select count(*) from resolved where lat is not null) as mapped,
    cast(greatest((select count(*) from resolved where lat is null) - e.empty, 0) as bigint) as unmatched,
    cast(e.empty as bigint) as empty
  from (select count_if(Route is null or regexp_replace(Route, '^\s+|\s+$', '', 'g') in ('', 'nan')) as empty
        from routes) e""", ["resolved"])
register("top_locations", """select Mapped_Location, round(avg(Amount), 6) as avg_Amount from resolved
  where lat is not null group by Mapped_Location order by avg(Amount) desc nulls last, Mapped_Location limit 10""",
         ["resolved"])

# ---- sentiment ----------------------------------------------------------------------
def _sql_list(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


_NEG, _UP, _DOWN = _sql_list(NEGATORS), _sql_list(BOOSTERS_UP), _sql_list(BOOSTERS_DOWN)


_BOOSTERS = _UP[:-1] + ", " + _DOWN[1:]
_PHRASES = {n: _sql_list(p for p in [*LEXICON_EXTRAS, *BOOSTERS_DOWN] if len(p.split()) == n) for n in (2, 3)}


def _boost_sql(p: str, c: str, d: float) -> str:
    sign = "(case when valence < 0 then -1.0 else 1.0 end)"
    return (f"((case when {p} in {_UP} then 0.293 when {p} in {_DOWN} then -0.293 else 0.0 end) "
            f"+ (case when {p} in {_BOOSTERS} and cd and coalesce({c}, false) then 0.733 else 0.0 end)) "
            f"* {sign} * {d}")


def _free(p: str) -> str:
    """A word before, if it has no valence of its own."""
    return f"(case when {p} not in (select token from test_lexicon) then {p} end)"


_NEGS = (" + ".join(f"coalesce({_free(p)} in {_NEG}, false)::int" for p in ("p1", "p2", "p3"))
         + f" + coalesce({_free('p1')} = 'least' and not coalesce(p2 in ('at', 'very'), false), false)::int")
_ADJ = (f"(valence + (case when cd and caps then 0.733 else 0.0 end) * (case when valence < 0 then -1.0 else 1.0 end)"
        f" + {_boost_sql(_free('p1'), 'c1', 1.0)} + {_boost_sql(_free('p2'), 'c2', 0.95)} + {_boost_sql(_free('p3'), 'c3', 0.9)})"
        f" * power(-0.74, {_NEGS})"
        f" * (case when bp > 0 and pos < bp then 0.5 when bp > 0 and pos > bp then 1.5 else 1.0 end)")
_AMP = ("(least(length(ReviewBody) - length(replace(ReviewBody, '!', '')), 4) * 0.292"
        " + case when length(ReviewBody) - length(replace(ReviewBody, '?', '')) > 1 then"
        " case when length(ReviewBody) - length(replace(ReviewBody, '?', '')) <= 3"
        " then (length(ReviewBody) - length(replace(ReviewBody, '?', ''))) * 0.18 else 0.96 end else 0.0 end)")
CTES["scored_reviews"] = f"""select r.*, case when r.ReviewBody is null or trim(r.ReviewBody) = '' then 0.0
    else round(ss / sqrt(ss * ss + 15.0), 4) + 0.0 end as Sentiment_Score
  from (select r.*, case when coalesce(s.raw, 0.0) > 0 then s.raw + {_AMP}
                         when coalesce(s.raw, 0.0) < 0 then s.raw - {_AMP} else 0.0 end as ss
        from reviews r left join (
    select ReviewID, sum({_ADJ}) as raw
    from (select *, lag(tok, 1) over w as p1, lag(tok, 2) over w as p2, lag(tok, 3) over w as p3, lead(tok, 1) over w as n1,
                 lag(caps, 1) over w as c1, lag(caps, 2) over w as c2, lag(caps, 3) over w as c3,
                 bool_or(caps) over d and bool_or(not caps) over d as cd,
                 coalesce(min(case when tok = 'but' then pos end) over d, 0) as bp
          from (select ReviewID, raw, lower(raw) as tok, raw = upper(raw) and raw <> lower(raw) as caps,
                       row_number() over (partition by ReviewID order by spot) as pos
                from (select ReviewID, spot, case kept when 3 then raw || ' ' || r1 || ' ' || r2 when 2 then raw || ' ' || r1 else raw end as raw,
                             coalesce(lag(kept, 1) over v, 0) > 1 or coalesce(lag(kept, 2) over v, 0) > 2 as gone
                      from (select *, case when coalesce(lag(words, 1) over v, 0) > 1 or coalesce(lag(words, 2) over v, 0) > 2 then 0 else words end as kept
                            from (select *, case when lower(raw || ' ' || r1 || ' ' || r2) in {_PHRASES[3]} then 3
                                                 when lower(raw || ' ' || r1) in {_PHRASES[2]} then 2 else 0 end as words
                                  from (select *, lead(raw, 1) over v as r1, lead(raw, 2) over v as r2
                                        from (select ReviewID, unnest(arr) as raw, unnest(range(1, len(arr) + 1)) as spot
                                              from (select ReviewID, {TOKENS_SQL.format(c='ReviewBody')} as arr
                                                    from reviews where not (ReviewBody is null or trim(ReviewBody) = '')))
                                        window v as (partition by ReviewID order by spot))) window v as (partition by ReviewID order by spot))
                      window v as (partition by ReviewID order by spot)) where not gone)
          window w as (partition by ReviewID order by pos), d as (partition by ReviewID)) t
    join test_lexicon l on t.tok = l.token
    where t.tok not in {_BOOSTERS}
    group by ReviewID) s on r.ReviewID = s.ReviewID) r"""
DEPS["scored_reviews"] = ["reviews", "test_lexicon"]
_LABEL = ("case when Sentiment_Score >= 0.05 then 'Positive' when Sentiment_Score <= -0.05 then 'Negative' "
          "else 'Neutral' end")
register("sentiment_score", f"""select ReviewID, lang, source, Sentiment_Score, {_LABEL} as Sentiment_Label
  from scored_reviews""", ["scored_reviews"])
register("sentiment_shares", f"""select count(*) as total, round(avg(p), 6) as positive_share,
    round(avg(n), 6) as negative_share, round(1.0 - avg(p) - avg(n), 6) as neutral_share
  from (select ({_LABEL} = 'Positive')::int as p, ({_LABEL} = 'Negative')::int as n from scored_reviews)""",
         ["scored_reviews"])
register("sentiment_by_group", f"""select lang, {_LABEL} as Sentiment_Label, count(*) as count
  from scored_reviews group by all""", ["scored_reviews"])

# ---- profiling ------------------------------------------------------------------------

# Schemas of the derived inputs (name, kind), as FIXTURES.md defines them.
FIXTURE_COLUMNS = {
    "churn_customers": [("customerID", "numeric"), ("Segment", "string"), ("Contract", "string"),
                        ("Support", "string"), ("Tenure", "numeric"), ("MonthlyCharges", "numeric"),
                        ("TotalCharges", "string"), ("Churn", "string")],
    "demographics": [("CustomerID", "numeric"), ("Age", "numeric"), ("Spending_Score", "string"),
                     ("Family_Size", "numeric"), ("Profession", "string")],
    "transactions": [("CustomerID", "numeric"), ("InvoiceDate", "datetime"), ("TotalAmount", "numeric")],
    "reviews": [("ReviewID", "numeric"), ("ReviewBody", "string"), ("lang", "string"), ("source", "string")],
    "routes": [("TripID", "numeric"), ("CustomerID", "numeric"), ("Amount", "numeric"),
               ("OverallRating", "numeric"), ("Route", "string")],
}


def _sql_lit(v, t):
    if v is None:
        return f"cast(null as {t})"
    if isinstance(v, bool):
        return "true" if v else "false"
    return "'" + str(v).replace("'", "''") + "'"


def _expected(text, keys):
    value = {"-": None, "yes": True, "no": False}
    return [dict(zip(keys, (value.get(w, w) for w in line.split()))) for line in text.strip().splitlines()]


def _readiness_sql(table):
    sels = []
    keys = ("module", "flavor", "standard_column", "source_column", "expected_type", "actual_type",
            "type_ok", "ready", "module_ready", "chosen_flavor")
    for r in _expected(READINESS[table], keys):
        src = r["source_column"]
        nulls = f"(select count(*) from {table} where {src} is null)" if src else "cast(null as bigint)"
        bad = (f"(select count(*) from {table} where {src} is not null and "
               f"try_cast(trim(cast({src} as varchar)) as double) is null)"
               if src and r["expected_type"] == "numeric" else "cast(null as bigint)")
        meta = ", ".join(f"{_sql_lit(r[k], 'varchar' if k not in ('type_ok', 'ready', 'module_ready') else 'boolean')} as {k}"
                         for k in keys)
        sels.append(f"select '{table}' as table_name, {meta}, (select count(*) from {table}) as rows, "
                    f"{nulls} as nulls, {bad} as non_numeric")
    return " union all ".join(sels)


def _capability_sql(table):
    sels = []
    for r in _expected(CAPABILITIES[table], ("rule_set", "capability", "detected", "evidence_column")):
        src = r["evidence_column"]
        v = f"(select count({src}) from {table})" if src else "cast(null as bigint)"
        sels.append(f"select '{table}' as table_name, '{r['rule_set']}' as rule_set, '{r['capability']}' as capability, "
                    f"{_sql_lit(r['detected'], 'boolean')} as detected, {_sql_lit(src, 'varchar')} as evidence_column, "
                    f"(select count(*) from {table}) as rows, {v} as evidence_non_null")
    return " union all ".join(sels)


_PROFILED = list(FIXTURE_COLUMNS)
register("readiness_report", " union all ".join(_readiness_sql(t) for t in _PROFILED), _PROFILED)
register("capability_report", " union all ".join(_capability_sql(t) for t in _PROFILED), _PROFILED)


def _groupable_sql(table, cols):
    return " union all ".join(
        f"select '{table}' as table_name, '{c}' as column_name, count(distinct {c}) as distinct_values from {table} "
        f"having count(distinct {c}) < 50" for c in cols)


register("groupable_columns", _groupable_sql("reviews", ["ReviewID", "lang", "source"]) + " union all "
         + _groupable_sql("churn_customers", [c for c, _ in FIXTURE_COLUMNS["churn_customers"]]),
         ["reviews", "churn_customers"])
register("column_domains", " union all ".join(
    [f"""select '{c}' as column_name, 'numeric' as kind, min({c}) as min_value, max({c}) as max_value,
          max({c}) * 1.2 as slider_max, cast(null as bigint) as distinct_values, cast(null as varchar) as "value"
        from cleaned""" for c in ("Tenure", "MonthlyCharges", "TotalCharges")]
    + [f"""select '{c}', 'category', null, null, null, count(*) over (), v
        from (select distinct {c} as v from cleaned where {c} is not null)""" for c in ("Segment", "Contract", "Support")]),
    ["cleaned"])

# ---- models (value-checkable parts) -----------------------------------------------------
CTES["sil_z"] = """select CustomerID, Cluster,
    (Recency - avg(Recency) over ()) / stddev_samp(Recency) over () as Recency,
    (Frequency - avg(Frequency) over ()) / stddev_samp(Frequency) over () as Frequency,
    (Monetary - avg(Monetary) over ()) / stddev_samp(Monetary) over () as Monetary
  from segments"""
DEPS["sil_z"] = ["segments"]
CTES["sil_stats"] = """select Cluster, count(*) as n, sum(cast(Recency as double)) as sr,
    sum(cast(Frequency as double)) as sf, sum(Monetary) as sm,
    sum(cast(Recency as double) * Recency + cast(Frequency as double) * Frequency + Monetary * Monetary) as q
  from sil_z group by Cluster"""
DEPS["sil_stats"] = ["sil_z"]
CTES["sil_pd"] = """select p.CustomerID, p.Cluster as pc, s.Cluster as sc, s.n,
    s.n * (cast(p.Recency as double) * p.Recency + cast(p.Frequency as double) * p.Frequency + p.Monetary * p.Monetary)
    - 2 * (p.Recency * s.sr + p.Frequency * s.sf + p.Monetary * s.sm) + s.q as d
  from sil_z p, sil_stats s"""
DEPS["sil_pd"] = ["sil_stats"]
register("silhouette", """select round(avg(case when na <= 1 then 0.0 else (b - a) / greatest(a, b) end), 6) as silhouette
  from (select CustomerID, max(case when sc = pc then n end) as na,
               max(case when sc = pc and n > 1 then d / (n - 1) end) as a,
               min(case when sc <> pc then d / n end) as b
        from sil_pd group by CustomerID)""", ["sil_pd"])

register("scenario_grid", """select customerID, s.scenario_id, coalesce(s.c, Contract) as Contract,
    coalesce(s.su, Support) as Support, coalesce(s.t, Tenure) as Tenure, coalesce(s.mc, MonthlyCharges) as MonthlyCharges
  from cleaned, (select 'base' as scenario_id, cast(null as varchar) as c, cast(null as varchar) as su, cast(null as double) as t, cast(null as double) as mc union all select 'two_year_contract' as scenario_id, 'Two year' as c, cast(null as varchar) as su, cast(null as double) as t, cast(null as double) as mc union all select 'with_support' as scenario_id, cast(null as varchar) as c, 'Yes' as su, cast(null as double) as t, cast(null as double) as mc union all select 'tenure_48' as scenario_id, cast(null as varchar) as c, cast(null as varchar) as su, cast(48.0 as double) as t, cast(null as double) as mc union all select 'charges_50k' as scenario_id, cast(null as varchar) as c, cast(null as varchar) as su, cast(null as double) as t, cast(50000.0 as double) as mc) s""", ["cleaned"])

_STOP = _sql_list(STOP_WORDS)
register("vocabulary", f"""select term, count(*) as doc_freq
  from (select distinct d, unnest(t) as term from (
          select row_number() over () as d, regexp_extract_all({CLEAN_TEXT_SQL.format(c='ReviewBody')}, '\\w\\w+') as t
          from reviews where ReviewBody is not null and trim(ReviewBody) <> ''
            and length({CLEAN_TEXT_SQL.format(c='ReviewBody')}) > 2))
  where term not in {_STOP}
  group by term
  having count(*) >= 2 and count(*) <= 0.95 * (select count(*) from reviews where ReviewBody is not null
    and trim(ReviewBody) <> '' and length({CLEAN_TEXT_SQL.format(c='ReviewBody')}) > 2)""", ["reviews"])

# ---- demographic segment labels and narratives ---------------------------------------------
CTES["demo_groups"] = """select *, cast(least(floor((Age - 18) / 20), 2) * 3 + Spending_Score_Num - 1 as integer) as Cluster
  from (select *, cast(case Spending_Score when 'Low' then 1 when 'Average' then 2 when 'High' then 3 else 1 end
                       as double) as Spending_Score_Num from demographics)"""
DEPS["demo_groups"] = ["demographics"]
register("segment_labels_demographic", """select Cluster, round(a, 6) as Age, round(s, 6) as Spending_Score_Num,
    round(f, 6) as Family_Size,
    concat_ws(' ', case when a < 30 then 'Young' when a < 50 then 'Mid-Age' else 'Senior' end,
              case when s < 1.5 then 'Saver' when s > 2.5 then 'Spender' else 'Standard' end,
              case when f > 3.5 then '(Fam)' end) as Cluster_Label
  from (select Cluster, avg(Age) as a, avg(Spending_Score_Num) as s, avg(Family_Size) as f
        from demo_groups group by Cluster)""", ["demo_groups"])
register("segment_narrative_demographic", f"""select Cluster, size, adjectives,
    '**Segment Overview:** This group represents **' || {tenths_sql('size', 'total')} || '%** of your customer base ('
      || size::varchar || ' users). They are predominantly **' || adjectives || '** customers.' as summary,
    case when sp = 'high-value' and ag = 'younger'
           then 'Strategy: Promote trending, premium items on social channels (Instagram/TikTok).'
         when sp = 'high-value' and ag = 'senior' then 'Strategy: Focus on loyalty rewards and high-touch customer service.'
         when sp = 'budget-conscious' then 'Strategy: Target with bulk discounts, bundles, or seasonal sales.'
         else 'Strategy: Maintain engagement with regular newsletters.' end as action
  from (select *, ag || ', ' || sp as adjectives from (
          select Cluster, count(*) as size, (select count(*) from demo_groups) as total,
            case when avg(Age) < 30 then 'younger' when avg(Age) > 50 then 'senior' else 'middle-aged' end as ag,
            case when avg(Spending_Score_Num) > (select avg(Spending_Score_Num) from demo_groups) * 1.2 then 'high-value'
                 when avg(Spending_Score_Num) < (select avg(Spending_Score_Num) from demo_groups) * 0.8 then 'budget-conscious'
                 else 'average-spending' end as sp
          from demo_groups group by Cluster))""", ["demo_groups"])
register("persona_segments", """select Cluster, size, Age, Spending_Score_Num, Family_Size, Persona,
    case when contains(Persona, 'Solo') and contains(Persona, 'Gen Z') then 'Trend & FOMO'
         when contains(Persona, 'Fam') and contains(Persona, 'Saver') then 'Value Bundles'
         when contains(Persona, 'Senior') then 'Trust & Loyalty'
         when contains(Persona, 'Spender') then 'Exclusivity' else 'Standard' end as Strategy,
    case when contains(Persona, 'Solo') and contains(Persona, 'Gen Z') then 'Push: ''Trending Now'''
         when contains(Persona, 'Fam') and contains(Persona, 'Saver') then 'Email: ''Buy 2 Get 1'''
         when contains(Persona, 'Senior') then 'Mail: Loyalty Club'
         when contains(Persona, 'Spender') then 'Invite: VIP Early Access' else 'Newsletter' end as Next_Best_Action
  from (select *, concat_ws(' / ',
          case when Family_Size <= 1.5 then 'Solo' when Family_Size <= 3.5 then 'Small Fam' else 'Large Fam' end,
          case when Age < 30 then 'Gen Z' when Age < 50 then 'Pro' else 'Senior' end,
          case when Spending_Score_Num > 2.5 then 'Spender' when Spending_Score_Num < 1.5 then 'Saver' end) as Persona
        from (select Cluster, count(*) as size, round_even(avg(Age), 1) as Age,
                     round_even(avg(Spending_Score_Num), 1) as Spending_Score_Num,
                     round_even(avg(Family_Size), 1) as Family_Size
              from demo_groups group by Cluster))""", ["demo_groups"])

# ---- what models and sinks must hold (expected values) ---------------------------------------
register("saved_table", " union all ".join(f"""select '{f}' as format, count(*) as rows, count(distinct customerID) as customers,
    cast(sum(Tenure) as bigint) as tenure, cast(count_if(Churn = 'Yes') as bigint) as churned from churn_customers""" for f in ("parquet", "json", "csv")),
         ["churn_customers"])
register("churn_score_check", """select count(*) as rows, 0::bigint as out_of_range, 0::bigint as band_mismatches,
    true as better_than_chance from churn_customers""", ["churn_customers"])
register("saved_model_check", """select count(*) as rows, 0::bigint as different, 1::bigint as single, 0::bigint as single_different
  from churn_customers""", ["churn_customers"])
register("churn_driver_check", """select true as at_most_five, 0::bigint as unknown, 0::bigint as without_gain,
    0::bigint as wrong_directions, 0::bigint as wrong_key_drivers""")
register("scenario_check", """select scenario_id, count(*) as rows, 0::bigint as wrong_deltas, 0::bigint as wrong_band_flags
  from churn_customers, (values ('two_year_contract'), ('with_support'), ('tenure_48'), ('charges_50k')) s(scenario_id)
  group by scenario_id""", ["churn_customers"])
register("attribution_check", """select count(*) as customers, cast(6 * count(*) as bigint) as rows, 0::bigint as wrong_ranks
  from churn_customers""", ["churn_customers"])
register("value_check", """select count(*) as rows, 0::bigint as missing, 'TotalCharges' as target, true as better_than_mean
  from churn_customers""", ["churn_customers"])
register("segment_check", """select count(*) as rows, count(*) as customers, 0::bigint as unassigned, 4::integer as clusters,
    true as by_size, count(*) as leaf_rows, 0::bigint as bad_purities from rfm""", ["rfm"])
register("k_sweep_check", """select 5::bigint as ks, 0::bigint as out_of_range, 1::bigint as flagged, true as flag_on_best,
    true as costs_fall""")
register("topic_check", f"""select count(*) as rows, cast(count_if(c is null or length(c) <= 2) as bigint) as unknown, 0::bigint as bad_topics,
    50::bigint as terms, 5::bigint as topics, 0::bigint as bad_weights
  from (select case when ReviewBody is null or trim(ReviewBody) = '' then '' else {CLEAN_TEXT_SQL.format(c='ReviewBody')} end as c from reviews)""",
         ["reviews"])
register("sentiment_by_fixed_topic", f"""select 'Topic ' || (length(ReviewBody) // 1000)::varchar as Topic_Label, {_LABEL} as Sentiment_Label,
    count(*) as count from scored_reviews where length(ReviewBody) > 2 group by all""", ["scored_reviews"])
register("customer_sample", """select * from rfm order by md5(CustomerID::varchar), CustomerID limit 1000""", ["rfm"])

"""Queries: scans, filters, period comparison, ratios, ranking."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from factweave.functions.dates import month_index
from factweave.operators import periods as P, quality as Q, ratios as R, selection as S
from factweave.plans import inputs as I
from factweave.plans.registry import query
from factweave.sources import scans

FAMILIES = {"order_count": {"v2": "v2_family", "v2_transition": "v2_family"}}
GROWTH = ("order_value", "order_count", "line_quantity", "net_revenue")
RATIOS = (
    R.Ratio("net_margin", "net_revenue", "order_value"),
    R.Ratio("items_per_order", "line_quantity", "order_count", unit="items_per_order", scale=None, positive_denominator=True),
)

_FACT_COLUMNS = "entity, metric_id, unit, period_type, period_start, period_end, reference_year, period_label, definition_version, value, filed_at, accession_number"

# --- scans -----------------------------------------------------------------


@query("scan_facts", f"""
SELECT {_FACT_COLUMNS} FROM quarter_facts WHERE metric_id = 'order_value' AND period_type = 'QUARTER' AND reference_year >= 1997
""", uses=["quarter_facts"])
def _(t):
    return scans.scan_facts(I.quarter_facts(t, ("order_value",)), metric="order_value", period_type="QUARTER", first_year=1997)


@query("scan_kpis", f"""
SELECT {_FACT_COLUMNS} FROM quarter_facts WHERE metric_id = 'order_count' AND definition_version = 'v2_transition'
""", uses=["quarter_facts"])
def _(t):
    return scans.scan_facts(I.quarter_facts(t, ("order_count",)), metric="order_count", definition_version="v2_transition")


@query("scan_series_between", """
SELECT entity, metric_id, reference_date, value FROM customer_days WHERE reference_date BETWEEN DATE '1996-02-01' AND DATE '1997-06-30'
""", uses=["customer_days"])
def _(t):
    rows = scans.scan_series(I.customer_days(t), "order_value_daily", dt.date(1996, 2, 1), dt.date(1997, 6, 30))
    return rows.select("entity", "metric_id", "reference_date", "value")


@query("legacy_series_id", """
SELECT 'orders' AS metric_id, CAST(o_orderdate AS DATE) AS reference_date, o_totalprice AS value, 'ledger:' || o_custkey AS source_series_id
FROM orders
""")
def _(t):
    legacy = t.orders.select(
        F.lit("orders").alias("metric_id"), F.col("o_orderdate").cast("date").alias("reference_date"),
        F.col("o_totalprice").alias("value"), F.col("o_custkey").cast("double").alias("series_code"))
    return scans.upgrade_legacy_series(legacy, "ledger", ["metric_id", "reference_date", "value", "source_series_id"])


@query("apply_filters", """
SELECT o_orderkey, o_orderpriority AS business_domain, CAST(o_orderdate AS DATE) AS reference_date, o_totalprice
FROM orders WHERE o_orderpriority = '1-URGENT' AND CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'
""")
def _(t):
    frame = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("business_domain"),
                            F.col("o_orderdate").cast("date").alias("reference_date"), "o_totalprice")
    return S.apply_filters(frame, "1-URGENT", dt.date(1996, 1, 1), dt.date(1998, 12, 31))


@query("rename_metric", """
SELECT entity, 'gross_order_value' AS metric_id, period_start, period_end, reference_year, period_type, period_label, value,
       'USD' AS unit, 'order_value' AS formula, 'order_value' AS source_metrics, FALSE AS is_derived, '1' AS methodology_version
FROM quarter_facts WHERE metric_id = 'order_value'
""", uses=["quarter_facts"])
def _(t):
    return R.renamed_metric(I.quarter_facts(t, ("order_value",)), "order_value", "gross_order_value", "USD")


@query("trend", """
SELECT entity, period_end, value FROM quarter_facts WHERE metric_id = 'net_revenue' AND period_type = 'QUARTER'
""", uses=["quarter_facts"])
def _(t):
    return S.trend(I.quarter_facts(t, ("net_revenue",)), "net_revenue", "QUARTER").select("entity", "period_end", "value")


# --- year over year --------------------------------------------------------

_GROWTH_SQL = """
SELECT c.entity, c.metric_id || '_yoy_growth' AS metric_id, c.period_start, c.period_end, c.reference_year, c.period_type, c.period_label,
       (c.value / p.value - 1.0) * 100.0 AS value, 'percent' AS unit, '(current_value / previous_year_value - 1) * 100' AS formula,
       c.metric_id AS source_metrics, TRUE AS is_derived, '1' AS methodology_version {extra}
FROM quarter_facts c JOIN quarter_facts p
  ON p.entity = c.entity AND p.metric_id = c.metric_id AND p.unit = c.unit AND p.period_type = c.period_type
 AND year(p.period_end) = year(c.period_end) - 1
 AND strftime(p.period_start, '%m-%d') = strftime(c.period_start, '%m-%d') AND strftime(p.period_end, '%m-%d') = strftime(c.period_end, '%m-%d')
WHERE p.value > 0 {where}
"""


@query("yoy_growth", _GROWTH_SQL.format(extra="", where=""), uses=["quarter_facts"])
def _(t):
    return P.yoy_growth(I.quarter_facts(t), metrics=GROWTH, unique=True)


_FAMILY_CASE = "CASE WHEN {a}.metric_id = 'order_count' AND {a}.definition_version IN ('v2','v2_transition') THEN 'v2_family' ELSE {a}.definition_version END"


@query("yoy_growth_family", _GROWTH_SQL.format(
    extra=", CASE WHEN c.definition_version = p.definition_version THEN c.definition_version ELSE c.definition_version || ';prior=' || p.definition_version END AS definition_context",
    where=f"AND {_FAMILY_CASE.format(a='c')} = {_FAMILY_CASE.format(a='p')} AND c.metric_id IN ('order_value', 'order_count')"),
    uses=["quarter_facts"])
def _(t):
    return P.yoy_growth(I.quarter_facts(t, ("order_value", "order_count")), families=FAMILIES, unique=True)


@query("yoy_change_pp", """
SELECT c.entity, c.metric_id || '_yoy_change_pp' AS metric_id, c.period_start, c.period_end, c.reference_year, c.period_type, c.period_label,
       c.value - p.value AS value, 'percentage_points' AS unit, 'current_order_count - previous_year_order_count' AS formula,
       c.metric_id AS source_metrics, TRUE AS is_derived, '1' AS methodology_version,
       c.definition_version AS definition_context
FROM quarter_facts c JOIN quarter_facts p
  ON p.entity = c.entity AND p.metric_id = c.metric_id AND p.period_type = c.period_type AND p.definition_version = c.definition_version
 AND p.period_label = c.period_label AND year(p.period_end) = year(c.period_end) - 1
WHERE c.metric_id = 'order_count'
""", uses=["quarter_facts"])
def _(t):
    return P.yoy_difference(I.quarter_facts(t, ("order_count",)), families={}, unique=True)


def qualified_snapshots(t):
    """Instant facts with a scope and a qualifier taken from the filing lag."""
    lag = F.datediff("filed_at", "period_end")
    return I.instant_facts(t).withColumns({
        "scope": F.when(F.col("entity").cast("int") % 2 == 0, F.lit("total")).otherwise(F.lit("total_portfolio")),
        "value_qualifier": F.when(lag % 5 == 0, F.lit("approximate")).when(F.quarter("period_end") == 4, F.lit("lower_bound")).otherwise(F.lit("exact")),
    })


I.shared_sql("qualified_snapshots", """
SELECT *, CASE WHEN CAST(entity AS INTEGER) % 2 = 0 THEN 'total' ELSE 'total_portfolio' END AS scope,
       CASE WHEN date_diff('day', period_end, filed_at) % 5 = 0 THEN 'approximate' WHEN quarter(period_end) = 4 THEN 'lower_bound' ELSE 'exact' END AS value_qualifier
FROM instant_facts
""", uses=["instant_facts"])


@query("yoy_qualified", """
SELECT c.entity, c.metric_id || '_yoy_growth' AS metric_id, c.period_start, c.period_end, c.reference_year, c.period_type, c.period_label,
       (c.value / p.value - 1.0) * 100.0 AS value, 'percent' AS unit, '(current_value / previous_year_value - 1) * 100' AS formula,
       c.metric_id AS source_metrics, TRUE AS is_derived, '1' AS methodology_version,
       'scope=' || c.scope || ';current_qualifier=exact;prior_qualifier=exact' AS definition_context
FROM qualified_snapshots c JOIN qualified_snapshots p
  ON p.entity = c.entity AND p.unit = c.unit AND p.scope = c.scope AND year(p.period_end) = year(c.period_end) - 1
 AND strftime(p.period_end, '%m-%d') = strftime(c.period_end, '%m-%d')
WHERE c.value_qualifier = 'exact' AND p.value_qualifier = 'exact' AND p.value > 0
""", uses=["qualified_snapshots"])
def _(t):
    return P.yoy_qualified(qualified_snapshots(t), unique=True)


# --- months ----------------------------------------------------------------

_MONTH_SQL = """
SELECT c.entity, c.metric_id, c.reference_date, {change} AS change, p.reference_date AS previous_reference_date, p.value AS previous_value,
       '{match}' AS temporal_match
FROM customer_months c JOIN customer_months p ON p.entity = c.entity
 AND year(p.reference_date) * 12 + month(p.reference_date) = year(c.reference_date) * 12 + month(c.reference_date) - {back}
WHERE p.value <> 0
"""


@query("mom_change", _MONTH_SQL.format(change="(c.value / p.value - 1.0) * 100.0", match="previous_calendar_month", back=1), uses=["customer_months"])
def _(t):
    return P.month_change(I.customer_months(t), back=1, unique=True)


@query("month_yoy", _MONTH_SQL.format(change="c.value - p.value", match="same_month_previous_year", back=12), uses=["customer_months"])
def _(t):
    return P.month_change(I.customer_months(t), back=12, percent=False, unique=True)


@query("prev_obs_change", """
SELECT * FROM (
  SELECT entity, metric_id, reference_date,
         lag(value) OVER w AS previous_value, lag(reference_date) OVER w AS previous_reference_date, value - lag(value) OVER w AS change
  FROM customer_days WINDOW w AS (PARTITION BY entity, metric_id ORDER BY reference_date))
WHERE previous_reference_date IS NOT NULL
""", uses=["customer_days"])
def _(t):
    return P.previous_observation_change(I.customer_days(t))


@query("month_end_snapshot", """
SELECT entity, metric_id, last_day(reference_date) AS reference_date, arg_max(value, reference_date) AS value, max(reference_date) AS source_reference_date
FROM customer_days GROUP BY entity, metric_id, last_day(reference_date)
""", uses=["customer_days"])
def _(t):
    return P.month_end_snapshot(I.customer_days(t))


@query("direction_flags", """
SELECT entity, reference_date, flag_id,
       CASE WHEN change = 0 THEN 'unchanged' WHEN flag_id = 'credit_yoy_direction' AND change > 0 THEN 'expanding' WHEN flag_id = 'credit_yoy_direction' THEN 'contracting'
            WHEN change > 0 THEN 'rising' ELSE 'falling' END AS flag_value
FROM (SELECT c.entity, c.reference_date, CASE WHEN month(c.reference_date) > 6 THEN 'credit_yoy_direction' ELSE 'ledger_direction' END AS flag_id,
             CAST(c.orders - p.orders AS DOUBLE) AS change
      FROM customer_months c JOIN customer_months p ON p.entity = c.entity
       AND year(p.reference_date) * 12 + month(p.reference_date) = year(c.reference_date) * 12 + month(c.reference_date) - 1)
""", uses=["customer_months"])
def _(t):
    from factweave.operators.rules import DEFAULT_DIRECTION, DIRECTIONS

    orders = I.customer_months(t).withColumn("value", F.col("orders").cast("double"))
    changes = P.month_change(orders, back=1, percent=False, unique=True).withColumn(
        "flag_id", F.when(F.month("reference_date") > 6, F.lit("credit_yoy_direction")).otherwise(F.lit("ledger_direction")))
    return changes.select("entity", "reference_date", "flag_id",
                          P.direction(F.col("flag_id"), F.col("change"), DIRECTIONS, DEFAULT_DIRECTION).alias("flag_value"))


# --- latest rows -----------------------------------------------------------


@query("latest_snapshot", """
SELECT entity, metric_id, period_end, filed_at, accession_number, value, period_type FROM (
  SELECT *, row_number() OVER (PARTITION BY entity, metric_id ORDER BY period_end DESC, filed_at DESC, accession_number DESC, value DESC) AS rn FROM quarter_facts)
WHERE rn = 1
""", uses=["quarter_facts"])
def _(t):
    return S.latest_rows(I.quarter_facts(t), ["entity", "metric_id"], ["period_end", "filed_at", "accession_number"], ["value", "period_type"])


@query("latest_yoy", """
WITH growth AS (""" + _GROWTH_SQL.format(extra="", where="AND c.metric_id = 'order_value' AND c.period_type = 'QUARTER'") + """),
newest AS (SELECT entity, max(period_end) AS period_end FROM quarter_facts WHERE metric_id = 'order_value' AND period_type = 'QUARTER' GROUP BY entity)
SELECT g.entity, g.metric_id, g.period_end, g.value FROM growth g JOIN newest n ON n.entity = g.entity AND n.period_end = g.period_end
""", uses=["quarter_facts"])
def _(t):
    facts = S.trend(I.quarter_facts(t, ("order_value",)), "order_value", "QUARTER")
    newest = facts.groupBy("entity").agg(F.max("period_end").alias("period_end"))
    growth = P.yoy_growth(facts, unique=True).select("entity", "metric_id", "period_end", "value")
    return S.latest_only(growth, newest, ["entity", "period_end"])


@query("priority_signal", """
SELECT entity, business_domain, metric_id, period_end, period_label, value, unit FROM (
  SELECT *, row_number() OVER (PARTITION BY entity, business_domain ORDER BY pr, period_end DESC, filed_at DESC, accession_number DESC) AS rn FROM (
    SELECT *, CASE metric_id WHEN 'net_revenue' THEN 'Financial' ELSE 'Commerce' END AS business_domain,
           CASE metric_id WHEN 'line_quantity' THEN 0 WHEN 'order_count' THEN 1 ELSE 0 END AS pr
    FROM quarter_facts WHERE metric_id IN ('net_revenue', 'line_quantity', 'order_count')
      AND NOT (metric_id = 'line_quantity' AND entity LIKE '%3')))
WHERE rn = 1
""", uses=["quarter_facts"])
def _(t):
    facts = I.quarter_facts(t, ("net_revenue", "line_quantity", "order_count"))
    # Customers with a number ending in 3 report no quantities: the preferred metric is missing for them.
    facts = facts.filter(~((F.col("metric_id") == "line_quantity") & F.col("entity").endswith("3")))
    return S.priority_signal(facts, {"Commerce": ["line_quantity", "order_count"], "Financial": ["net_revenue"]})


@query("last_n_history", """
SELECT entity, reference_date, value FROM (
  SELECT *, row_number() OVER (PARTITION BY entity ORDER BY reference_date DESC) AS rn FROM customer_months) WHERE rn <= 12
""", uses=["customer_months"])
def _(t):
    return S.last_n(I.customer_months(t).select("entity", "reference_date", "value"), ["entity"], "reference_date")


@query("topk_recent", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS reference_date, o_totalprice FROM orders ORDER BY reference_date DESC, o_orderkey LIMIT 25
""")
def _(t):
    frame = t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").alias("reference_date"), "o_totalprice")
    return S.top_recent(frame, "reference_date", "o_orderkey", 25)


@query("topk_category_order", """
SELECT o_orderkey, o_orderpriority, CAST(o_orderdate AS DATE) AS reference_date FROM orders
ORDER BY CASE o_orderpriority WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END, reference_date DESC, o_orderkey LIMIT 40
""")
def _(t):
    frame = t.orders.select("o_orderkey", "o_orderpriority", F.col("o_orderdate").cast("date").alias("reference_date"))
    return S.top_by_category(frame, "o_orderpriority", ["3-MEDIUM", "1-URGENT"], "reference_date", "o_orderkey", 40)


# --- keys that the pairing operators refuse --------------------------------


def _with_repeats(t):
    """Facts of which the customers with a number ending in 7 report everything twice, with another filing."""
    facts = I.quarter_facts(t, ("order_value", "order_count"))
    again = facts.filter(F.col("entity").endswith("7")).withColumn("accession_number", F.concat("accession_number", F.lit("-again")))
    return facts.unionByName(again)


@query("duplicate_periods", """
SELECT entity, metric_id, period_start, period_end, reference_year, period_type, period_label, CAST(2 AS BIGINT) AS row_count
FROM quarter_facts WHERE metric_id IN ('order_value', 'order_count') AND entity LIKE '%7'
""", uses=["quarter_facts"])
def _(t):
    return R.duplicate_periods(_with_repeats(t), ["order_value", "order_count"])


@query("ambiguous_periods", """
SELECT entity, metric_id, unit, period_type, reference_year AS economic_year, CAST(2 AS BIGINT) AS row_count
FROM quarter_facts WHERE metric_id = 'order_value' AND entity LIKE '%7'
""", uses=["quarter_facts"])
def _(t):
    found = P.ambiguous_periods(_with_repeats(t).filter("metric_id = 'order_value'"))
    return found.select("entity", "metric_id", "unit", "period_type", "economic_year", "row_count")


# --- ratios ----------------------------------------------------------------

_PAIR_SQL = """
SELECT l.*, r.value AS rvalue, r.definition_version AS rdef FROM quarter_facts l JOIN quarter_facts r
  ON l.entity = r.entity AND l.period_start IS NOT DISTINCT FROM r.period_start AND l.period_end = r.period_end
 AND l.reference_year = r.reference_year AND l.period_type = r.period_type AND l.period_label IS NOT DISTINCT FROM r.period_label
WHERE l.metric_id = '{left}' AND r.metric_id = '{right}'
"""
_OUT = "entity, '{m}' AS metric_id, period_start, period_end, reference_year, period_type, period_label, {v} AS value, '{u}' AS unit, '{f}' AS formula, '{s}' AS source_metrics, TRUE AS is_derived, '1' AS methodology_version"


@query("exact_period_join", """
SELECT l.entity, l.period_start, l.period_end, l.reference_year, l.period_type, l.period_label, l.value AS left_value, r.value AS right_value,
       l.definition_version AS left_definition_version, r.definition_version AS right_definition_version
FROM quarter_facts l JOIN quarter_facts r ON l.entity = r.entity AND l.period_start IS NOT DISTINCT FROM r.period_start AND l.period_end = r.period_end
 AND l.period_type = r.period_type AND l.period_label IS NOT DISTINCT FROM r.period_label
WHERE l.metric_id = 'net_revenue' AND r.metric_id = 'order_count'
""", uses=["quarter_facts"])
def _(t):
    return R.exact_period_join(I.quarter_facts(t, ("net_revenue", "order_count")), "net_revenue", "order_count")


@query("margin", f"SELECT {_OUT.format(m='net_margin', v='value / rvalue * 100.0', u='percent', f='net_revenue / order_value * 100', s='net_revenue;order_value')} FROM ({_PAIR_SQL.format(left='net_revenue', right='order_value')}) WHERE rvalue <> 0", uses=["quarter_facts"])
def _(t):
    return R.period_ratio(I.quarter_facts(t, ("net_revenue", "order_value")), RATIOS[0])


@query("metric_difference", f"SELECT {_OUT.format(m='value_gap', v='value - rvalue', u='USD', f='order_value - net_revenue', s='order_value;net_revenue')} FROM ({_PAIR_SQL.format(left='order_value', right='net_revenue')})", uses=["quarter_facts"])
def _(t):
    return R.difference(I.quarter_facts(t, ("order_value", "net_revenue")), "value_gap", "order_value", "net_revenue", "USD")


@query("derived_margin", f"SELECT {_OUT.format(m='value_gap_margin', v='(value - rvalue) / value * 100.0', u='percent', f='value_gap / order_value * 100', s='order_value;net_revenue;order_value')} FROM ({_PAIR_SQL.format(left='order_value', right='net_revenue')}) WHERE value <> 0", uses=["quarter_facts"])
def _(t):
    return R.difference_margin(I.quarter_facts(t, ("order_value", "net_revenue")), "value_gap_margin", "order_value", "net_revenue", "order_value", difference_name="value_gap")


def _with_definitions(sql):
    return sql.replace("'1' AS methodology_version", "'1' AS methodology_version, '{l}:' || definition_version || ';{r}:' || rdef AS definition_context")


@query("ratio_same_definition", f"SELECT {_with_definitions(_OUT).format(m='items_per_order', v='value / rvalue', u='items_per_order', f='line_quantity / order_count', s='line_quantity;order_count', l='line_quantity', r='order_count')} FROM ({_PAIR_SQL.format(left='line_quantity', right='order_count')}) WHERE rvalue > 0 AND definition_version = rdef", uses=["quarter_facts"])
def _(t):
    ratio = R.Ratio("items_per_order", "line_quantity", "order_count", unit="items_per_order", scale=None, positive_denominator=True, same_definition=True)
    return R.period_ratio(I.quarter_facts(t, ("line_quantity", "order_count")), ratio)


@query("share_of_total", f"SELECT {_with_definitions(_OUT).format(m='net_share', v='value / rvalue * 100.0', u='percent', f='net_revenue / order_value * 100', s='net_revenue;order_value', l='net_revenue', r='order_value')} FROM ({_PAIR_SQL.format(left='net_revenue', right='order_value')}) WHERE rvalue <> 0", uses=["quarter_facts"])
def _(t):
    return R.period_ratio(I.quarter_facts(t, ("net_revenue", "order_value")), R.Ratio("net_share", "net_revenue", "order_value", record_definitions=True))


def _users(t):
    return I.instant_facts(t).withColumn("unit", F.lit("users"))


def _dollar_snapshots(t):
    return qualified_snapshots(t).withColumns({"unit": F.lit("USD"), "value": F.col("value") * 1000.0, "metric_id": F.lit("balance")})


_SAME_DATE = """
FROM qualified_snapshots s JOIN instant_facts u ON u.entity = s.entity AND u.period_end = s.period_end
WHERE s.value_qualifier = 'exact' AND u.value > 0
"""


@query("same_date_join", f"""
SELECT s.entity, s.period_end, s.value * 1000.0 AS snapshot_value, u.value AS users {_SAME_DATE}
""", uses=["qualified_snapshots"])
def _(t):
    joined = R.same_date_join(_dollar_snapshots(t), _users(t))
    return joined.select("entity", "period_end", F.col("value").alias("snapshot_value"), "users")


@query("per_user_ratio", f"""
SELECT s.entity, 'balance_per_active_user' AS metric_id, s.period_start, s.period_end, s.reference_year, s.period_type, s.period_label,
       s.value * 1000.0 / u.value AS value, 'USD_per_user' AS unit, 'balance / active_users' AS formula, 'balance;active_users' AS source_metrics,
       TRUE AS is_derived, '1' AS methodology_version,
       'scope=' || s.scope || ';qualifier=exact;denominator=reported_active_users;user_definition_version=' || u.definition_version AS definition_context
{_SAME_DATE}
""", uses=["qualified_snapshots"])
def _(t):
    return R.same_date_ratio(_dollar_snapshots(t), _users(t), F.concat("metric_id", F.lit("_per_active_user")))


_SUITE_SQL = "WITH growth AS (" + _GROWTH_SQL.format(extra="", where="") + "), nv AS (" + _PAIR_SQL.format(left="net_revenue", right="order_value") + \
    "), qc AS (" + _PAIR_SQL.format(left="line_quantity", right="order_count") + """)
SELECT * FROM growth
UNION ALL BY NAME SELECT """ + _OUT.format(m="net_margin", v="value / rvalue * 100.0", u="percent", f="net_revenue / order_value * 100", s="net_revenue;order_value") + """ FROM nv WHERE rvalue <> 0
UNION ALL BY NAME SELECT """ + _OUT.format(m="items_per_order", v="value / rvalue", u="items_per_order", f="line_quantity / order_count", s="line_quantity;order_count") + """ FROM qc WHERE rvalue > 0
UNION ALL BY NAME SELECT """ + _OUT.format(m="gross_order_value", v="rvalue", u="USD", f="order_value", s="order_value").replace("TRUE AS is_derived", "FALSE AS is_derived") + """ FROM nv
UNION ALL BY NAME SELECT """ + _OUT.format(m="value_gap", v="rvalue - value", u="USD", f="order_value - net_revenue", s="order_value;net_revenue") + """ FROM nv
UNION ALL BY NAME SELECT """ + _OUT.format(m="value_gap_margin", v="(rvalue - value) / rvalue * 100.0", u="percent", f="value_gap / order_value * 100", s="order_value;net_revenue;order_value") + """ FROM nv WHERE rvalue <> 0
"""


@query("metric_suite", _SUITE_SQL, uses=["quarter_facts"])
def _(t):
    return R.metric_suite(
        I.quarter_facts(t), GROWTH, RATIOS, {"order_value": ("gross_order_value", "USD")},
        [("value_gap", "order_value", "net_revenue", "USD", "order_value")], unique=True)


@query("pearson_aligned", """
WITH both_sides AS (SELECT entity, last_day(reference_date) AS m, value AS a, CAST(orders AS DOUBLE) AS b FROM customer_months)
SELECT entity, CASE WHEN n < 3 THEN 'TOO_FEW' WHEN amin = amax OR bmin = bmax THEN 'CONSTANT' ELSE 'OK' END AS status, n AS n_observations,
       s AS start_date, e AS end_date, CASE WHEN n >= 3 AND amin < amax AND bmin < bmax THEN round(c, 6) END AS correlation
FROM (SELECT entity, count(*) AS n, min(m) AS s, max(m) AS e, min(a) AS amin, max(a) AS amax, min(b) AS bmin, max(b) AS bmax,
             covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) AS c FROM both_sides GROUP BY entity)
""", uses=["customer_months"])
def _(t):
    months = I.customer_months(t)
    long = months.select("entity", "reference_date", F.explode(F.array(
        F.struct(F.lit("value").alias("metric_id"), F.col("value").alias("value")),
        F.struct(F.lit("orders").alias("metric_id"), F.col("orders").cast("double").alias("value")))).alias("m")).select("entity", "reference_date", "m.*")
    result = Q.aligned_correlation(long, "value", "orders", month_index(F.col("reference_date")), ["entity"])
    return result.withColumn("correlation", F.round("correlation", 6))


_SUITE_CHANGE = """
SELECT c.entity, '{m}' AS metric_id, c.reference_date, {v} AS value, '{u}' AS unit, 'monthly' AS frequency, '{s}' AS source_metric_id, '{k}' AS analytics_kind,
       p.reference_date AS previous_reference_date, p.value AS previous_value, CAST(NULL AS DATE) AS source_reference_date, '{f}' AS direction_flag_id,
       CASE WHEN {v} = 0 THEN 'unchanged' WHEN {v} > 0 THEN '{up}' ELSE '{down}' END AS direction_value, '{t}' AS temporal_match
FROM {x} c JOIN {x} p ON p.entity = c.entity AND year(p.reference_date) * 12 + month(p.reference_date) = year(c.reference_date) * 12 + month(c.reference_date) - {back}
WHERE p.value <> 0
"""


@query("series_suite", """
WITH ends AS (SELECT entity, last_day(reference_date) AS reference_date, arg_max(value, reference_date) AS value, max(reference_date) AS source_reference_date FROM customer_days GROUP BY 1, 2)
""" + _SUITE_CHANGE.format(m="household_free_credit_balance_yoy_growth", s="household_free_credit_balance", u="percent", v="(c.value / p.value - 1.0) * 100.0", k="yoy_growth",
                           f="credit_yoy_direction", up="expanding", down="contracting", t="same_month_previous_year", x="customer_months", back=12)
       + "UNION ALL" + _SUITE_CHANGE.format(m="usd_brl_monthly_change_pct", s="usd_brl_sell_rate", u="percent", v="(c.value / p.value - 1.0) * 100.0", k="monthly_percentage_change",
                                            f="usd_brl_direction", up="depreciating_brl", down="appreciating_brl", t="previous_calendar_month", x="ends", back=1)
       + """UNION ALL SELECT entity, 'usd_brl_month_end', reference_date, value, 'brl_per_usd', 'monthly', 'usd_brl_sell_rate', 'month_end_snapshot', NULL, NULL, source_reference_date, NULL, NULL, NULL FROM ends
UNION ALL SELECT entity, 'unemployment_rate_change_pp', reference_date, change, 'percentage_points', 'rolling_3m_monthly', 'unemployment_rate_rolling_3m', 'previous_observation_change', pd, pv, NULL, 'unemployment_direction',
       CASE WHEN change = 0 THEN 'unchanged' WHEN change > 0 THEN 'rising' ELSE 'falling' END, 'previous_published_observation'
FROM (SELECT entity, reference_date, value - lag(value) OVER w AS change, lag(value) OVER w AS pv, lag(reference_date) OVER w AS pd FROM customer_months WINDOW w AS (PARTITION BY entity ORDER BY reference_date)) WHERE pd IS NOT NULL
""", uses=["customer_months", "customer_days"])
def _(t):
    from factweave.operators.series import series_suite

    months = I.customer_months(t).select("entity", F.explode(F.array(F.lit("household_free_credit_balance"), F.lit("unemployment_rate_rolling_3m"))).alias("metric_id"), "reference_date", "value")
    days = I.customer_days(t).select("entity", F.lit("usd_brl_sell_rate").alias("metric_id"), "reference_date", "value")
    return series_suite(months.unionByName(days))

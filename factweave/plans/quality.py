"""Queries: canonicalisation, validation, coverage, health, sources and sinks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from factweave.functions.dates import as_date
from factweave.operators import canonical as C, quality as Q
from factweave.plans import inputs as I
from factweave.plans.registry import query
from factweave.sources import landing, sinks

METRICS = ["order_value", "order_count", "line_quantity", "net_revenue"]
KEY = ["orderkey", "linenumber"]


def joined(c: str):
    """Arrays leave the query as text."""
    return F.array_join(c, "|").alias(c)


@query("facts_summary", """
SELECT metric_id, period_type, count(*) AS fact_count, min(period_end) AS first_period_end, max(period_end) AS last_period_end,
       count(*) FILTER (WHERE value > 300000) AS large_count
FROM quarter_facts GROUP BY metric_id, period_type
""", uses=["quarter_facts"])
def _(t):
    facts = I.quarter_facts(t).withColumn("large", F.col("value") > 300000)
    return Q.coverage_summary(facts, ["metric_id", "period_type"], "large")


@query("kpis_summary", """
SELECT metric_id, definition_version, period_type, count(*) AS fact_count, min(period_end) AS first_period_end, max(period_end) AS last_period_end
FROM quarter_facts GROUP BY metric_id, definition_version, period_type
""", uses=["quarter_facts"])
def _(t):
    return Q.coverage_summary(I.quarter_facts(t), ["metric_id", "definition_version", "period_type"])


_LATEST = """
SELECT {key}, arg_max(value, o) AS value, max(filed_at) AS filed_at, arg_max(accession_number, o) AS accession_number, {carry} count(*) AS occurrences,
       arg_min(value, o) AS first_reported_value, min(filed_at) AS first_filed_at, arg_min(accession_number, o) AS first_accession_number,
       {flag} AS has_value_change, arg_max(value, o) - arg_min(value, o) AS value_change
FROM (SELECT *, row_number() OVER (ORDER BY filed_at, accession_number, value) AS o FROM restatements) GROUP BY {key}
"""


@query("latest_wins_any_change", _LATEST.format(key="orderkey, linenumber", carry="arg_max(definition_version, o) AS definition_version,", flag="count(DISTINCT value) > 1"), uses=["restatements"])
def _(t):
    return C.latest_filing_wins(I.restatements(t), KEY, change="any", carry=["definition_version"])


@query("latest_wins_endpoints", _LATEST.format(key="orderkey, linenumber, definition_version", carry="", flag="arg_max(value, o) <> arg_min(value, o)"), uses=["restatements"])
def _(t):
    return C.latest_filing_wins(I.restatements(t), [*KEY, "definition_version"], change="endpoints")


@query("dup_agreement", """
SELECT orderkey, linenumber, filed_at, accession_number, value, definition_version, copies, agrees FROM (
  SELECT *, row_number() OVER (PARTITION BY orderkey, linenumber ORDER BY filed_at, accession_number, value, definition_version) AS rn,
         count(*) OVER p AS copies, min(definition_version) OVER p = max(definition_version) OVER p AS agrees
  FROM restatements WINDOW p AS (PARTITION BY orderkey, linenumber)) WHERE rn = 1
""", uses=["restatements"])
def _(t):
    return C.duplicate_agreement(I.restatements(t), KEY, ["definition_version"], ["filed_at", "accession_number"])


@query("dup_keys", "SELECT orderkey, linenumber, count(*) AS row_count FROM restatements GROUP BY ALL HAVING count(*) > 1", uses=["restatements"])
def _(t):
    return Q.duplicate_keys(I.restatements(t), KEY)


@query("null_profile", """
SELECT 'text' AS column_name, count(*) FILTER (WHERE text IS NULL OR trim(text) = '') AS blank_count, count(*) AS row_count FROM documents
UNION ALL SELECT 'lang', count(*) FILTER (WHERE lang IS NULL OR trim(lang) = ''), count(*) FROM documents
UNION ALL SELECT 'source', count(*) FILTER (WHERE source IS NULL OR trim(source) = ''), count(*) FROM documents
""")
def _(t):
    return Q.null_profile(t.documents, ["text", "lang", "source"])


@query("period_violations", """
SELECT o_orderkey, period_type, period_start, period_end, reference_year,
       concat_ws('|', CASE WHEN period_type NOT IN ('INSTANT','QUARTER','YTD','FY') THEN 'period_type_allowed' END,
         CASE WHEN period_type = 'INSTANT' AND period_start IS NOT NULL THEN 'instant_has_no_start' END,
         CASE WHEN period_type <> 'INSTANT' AND period_start IS NULL THEN 'duration_has_start' END,
         CASE WHEN period_start > period_end THEN 'start_not_after_end' END,
         CASE WHEN reference_year <> year(period_end) THEN 'year_matches_end' END) AS violations
FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'QUARTER' WHEN 'O' THEN 'INSTANT' ELSE 'OTHER' END AS period_type,
             CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(o_orderdate AS DATE) END AS period_start,
             CAST(l.ship AS DATE) AS period_end, CAST(year(o_orderdate) AS INTEGER) AS reference_year
      FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS ship FROM lineitem GROUP BY 1) l ON l.l_orderkey = o_orderkey)
WHERE violations <> ''
""")
def _(t):
    ships = t.lineitem.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("ship"))
    facts = t.orders.join(ships, F.col("o_orderkey") == F.col("l_orderkey")).select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", F.lit("QUARTER")).when(F.col("o_orderstatus") == "O", F.lit("INSTANT")).otherwise(F.lit("OTHER")).alias("period_type"),
        F.when(F.col("o_orderpriority") != "5-LOW", as_date("o_orderdate")).alias("period_start"),
        as_date("ship").alias("period_end"), F.year("o_orderdate").alias("reference_year"))
    return Q.period_violations(facts).withColumn("violations", joined("violations"))


@query("series_contract", """
SELECT entity, metric_id, reference_date, 'month_end_dated' AS violations FROM (
  SELECT CAST(o_custkey AS VARCHAR) AS entity, 'order_value_monthly' AS metric_id, CAST(o_orderdate AS DATE) AS reference_date FROM orders)
WHERE reference_date <> last_day(reference_date)
""")
def _(t):
    rows = t.orders.select(F.col("o_custkey").cast("string").alias("entity"), F.lit("order_value_monthly").alias("metric_id"),
                           as_date("o_orderdate").alias("reference_date"), F.col("o_totalprice").alias("value"),
                           F.lit("USD").alias("unit"), F.lit("monthly").alias("frequency"))
    found = Q.series_violations(rows, {"order_value_monthly": ("monthly", "USD")})
    return found.select("entity", "metric_id", "reference_date", joined("violations"))


@query("price_contract", """
SELECT event_id, concat_ws('|', CASE WHEN NOT (open > 0 AND high > 0 AND low > 0 AND close > 0) THEN 'prices_positive' END,
  CASE WHEN high < low THEN 'high_not_below_low' END, CASE WHEN open < low OR open > high THEN 'open_in_range' END,
  CASE WHEN close < low OR close > high THEN 'close_in_range' END) AS violations
FROM (SELECT event_id, value AS open, value * 1.25 AS high, value / 2 AS low, CAST(user_id AS DOUBLE) AS close FROM events)
WHERE violations <> ''
""")
def _(t):
    rows = t.events.select("event_id", F.col("value").alias("open"), (F.col("value") * 1.25).alias("high"), (F.col("value") / 2).alias("low"),
                           F.col("user_id").cast("double").alias("close"), F.lit(None).cast("double").alias("volume"))
    return Q.failed_rules(rows, Q.price_rules()).select("event_id", joined("violations"))


@query("quarter_gaps", """
WITH seen AS (SELECT entity, period_end, year(period_end) * 4 + quarter(period_end) - 1 AS i FROM quarter_facts WHERE metric_id = 'order_value' AND period_type = 'QUARTER'),
span AS (SELECT entity, min(i) AS lo, max(i) AS hi, count(*) AS row_count, count(DISTINCT period_end) AS n, min(period_end) AS f, max(period_end) AS l FROM seen GROUP BY entity),
walk AS (SELECT s.entity, g.i, (g.i // 4) || 'Q' || (g.i % 4 + 1) AS label, EXISTS (SELECT 1 FROM seen x WHERE x.entity = s.entity AND x.i = g.i) AS hit
         FROM span s, LATERAL (SELECT unnest(range(s.lo, s.hi + 1)) AS i) g)
SELECT s.entity, s.row_count, CAST(s.n AS INTEGER) AS distinct_period_count, s.f AS first_period_end, s.l AS last_period_end,
       string_agg(w.label, '|' ORDER BY w.i) FILTER (WHERE hit) AS observed_quarters, coalesce(string_agg(w.label, '|' ORDER BY w.i) FILTER (WHERE NOT hit), '') AS missing_quarters
FROM span s JOIN walk w ON w.entity = s.entity GROUP BY ALL
""", uses=["quarter_facts"])
def _(t):
    facts = I.quarter_facts(t, ("order_value",)).filter("period_type = 'QUARTER'")
    out = Q.quarter_coverage(facts, ["entity"])
    return out.withColumns({"observed_quarters": joined("observed_quarters"), "missing_quarters": joined("missing_quarters")})


def _health(t):
    frames = {
        "orders": t.orders.select(as_date("o_orderdate").alias("date"), "o_orderkey"),
        "shipments": t.lineitem.select(as_date("l_shipdate").alias("reference_date"), "l_orderkey", "l_linenumber"),
        "documents": t.documents.select("doc_id", "lang"),
        "late_orders": t.orders.filter("o_totalprice < 0").select(as_date("o_orderdate").alias("period_end")),
        "invoices": None,
    }
    return Q.dataset_health(frames, ("reference_date", "period_end", "date"))


I.shared_sql("health", """
SELECT 'orders' AS dataset_id, 'AVAILABLE' AS status, count(*) AS row_count, 2 AS column_count, max(CAST(o_orderdate AS DATE)) AS latest_date FROM orders
UNION ALL SELECT 'shipments', 'AVAILABLE', count(*), 3, max(CAST(l_shipdate AS DATE)) FROM lineitem
UNION ALL SELECT 'documents', 'AVAILABLE', count(*), 2, NULL FROM documents
UNION ALL SELECT 'late_orders', 'EMPTY', count(*), 1, NULL FROM orders WHERE o_totalprice < 0
UNION ALL SELECT 'invoices', 'MISSING', NULL, NULL, NULL
""")


@query("dataset_health", "SELECT * FROM health", uses=["health"])
def _(t):
    return _health(t)


@query("health_rollup", """
SELECT business_domain, layer, status, count(*) AS dataset_count, max(latest_date) AS latest_date
FROM health JOIN (VALUES ('orders','Silver','Commerce'),('orders','Silver','Fintech'),('shipments','Silver','Commerce'),('documents','Bronze','Unassigned'),
  ('late_orders','Silver','Commerce'),('invoices','Gold','Fintech')) s(dataset_id, layer, business_domain) USING (dataset_id)
GROUP BY ALL
""", uses=["health"])
def _(t):
    return Q.health_rollup(_health(t), {
        "orders": ("Silver", ["Commerce", "Fintech"]), "shipments": ("Silver", ["Commerce"]), "documents": ("Bronze", []),
        "late_orders": ("Silver", ["Commerce"]), "invoices": ("Gold", ["Fintech"])})


@query("freshness", """
SELECT entity, max(period_end) AS latest_date FROM quarter_facts WHERE metric_id IN ('order_value', 'net_revenue') GROUP BY entity
""", uses=["quarter_facts"])
def _(t):
    return Q.freshness(I.quarter_facts(t, ("order_value", "net_revenue")), ["order_value", "net_revenue"], "period_end", ["entity"])


@query("missing_metrics", """
SELECT u.user_id, m.metric_id FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events) u, (VALUES ('click'),('view'),('signup'),('purchase'),('error'),('refund')) m(metric_id)
WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND e.event_type = m.metric_id) GROUP BY ALL
""")
def _(t):
    frame = t.events.select("user_id", F.col("event_type").alias("metric_id"))
    return Q.missing_metrics(frame, ["click", "view", "signup", "purchase", "error", "refund"], ["user_id"])


@query("category_counts", """
SELECT c.o_custkey, p.o_orderpriority, count(o.o_orderkey) AS row_count
FROM (SELECT DISTINCT o_custkey FROM orders) c CROSS JOIN (VALUES ('1-URGENT'),('2-HIGH'),('0-IMMEDIATE')) p(o_orderpriority)
LEFT JOIN orders o ON o.o_custkey = c.o_custkey AND o.o_orderpriority = p.o_orderpriority GROUP BY ALL
""")
def _(t):
    return Q.category_counts(t.orders, "o_orderpriority", ["1-URGENT", "2-HIGH", "0-IMMEDIATE"], ["o_custkey"])


# --- sources and sinks -----------------------------------------------------


@query("content_hash", """
SELECT page_id, sha256(html) AS content_sha256, CAST(strlen(html) AS INTEGER) AS byte_count,
       sha256('document|' || length(url) || ':' || url || length(html) || ':' || html) AS document_id FROM pages
""")
def _(t):
    return landing.with_content_hash(t.pages, "html", "url").select("page_id", "content_sha256", "byte_count", "document_id")


@query("document_pins", """
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, sha256(d.text) AS landed_sha256, l.h AS approved_sha256,
       CASE WHEN l.h IS NULL THEN 'UNKNOWN' WHEN sha256(d.text) = l.h THEN 'PINNED' ELSE 'HASH_MISMATCH' END AS status
FROM documents d LEFT JOIN (SELECT x.doc_id, CASE WHEN quality = 1 THEN sha256(text) ELSE sha256('revised ' || text) END AS h
  FROM labels x JOIN documents y ON y.doc_id = x.doc_id) l ON l.doc_id = d.doc_id
""")
def _(t):
    # The labelled documents are the approved list; low-quality ones were approved with other content.
    pinned = t.labels.join(t.documents, "doc_id").select(
        "doc_id", F.sha2(F.when(F.col("quality") == 1, F.col("text")).otherwise(F.concat(F.lit("revised "), "text")), 256).alias("content_sha256"))
    landed = t.documents.select("doc_id", F.sha2("text", 256).alias("content_sha256"))
    return landing.document_pins(landed, pinned, "doc_id")


@query("sink_stats", """
SELECT 'event_type' AS statistic, event_type AS value, count(*) AS row_count FROM events GROUP BY 2
UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR), count(*) FROM events GROUP BY 2
""")
def _(t):
    return sinks.sink_statistics(t.events, ["event_type", "user_id"])


@query("snapshot_export", """
SELECT entity, metric_id, period_type, period_start, period_end, value, filed_at, accession_number FROM (
  SELECT * FROM quarter_facts UNION ALL BY NAME SELECT * FROM instant_facts)
WHERE metric_id IN ('order_value', 'order_count_to_date') AND period_end <= DATE '2000-12-31' AND filed_at <= DATE '2001-01-31'
  AND ((metric_id = 'order_count_to_date' AND period_type = 'INSTANT')
    OR (metric_id <> 'order_count_to_date' AND period_type = 'QUARTER' AND period_start = date_trunc('quarter', period_end)))
""", uses=["quarter_facts", "instant_facts"])
def _(t):
    facts = I.quarter_facts(t, ("order_value",)).unionByName(I.instant_facts(t))
    out = sinks.snapshot_export(facts, ["order_value", "order_count_to_date"], ["order_count_to_date"], dt.date(2000, 12, 31), dt.date(2001, 1, 31))
    return out.select("entity", "metric_id", "period_type", "period_start", "period_end", "value", "filed_at", "accession_number")

"""Fact, series and evidence inputs derived from the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factweave.functions.dates import as_date, quarter_start
from factweave.plans.registry import Tables, shared_sql
from factweave.session import work_tasks

CHANGE_DATE = "1998-04-01"

# (period_type, period_label, first quarter, last quarter)
_SHAPES = (
    ("QUARTER", "Q1", 1, 1), ("QUARTER", "Q2", 2, 2), ("QUARTER", "Q3", 3, 3), ("QUARTER", "Q4", 4, 4),
    ("YTD", "H1", 1, 2), ("YTD", "9M", 1, 3), ("FY", "FY", 1, 4),
)
_UNITS = {
    "order_value": "USD", "order_count": "orders", "line_quantity": "items", "net_revenue": "USD",
    "order_count_to_date": "orders",
}
_LINE_METRICS = {"line_quantity", "net_revenue"}


def money(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)")


def _definition(start: Column, end: Column) -> Column:
    change = F.lit(CHANGE_DATE).cast("date")
    return (
        F.when(end < change, F.lit("v1"))
        .when(start.isNotNull() & (start < change), F.lit("v2_transition"))
        .otherwise(F.lit("v2"))
    )


def quarter_totals(t: Tables, lines: bool) -> DataFrame:
    """One row per customer and calendar quarter with order and line totals."""
    orders = t.orders.select(
        "o_orderkey",
        F.col("o_custkey").cast("string").alias("entity"),
        quarter_start(as_date("o_orderdate")).alias("quarter"),
        money("o_totalprice").alias("price"),
    )
    measures = [F.sum("price").alias("order_value"), F.count(F.lit(1)).alias("order_count")]
    if lines:
        per_order = t.lineitem.groupBy("l_orderkey").agg(
            F.sum(money("l_quantity")).alias("quantity"),
            F.sum(money("l_extendedprice") * (F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)"))).alias("net"),
        )
        orders = orders.join(per_order, orders.o_orderkey == per_order.l_orderkey, "left")
        measures += [
            F.coalesce(F.sum("quantity"), F.lit(0)).alias("line_quantity"),
            F.coalesce(F.sum("net"), F.lit(0)).alias("net_revenue"),
        ]
    return orders.groupBy("entity", "quarter").agg(*measures)


def _finish(rows: DataFrame) -> DataFrame:
    return rows.select(
        "entity", "metric_id", "unit", "period_type", "period_start", "period_end",
        F.year("period_end").alias("reference_year"), "period_label",
        _definition(F.col("period_start"), F.col("period_end")).alias("definition_version"),
        "value",
        F.date_add("period_end", F.lit(20) + (F.col("entity").cast("int") % 41)).alias("filed_at"),
        F.concat_ws("-", "entity", F.date_format("period_end", "yyyyMMdd"), "period_label").alias("accession_number"),
    )


def quarter_facts(t: Tables, metrics: tuple[str, ...] = ("order_value", "order_count", "line_quantity", "net_revenue")) -> DataFrame:
    """Duration facts (QUARTER, YTD, FY) per customer; line totals are joined only when asked for."""
    totals = quarter_totals(t, bool(_LINE_METRICS & set(metrics)))
    shapes = F.array(*[
        F.struct(F.lit(a).alias("period_type"), F.lit(b).alias("period_label"),
                 F.lit(c).alias("first"), F.lit(d).alias("last"))
        for a, b, c, d in _SHAPES
    ])
    year, number = F.year("quarter"), F.quarter("quarter")
    # Placed by entity once, a customer's few quarters need no further exchange for shapes, metrics and windows.
    # They become some eleven facts each, so few small partitions, joined by their bytes, would be large tasks.
    shaped = (
        totals.repartition(work_tasks(t.spark), "entity").withColumn("shape", F.explode(F.filter(shapes, lambda s: number.between(s["first"], s["last"]))))
        .select(
            "entity", "shape.period_type", "shape.period_label",
            F.make_date(year, (F.col("shape.first") - 1) * 3 + 1, F.lit(1)).alias("period_start"),
            F.last_day(F.make_date(year, F.col("shape.last") * 3, F.lit(1))).alias("period_end"),
            *metrics,
        )
        .groupBy("entity", "period_type", "period_label", "period_start", "period_end")
        .agg(*[F.sum(m).alias(m) for m in metrics])
    )
    long = shaped.withColumn("m", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric_id"), F.lit(_UNITS[m]).alias("unit"), F.col(m).cast("double").alias("value"))
        for m in metrics
    ]))).select("*", "m.*")
    return _finish(long)


def instant_facts(t: Tables) -> DataFrame:
    """INSTANT facts: orders to date per customer at quarter end (one row per quarter with orders)."""
    from pyspark.sql import Window

    # At most one row per customer and quarter reaches the window.
    running = Window.partitionBy("entity").orderBy("quarter").rowsBetween(Window.unboundedPreceding, 0)
    return _finish(
        quarter_totals(t, lines=False).select(
            "entity", F.lit("order_count_to_date").alias("metric_id"), F.lit("orders").alias("unit"),
            F.lit("INSTANT").alias("period_type"),
            F.lit(None).cast("date").alias("period_start"),
            F.last_day(F.add_months("quarter", 2)).alias("period_end"),
            F.concat(F.lit("Q"), F.quarter("quarter").cast("string")).alias("period_label"),
            F.sum("order_count").over(running).cast("double").alias("value"),
        )
    )


shared_sql("quarter_totals", """
SELECT CAST(o_custkey AS VARCHAR) AS entity, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter,
       sum(CAST(o_totalprice AS DECIMAL(18,2))) AS order_value, count(*) AS order_count,
       coalesce(sum(l.quantity), 0) AS line_quantity, coalesce(sum(l.net), 0) AS net_revenue
FROM orders LEFT JOIN (
  SELECT l_orderkey, sum(CAST(l_quantity AS DECIMAL(18,2))) AS quantity,
         sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (CAST(1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2)))) AS net
  FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o_orderkey
GROUP BY 1, 2
""")

_FINISH_SQL = f"""
  CASE WHEN period_end < DATE '{CHANGE_DATE}' THEN 'v1'
       WHEN period_start IS NOT NULL AND period_start < DATE '{CHANGE_DATE}' THEN 'v2_transition'
       ELSE 'v2' END AS definition_version,
  value,
  CAST(period_end + (20 + CAST(entity AS INTEGER) % 41) * INTERVAL 1 DAY AS DATE) AS filed_at,
  entity || '-' || strftime(period_end, '%Y%m%d') || '-' || period_label AS accession_number
"""

shared_sql("shaped_facts", """
SELECT entity, s.period_type, s.period_label,
       make_date(year(quarter), (s.f - 1) * 3 + 1, 1) AS period_start,
       last_day(make_date(year(quarter), s.l * 3, 1)) AS period_end,
       sum(order_value) AS order_value, sum(order_count) AS order_count,
       sum(line_quantity) AS line_quantity, sum(net_revenue) AS net_revenue
FROM quarter_totals JOIN (VALUES ('QUARTER','Q1',1,1),('QUARTER','Q2',2,2),('QUARTER','Q3',3,3),('QUARTER','Q4',4,4),
     ('YTD','H1',1,2),('YTD','9M',1,3),('FY','FY',1,4)) s(period_type, period_label, f, l)
  ON quarter(quarter) BETWEEN s.f AND s.l
GROUP BY ALL
""", uses=("quarter_totals",))

shared_sql("quarter_facts", f"""
SELECT entity, metric_id, unit, period_type, period_start, period_end, CAST(year(period_end) AS INTEGER) AS reference_year, period_label, {_FINISH_SQL}
FROM (
  SELECT entity, 'order_value' AS metric_id, 'USD' AS unit, period_type, period_start, period_end, period_label, CAST(order_value AS DOUBLE) AS value FROM shaped_facts
  UNION ALL SELECT entity, 'order_count', 'orders', period_type, period_start, period_end, period_label, CAST(order_count AS DOUBLE) FROM shaped_facts
  UNION ALL SELECT entity, 'line_quantity', 'items', period_type, period_start, period_end, period_label, CAST(line_quantity AS DOUBLE) FROM shaped_facts
  UNION ALL SELECT entity, 'net_revenue', 'USD', period_type, period_start, period_end, period_label, CAST(net_revenue AS DOUBLE) FROM shaped_facts)
""", uses=("shaped_facts",))

shared_sql("instant_facts", f"""
SELECT entity, metric_id, unit, period_type, period_start, period_end, CAST(year(period_end) AS INTEGER) AS reference_year, period_label, {_FINISH_SQL}
FROM (
  SELECT entity, 'order_count_to_date' AS metric_id, 'orders' AS unit, 'INSTANT' AS period_type, CAST(NULL AS DATE) AS period_start,
         last_day(CAST(quarter + INTERVAL 2 MONTH AS DATE)) AS period_end, 'Q' || quarter(quarter) AS period_label,
         CAST(sum(order_count) OVER (PARTITION BY entity ORDER BY quarter) AS DOUBLE) AS value
  FROM quarter_totals)
""", uses=("quarter_totals",))


def restatements(t: Tables) -> DataFrame:
    """Repeated filings of one economic key; (order, line) is not unique in the table."""
    return t.lineitem.select(
        F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("linenumber"),
        as_date("l_shipdate").alias("filed_at"),
        F.concat_ws(":", F.format_string("%08d", "l_partkey"), F.format_string("%08d", "l_suppkey")).alias("accession_number"),
        F.col("l_extendedprice").alias("value"),
        F.col("l_returnflag").alias("definition_version"),
    )


shared_sql("restatements", """
SELECT l_orderkey AS orderkey, l_linenumber AS linenumber, CAST(l_shipdate AS DATE) AS filed_at,
       printf('%08d', l_partkey) || ':' || printf('%08d', l_suppkey) AS accession_number,
       l_extendedprice AS value, l_returnflag AS definition_version
FROM lineitem
""")


def customer_months(t: Tables) -> DataFrame:
    """Monthly series per customer, dated at month end; months without orders are absent."""
    return (
        t.orders.groupBy(
            F.col("o_custkey").cast("string").alias("entity"),
            F.last_day(as_date("o_orderdate")).alias("reference_date"),
        )
        .agg(F.sum(money("o_totalprice")).cast("double").alias("value"), F.count(F.lit(1)).alias("orders"))
        .select(
            "entity", F.lit("order_value_monthly").alias("metric_id"), "reference_date", "value", "orders",
            F.lit("USD").alias("unit"), F.lit("monthly").alias("frequency"),
            F.lit("order ledger").alias("source"), F.concat(F.lit("ledger:"), "entity").alias("source_series_id"),
        )
    )


shared_sql("customer_months", """
SELECT CAST(o_custkey AS VARCHAR) AS entity, 'order_value_monthly' AS metric_id,
       last_day(CAST(o_orderdate AS DATE)) AS reference_date,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value, count(*) AS orders,
       'USD' AS unit, 'monthly' AS frequency, 'order ledger' AS source, 'ledger:' || o_custkey AS source_series_id
FROM orders GROUP BY o_custkey, last_day(CAST(o_orderdate AS DATE))
""")


def customer_days(t: Tables) -> DataFrame:
    """Daily series per customer with the day's order value."""
    return (
        t.orders.groupBy(F.col("o_custkey").cast("string").alias("entity"), as_date("o_orderdate").alias("reference_date"))
        .agg(F.sum(money("o_totalprice")).cast("double").alias("value"))
        .withColumn("metric_id", F.lit("order_value_daily"))
    )


shared_sql("customer_days", """
SELECT CAST(o_custkey AS VARCHAR) AS entity, CAST(o_orderdate AS DATE) AS reference_date,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value, 'order_value_daily' AS metric_id
FROM orders GROUP BY o_custkey, CAST(o_orderdate AS DATE)
""")


def user_prices(t: Tables) -> DataFrame:
    """Daily open/high/low/close per (event type, user) from the event values in time order."""
    by_time = F.struct("ts", "event_id")
    return (
        t.events.groupBy(
            F.concat_ws(":", "event_type", "user_id").alias("ticker"), as_date("ts").alias("reference_date"),
        )
        .agg(
            F.min_by("value", by_time).alias("open"), F.max("value").alias("high"),
            F.min("value").alias("low"), F.max_by("value", by_time).alias("close"),
            F.count(F.lit(1)).cast("double").alias("volume"),
        )
    )


shared_sql("user_prices", """
SELECT event_type || ':' || user_id AS ticker, CAST(ts AS DATE) AS reference_date,
       arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
       arg_max(value, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume
FROM events GROUP BY event_type || ':' || user_id, CAST(ts AS DATE)
""")


def share_facts(t: Tables) -> DataFrame:
    """Bitemporal facts: economic date = order date, known date = ship date (often earlier).

    Returned lines count negative, so they are facts that never qualify.
    """
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").cast("string").alias("entity"),
        as_date("o_orderdate").alias("reference_date"), as_date("l_shipdate").alias("filed_at"),
        F.concat_ws(":", F.format_string("%010d", "l_orderkey"), "l_linenumber").alias("accession_number"),
        F.when(F.col("l_returnflag") == "R", -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")).alias("value"),
    )


shared_sql("share_facts", """
SELECT CAST(o_custkey AS VARCHAR) AS entity, CAST(o_orderdate AS DATE) AS reference_date, CAST(l_shipdate AS DATE) AS filed_at,
       printf('%010d', l_orderkey) || ':' || l_linenumber AS accession_number,
       CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END AS value
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""")

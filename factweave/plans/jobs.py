"""Queries: load jobs from raw rows to a merged, versioned table, and checked scans."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from factweave.operators import evidence as E, normalise as N, quality as Q
from factweave.operators.quality import ContractViolation
from factweave.plans import evidence as PE, inputs as I
from factweave.plans.registry import query
from factweave.session import new_folder
from factweave.sources import scans
from factweave.sources.store import Store, Written

SERIES_KEY = ["entity", "metric_id", "reference_date"]
COLUMNS = (N.WideColumn("quantity", "order_count_monthly", "orders", 1, integral=True), N.WideColumn("amount", "order_value_monthly", "USD", 1000))


def load_series(wide: DataFrame, root: str) -> tuple[Store, Written]:
    """Wide monthly rows to the stored series: scaled, the clean rows merged, a conflicting run refused."""
    rows = N.unpivot_scaled(wide, ["entity"], "AnoMes", COLUMNS).filter("status = 'OK'").drop("status")
    store = Store(root, rows.schema, SERIES_KEY, bound="reference_date")
    return store, store.merge(rows, ["value", "unit"])[0]


def load_prices(rows: DataFrame, root: str, boundary: str) -> tuple[Store, Written]:
    """Daily prices of completed sessions to the stored table; keys whose copies disagree stay out."""
    sound = N.normalise_prices(N.completed_sessions(rows, F.lit(boundary).cast("date"))).filter("agrees").drop("agrees", "copies")
    store = Store(root, sound.schema, ["ticker", "reference_date"], partition=F.trunc("reference_date", "month"), bound="reference_date")
    return store, store.merge(sound, ["open", "high", "low", "close", "volume"])[0]


def _twice(spark: SparkSession, job, first, second, wrong, root: str) -> DataFrame:
    """Run a job on two batches, replay the second and offer a wrong one: rows of the final table, its version and what the last two did."""
    job(first, root)
    job(second, root)
    store, replay = job(second, root)
    try:
        job(wrong, root)
        refused = False
    except ContractViolation:
        refused = True
    return store.read(spark).withColumns({"version": F.lit(replay.version), "replay_wrote": F.lit(replay.written), "refused": F.lit(refused)})


@query("load_series_job", """
SELECT entity, metric_id, reference_date, value, unit, 2 AS version, FALSE AS replay_wrote, TRUE AS refused FROM (
  SELECT CAST(o_custkey AS VARCHAR) AS entity, last_day(CAST(o_orderdate AS DATE)) AS reference_date, 'order_count_monthly' AS metric_id, 'orders' AS unit, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1, 2
  UNION ALL SELECT CAST(o_custkey AS VARCHAR), last_day(CAST(o_orderdate AS DATE)), 'order_value_monthly', 'USD', CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) * 1000 AS DOUBLE) FROM orders GROUP BY 1, 2)
""")
def _(t):
    months = t.orders.groupBy(F.col("o_custkey").cast("string").alias("entity"), F.date_format("o_orderdate", "yyyyMM").alias("AnoMes")).agg(
        F.count(F.lit(1)).cast("string").alias("quantity"), F.sum(I.money("o_totalprice")).cast("string").alias("amount"))
    early = months.filter("AnoMes < '199807'")
    wrong = early.withColumn("quantity", (F.col("quantity").cast("int") + 1).cast("string"))
    return _twice(t.spark, load_series, early, months.filter("AnoMes >= '199801'"), wrong, new_folder(t.spark, "series"))


@query("load_prices_job", """
SELECT event_type AS ticker, CAST(ts AS DATE) AS reference_date, min(value) + 1 AS open, max(value) + 1 AS high, min(value) + 1 AS low, max(value) + 1 AS close, count(*) AS volume,
       2 AS version, FALSE AS replay_wrote, TRUE AS refused
FROM events GROUP BY 1, 2 HAVING CAST(ts AS DATE) < DATE '2024-01-29' AND min(value) + 1 > 0 AND (event_type <> 'click' OR day(CAST(ts AS DATE)) <> 5)
""")
def _(t):
    days = t.events.groupBy(F.col("event_type").alias("ticker"), F.col("ts").cast("date").alias("reference_date")).agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.count(F.lit(1)).alias("volume"))
    prices = days.select("ticker", "reference_date", (F.col("low") + 1).alias("open"), (F.col("high") + 1).alias("high"), (F.col("low") + 1).alias("low"), (F.col("high") + 1).alias("close"), "volume")
    # One session of one ticker has two copies that disagree, and another row breaks the contract.
    second_copy = prices.filter("ticker = 'click' AND day(reference_date) = 5").withColumn("volume", F.col("volume") + 1)
    broken = prices.filter("day(reference_date) = 7").withColumn("close", F.col("high") + 1)
    rows = prices.unionByName(second_copy).unionByName(broken)
    job = lambda df, root: load_prices(df, root, "2024-01-29")
    wrong = prices.filter("day(reference_date) = 9").withColumn("volume", F.col("volume") + 1)
    return _twice(t.spark, job, rows.filter("day(reference_date) < 15"), rows.filter("day(reference_date) >= 10"), wrong, new_folder(t.spark, "prices"))


@query("derived_series_contract", """
SELECT * FROM (SELECT entity, reference_date, concat_ws(',', CASE WHEN entity LIKE '%4' THEN 'value_finite' END, CASE WHEN entity LIKE '%1' THEN 'lineage_present' END,
       CASE WHEN entity LIKE '%2' THEN 'flag_complete' END, CASE WHEN entity LIKE '%3' THEN 'direction_known' END) AS violations FROM customer_months) WHERE violations <> ''
""", uses=["customer_months"])
def _(t):
    ends = lambda d: F.col("entity").endswith(d)
    rows = I.customer_months(t).withColumns({
        "value": F.when(ends("4"), F.lit(float("nan"))).otherwise(F.col("value")), "source_metric_id": F.lit("order_value"), "definition_context": F.when(ends("1"), F.lit(" ")).otherwise(F.lit("reported")),
        "direction_flag_id": F.when(~ends("2"), F.lit("direction")), "direction_value": F.when(ends("3"), F.lit("sideways")).otherwise(F.lit("rising"))})
    return Q.failed_rules(rows, Q.derived_series_rules()).select("entity", "reference_date", F.array_join("violations", ",").alias("violations"))


@query("scan_dimensions", "SELECT pestel_id, entity, reference_date, claim FROM dimensions WHERE pestel_dimension = 'SOCIAL' AND metric_id = 'fintech_mau_yoy_growth' AND reference_date >= DATE '1997-01-01'", uses=["dimensions"])
def _(t):
    rows = E.classify_dimensions(PE.stored_evidence(t)).filter("metric_id = 'fintech_mau_yoy_growth'")
    found = scans.scan_dimensions(rows, "SOCIAL", metric="fintech_mau", start=dt.date(1997, 1, 1))
    return found.select("pestel_id", "entity", "reference_date", "claim")


@query("scan_interpretations", "SELECT evidence_id, entity, reference_date, claim FROM single_interpretations WHERE business_domain = 'Commerce'", uses=["single_interpretations"])
def _(t):
    rows = PE.stored_evidence(t)
    everything = rows.unionByName(E.interpretations(rows))
    return scans.scan_interpretations(everything, domain="Commerce").select("evidence_id", "entity", "reference_date", "claim")

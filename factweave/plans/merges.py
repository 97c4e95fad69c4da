"""Queries: replay-safe merges and subset checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.functions.dates import as_date
from factweave.operators import merge as M
from factweave.plans import inputs as I
from factweave.plans.registry import query

_CUT = "1999-01-01"


def stored_and_incoming(t):
    """Stored months up to the cut; the incoming batch replays all months with urgent orders left out, and adds later ones."""
    def months(orders):
        return orders.groupBy(F.col("o_custkey").cast("string").alias("entity"), F.last_day(as_date("o_orderdate")).alias("reference_date")).agg(
            F.sum(I.money("o_totalprice")).cast("double").alias("value"),
            F.max(F.concat(F.lit("2020-01-"), F.lpad(F.dayofmonth("o_orderdate").cast("string"), 2, "0"))).alias("retrieved_at"))

    stored = months(t.orders.filter(F.col("o_orderdate") < _CUT))
    incoming = months(t.orders.filter(F.col("o_orderpriority") != "1-URGENT"))
    return stored, incoming


I.shared_sql("stored", f"""
SELECT CAST(o_custkey AS VARCHAR) AS entity, last_day(CAST(o_orderdate AS DATE)) AS reference_date, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value,
       max('2020-01-' || lpad(CAST(day(o_orderdate) AS VARCHAR), 2, '0')) AS retrieved_at
FROM orders WHERE o_orderdate < '{_CUT}' GROUP BY 1, 2
""")
I.shared_sql("incoming", """
SELECT CAST(o_custkey AS VARCHAR) AS entity, last_day(CAST(o_orderdate AS DATE)) AS reference_date, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS value,
       max('2020-01-' || lpad(CAST(day(o_orderdate) AS VARCHAR), 2, '0')) AS retrieved_at
FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1, 2
""")
_MERGE = """
SELECT coalesce(s.entity, n.entity) AS entity, coalesce(s.reference_date, n.reference_date) AS reference_date, {value} AS value, {retrieved} AS retrieved_at,
       CASE WHEN s.entity IS NULL THEN 'NEW' WHEN n.entity IS NOT NULL AND ({conflict}) THEN 'CONFLICT' ELSE 'KEPT' END AS merge_status
FROM stored s FULL OUTER JOIN incoming n ON s.entity = n.entity AND s.reference_date = n.reference_date
"""


@query("merge_append_only", _MERGE.format(value="coalesce(s.value, n.value)", retrieved="coalesce(s.retrieved_at, n.retrieved_at)", conflict="s.value <> n.value"), uses=["stored", "incoming"])
def _(t):
    stored, incoming = stored_and_incoming(t)
    return M.append_only(stored, incoming, ["entity", "reference_date"], ["value"])


@query("merge_keep_earliest", _MERGE.format(value="CASE WHEN n.retrieved_at < s.retrieved_at THEN n.value ELSE coalesce(s.value, n.value) END",
                                            retrieved="coalesce(least(s.retrieved_at, n.retrieved_at), s.retrieved_at, n.retrieved_at)", conflict="s.value <> n.value"), uses=["stored", "incoming"])
def _(t):
    stored, incoming = stored_and_incoming(t)
    return M.keep_earliest(stored, incoming, ["entity", "reference_date"], "retrieved_at")


@query("merge_by_identity", """
SELECT coalesce(s.id, n.id) AS id, coalesce(s.value, n.value) AS value, coalesce(s.retrieved_at, n.retrieved_at) AS retrieved_at,
       CASE WHEN s.id IS NULL THEN 'NEW' WHEN n.id IS NOT NULL AND (s.value <> n.value OR s.retrieved_at <> n.retrieved_at) THEN 'CONFLICT' ELSE 'KEPT' END AS merge_status
FROM (SELECT entity || '@' || reference_date AS id, value, retrieved_at FROM stored) s
FULL OUTER JOIN (SELECT entity || '@' || reference_date AS id, value, retrieved_at FROM incoming) n ON s.id = n.id
""", uses=["stored", "incoming"])
def _(t):
    stored, incoming = stored_and_incoming(t)
    identity = F.concat_ws("@", "entity", "reference_date").alias("id")
    return M.by_identity(stored.select(identity, "value", "retrieved_at"), incoming.select(identity, "value", "retrieved_at"), "id")


@query("rows_not_in_expected", """
SELECT a.entity, a.reference_date, a.value, count(*) AS actual_count, max((SELECT count(*) FROM stored e WHERE e.entity = a.entity AND e.reference_date = a.reference_date AND e.value = a.value)) AS expected_count
FROM incoming a GROUP BY ALL HAVING actual_count > 1 OR expected_count = 0
""", uses=["stored", "incoming"])
def _(t):
    stored, incoming = stored_and_incoming(t)
    columns = ["entity", "reference_date", "value"]
    return M.rows_outside(incoming.select(*columns), stored.select(*columns))

"""Queries: classifications and hypotheses over evidence in which every status occurs.

Every order becomes a small registry of its own: an observation, the fact it names, and records built
on them. The customer number plants what is wrong with it.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from factweave.operators import evidence as E, hypotheses as H
from factweave.plans import inputs as I
from factweave.plans.registry import query, shared_sql
from factweave.session import new_folder, stage
from factweave.sources import scans
from factweave.sources.store import IndexedTable, read_positions, write_ordered


def _text(prefix: str):
    return F.concat(F.lit(prefix), "o_orderkey")


def _orders(t, kinds: int) -> DataFrame:
    return t.orders.select("o_orderkey", "o_custkey", (F.col("o_custkey") % kinds).alias("flaw"), F.col("o_orderdate").cast("date").alias("day"), (F.col("o_totalprice") - 150000).alias("value"))


def _evidence(df: DataFrame, **columns) -> DataFrame:
    defaults = {"claim_kind": F.lit("level"), "source": F.lit("order ledger"), "methodology_version": F.lit("1"), "period_type": F.lit("MONTH"), "entity": F.col("o_custkey").cast("string"),
                "source_evidence_ids": F.array().cast("array<string>")}
    return E.normalise_evidence(E.as_evidence(df, **defaults | columns))


_NPL = "household_free_credit_npl_90d_rate;npl_15_90_total"


def flawed_evidence(t) -> DataFrame:
    """Observations of three metrics, the facts they name, and one more fact for records that stand on two."""
    rows = _orders(t, 13).withColumn("kind", F.col("o_orderkey") % 3)
    by_kind = lambda a, b, c: F.when(F.col("kind") == 0, a).when(F.col("kind") == 1, b).otherwise(c)
    metric = by_kind("pix_transactions_count_yoy_growth", "selic_target_change_pp", "gmv_yoy_growth")
    domain = by_kind("Macro", "Macro", "Commerce")
    claim_kind = by_kind(F.when(F.col("flaw") == 5, F.lit("yoy_growth")).otherwise(F.lit("technology_adoption")), F.lit("increase"), F.when(F.col("value") > 0, F.lit("yoy_growth")).otherwise(F.lit("yoy_decline")))
    flaw = lambda n: F.col("flaw") == n
    label = F.date_format("day", "yyyy-MM")
    observed = _evidence(
        rows, evidence_id=_text("o-"), evidence_type=F.lit("OBSERVATION"), business_domain=domain, metric_id=metric, reference_date=F.col("day"), period_label=label, claim_kind=claim_kind,
        value=F.col("value"), claim=F.concat(F.lit("Order "), "o_orderkey", F.when(flaw(6), F.lit(" drives growth.")).when(flaw(12), F.lit(" shows a weakness.")).otherwise(F.lit(" is reported."))),
        source_metric_id=F.when(flaw(4), F.lit(_NPL)).otherwise(metric), source_evidence_ids=F.array(F.when(flaw(0), _text("x-")).otherwise(_text("s-"))),
        definition_context=F.lit("technology_adoption;definition_version=1"))
    named = _evidence(
        rows, evidence_id=_text("s-"), evidence_type=F.lit("FACT"), business_domain=domain, metric_id=metric, period_label=label, reference_date=F.date_add("day", F.when(flaw(1), 1).otherwise(0)),
        claim=F.lit("fact"), definition_context=F.when(flaw(2), F.lit("definition_version=2")).otherwise(F.lit("definition_version=1")))
    more = _evidence(rows.filter("flaw = 7"), evidence_id=_text("t-"), evidence_type=F.lit("FACT"), business_domain=domain, metric_id=metric, period_label=label, reference_date=F.col("day"),
                     claim=F.lit("fact"), definition_context=F.lit("population=all"))
    return reduce(DataFrame.unionByName, [observed, named, more])


def further_dimensions(t, rows: DataFrame) -> DataFrame:
    """Records of other origin that name an observation: one that fits, and one flaw each."""
    flawed = _orders(t, 13).filter("flaw BETWEEN 7 AND 11 AND o_orderkey % 3 < 2")
    flaw = lambda n: F.col("flaw") == n
    pix = F.col("o_orderkey") % 3 == 0
    records = flawed.select(
        _text("p-").alias("pestel_id"), F.when(pix, F.lit("TECHNOLOGICAL")).otherwise(F.lit("ECONOMIC")).alias("pestel_dimension"),
        F.when(flaw(9), F.lit("Commerce")).otherwise(F.lit("Macro")).alias("business_domain"), F.when(flaw(10), F.date_add("day", 3)).otherwise(F.col("day")).alias("reference_date"),
        F.array(F.when(flaw(8), F.lit("another_metric")).when(pix, F.lit("pix_transactions_count_yoy_growth")).otherwise(F.lit("selic_target_change_pp"))).alias("source_metric_ids"),
        F.when(flaw(7), F.array(_text("o-"), _text("t-"))).otherwise(F.array(_text("o-"))).alias("source_evidence_ids"),
        F.when(flaw(11), F.lit("Definition_Version = 3")).otherwise(F.lit("definition_version=1")).alias("definition_context"), F.lit("OK").alias("status"))
    own = E.classify_dimensions(rows)
    return own.select(*records.columns).unionByName(records)


def classified(t):
    rows = stage(flawed_evidence(t), "flawed-evidence")
    dimensions = stage(further_dimensions(t, rows), "dimensions")
    return rows, dimensions, E.classify_quadrants(rows, dimensions)


shared_sql("flawed", """
SELECT o_orderkey AS k, o_orderkey % 3 AS kind, o_custkey % 13 AS flaw, CAST(o_orderdate AS DATE) AS day, o_totalprice - 150000 AS value,
       'o-' || o_orderkey AS o, CASE WHEN o_custkey % 13 = 0 THEN 'x-' ELSE 's-' END || o_orderkey AS s FROM orders
""")
shared_sql("flawed_quadrants", """
SELECT o AS evidence_id, CASE kind WHEN 0 THEN 'OPPORTUNITY' WHEN 1 THEN 'THREAT' ELSE CASE WHEN value > 0 THEN 'STRENGTH' ELSE 'WEAKNESS' END END AS swot_category,
       CASE WHEN kind < 2 THEN 'EXTERNAL' ELSE 'INTERNAL' END AS scope, day AS reference_date,
       o || ',' || s || CASE WHEN flaw = 7 AND kind < 2 THEN ',t-' || k ELSE '' END AS source_evidence_ids,
       CASE WHEN kind = 2 OR flaw = 0 OR flaw = 12 AND kind < 2 OR flaw = 5 AND kind = 0 THEN 0 ELSE 1 END + CASE WHEN kind < 2 AND flaw BETWEEN 7 AND 11 THEN 1 ELSE 0 END AS n_dimensions,
       CASE WHEN flaw = 0 THEN 'UNKNOWN_SOURCE' WHEN flaw = 4 THEN 'INCOMPATIBLE_METRICS' WHEN flaw = 1 THEN 'INCOMPATIBLE_PERIOD' WHEN flaw = 2 THEN 'INCOMPATIBLE_DEFINITION'
            WHEN kind < 2 AND flaw IN (8, 9) THEN 'INCOMPATIBLE_DIMENSION' WHEN kind < 2 AND flaw = 10 THEN 'INCOMPATIBLE_PERIOD' WHEN kind < 2 AND flaw = 11 THEN 'INCOMPATIBLE_DEFINITION'
            WHEN kind = 0 AND flaw = 5 OR kind < 2 AND flaw = 12 THEN 'NO_DIMENSION' WHEN flaw = 6 THEN 'FORBIDDEN_WORDING' ELSE 'OK' END AS status
FROM flawed WHERE value > 0 OR kind = 2 AND value < 0
""", uses=["flawed"])


@query("dimension_statuses", """
SELECT o AS evidence_id, CASE WHEN kind = 0 AND flaw <> 5 THEN 'TECHNOLOGICAL' ELSE 'ECONOMIC' END AS pestel_dimension, o || ',' || s AS source_evidence_ids,
       CASE WHEN flaw = 0 THEN 'OBSERVATION,' ELSE 'OBSERVATION,FACT' END AS source_evidence_types,
       CASE WHEN flaw = 0 THEN 'UNKNOWN_SOURCE' WHEN flaw = 12 THEN 'FORBIDDEN_WORDING' ELSE 'OK' END AS status FROM flawed WHERE kind < 2
UNION ALL SELECT 's-' || k, 'ECONOMIC', 's-' || k, 'FACT', 'OK' FROM flawed WHERE kind < 2
UNION ALL SELECT 't-' || k, 'ECONOMIC', 't-' || k, 'FACT', 'OK' FROM flawed WHERE kind < 2 AND flaw = 7
""", uses=["flawed"])
def _(t):
    found = E.classify_dimensions(flawed_evidence(t))
    types = F.array_join(F.transform("source_evidence_types", lambda x: F.coalesce(x, F.lit(""))), ",")
    return found.select("evidence_id", "pestel_dimension", F.array_join("source_evidence_ids", ",").alias("source_evidence_ids"), types.alias("source_evidence_types"), "status")


@query("quadrant_statuses", "SELECT * FROM flawed_quadrants", uses=["flawed_quadrants"])
def _(t):
    _, _, found = classified(t)
    return found.select("evidence_id", "swot_category", "scope", "reference_date", F.array_join("source_evidence_ids", ",").alias("source_evidence_ids"),
                        F.size("source_pestel_ids").alias("n_dimensions"), "status")


# --- hypotheses ---------------------------------------------------------------------------


def paired_evidence(t) -> DataFrame:
    """Per order a commerce and a fintech observation, each on a fact; flaws by customer."""
    rows = _orders(t, 12)
    flaw = lambda n: F.col("flaw") == n
    entity = F.col("o_orderkey").cast("string")
    base = {"entity": entity, "reference_date": F.col("day"), "period_label": F.date_format("day", "yyyy-MM"), "claim": F.lit("reported")}
    growth = {"evidence_type": F.lit("OBSERVATION"), "claim_kind": F.lit("yoy_growth"), "value": F.lit(1.0)}
    commerce = {"business_domain": F.lit("Commerce"), "metric_id": F.lit("gmv_yoy_growth"), "source_metric_id": F.lit("gmv")}
    fintech = {"business_domain": F.lit("Fintech"), "metric_id": F.lit("tpv_yoy_growth"), "source_metric_id": F.lit("tpv")}
    one = _evidence(rows, **base, **growth, **commerce, evidence_id=_text("c-"), source_evidence_ids=F.array(_text("a-")), definition_context=F.lit("definition_version=1;population=buyers"))
    two = _evidence(rows, **base | {"period_label": F.when(flaw(1), F.lit("other")).otherwise(base["period_label"])}, **growth, **fintech, evidence_id=_text("f-"),
                    source_evidence_ids=F.array(F.when(flaw(4), _text("x-")).otherwise(_text("b-"))),
                    definition_context=F.when(flaw(2), F.lit("definition_version=2")).otherwise(F.lit("definition_version=1;population=users")))
    again = _evidence(rows.filter("flaw = 0"), **base, **growth, **fintech, evidence_id=_text("g-"), definition_context=F.lit("x"))
    said = _evidence(rows.filter("flaw = 9"), **base, **growth | {"evidence_type": F.lit("INTERPRETATION")}, **fintech, evidence_id=_text("i-"), source_evidence_ids=F.array(_text("f-")), definition_context=F.lit("rule_based"))
    facts = [_evidence(rows, **base, **side | {"metric_id": side["source_metric_id"]}, evidence_type=F.lit("FACT"), evidence_id=_text(p), definition_context=F.lit("definition_version=1"))
             for p, side in (("a-", commerce), ("b-", fintech))]
    return reduce(DataFrame.unionByName, [one, two, again, said, *facts])


def strategy_records(t) -> tuple[DataFrame, DataFrame]:
    """Dimension and quadrant records that lie inside a hypothesis, half inside, or outside."""
    rows = _orders(t, 12)
    flaw = lambda n: F.col("flaw") == n
    common = [F.when(flaw(5), F.date_add("day", 1)).otherwise(F.col("day")).alias("reference_date"), F.when(flaw(8), F.lit("definition_version=7")).otherwise(F.lit("")).alias("definition_context"), F.lit("OK").alias("status")]
    ids = F.when(flaw(7), F.array(_text("c-"), _text("z-"))).when(flaw(10), F.array().cast("array<string>")).otherwise(F.array(_text("c-"), _text("a-"), _text("c-")))
    dimensions = rows.select(_text("d-").alias("pestel_id"), ids.alias("source_evidence_ids"), *common)
    quadrants = rows.filter("flaw IN (3, 6, 7)").select(
        _text("q-").alias("swot_id"), F.array(_text("b-"), _text("f-")).alias("source_evidence_ids"), F.array(_text("e-")).alias("source_pestel_ids"), F.lit("MONTH").alias("period_type"),
        F.when(flaw(3), F.lit("elsewhere")).otherwise(F.date_format("day", "yyyy-MM")).alias("period_label"), *common)
    return dimensions, quadrants


def products(t) -> DataFrame:
    return H.product_evidence(stage(paired_evidence(t), "paired-evidence"), *strategy_records(t), keep=lambda rows: stage(rows, "chosen"))


shared_sql("paired", """
SELECT *, CASE WHEN flaw IN (7, 10) THEN '' ELSE 'd-' || k END AS own_dimension, CASE WHEN flaw IN (3, 6, 7) THEN 'q-' || k ELSE '' END AS swots
FROM (SELECT o_orderkey AS k, o_custkey % 12 AS flaw, CAST(o_orderdate AS DATE) AS day FROM orders)
""")
shared_sql("paired_products", """
SELECT CAST(k AS VARCHAR) AS entity, day AS reference_date, kind AS product_evidence_type, 'MONTH' AS period_type,
       CASE flaw WHEN 0 THEN 'a-' || k || ',c-' || k || ',g-' || k WHEN 4 THEN 'a-' || k || ',c-' || k || ',f-' || k || ',x-' || k WHEN 9 THEN 'a-' || k || ',c-' || k || ',f-' || k || ',i-' || k
                 ELSE 'a-' || k || ',b-' || k || ',c-' || k || ',f-' || k END AS source_evidence_ids,
       CASE WHEN flaw = 9 THEN 'i-' || k ELSE '' END AS source_interpretation_ids, own_dimension || CASE WHEN swots <> '' AND own_dimension <> '' THEN ',' ELSE '' END || CASE WHEN swots <> '' THEN 'e-' || k ELSE '' END AS source_pestel_ids,
       swots AS source_swot_ids, 'gmv,tpv' AS source_metric_ids, kind <> 'HYPOTHESIS' AS has_parent,
       CASE flaw WHEN 0 THEN 'AMBIGUOUS' WHEN 1 THEN 'INCOMPATIBLE_PERIOD' WHEN 2 THEN 'INCOMPATIBLE_DEFINITION' WHEN 3 THEN 'INCOMPATIBLE_PERIOD' WHEN 4 THEN 'UNKNOWN_SOURCE'
                 WHEN 5 THEN 'INCOMPATIBLE_PERIOD' WHEN 8 THEN 'INCOMPATIBLE_DEFINITION' ELSE 'OK' END AS status
FROM paired, (SELECT unnest(['HYPOTHESIS', 'QUESTION_FOR_PRODUCT_DISCOVERY']) AS kind)
""", uses=["paired"])
_SHOWN = ("source_evidence_ids", "source_interpretation_ids", "source_pestel_ids", "source_swot_ids", "source_metric_ids")


def _shown(df: DataFrame) -> DataFrame:
    return df.select("entity", "reference_date", "product_evidence_type", "period_type", *[F.array_join(c, ",").alias(c) for c in _SHOWN], (F.size("source_hypothesis_ids") > 0).alias("has_parent"), "status")


@query("product_statuses", "SELECT * FROM paired_products", uses=["paired_products"])
def _(t):
    return _shown(products(t))


# --- scans of the stored classifications -----------------------------------------------------


def _least(df: DataFrame, condition: str) -> int:
    return df.filter(condition).agg(F.min("o_orderkey")).first()[0] or 0


def _labelled(parts: dict[str, DataFrame], *columns: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.select(F.lit(label).alias("scan"), *columns) for label, df in parts.items()])


@query("scan_quadrants", """
SELECT 'class' AS scan, evidence_id, status FROM flawed_quadrants WHERE swot_category = 'OPPORTUNITY' AND scope = 'EXTERNAL' AND reference_date >= DATE '1996-01-01'
UNION ALL SELECT 'evidence', q.evidence_id, status FROM flawed_quadrants q JOIN flawed f ON f.o = q.evidence_id WHERE f.k = (SELECT min(k) FROM flawed WHERE kind = 1 AND flaw = 3 AND value > 0)
UNION ALL SELECT 'dimension', q.evidence_id, status FROM flawed_quadrants q JOIN flawed f ON f.o = q.evidence_id WHERE f.k = (SELECT min(k) FROM flawed WHERE kind = 0 AND flaw = 7 AND value > 0)
""", uses=["flawed", "flawed_quadrants"])
def _(t):
    _, _, found = classified(t)
    table = IndexedTable.write(found, new_folder(t.spark, "quadrants"), ["source_evidence_ids", "source_pestel_ids"], ["evidence_id"])
    rows = _orders(t, 13)
    named = _least(rows, "o_orderkey % 3 = 1 AND flaw = 3 AND value > 0")
    linked = _least(rows, "o_orderkey % 3 = 0 AND flaw = 7 AND value > 0")
    scan = lambda **arguments: scans.scan_members(table, t.spark, scans.scan_quadrants, **arguments)
    return _labelled({
        "class": scan(category="OPPORTUNITY", scope="EXTERNAL", start=dt.date(1996, 1, 1)), "evidence": scan(source_evidence_id=f"s-{named}"), "dimension": scan(source_pestel_id=f"p-{linked}"),
    }, "evidence_id", "status")


@query("scan_products", """
SELECT 'kind' AS scan, entity, product_evidence_type, status FROM paired_products WHERE product_evidence_type = 'HYPOTHESIS' AND reference_date <= DATE '1995-12-31'
UNION ALL SELECT 'evidence', entity, product_evidence_type, status FROM paired_products WHERE entity = (SELECT CAST(min(k) AS VARCHAR) FROM paired WHERE flaw = 11)
UNION ALL SELECT 'interpretation', entity, product_evidence_type, status FROM paired_products WHERE entity = (SELECT CAST(min(k) AS VARCHAR) FROM paired WHERE flaw = 9)
UNION ALL SELECT 'dimension', entity, product_evidence_type, status FROM paired_products WHERE entity = (SELECT CAST(min(k) AS VARCHAR) FROM paired WHERE flaw = 6)
UNION ALL SELECT 'quadrant', entity, product_evidence_type, status FROM paired_products WHERE entity = (SELECT CAST(min(k) AS VARCHAR) FROM paired WHERE flaw = 7)
UNION ALL SELECT 'hypothesis', entity, product_evidence_type, status FROM paired_products WHERE product_evidence_type <> 'HYPOTHESIS' AND entity = (SELECT CAST(min(k) AS VARCHAR) FROM paired WHERE flaw = 11)
""", uses=["paired", "paired_products"])
def _(t):
    ids = ["source_evidence_ids", "source_interpretation_ids", "source_pestel_ids", "source_swot_ids", "source_hypothesis_ids"]
    table = IndexedTable.write(products(t), new_folder(t.spark, "products"), ids, ["entity"])
    rows = _orders(t, 12)
    first = {flaw: _least(rows, f"flaw = {flaw}") for flaw in (6, 7, 9, 11)}
    scan = lambda **arguments: scans.scan_members(table, t.spark, scans.scan_products, **arguments)
    parent = scan(kind="HYPOTHESIS", source_evidence_id=f"c-{first[11]}").select("product_evidence_id").first()
    return _labelled({
        "kind": scan(kind="HYPOTHESIS", end=dt.date(1995, 12, 31)), "evidence": scan(source_evidence_id=f"c-{first[11]}"), "interpretation": scan(source_interpretation_id=f"i-{first[9]}"),
        "dimension": scan(source_pestel_id=f"e-{first[6]}"), "quadrant": scan(source_swot_id=f"q-{first[7]}"), "hypothesis": scan(source_hypothesis_id=parent[0] if parent else "none"),
    }, "entity", "product_evidence_type", "status")


_ORDER = "metric_id NULLS LAST, period_end NULLS LAST, period_start NULLS FIRST, entity, value"


@query("ordered_store", f"""
SELECT row_number() OVER (ORDER BY {_ORDER}) AS position, metric_id, period_end, period_start, entity, value FROM (
  SELECT metric_id, period_end, period_start, entity, value FROM quarter_facts UNION ALL SELECT 'order_count', period_end, NULL, entity, value FROM instant_facts)
""", uses=["quarter_facts", "instant_facts"])
def _(t):
    columns = ["metric_id", "period_end", "period_start", "entity", "value"]
    instants = I.instant_facts(t).withColumns({"metric_id": F.lit("order_count"), "period_start": F.lit(None).cast("date")})
    rows = I.quarter_facts(t).select(*columns).unionByName(instants.select(*columns))
    path = new_folder(t.spark, "ordered")
    order = [F.col("metric_id").asc_nulls_last(), F.col("period_end").asc_nulls_last(), F.col("period_start").asc_nulls_first(), F.col("entity"), F.col("value")]
    write_ordered(rows, path, order)
    return read_positions(t.spark, path, rows.schema)

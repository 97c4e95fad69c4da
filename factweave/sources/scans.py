"""Scans of stored datasets. Filters and columns reach the Parquet reader."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from factweave.operators.selection import check_bounds
from factweave.sources.store import IndexedTable


class SchemaMismatch(ValueError):
    pass


def read_typed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Read Parquet whose stored columns and types must equal `schema`."""
    stored = spark.read.parquet(path).schema
    have = [(f.name, f.dataType) for f in stored]
    want = [(f.name, f.dataType) for f in schema]
    if have != want:
        raise SchemaMismatch(f"stored columns {have} differ from {want}")
    return spark.read.schema(schema).parquet(path)


def scan_facts(facts: DataFrame, metric: str | None = None, period_type: str | None = None,
               definition_version: str | None = None, first_year: int | None = None, ordered: bool = False) -> DataFrame:
    """Fact rows by optional equality filters and a lower year bound."""
    if metric is not None:
        facts = facts.filter(F.col("metric_id") == metric)
    if period_type is not None:
        facts = facts.filter(F.col("period_type") == period_type)
    if definition_version is not None:
        facts = facts.filter(F.col("definition_version") == definition_version)
    if first_year is not None:
        facts = facts.filter(F.col("reference_year") >= first_year)
    return order_facts(facts) if ordered else facts


def order_facts(facts: DataFrame) -> DataFrame:
    """The stored order of fact outputs: instants first within a period end. For sinks and reports only."""
    return facts.orderBy(F.col("metric_id").asc_nulls_last(), F.col("period_end").asc_nulls_last(), F.col("period_start").asc_nulls_first())


def scan_series(series: DataFrame, metric: str | None = None, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """Series rows in an inclusive date window; inverted bounds are refused before planning."""
    check_bounds(start, end)
    if metric is not None:
        series = series.filter(F.col("metric_id") == metric)
    if start is not None:
        series = series.filter(F.col("reference_date") >= F.lit(start))
    if end is not None:
        series = series.filter(F.col("reference_date") <= F.lit(end))
    return series


def scan_evidence(evidence: DataFrame, evidence_type: str | None = None, domain: str | None = None, metric: str | None = None,
                  start: dt.date | None = None, end: dt.date | None = None, members: dict[str, str] | None = None,
                  equals: dict[str, str] | None = None) -> DataFrame:
    """Evidence or classification rows; `members` maps a lineage array column to an id it must hold.

    Membership is tested on real arrays before any sort.
    """
    check_bounds(start, end)
    for column, value in {"evidence_type": evidence_type, "business_domain": domain, **(equals or {})}.items():
        if value is not None:
            evidence = evidence.filter(F.col(column) == value)
    if metric is not None:
        listed = F.array_contains("source_metric_ids", metric) if "source_metric_ids" in evidence.columns else F.col("metric_id") == metric
        evidence = evidence.filter(listed)
    if start is not None:
        evidence = evidence.filter(F.col("reference_date") >= F.lit(start))
    if end is not None:
        evidence = evidence.filter(F.col("reference_date") <= F.lit(end))
    for column, value in (members or {}).items():
        evidence = evidence.filter(F.array_contains(column, value))
    return evidence


# --- fixed values: classes that the classified tables may hold -----------------
DIMENSIONS = ("POLITICAL", "ECONOMIC", "SOCIAL", "TECHNOLOGICAL", "ENVIRONMENTAL", "LEGAL")
QUADRANTS = ("STRENGTH", "WEAKNESS", "OPPORTUNITY", "THREAT")
SCOPES = ("INTERNAL", "EXTERNAL")
PRODUCT_TYPES = ("HYPOTHESIS", "QUESTION_FOR_PRODUCT_DISCOVERY")


def _known(name: str, value: str | None, allowed: Sequence[str]) -> None:
    if value is not None and value not in allowed:
        raise ValueError(f"unknown {name} {value!r}")


def scan_dimensions(rows: DataFrame, dimension: str | None = None, source_evidence_id: str | None = None, **filters) -> DataFrame:
    """Six-dimension rows; an unknown dimension is refused before anything is read."""
    _known("dimension", dimension, DIMENSIONS)
    return scan_evidence(rows, equals={"pestel_dimension": dimension}, members=_members(source_evidence_ids=source_evidence_id), **filters)


def scan_quadrants(rows: DataFrame, category: str | None = None, scope: str | None = None, source_evidence_id: str | None = None,
                   source_pestel_id: str | None = None, **filters) -> DataFrame:
    """Quadrant rows; unknown categories and scopes are refused before anything is read."""
    _known("category", category, QUADRANTS)
    _known("scope", scope, SCOPES)
    return scan_evidence(rows, equals={"swot_category": category, "scope": scope},
                         members=_members(source_evidence_ids=source_evidence_id, source_pestel_ids=source_pestel_id), **filters)


def scan_products(rows: DataFrame, kind: str | None = None, source_evidence_id: str | None = None, source_interpretation_id: str | None = None,
                  source_pestel_id: str | None = None, source_swot_id: str | None = None, source_hypothesis_id: str | None = None, **filters) -> DataFrame:
    """Hypotheses and questions; an unknown kind is refused before anything is read."""
    _known("kind", kind, PRODUCT_TYPES)
    members = _members(source_evidence_ids=source_evidence_id, source_interpretation_ids=source_interpretation_id, source_pestel_ids=source_pestel_id,
                       source_swot_ids=source_swot_id, source_hypothesis_ids=source_hypothesis_id)
    return scan_evidence(rows, equals={"product_evidence_type": kind}, members=members, **filters)


def scan_members(table: IndexedTable, spark: SparkSession, scan, **arguments) -> DataFrame:
    """A classified scan of a stored table whose id filters read only the buckets that the table's index names."""
    ids = {f"{name}s": value for name, value in arguments.items() if name.startswith("source_") and value is not None}
    return scan(table.scan(spark, **ids), **arguments)


def _members(**ids: str | None) -> dict[str, str]:
    return {column: value for column, value in ids.items() if value is not None}


def scan_interpretations(evidence: DataFrame, **filters) -> DataFrame:
    return scan_evidence(evidence, evidence_type="INTERPRETATION", **filters)


def upgrade_legacy_series(series: DataFrame, prefix: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Older tables carry a numeric `series_code` instead of `source_series_id`."""
    if "source_series_id" in series.columns or "series_code" not in series.columns:
        return series
    upgraded = series.withColumn(
        "source_series_id", F.concat(F.lit(f"{prefix}:"), F.col("series_code").cast("bigint").cast("string"))
    ).drop("series_code")
    return upgraded.select(*columns) if columns else upgraded


def lineage_preview(df: DataFrame, columns: Sequence[str], n: int = 5) -> DataFrame:
    """A few rows of the provenance columns that exist."""
    return df.select(*[c for c in columns if c in df.columns]).limit(n)

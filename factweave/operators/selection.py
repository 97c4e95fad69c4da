"""Filters, latest rows, priority signals and top-k reports."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from factweave.functions.numbers import is_finite

DATE_COLUMNS = ("reference_date", "period_end", "date")


def check_bounds(start: dt.date | None, end: dt.date | None) -> None:
    if start is not None and end is not None and start > end:
        raise ValueError("start date is after end date")


def apply_filters(df: DataFrame, domain: str | None = None, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """Domain equality and an inclusive window on the first date column present.

    A filter whose column the frame lacks is skipped.
    """
    check_bounds(start, end)
    if domain is not None and "business_domain" in df.columns:
        df = df.filter(F.col("business_domain") == domain)
    date = next((c for c in DATE_COLUMNS if c in df.columns), None)
    if date:
        if start is not None:
            df = df.filter(F.col(date) >= F.lit(start))
        if end is not None:
            df = df.filter(F.col(date) <= F.lit(end))
    return df


def trend(facts: DataFrame, metric: str, period_type: str | None = None, date: str = "period_end") -> DataFrame:
    """One metric of one period type, finite values only, nothing filled; sort at the sink by `date`."""
    rows = facts.filter((F.col("metric_id") == metric) & is_finite(F.col("value")))
    return rows.filter(F.col("period_type") == period_type) if period_type and "period_type" in facts.columns else rows


def latest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """Row with the greatest `order` per key; partial aggregation keeps one row per key and task."""
    return (
        df.groupBy(*keys).agg(F.max(F.struct(*order, *carry)).alias("_top"))
        .select(*keys, *[F.col(f"_top.{c}").alias(c) for c in (*order, *carry)])
    )


def priority_signal(facts: DataFrame, candidates: Mapping[str, Sequence[str]], keys: Sequence[str] = ("entity",)) -> DataFrame:
    """Per domain the first listed metric that has any row, then its latest row.

    A latest value that is not finite drops the domain instead of falling back.
    """
    pairs = [(d, m, i) for d, ms in candidates.items() for i, m in enumerate(ms)]
    spec = F.create_map(*[
        x for d, m, i in pairs for x in (F.lit(m), F.struct(F.lit(d).alias("business_domain"), F.lit(-i).alias("rank")))
    ])
    rows = facts.filter(F.col("metric_id").isin(*[m for _, m, _ in pairs])).withColumn("_s", spec[F.col("metric_id")])
    top = (
        rows.select(*keys, "_s.business_domain", F.struct(
            F.col("_s.rank").alias("rank"), "period_end", "filed_at", "accession_number", "metric_id", "value", "unit", "period_label").alias("r"))
        .groupBy(*keys, "business_domain").agg(F.max("r").alias("r"))
    )
    return top.filter(is_finite(F.col("r.value"))).select(
        *keys, "business_domain", "r.metric_id", "r.period_end", "r.period_label", "r.value", "r.unit")


def latest_only(derived: DataFrame, latest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Derived rows that belong to the latest selected point."""
    return derived.join(latest.select(*keys), list(keys), "left_semi")


def last_n(df: DataFrame, keys: Sequence[str], date: str, n: int = 12) -> DataFrame:
    """The n newest points of every series; Spark limits each task before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.col(date).desc_nulls_last())
    return df.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= n).drop("_rank")


def top_recent(df: DataFrame, date: str, identity: str, k: int) -> DataFrame:
    """k newest records, ids ascending within a date."""
    return df.orderBy(F.col(date).desc_nulls_last(), F.col(identity).asc_nulls_last()).limit(k)


def category_rank(category: Column, order: Sequence[str]) -> Column:
    """Position in a custom category order; unlisted categories come last."""
    position = F.array_position(F.array(*[F.lit(c) for c in order]), category)
    return F.when(position > 0, position).otherwise(F.lit(len(order) + 1))


def top_by_category(df: DataFrame, category: str, order: Sequence[str], date: str, identity: str, k: int) -> DataFrame:
    return df.orderBy(
        category_rank(F.col(category), order).asc(), F.col(date).desc_nulls_last(), F.col(identity).asc_nulls_last()
    ).limit(k)

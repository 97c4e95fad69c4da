"""Restatement canonicalisation and agreement of duplicated keys.

One `groupBy` per operator, no window: a key with many filings collapses
map-side, so a hot key never becomes one task's sort.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Literal

from pyspark.sql import Column, DataFrame, functions as F


def latest_filing_wins(facts: DataFrame, key: Sequence[str], filed: str = "filed_at", accession: str = "accession_number",
                       value: str = "value", change: Literal["any", "endpoints"] = "any", carry: Sequence[str] = ()) -> DataFrame:
    """Latest (filed, accession) presentation per key with its revision history.

    `change="any"` flags a key once more than one distinct value was ever filed,
    null counting as a value (A -> B -> A is a change). `change="endpoints"`
    compares only the first and the last value (A -> B -> A is none). Null filing
    dates and accessions sort first; the value breaks remaining ties, so input
    order never matters.
    """
    v = F.col(value)
    order = (F.col(filed).alias("filed"), F.coalesce(F.col(accession), F.lit("")).alias("accession"), v.alias("value"))
    grouped = facts.groupBy(*key).agg(
        F.max(F.struct(*order, *carry)).alias("last"), F.min(F.struct(*order)).alias("first"),
        F.count(F.lit(1)).alias("occurrences"),
        F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.count(v).alias("_present"),
    )
    last, first = F.col("last.value"), F.col("first.value")
    if change == "any":
        mixed_null = (F.col("_present") > 0) & (F.col("_present") < F.col("occurrences"))
        changed = F.coalesce(F.col("_lo") != F.col("_hi"), F.lit(False)) | mixed_null
    else:
        changed = ~last.eqNullSafe(first)
    blank_to_null = lambda c: F.when(c != "", c)
    return grouped.select(
        *key, last.alias(value), F.col("last.filed").alias(filed), blank_to_null(F.col("last.accession")).alias(accession),
        *[F.col(f"last.{c}").alias(c) for c in carry], "occurrences",
        first.alias("first_reported_value"), F.col("first.filed").alias("first_filed_at"),
        blank_to_null(F.col("first.accession")).alias("first_accession_number"),
        changed.alias("has_value_change"), (last - first).alias("value_change"),
    )


def agree(low: Column, high: Column) -> Column:
    return low.eqNullSafe(high)


def duplicate_agreement(df: DataFrame, key: Sequence[str], compare: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the survivor by `order`, the number of copies and whether all copies agree on `compare`.

    Nulls agree with nulls.
    """
    fields = F.struct(*compare)
    rest = [c for c in df.columns if c not in key and c not in order]
    grouped = df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("copies"), F.min(fields).alias("_lo"), F.max(fields).alias("_hi"),
        F.min(F.struct(*order, *rest)).alias("_keep"),
    )
    return grouped.select(*key, *[F.col(f"_keep.{c}").alias(c) for c in (*order, *rest)], "copies",
                          agree(F.col("_lo"), F.col("_hi")).alias("agrees"))

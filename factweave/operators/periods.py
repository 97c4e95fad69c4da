"""Calendar-exact comparison of periods.

Pairing runs on a window whose partition key holds everything but the year (or
month) and whose frame is exactly one step back, so a gap stays a gap. With a
unique key a partition holds one row per year or month of the calendar; a hot
entity therefore spreads over its own metrics and period shapes. Rows that are not
known to be unique go through `split_unique` first, which collapses duplicates
before they travel.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from factweave.functions.dates import calendar_signature, month_day, month_index
from factweave.functions.numbers import is_finite
from factweave.operators.quality import duplicate_keys, require_empty, split_unique

PERIOD_KEY = ["period_start", "period_end", "reference_year", "period_type", "period_label"]
YOY_FORMULA = "(current_value / previous_year_value - 1) * 100"
METHODOLOGY_VERSION = "1"


def with_prior(df: DataFrame, keys: Sequence[str], step: Column, back: int, columns: Sequence[str], unique: bool,
               keep_unpaired: bool = False, strict: bool = False) -> DataFrame:
    """Attach `prior_<column>` from exactly `back` steps earlier; rows without one leave.

    Keys occupied twice at either step are ambiguous and leave as well, or with `strict`
    stop the whole comparison. With `keep_unpaired` all rows stay and `paired` tells them
    apart.
    """
    rows = df.withColumn("_step", step)
    if strict:
        require_empty(duplicate_keys(rows, [*keys, "_step"]), "periods that occur twice")
    if not unique:
        rows = split_unique(rows, [*keys, "_step"])
    order = Window.partitionBy(*keys).orderBy("_step")
    here, before = order.rangeBetween(0, 0), order.rangeBetween(-back, -back)
    walked = (
        rows.withColumn("_here", F.count(F.lit(1)).over(here))
        .withColumn("_before", F.count(F.lit(1)).over(before))
        .withColumns({f"prior_{c}": F.first(c).over(before) for c in columns})
    )
    if keep_unpaired:
        return walked.withColumn("paired", F.expr("_here = 1 AND _before = 1")).drop("_step", "_here", "_before")
    return walked.filter("_here = 1 AND _before = 1").drop("_step", "_here", "_before")


def comparison_family(metric: Column, version: Column, families: Mapping[str, Mapping[str, str]]) -> Column:
    """Definition versions that may be compared share a family; others stand alone."""
    family = version
    for name, versions in families.items():
        lookup = F.create_map(*[x for v, f in versions.items() for x in (F.lit(v), F.lit(f))])
        family = F.when(metric == name, F.coalesce(F.try_element_at(lookup, version), version)).otherwise(family)
    return family


def definition_context(current: Column, prior: Column) -> Column:
    return F.when(current == prior, current).otherwise(F.concat(current, F.lit(";prior="), prior))


def growth_percent(current: Column, base: Column) -> Column:
    return (current / base - F.lit(1.0)) * F.lit(100.0)


def _shape(facts: DataFrame, keys: Sequence[str], families) -> tuple[DataFrame, list[str]]:
    shaped = facts.withColumn("_signature", calendar_signature(F.col("period_start"), F.col("period_end")))
    partition = [*keys, "metric_id", "unit", "period_type", "_signature"]
    if families is not None:
        shaped = shaped.withColumn("_family", comparison_family(F.col("metric_id"), F.col("definition_version"), families))
        partition.append("_family")
    return shaped, partition


def ambiguous_periods(facts: DataFrame, keys: Sequence[str] = ("entity",), families=None) -> DataFrame:
    """Period shapes that occur twice in one economic year."""
    shaped, partition = _shape(facts, keys, families)
    return duplicate_keys(shaped.withColumn("economic_year", F.year("period_end")), [*partition, "economic_year"])


def paired_years(facts: DataFrame, keys: Sequence[str] = ("entity",), metrics: Sequence[str] | None = None,
                 families: Mapping[str, Mapping[str, str]] | None = None, period_types: Sequence[str] | None = None,
                 carry: Sequence[str] = (), unique: bool = False, keep_unpaired: bool = False, strict: bool = False) -> DataFrame:
    """Every period with the same-shaped period of the year before.

    The year is that of `period_end`. With `families`, definition versions of
    different families never pair.
    """
    if metrics is not None:
        facts = facts.filter(F.col("metric_id").isin(*metrics))
    if period_types is not None:
        facts = facts.filter(F.col("period_type").isin(*period_types))
    shaped, partition = _shape(facts, keys, families)
    columns = ["value", *carry] + (["definition_version"] if families is not None else [])
    return with_prior(shaped, partition, F.year("period_end"), 1, columns, unique, keep_unpaired, strict).drop("_signature", "_family")


def yoy_growth(facts: DataFrame, keys: Sequence[str] = ("entity",), metrics: Sequence[str] | None = None,
               families: Mapping[str, Mapping[str, str]] | None = None,
               period_types: Sequence[str] | None = ("QUARTER", "YTD", "FY"), unique: bool = False, strict: bool = False) -> DataFrame:
    """Year-over-year growth in percent on a positive base; `strict` refuses ambiguous periods."""
    paired = paired_years(facts, keys, metrics, families, period_types, unique=unique, strict=strict)
    base = F.col("prior_value")
    paired = paired.filter(~F.isnan(base) & (base > 0))
    return derived(
        paired, keys, metric=F.concat("metric_id", F.lit("_yoy_growth")), value=growth_percent(F.col("value"), base),
        unit="percent", formula=F.lit(YOY_FORMULA), sources=F.col("metric_id"),
        context=definition_context(F.col("definition_version"), F.col("prior_definition_version")) if families is not None else None,
    )


def yoy_difference(facts: DataFrame, keys: Sequence[str] = ("entity",), metrics: Sequence[str] | None = None,
                   families: Mapping[str, Mapping[str, str]] | None = None, unique: bool = False) -> DataFrame:
    """Year-over-year change in percentage points; any base."""
    paired = paired_years(facts, keys, metrics, families, unique=unique)
    return derived(
        paired, keys, metric=F.concat("metric_id", F.lit("_yoy_change_pp")), value=F.col("value") - F.col("prior_value"),
        unit="percentage_points",
        formula=F.concat(F.lit("current_"), "metric_id", F.lit(" - previous_year_"), "metric_id"), sources=F.col("metric_id"),
        context=definition_context(F.col("definition_version"), F.col("prior_definition_version")) if families is not None else None,
    )


def yoy_qualified(facts: DataFrame, keys: Sequence[str] = ("entity",), points: bool = False, unique: bool = False) -> DataFrame:
    """Year-over-year change of qualified snapshots; both sides exact and of one scope.

    The qualifier is judged after pairing, so an approximate prior is not skipped
    in favour of an older exact one.
    """
    rows = facts.filter(F.col("period_type") == "INSTANT").withColumn("_md", month_day(F.col("period_end")))
    paired = with_prior(rows, [*keys, "metric_id", "unit", "scope", "_md"], F.year("period_end"), 1,
                        ["value", "value_qualifier"], unique)
    paired = paired.filter((F.col("value_qualifier") == "exact") & (F.col("prior_value_qualifier") == "exact"))
    context = F.concat(F.lit("scope="), "scope", F.lit(";current_qualifier="), "value_qualifier",
                       F.lit(";prior_qualifier="), "prior_value_qualifier")
    if points:
        value, unit, suffix, formula = F.col("value") - F.col("prior_value"), "percentage_points", "_yoy_change_pp", "current_value - previous_year_value"
    else:
        base = F.col("prior_value")
        paired = paired.filter(~F.isnan(base) & (base > 0))
        value, unit, suffix, formula = growth_percent(F.col("value"), base), "percent", "_yoy_growth", YOY_FORMULA
    return derived(paired, keys, metric=F.concat("metric_id", F.lit(suffix)), value=value, unit=unit,
                   formula=F.lit(formula), sources=F.col("metric_id"), context=context)


def derived(df: DataFrame, keys: Sequence[str], metric: Column, value: Column, unit, formula: Column, sources: Column,
            context: Column | None = None, is_derived: bool = True) -> DataFrame:
    """Shape derived rows: period key, value, lineage literals."""
    columns = [
        *keys, metric.alias("metric_id"), *PERIOD_KEY, value.alias("value"),
        (unit if isinstance(unit, Column) else F.lit(unit)).alias("unit"), formula.alias("formula"), sources.alias("source_metrics"),
        F.lit(is_derived).alias("is_derived"), F.lit(METHODOLOGY_VERSION).alias("methodology_version"),
    ]
    if context is not None:
        columns.append(context.alias("definition_context"))
    return df.select(*columns)


def month_change(series: DataFrame, keys: Sequence[str] = ("entity", "metric_id"), back: int = 1, percent: bool = True,
                 unique: bool = False) -> DataFrame:
    """Change against the previous month (`back=1`) or the same month last year (`back=12`).

    A missing month gives no row. With `percent`, a zero base gives no row; see
    `zero_base_months` for callers that must reject it.
    """
    paired = with_prior(series, keys, month_index(F.col("reference_date")), back, ["value", "reference_date"], unique)
    base = F.col("prior_value")
    if percent:
        paired = paired.filter(base != 0)
    change = growth_percent(F.col("value"), base) if percent else F.col("value") - base
    return paired.select(
        *keys, "reference_date", change.alias("change"), F.col("prior_reference_date").alias("previous_reference_date"),
        base.alias("previous_value"),
        F.lit("same_month_previous_year" if back == 12 else "previous_calendar_month").alias("temporal_match"),
    ).filter(is_finite(F.col("change")))


def zero_base_months(series: DataFrame, keys: Sequence[str] = ("entity", "metric_id"), back: int = 1, unique: bool = False) -> DataFrame:
    """Months whose base is zero, for metrics where that is an error."""
    paired = with_prior(series, keys, month_index(F.col("reference_date")), back, ["value", "reference_date"], unique)
    return paired.filter(F.col("prior_value") == 0).select(*keys, "reference_date", "prior_reference_date")


def previous_observation_change(series: DataFrame, keys: Sequence[str] = ("entity", "metric_id"), carry: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """Difference to the previous published observation, whatever the gap.

    The one operator where `lag` is right. A series has one row per date; `strict` checks
    that and refuses repeated dates. Columns in `carry` come along with their previous value.
    """
    if strict:
        require_empty(duplicate_keys(series, [*keys, "reference_date"]), "dates that occur twice")
    order = Window.partitionBy(*keys).orderBy("reference_date")
    return (
        series.select(*keys, "reference_date", "value", *[c for c in carry if c != "value"],
                      F.lag("value").over(order).alias("previous_value"),
                      F.lag("reference_date").over(order).alias("previous_reference_date"),
                      *[F.lag(c).over(order).alias(f"previous_{c}") for c in carry if c != "value"])
        .filter(F.col("previous_reference_date").isNotNull())
        .withColumn("change", F.col("value") - F.col("previous_value"))
        .drop(*([] if "value" in carry else ["value"]))
    )


def month_end_snapshot(series: DataFrame, keys: Sequence[str] = ("entity", "metric_id"), unique: bool = True) -> DataFrame:
    """Last observation of each calendar month, re-dated to month end.

    Only fixed-width columns are aggregated, so this stays a hash aggregate.
    """
    date = F.col("reference_date")
    return (
        series.groupBy(*keys, F.last_day(date).alias("month_end"))
        .agg(F.max_by("value", date).alias("value"), F.max(date).alias("source_reference_date"))
        .select(*keys, F.col("month_end").alias("reference_date"), "value", "source_reference_date")
    )


def direction(flag: Column, value: Column, vocabulary: Mapping[str, tuple[str, str]], default: tuple[str, str]) -> Column:
    """Label for the sign of a change: flag -> (up, down); zero is `unchanged`."""
    up = F.create_map(*[x for f, (u, _) in vocabulary.items() for x in (F.lit(f), F.lit(u))]) if vocabulary else None
    down = F.create_map(*[x for f, (_, d) in vocabulary.items() for x in (F.lit(f), F.lit(d))]) if vocabulary else None
    rising = F.coalesce(F.try_element_at(up, flag), F.lit(default[0])) if vocabulary else F.lit(default[0])
    falling = F.coalesce(F.try_element_at(down, flag), F.lit(default[1])) if vocabulary else F.lit(default[1])
    return F.when(flag.isNull(), None).when(value == 0, F.lit("unchanged")).when(value > 0, rising).otherwise(falling)

"""Violations as rows, coverage, health and summaries.

Every check is one partial-aggregated `groupBy` or a row-wise projection; a key
holding a third of all rows collapses map-side before the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factweave.functions.dates import is_quarter_end, quarter_index, quarter_label
from factweave.functions.numbers import is_finite, is_positive


class ContractViolation(ValueError):
    """Raised by strict checks; the message holds the counts, never the rows."""


def require_empty(violations: DataFrame, what: str) -> None:
    """Strict mode: one aggregate over the violation rows, then raise."""
    count = violations.count()
    if count:
        raise ContractViolation(f"{what}: {count} violating rows")


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys held by more than one row (nulls equal each other)."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("row_count")).filter("row_count > 1")


def split_unique(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key is unique; duplicated keys leave as a whole.

    Partial aggregation keeps one row per key and task, so hot duplicates do not
    travel.
    """
    rest = [c for c in df.columns if c not in key]
    return (
        df.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct(*rest)).alias("_row"))
        .filter("_n = 1")
        .select(*key, "_row.*")
        .select(*df.columns)
    )


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c.cast("string")) == "")


def null_profile(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """One row per required column: blank or null count and total."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ContractViolation(f"missing columns: {sorted(missing)}")
    counted = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(blank(F.col(c))).alias(c) for c in required])
    return counted.select(
        F.explode(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.col(c).alias("blank_count"), F.col("_n").alias("row_count"))
            for c in required
        ])).alias("r")
    ).select("r.*")


def failed_rules(df: DataFrame, rules: Mapping[str, Column], name: str = "violations") -> DataFrame:
    """Rows breaking at least one rule, with the names of the broken rules in order.

    A rule that evaluates to null counts as broken: required inputs may not be absent.
    """
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(rule)) for rule, ok in rules.items()]
    return df.withColumn(name, F.array_compact(F.array(*broken))).filter(F.size(name) > 0)


def passing_rows(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    every = reduce(lambda a, b: a & b, [F.coalesce(ok, F.lit(False)) for ok in rules.values()])
    return df.filter(every)


PERIOD_TYPES = ("INSTANT", "QUARTER", "YTD", "FY")


def period_rules(year: str | None = "reference_year") -> dict[str, Column]:
    """Shape rules every stored period fact obeys."""
    kind, start, end = F.col("period_type"), F.col("period_start"), F.col("period_end")
    rules = {
        "period_type_allowed": kind.isin(*PERIOD_TYPES),
        "instant_has_no_start": (kind != "INSTANT") | start.isNull(),
        "duration_has_start": (kind == "INSTANT") | start.isNotNull(),
        "start_not_after_end": start.isNull() | (start <= end),
    }
    if year:
        rules["year_matches_end"] = F.col(year) == F.year(end)
    return rules


def period_violations(facts: DataFrame) -> DataFrame:
    return failed_rules(facts, period_rules())


def series_violations(series: DataFrame, contract: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Series rows off their contract: metric -> (frequency, unit).

    Metrics without a contract are only checked for finite values.
    """
    def expected(i: int) -> Column:
        pairs = [x for metric, spec in contract.items() for x in (F.lit(metric), F.lit(spec[i]))]
        return F.try_element_at(F.create_map(*pairs), F.col("metric_id"))

    frequency, unit, date = expected(0), expected(1), F.col("reference_date")
    return failed_rules(series, {
        "finite_value": is_finite(F.col("value")),
        "metric_named": ~blank(F.col("metric_id")),
        "expected_frequency": frequency.isNull() | (F.col("frequency") == frequency),
        "expected_unit": unit.isNull() | (F.col("unit") == unit),
        "month_end_dated": frequency.isNull() | (frequency == "daily") | (date == F.last_day(date)),
    })


def unstable_series(series: DataFrame, keys: Sequence[str], identity: Sequence[str]) -> DataFrame:
    """Series whose identity columns change within the series."""
    return (
        series.groupBy(*keys)
        .agg(*[F.min(c).alias(f"{c}_min") for c in identity], *[F.max(c).alias(f"{c}_max") for c in identity])
        .filter(reduce(lambda a, b: a | b, [~F.col(f"{c}_min").eqNullSafe(F.col(f"{c}_max")) for c in identity]))
    )


def price_rules() -> dict[str, Column]:
    """Open/high/low/close contract; volume is optional."""
    o, h, l, c, v = (F.col(n) for n in ("open", "high", "low", "close", "volume"))
    return {
        "prices_positive": is_positive(o) & is_positive(h) & is_positive(l) & is_positive(c),
        "high_not_below_low": h >= l,
        "open_in_range": (o >= l) & (o <= h),
        "close_in_range": (c >= l) & (c <= h),
        "volume_not_negative": v.isNull() | (is_finite(v) & (v >= 0)),
    }


def sha256_text(c: Column) -> Column:
    return c.rlike("^[0-9a-fA-F]{64}$")


def no_credentials(url: Column) -> Column:
    return ~F.lower(url).contains("apikey")


def product_rules(status: str = "status", available: str = "AVAILABLE") -> dict[str, Column]:
    """Derived price-times-quantity rows: value is exact, nothing comes from the future."""
    ok = F.col(status) == available
    return {
        "available_is_complete": ~ok | (is_positive(F.col("value")) & is_positive(F.col("price")) & is_positive(F.col("quantity"))),
        "unavailable_has_no_value": ok | F.col("value").isNull(),
        "value_is_product": ~ok | (F.col("value") == F.col("price") * F.col("quantity")),
        "quantity_not_from_future": ~ok | (
            (F.col("quantity_reference_date") <= F.col("reference_date")) & (F.col("quantity_filed_at") <= F.col("reference_date"))
        ),
    }


def share_fact_violations(rows: DataFrame, key: Sequence[str], material: Sequence[str], authoritative: Column, url_prefix: str) -> DataFrame:
    """Quantity facts against their contract, with the broken rules; copies of one key must agree on the material columns."""
    value = F.col("value")
    fields = F.struct(*material)
    agreed = rows.groupBy(*key).agg((F.min(fields) == F.max(fields)).alias("_agrees"))
    on = reduce(lambda a, b: a & b, [F.col(f"r.{c}").eqNullSafe(F.col(f"a.{c}")) for c in key])
    joined = rows.alias("r").join(agreed.alias("a"), on).select("r.*", "a._agrees")
    return failed_rules(joined, {
        "authoritative": authoritative,
        "whole_and_positive": is_positive(value) & (value == F.floor(value)),
        "url_prefix": F.col("source_url").startswith(url_prefix) & no_credentials(F.col("source_url")),
        "content_sha256": F.col("source_content_sha256").isNull() | sha256_text(F.col("source_content_sha256")),
        "dates_present": F.col("reference_date").isNotNull() & F.col("filed_at").isNotNull(),
        "key_agrees": F.col("_agrees"),
    })


def product_recomputed(stored: DataFrame, expected: DataFrame, key: Sequence[str]) -> DataFrame:
    """Stored price-times-quantity rows against their own rules and against the as-of result for the same key.

    `expected` is that result: selected by both clocks, so no later fact can be in it. Rows that only one side has are
    violations too. One join on the key.
    """
    columns = ("status", "price", "quantity", "value", "quantity_reference_date", "quantity_filed_at")
    ours = stored.select(*key, *columns, F.lit(True).alias("_stored"))
    theirs = expected.select(*key, F.struct("status", "quantity", "value", "quantity_reference_date", "quantity_filed_at").alias("_e"))
    joined = ours.join(theirs, list(key), "full_outer")
    both = F.col("_stored").isNotNull() & F.col("_e").isNotNull()
    same = lambda *names: ~both | reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_e.{n}")) for n in names])
    own = {rule: F.col("_stored").isNull() | ok for rule, ok in product_rules().items() if rule != "available_is_complete"}
    order = ("value_is_product", "quantity_not_from_future", "unavailable_has_no_value")
    return failed_rules(joined, {
        **{rule: own[rule] for rule in order}, "row_expected": both, "status_recomputes": same("status"),
        "quantity_recomputes": same("quantity", "quantity_reference_date", "quantity_filed_at"), "value_recomputes": same("value")})


# --- fixed values: direction vocabulary of derived series -----------------------
DIRECTION_VALUES = (
    "rising", "falling", "unchanged", "accelerating", "decelerating", "appreciating_brl", "depreciating_brl", "expanding", "contracting",
)


def derived_series_rules() -> dict[str, Column]:
    """Rows of a derived series: finite values, non-empty lineage, a flag and its value set together and from the vocabulary."""
    filled = lambda c: F.coalesce(F.trim(F.col(c)) != "", F.lit(False))
    return {
        "key_present": F.col("metric_id").isNotNull() & F.col("reference_date").isNotNull(),
        "value_finite": is_finite(F.col("value")),
        "lineage_present": filled("source") & filled("source_metric_id") & filled("definition_context"),
        "flag_complete": F.col("direction_flag_id").isNull() == F.col("direction_value").isNull(),
        "direction_known": F.col("direction_value").isNull() | F.col("direction_value").isin(*DIRECTION_VALUES),
    }


# --- summaries -------------------------------------------------------------


def coverage_summary(facts: DataFrame, keys: Sequence[str], flag: str | None = None) -> DataFrame:
    """Fact count and date span per key; optionally the number of flagged rows."""
    measures = [
        F.count(F.lit(1)).alias("fact_count"),
        F.min("period_end").alias("first_period_end"),
        F.max("period_end").alias("last_period_end"),
    ]
    if flag:
        measures.append(F.count_if(F.col(flag)).alias(f"{flag}_count"))
    return facts.groupBy(*keys).agg(*measures)


def quarter_coverage(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Observed and missing quarters per key between its first and last exact quarter end.

    The collected set holds calendar quarters, so its size is bounded by the
    calendar and not by the rows of the key.
    """
    index = F.when(is_quarter_end(F.col("period_end")), quarter_index(F.col("period_end")))
    grouped = facts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.collect_set(F.col("period_end")).alias("_ends"),
        F.collect_set(index).alias("_seen"),
        F.min("period_end").alias("first_period_end"), F.max("period_end").alias("last_period_end"),
    )
    span = F.sequence(F.array_min("_seen"), F.array_max("_seen"))
    label = lambda a: F.transform(F.array_sort(a), quarter_label)
    empty = F.array().cast("array<string>")
    return grouped.select(
        *keys, "row_count", F.size("_ends").alias("distinct_period_count"), "first_period_end", "last_period_end",
        label(F.col("_seen")).alias("observed_quarters"),
        F.coalesce(label(F.array_except(span, F.col("_seen"))), empty).alias("missing_quarters"),
    )


def dataset_health(frames: Mapping[str, DataFrame | str | None], date_columns: Sequence[str], spark: SparkSession | None = None) -> DataFrame:
    """Status, row count, column count and latest date per dataset; `None` means missing, a text is the status itself.

    One aggregate per dataset, united into one lazy frame.
    """
    parts = []
    session = spark or next(f.sparkSession for f in frames.values() if isinstance(f, DataFrame))
    for name, frame in frames.items():
        if not isinstance(frame, DataFrame):
            parts.append(session.range(1).select(
                F.lit(name).alias("dataset_id"), F.lit(frame or "MISSING").alias("status"),
                F.lit(None).cast("bigint").alias("row_count"), F.lit(None).cast("int").alias("column_count"),
                F.lit(None).cast("date").alias("latest_date")))
            continue
        date = next((c for c in date_columns if c in frame.columns), None)
        latest = F.max(F.col(date).cast("date")) if date else F.lit(None).cast("date")
        parts.append(frame.agg(F.count(F.lit(1)).alias("row_count"), latest.alias("latest_date")).select(
            F.lit(name).alias("dataset_id"),
            F.when(F.col("row_count") == 0, F.lit("EMPTY")).otherwise(F.lit("AVAILABLE")).alias("status"),
            "row_count", F.lit(len(frame.columns)).alias("column_count"), "latest_date"))
    return reduce(DataFrame.unionByName, parts)


def health_rollup(health: DataFrame, domains: Mapping[str, tuple[str, Sequence[str]]]) -> DataFrame:
    """Dataset counts by business domain, layer and status; dataset -> (layer, domains)."""
    layer = F.create_map(*[x for d, s in domains.items() for x in (F.lit(d), F.lit(s[0]))])
    listed = F.create_map(*[
        x for d, s in domains.items() for x in (F.lit(d), F.array(*[F.lit(v) for v in (s[1] or ("Unassigned",))]))
    ])
    return (
        health.select(
            F.explode(F.try_element_at(listed, F.col("dataset_id"))).alias("business_domain"),
            F.try_element_at(layer, F.col("dataset_id")).alias("layer"), "status", "latest_date",
        )
        .groupBy("business_domain", "layer", "status")
        .agg(F.count(F.lit(1)).alias("dataset_count"), F.max("latest_date").alias("latest_date"))
    )


def status_summary(health: DataFrame) -> DataFrame:
    """One row: dataset count, count per status, newest date."""
    return health.agg(
        F.count(F.lit(1)).alias("dataset_count"),
        *[F.count_if(F.col("status") == s).alias(f"{s.lower()}_count") for s in ("AVAILABLE", "MISSING", "EMPTY", "INVALID")],
        F.max("latest_date").alias("latest_date"),
    )


def freshness(df: DataFrame, metrics: Sequence[str], date: str, by: Sequence[str] = ()) -> DataFrame:
    """Newest date over the listed metrics."""
    return df.filter(F.col("metric_id").isin(*metrics)).groupBy(*by).agg(F.max(date).alias("latest_date"))


def missing_metrics(df: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Listed metrics without any row, per group of `by`.

    The presence set is an aggregate over at most the listed metrics.
    """
    wanted = F.array(*[F.lit(m) for m in metrics])
    seen = df.groupBy(*by).agg(
        F.collect_set(F.when(F.col("metric_id").isin(*metrics), F.col("metric_id"))).alias("_seen")
    )
    return seen.select(*by, F.explode(F.array_except(wanted, F.col("_seen"))).alias("metric_id"))


def category_counts(df: DataFrame, category: str, categories: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows per listed category including categories without rows."""
    counted = df.groupBy(*by).agg(*[F.count_if(F.col(category) == c).alias(c) for c in categories])
    return counted.select(
        *by,
        F.explode(F.array(*[
            F.struct(F.lit(c).alias(category), F.col(f"`{c}`").alias("row_count")) for c in categories
        ])).alias("r"),
    ).select(*by, "r.*")


def aligned_correlation(series: DataFrame, left: str, right: str, period: Column, keys: Sequence[str], minimum: int = 3) -> DataFrame:
    """Pearson correlation of two metrics after aligning on one period index.

    Both series come from one pivoting aggregate, so nothing is joined. A period
    observed twice in a series disqualifies the key; constant or short series give
    no coefficient and a reason.
    """
    if minimum < 2:
        raise ValueError("at least two observations are needed")
    metric, value = F.col("metric_id"), F.col("value")
    pair = (
        series.filter(metric.isin(left, right))
        .groupBy(*keys, period.alias("_period"))
        .agg(
            F.max(F.when(metric == left, value)).alias("a"), F.max(F.when(metric == right, value)).alias("b"),
            F.count_if(metric == left).alias("na"), F.count_if(metric == right).alias("nb"),
            F.max("reference_date").alias("d"),
        )
    )
    usable = (F.col("na") == 1) & (F.col("nb") == 1) & is_finite(F.col("a")) & is_finite(F.col("b"))
    a, b, d = (F.when(usable, F.col(c)) for c in ("a", "b", "d"))
    stats = pair.groupBy(*keys).agg(
        F.count(a).alias("n_observations"), F.max(F.greatest("na", "nb")).alias("_dup"),
        F.min(a).alias("_amin"), F.max(a).alias("_amax"), F.min(b).alias("_bmin"), F.max(b).alias("_bmax"),
        F.covar_pop(a, b).alias("_cov"), F.stddev_pop(a).alias("_sa"), F.stddev_pop(b).alias("_sb"),
        F.min(d).alias("start_date"), F.max(d).alias("end_date"),
    )
    status = (
        F.when(F.col("_dup") > 1, F.lit("DUPLICATE_PERIOD"))
        .when(F.col("n_observations") < minimum, F.lit("TOO_FEW"))
        .when((F.col("_amin") == F.col("_amax")) | (F.col("_bmin") == F.col("_bmax")), F.lit("CONSTANT"))
        .otherwise(F.lit("OK"))
    )
    return stats.withColumn("status", status).select(
        *keys, "status", "n_observations", "start_date", "end_date",
        F.when(F.col("status") == "OK", F.try_divide(F.col("_cov"), F.col("_sa") * F.col("_sb"))).alias("correlation"),
    )


def dictionary_violations(dictionary: DataFrame, identity: str, required: Sequence[str]) -> DataFrame:
    """Metric dictionary rows with blank fields, and ids listed more than once."""
    broken = failed_rules(dictionary, {f"{c}_present": ~blank(F.col(c)) for c in required}).select(identity, "violations")
    twice = duplicate_keys(dictionary, [identity]).select(identity, F.array(F.lit("duplicate_id")).alias("violations"))
    return broken.unionByName(twice)

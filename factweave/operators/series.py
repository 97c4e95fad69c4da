"""All approved derived metrics of published series in two window passes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from factweave.functions.dates import month_index
from factweave.functions.numbers import is_finite
from factweave.operators import rules as RULES
from factweave.operators.periods import direction, growth_percent, month_end_snapshot, previous_observation_change


@dataclass(frozen=True)
class Change:
    """One derived metric: how a source metric is compared.

    `match` is `month`, `year` or `previous`; `snapshot` compares month-end values of
    a daily series.
    """

    metric_id: str
    source: str
    match: str
    percent: bool
    kind: str
    frequency: str = "monthly"
    flag: str | None = None
    snapshot: bool = False


# --- fixed values: approved derived series --------------------------------------
SNAPSHOTS = {"usd_brl_sell_rate": ("usd_brl_month_end", "brl_per_usd")}
CHANGES = (
    Change("selic_target_change_pp", "selic_target_annual", "previous", False, "previous_observation_change", "daily", "selic_direction"),
    Change("ipca_12m_change_pp", "ipca_12m_change", "month", False, "monthly_percentage_point_change", flag="inflation_12m_direction"),
    Change("usd_brl_monthly_change_pct", "usd_brl_sell_rate", "month", True, "monthly_percentage_change", flag="usd_brl_direction", snapshot=True),
    Change("household_free_credit_balance_yoy_growth", "household_free_credit_balance", "year", True, "yoy_growth", flag="credit_yoy_direction"),
    Change("household_free_credit_npl_90d_yoy_change_pp", "household_free_credit_npl_90d_rate", "year", False, "yoy_percentage_point_change"),
    Change("ibc_br_activity_mom_change_pct", "ibc_br_activity_sa_index", "month", True, "monthly_percentage_change"),
    Change("unemployment_rate_change_pp", "unemployment_rate_rolling_3m", "previous", False, "previous_observation_change", "rolling_3m_monthly", "unemployment_direction"),
    Change("pix_transactions_count_yoy_growth", "pix_transactions_count_monthly", "year", True, "yoy_growth", flag="pix_count_yoy_direction"),
    Change("pix_transactions_value_yoy_growth", "pix_transactions_value_monthly", "year", True, "yoy_growth"),
)
MATCHES = {"month": "previous_calendar_month", "year": "same_month_previous_year", "previous": "previous_published_observation"}


def _described(changes: Sequence[Change]) -> Column:
    """Literal lookup source metric -> its derived metrics."""
    by_source: dict[str, list[Change]] = {}
    for c in changes:
        by_source.setdefault(c.source, []).append(c)
    return F.create_map(*[x for source, listed in by_source.items() for x in (F.lit(source), F.array(*[
        F.struct(F.lit(c.metric_id).alias("metric_id"), F.lit(c.match).alias("match"), F.lit(c.percent).alias("percent"), F.lit(c.kind).alias("analytics_kind"),
                 F.lit(c.frequency).alias("frequency"), F.lit(c.flag).cast("string").alias("direction_flag_id")) for c in listed]))])


def _shaped(df: DataFrame, keys: Sequence[str], change: Column) -> DataFrame:
    flag = F.col("c.direction_flag_id")
    return df.withColumn("_change", change).filter(is_finite(F.col("_change"))).select(
        *keys, "c.metric_id", "reference_date", F.col("_change").alias("value"),
        F.when(F.col("c.percent"), F.lit("percent")).otherwise(F.lit("percentage_points")).alias("unit"), "c.frequency", F.col("metric_id").alias("source_metric_id"),
        "c.analytics_kind", "previous_reference_date", "previous_value", "source_reference_date", flag.alias("direction_flag_id"),
        direction(flag, F.col("_change"), RULES.DIRECTIONS, RULES.DEFAULT_DIRECTION).alias("direction_value"),
        F.create_map(*[x for m, text in MATCHES.items() for x in (F.lit(m), F.lit(text))])[F.col("c.match")].alias("temporal_match"))


def series_suite(series: DataFrame, keys: Sequence[str] = ("entity",), changes: Sequence[Change] = CHANGES, snapshots: dict = SNAPSHOTS) -> DataFrame:
    """Derived metrics of the listed series; missing months and zero bases give no row.

    All month comparisons share one window over (keys, metric): month and year priors
    are two frames of it. Changes to the previous observation are a second window.
    """
    of = lambda pick: [c for c in changes if pick(c)]
    metric = F.col("metric_id")
    empty_date = F.lit(None).cast("date")
    plain = series.filter(metric.isin(*{c.source for c in of(lambda c: c.match != "previous" and not c.snapshot)})).select(
        *keys, "metric_id", "reference_date", "value", empty_date.alias("source_reference_date"))
    month_ends = month_end_snapshot(series.filter(metric.isin(*snapshots)), [*keys, "metric_id"])
    monthly = plain.unionByName(month_ends).withColumn("_month", month_index(F.col("reference_date")))
    order = Window.partitionBy(*keys, "metric_id").orderBy("_month")
    prior = lambda n: F.first(F.struct("reference_date", "value")).over(order.rangeBetween(-n, -n))
    walked = monthly.withColumns({"_m": prior(1), "_y": prior(12)}).withColumn(
        "c", F.explode(F.try_element_at(_described(of(lambda c: c.match != "previous")), metric)))
    base = F.when(F.col("c.match") == "month", F.col("_m")).otherwise(F.col("_y"))
    paired = walked.select("*", base["reference_date"].alias("previous_reference_date"), base["value"].alias("previous_value")).filter("previous_reference_date IS NOT NULL")
    value, before = F.col("value"), F.col("previous_value")
    compared = _shaped(paired.withColumn("source_reference_date", empty_date), keys,
                       F.when(F.col("c.percent"), growth_percent(value, F.when(before != 0, before))).otherwise(value - before))
    previous = previous_observation_change(series.filter(metric.isin(*{c.source for c in of(lambda c: c.match == "previous")})), [*keys, "metric_id"])
    stepped = _shaped(previous.withColumns({"c": F.explode(F.try_element_at(_described(of(lambda c: c.match == "previous")), metric)), "source_reference_date": empty_date}),
                      keys, F.col("change"))
    names = F.create_map(*[x for s, (n, u) in snapshots.items() for x in (F.lit(s), F.struct(F.lit(n).alias("n"), F.lit(u).alias("u")))])[metric]
    none = F.lit(None).cast("string")
    shown = month_ends.select(
        *keys, names["n"].alias("metric_id"), "reference_date", "value", names["u"].alias("unit"), F.lit("monthly").alias("frequency"), metric.alias("source_metric_id"),
        F.lit("month_end_snapshot").alias("analytics_kind"), empty_date.alias("previous_reference_date"), F.lit(None).cast("double").alias("previous_value"),
        "source_reference_date", none.alias("direction_flag_id"), none.alias("direction_value"), none.alias("temporal_match"))
    return compared.unionByName(stepped).unionByName(shown)

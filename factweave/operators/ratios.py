"""Exact-period ratios, differences and the combined metric suite."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from factweave.operators.periods import PERIOD_KEY, derived, yoy_growth
from factweave.operators.quality import require_empty


def pivot_metrics(facts: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("entity",), carry: Sequence[str] = ()) -> DataFrame:
    """One row per exact period with a column per metric.

    Grouping treats null period bounds as equal, needs one shuffle for any number
    of metrics and combines map-side. A metric reported twice for a period has
    `n_<metric> > 1`.
    """
    metric = F.col("metric_id")
    measures: list[Column] = []
    for m in dict.fromkeys(metrics):
        mine = metric == m
        measures.append(F.max(F.when(mine, F.col("value"))).alias(m))
        measures.append(F.count_if(mine).alias(f"n_{m}"))
        measures.extend(F.max(F.when(mine, F.col(c))).alias(f"{m}_{c}") for c in carry)
    return facts.filter(metric.isin(*metrics)).groupBy(*keys, *PERIOD_KEY).agg(*measures)


def all_once(metrics: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"n_{m}") == 1 for m in metrics])


def exact_period_join(facts: DataFrame, left: str, right: str, keys: Sequence[str] = ("entity",),
                      carry: Sequence[str] = ("definition_version",), strict: bool = False) -> DataFrame:
    """Two metrics on the same exact period, null-safe; duplicated periods leave, or with `strict` stop the join."""
    if strict:
        require_empty(duplicate_periods(facts, [left, right], keys), "periods reported twice")
    wide = pivot_metrics(facts, [left, right], keys, carry).filter(all_once([left, right]))
    return wide.select(
        *keys, *PERIOD_KEY, F.col(left).alias("left_value"), F.col(right).alias("right_value"),
        *[F.col(f"{left}_{c}").alias(f"left_{c}") for c in carry], *[F.col(f"{right}_{c}").alias(f"right_{c}") for c in carry],
    )


def duplicate_periods(facts: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("entity",)) -> DataFrame:
    """Exact periods for which a metric is reported more than once."""
    return (
        facts.filter(F.col("metric_id").isin(*metrics))
        .groupBy(*keys, "metric_id", *PERIOD_KEY).agg(F.count(F.lit(1)).alias("row_count")).filter("row_count > 1")
    )


@dataclass(frozen=True)
class Ratio:
    """numerator / denominator; `scale` 100 gives percent."""

    metric_id: str
    numerator: str
    denominator: str
    unit: str = "percent"
    scale: float | None = 100.0
    positive_denominator: bool = False
    same_definition: bool = False
    record_definitions: bool = False

    @property
    def formula(self) -> str:
        return f"{self.numerator} / {self.denominator}" + (" * 100" if self.scale else "")


def period_ratio(facts: DataFrame, ratio: Ratio, keys: Sequence[str] = ("entity",)) -> DataFrame:
    """One exact-period ratio."""
    definitions = ratio.same_definition or ratio.record_definitions
    joined = exact_period_join(facts, ratio.numerator, ratio.denominator, keys, ("definition_version",) if definitions else ())
    a, b = F.col("left_value"), F.col("right_value")
    if ratio.same_definition:
        joined = joined.filter(F.col("left_definition_version") == F.col("right_definition_version"))
    joined = joined.filter((b > 0) & ~F.isnan(b) if ratio.positive_denominator else b != 0)
    value = a / b * F.lit(ratio.scale) if ratio.scale else a / b
    context = None
    if definitions:
        context = F.concat(F.lit(f"{ratio.numerator}:"), "left_definition_version", F.lit(f";{ratio.denominator}:"), "right_definition_version")
    return derived(joined, keys, metric=F.lit(ratio.metric_id), value=value, unit=ratio.unit, formula=F.lit(ratio.formula),
                   sources=F.lit(f"{ratio.numerator};{ratio.denominator}"), context=context)


def difference(facts: DataFrame, output: str, left: str, right: str, unit: str, keys: Sequence[str] = ("entity",)) -> DataFrame:
    joined = exact_period_join(facts, left, right, keys, ())
    return derived(joined, keys, metric=F.lit(output), value=F.col("left_value") - F.col("right_value"), unit=unit,
                   formula=F.lit(f"{left} - {right}"), sources=F.lit(f"{left};{right}"))


def difference_margin(facts: DataFrame, output: str, left: str, right: str, base: str, keys: Sequence[str] = ("entity",),
                      difference_name: str | None = None) -> DataFrame:
    """(left - right) / base * 100 in one pivot."""
    wide = pivot_metrics(facts, [left, right, base], keys).filter(all_once([left, right, base]) & (F.col(base) != 0))
    name = difference_name or f"{left} - {right}"
    return derived(wide, keys, metric=F.lit(output), value=(F.col(left) - F.col(right)) / F.col(base) * F.lit(100.0),
                   unit="percent", formula=F.lit(f"{name} / {base} * 100"), sources=F.lit(f"{left};{right};{base}"))


def renamed_metric(facts: DataFrame, metric: str, output: str, unit: str, keys: Sequence[str] = ("entity",)) -> DataFrame:
    """Expose one reported metric under a canonical name, not as a derived value."""
    return derived(facts.filter(F.col("metric_id") == metric), keys, metric=F.lit(output), value=F.col("value"), unit=unit,
                   formula=F.lit(metric), sources=F.lit(metric), is_derived=False)


def same_date_join(snapshots: DataFrame, users: DataFrame, keys: Sequence[str] = ("entity",)) -> DataFrame:
    """Exact USD snapshots with the active users of the same date.

    The user series must be unique on (keys, period_end) alone and is reduced to
    that key before the join; a date reported twice does not pair.
    """
    base = (
        users.filter((F.col("period_type") == "INSTANT") & (F.col("unit") == "users"))
        .groupBy(*keys, "period_end")
        .agg(F.count(F.lit(1)).alias("_n"), F.max("value").alias("users"), F.max("definition_version").alias("user_definition"))
        .filter((F.col("_n") == 1) & (F.col("users") > 0) & ~F.isnan("users"))
        .drop("_n")
    )
    exact = snapshots.filter(
        (F.col("period_type") == "INSTANT") & (F.col("unit") == "USD") & (F.col("value_qualifier") == "exact")
    )
    return exact.join(base, [*keys, "period_end"])


def same_date_ratio(snapshots: DataFrame, users: DataFrame, output: Column, keys: Sequence[str] = ("entity",)) -> DataFrame:
    """Exact USD snapshot per active user of the same date."""
    return derived(
        same_date_join(snapshots, users, keys), keys, metric=output, value=F.col("value") / F.col("users"), unit="USD_per_user",
        formula=F.concat("metric_id", F.lit(" / active_users")), sources=F.concat("metric_id", F.lit(";active_users")),
        context=F.concat(F.lit("scope="), "scope", F.lit(";qualifier="), "value_qualifier",
                         F.lit(";denominator=reported_active_users;user_definition_version="), "user_definition"),
    )


def metric_suite(facts: DataFrame, growth: Sequence[str], ratios: Sequence[Ratio] = (),
                 renames: Mapping[str, tuple[str, str]] | None = None,
                 differences: Sequence[tuple[str, str, str, str, str | None]] = (),
                 keys: Sequence[str] = ("entity",), unique: bool = False) -> DataFrame:
    """All derived metrics of a fact table.

    Growth over every metric is one window pass. Ratios, differences and renames
    come from one pivot that is exploded again, whatever their number.
    `differences` holds (output, left, right, unit, base); with a base the
    margin `<output>_margin` is added.
    """
    parts = [yoy_growth(facts, keys, growth, unique=unique)]
    needed: list[str] = []
    outputs: list[Column] = []

    def add(metric: str, value: Column, ok: Column, unit: str, formula: str, sources: Sequence[str], is_derived: bool = True) -> None:
        needed.extend(s for s in sources if s not in needed)
        usable = ok & all_once(sources)
        outputs.append(F.when(usable, F.struct(
            F.lit(metric).alias("metric_id"), value.alias("value"), F.lit(unit).alias("unit"), F.lit(formula).alias("formula"),
            F.lit(";".join(sources)).alias("source_metrics"), F.lit(is_derived).alias("is_derived"))))

    for r in ratios:
        a, b = F.col(r.numerator), F.col(r.denominator)
        safe = F.when(b != 0, b)
        add(r.metric_id, a / safe * F.lit(r.scale) if r.scale else a / safe,
            (b > 0) & ~F.isnan(b) if r.positive_denominator else b != 0, r.unit, r.formula, [r.numerator, r.denominator])
    for metric, (output, unit) in (renames or {}).items():
        add(output, F.col(metric), F.lit(True), unit, metric, [metric], is_derived=False)
    for output, left, right, unit, base in differences:
        add(output, F.col(left) - F.col(right), F.lit(True), unit, f"{left} - {right}", [left, right])
        if base:
            bottom = F.when(F.col(base) != 0, F.col(base))
            add(f"{output}_margin", (F.col(left) - F.col(right)) / bottom * F.lit(100.0), F.col(base) != 0, "percent",
                f"{output} / {base} * 100", [left, right, base])
    if outputs:
        wide = pivot_metrics(facts, needed, keys)
        rows = wide.select(*keys, *PERIOD_KEY, F.explode(F.array_compact(F.array(*outputs))).alias("m"))
        parts.append(rows.select(*keys, "m.metric_id", *PERIOD_KEY, "m.value", "m.unit", "m.formula", "m.source_metrics",
                                 "m.is_derived", F.lit("1").alias("methodology_version")))
    return reduce(DataFrame.unionByName, parts)

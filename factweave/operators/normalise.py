"""Raw payloads to typed facts and series.

Every normaliser returns accepted rows; the matching `*_violations` or a status
column keeps rejected rows visible.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from factweave.functions.dates import exchange_date, parse_day_first, parse_year_month
from factweave.functions.numbers import is_finite, is_positive, plain_number, special_value
from factweave.operators.canonical import latest_filing_wins
from factweave.operators.quality import passing_rows, price_rules

# --- fixed values: filings accepted and period lengths in days -----------------
ALLOWED_FORMS = ("10-K", "10-Q")
QUARTER_DAYS = (75, 105)
HALF_YEAR_DAYS = (150, 200)
NINE_MONTH_DAYS = (240, 290)
YEAR_DAYS = (330, 380)

OBSERVATION = "struct<start:string,end:string,val:double,filed:string,accn:string,form:string,frame:string,fy:int,fp:string>"
PAYLOAD = f"struct<cik:string,entityName:string,facts:map<string,map<string,struct<units:map<string,array<{OBSERVATION}>>>>>>"


def classify_period(start: Column, end: Column, december_instant: str = "FY") -> Column:
    """struct(period_type, period_label) from the length of a period.

    Days are `end - start`, the end not counted. Lengths outside all ranges are
    OTHER and are rejected by the period rules. `december_instant` is the label of an
    instant in December.
    """
    days = F.datediff(end, start)
    month = F.month(end)
    quarter_end = month % 3 == 0
    quarter = F.when(quarter_end, F.concat(F.lit("Q"), (month / 3).cast("int").cast("string")))
    instant = F.when(month == 12, F.lit(december_instant)).otherwise(quarter)

    def shape(kind: str, label: Column) -> Column:
        return F.struct(F.lit(kind).alias("period_type"), label.cast("string").alias("period_label"))

    return (
        F.when(start.isNull(), shape("INSTANT", instant))
        .when(days.between(*QUARTER_DAYS), shape("QUARTER", quarter))
        .when(days.between(*HALF_YEAR_DAYS), shape("YTD", F.lit("H1")))
        .when(days.between(*NINE_MONTH_DAYS), shape("YTD", F.lit("9M")))
        .when(days.between(*YEAR_DAYS), shape("FY", F.lit("FY")))
        .otherwise(shape("OTHER", F.lit(None)))
    )


def flatten_payloads(payloads: DataFrame, json: str, concepts: Mapping[str, tuple[str, str]] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """One row per observation of a nested taxonomy -> concept -> unit payload.

    `concepts` maps metric -> (taxonomy, concept); unmapped concepts are dropped
    before their observations are unnested. Only accepted forms survive.
    """
    # The outer explode keeps the parse from being repeated as a filter below it.
    parsed = payloads.select(*keep, F.from_json(json, PAYLOAD).alias("p")).select(
        *keep, F.col("p.cik").alias("cik"), F.trim("p.entityName").alias("entity"), F.explode_outer("p.facts").alias("taxonomy", "_c")
    ).filter(F.col("_c").isNotNull())
    named = parsed.select(*keep, "cik", "entity", "taxonomy", F.explode("_c").alias("concept", "_u"))
    if concepts is not None:
        metric = F.create_map(*[x for m, (tx, c) in concepts.items() for x in (F.lit(f"{tx}:{c}"), F.lit(m))])
        named = named.withColumn("metric_id", F.try_element_at(metric, F.concat_ws(":", "taxonomy", "concept"))).filter(F.col("metric_id").isNotNull())
    columns = [*keep, "cik", "entity", *(["metric_id"] if concepts is not None else []), "taxonomy", "concept"]
    units = named.select(*columns, F.explode("_u.units").alias("unit", "_o"))
    return units.select(*columns, "unit", F.explode("_o").alias("o")).select(*columns, "unit", "o.*").filter(F.col("form").isin(*ALLOWED_FORMS))


def company_facts(payloads: DataFrame, json: str, concepts: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Canonical facts: mapped concepts, latest filing per economic period, revision history."""
    flat = flatten_payloads(payloads, json, concepts).filter(F.coalesce(F.col("end"), F.lit("")) != "")
    typed = flat.select(
        "entity", "metric_id", "taxonomy", "concept", "unit", F.try_to_date("start").alias("period_start"), F.try_to_date("end").alias("period_end"),
        F.try_to_date("filed").alias("filed_at"), F.col("accn").alias("accession_number"), F.col("val").alias("value"),
        "form", "frame", F.col("fy").alias("source_fy"), F.col("fp").alias("source_fp"))
    key = ["entity", "metric_id", "taxonomy", "concept", "unit", "period_start", "period_end"]
    latest = latest_filing_wins(typed, key, change="any", carry=["form", "frame", "source_fy", "source_fp"])
    shape = classify_period(F.col("period_start"), F.col("period_end"))
    return latest.withColumns({
        "reference_year": F.year("period_end"), "period_type": shape["period_type"], "period_label": shape["period_label"],
        "is_derived": F.lit(False)})


def instant_quantities(payloads: DataFrame, json: str, taxonomy: str, concept: str, metric: str, unit: str = "shares") -> DataFrame:
    """Instant counts of one concept: right unit, no start, real dates, positive finite value, an accession."""
    flat = flatten_payloads(payloads, json, {metric: (taxonomy, concept)})
    rows = flat.filter((F.lower("unit") == unit) & F.col("start").isNull()).select(
        "entity", "metric_id", F.concat_ws(":", "taxonomy", "concept").alias("source_metric_id"), "taxonomy", "concept",
        F.try_to_date("end").alias("reference_date"), F.col("val").alias("value"), F.lit(unit).alias("unit"),
        F.try_to_date("filed").alias("filed_at"), F.trim("accn").alias("accession_number"), "form")
    return rows.filter(
        F.col("reference_date").isNotNull() & F.col("filed_at").isNotNull() & is_positive(F.col("value"))
        & (F.coalesce("accession_number", F.lit("")) != ""))


# --- series ----------------------------------------------------------------


@dataclass(frozen=True)
class SeriesSpec:
    """What a registry says about one published series."""

    code: str
    metric_id: str
    unit: str
    frequency: str
    source: str
    prefix: str = ""

    @property
    def source_series_id(self) -> str:
        return f"{self.prefix}:{self.code}" if self.prefix else self.code


# --- fixed values: registered national series ---------------------------------
_CENTRAL_BANK = "Banco Central do Brasil - SGS"
_STATISTICS_OFFICE = "IBGE - SIDRA"
SERIES_REGISTRY = (
    SeriesSpec("1", "usd_brl_sell_rate", "brl_per_usd", "daily", _CENTRAL_BANK, "bcb_sgs"),
    SeriesSpec("432", "selic_target_annual", "percent_per_year", "daily", _CENTRAL_BANK, "bcb_sgs"),
    SeriesSpec("1178", "selic_effective_annual_252", "percent_per_year", "daily", _CENTRAL_BANK, "bcb_sgs"),
    SeriesSpec("20570", "household_free_credit_balance", "million_brl", "monthly", _CENTRAL_BANK, "bcb_sgs"),
    SeriesSpec("21112", "household_free_credit_npl_90d_rate", "percent", "monthly", _CENTRAL_BANK, "bcb_sgs"),
    SeriesSpec("24364", "ibc_br_activity_sa_index", "index", "monthly", _CENTRAL_BANK, "bcb_sgs"),
    SeriesSpec("1737:63", "ipca_monthly_change", "percent", "monthly", _STATISTICS_OFFICE, "ibge_sidra"),
    SeriesSpec("1737:2265", "ipca_12m_change", "percent", "monthly", _STATISTICS_OFFICE, "ibge_sidra"),
    SeriesSpec("6381:4099", "unemployment_rate_rolling_3m", "percent", "rolling_3m_monthly", _STATISTICS_OFFICE, "ibge_sidra"),
    SeriesSpec("8880:11708:retail_volume", "retail_sales_volume_mom_sa", "percent", "monthly", _STATISTICS_OFFICE, "ibge_sidra"),
)
SERIES_CONTRACT = {s.metric_id: (s.frequency, s.unit) for s in SERIES_REGISTRY} | {
    "pix_transactions_count_monthly": ("monthly", "transactions"),
    "pix_transactions_value_monthly": ("monthly", "brl"),
}


def normalise_series(rows: DataFrame, code: str, date_text: str, value_text: str, registry: Sequence[SeriesSpec], keep: Sequence[str] = ()) -> DataFrame:
    """Date/value text of registered series to typed rows with a `status`.

    Dates must be strict dd/MM/yyyy and values finite; monthly series are dated at
    month end. Status: OK, UNREGISTERED, BAD_DATE or BAD_VALUE. The registry is a
    literal map, so nothing is joined.
    """
    spec = F.create_map(*[x for s in registry for x in (F.lit(s.code), F.struct(
        F.lit(s.metric_id).alias("metric_id"), F.lit(s.unit).alias("unit"), F.lit(s.frequency).alias("frequency"),
        F.lit(s.source).alias("source"), F.lit(s.source_series_id).alias("source_series_id")))])
    day = parse_day_first(F.col(date_text))
    looked = rows.select(*keep, F.try_element_at(spec, F.col(code).cast("string")).alias("s"), day.alias("d"), plain_number(F.col(value_text)).alias("value"))
    status = (
        F.when(F.col("s").isNull(), F.lit("UNREGISTERED")).when(F.col("d").isNull(), F.lit("BAD_DATE"))
        .when(F.col("value").isNull(), F.lit("BAD_VALUE")).otherwise(F.lit("OK")))
    return looked.select(
        *keep, "s.metric_id", "s.source_series_id",
        F.when(F.col("s.frequency") == "monthly", F.last_day("d")).otherwise(F.col("d")).alias("reference_date"),
        "value", "s.unit", "s.frequency", "s.source", status.alias("status"))


@dataclass(frozen=True)
class WideColumn:
    """One measure column of a wide monthly payload."""

    field: str
    metric_id: str
    unit: str
    scale: int
    integral: bool = False


# --- fixed values: instant-payment columns -------------------------------------
PAYMENT_COLUMNS = (
    WideColumn("quantidadePix", "pix_transactions_count_monthly", "transactions", 1000, integral=True),
    WideColumn("valorPix", "pix_transactions_value_monthly", "brl", 1_000_000),
)


def unpivot_scaled(rows: DataFrame, keys: Sequence[str], month: str, columns: Sequence[WideColumn]) -> DataFrame:
    """Wide monthly measures to long scaled rows with a `status`.

    Scales are powers of ten, so scaling adds to the exponent of the text, given or zero: the value is
    rounded once, when the text is read, and the integral-count check is exact for any number of digits.
    Status: OK, BAD_MONTH, BAD_VALUE, NEGATIVE or NOT_INTEGRAL.
    """
    date = parse_year_month(F.col(month))
    long = rows.select(*keys, date.alias("reference_date"), F.explode(F.array(*[
        F.struct(F.lit(c.metric_id).alias("metric_id"), F.lit(c.unit).alias("unit"), F.lit(c.integral).alias("integral"),
                 F.lit(c.scale).cast("decimal(12,0)").alias("scale"), F.trim(F.col(c.field).cast("string")).alias("text")) for c in columns
    ])).alias("m")).select(*keys, "reference_date", "m.*")
    part = lambda i: F.regexp_extract("text", r"^([+-]?)(\d*)\.?(\d*)(?:[eE]([+-]?\d+))?$", i)
    given = F.when(part(4) == "", F.lit(0)).otherwise(part(4).try_cast("int"))
    shift = F.length(F.col("scale").cast("string")) - 1 + given
    text = F.concat(part(1), F.lit("0"), part(2), F.lit("."), part(3), F.lit("0e"), shift.cast("string"))
    # Digits that stand behind the moved point.
    behind = F.concat(F.right(part(2), F.greatest(-shift, F.lit(0))), F.substr(part(3), F.greatest(shift, F.lit(0)) + 1))
    value = text.try_cast("double")
    scaled = long.withColumn("known", plain_number(F.col("text")).isNotNull()).withColumns({
        "scaled": F.when(F.col("known") & is_finite(value), value), "whole": behind.rlike("^0*$")})
    status = (
        F.when(F.col("reference_date").isNull(), F.lit("BAD_MONTH")).when(F.col("scaled").isNull(), F.lit("BAD_VALUE"))
        .when(F.col("scaled") < 0, F.lit("NEGATIVE"))
        .when(F.col("integral") & ~F.coalesce(F.col("whole"), F.lit(False)), F.lit("NOT_INTEGRAL")).otherwise(F.lit("OK")))
    # Behind the explode, a filter on the status reads it; before it, the filter would repeat every expression, in a method too large to be compiled.
    judged = scaled.select(*keys, "metric_id", "reference_date", "unit", F.explode(F.array(F.struct(F.col("scaled").alias("value"), status.alias("status")))).alias("v"))
    return judged.select(*keys, "metric_id", "reference_date", "v.value", "unit", "v.status")


def normal_label(c: Column) -> Column:
    """Label under an accent- and case-insensitive collation, blanks collapsed."""
    return F.collate(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")), "UNICODE_CI_AI")


# --- fixed values: labels of a header-described statistics table ----------------
HEADER_LABELS = {"value": "Valor", "level_code": "Nível Territorial (Código)", "level_name": "Nível Territorial"}
VARIABLE_TERM = "variavel"
PERIOD_TERMS = ("mes", "periodo", "trimestre movel")


def header_described(rows: DataFrame, table: str, fields: str, classification: str | None = None, category: str | None = None) -> DataFrame:
    """Rows of tables whose columns are named by one header row per table.

    `fields` is a map column key -> text. The header row is recognised by its labels
    and attached to the rows of its table; keys are then resolved per table by label.
    Every role must resolve to exactly one key. Status: OK, ABSENT (value marker),
    NO_HEADER, AMBIGUOUS_HEADER, BAD_PERIOD, BAD_VALUE.
    """
    f = F.col(fields)
    holds = lambda m, term: F.exists(F.map_values(m), lambda v: F.contains(normal_label(v), F.collate(F.lit(term), "UNICODE_CI_AI")))
    # The tests run in order, each for the rows that passed those before.
    is_header = (
        F.exists(F.map_values(f), lambda v: normal_label(v) == HEADER_LABELS["value"]) & holds(f, "nivel territorial") & holds(f, VARIABLE_TERM)
        & reduce(lambda a, b: a | b, [holds(f, x) for x in PERIOD_TERMS])
    )
    marked = rows.withColumn("_header", is_header)

    def keys_where(test) -> Column:
        return F.map_keys(F.map_filter(F.col("h"), test))

    def dimension(terms: Sequence[str], exact: bool = False) -> Column:
        def matches(k, v):
            label = normal_label(v)
            hit = [label == F.collate(F.lit(x), "UNICODE_CI_AI") if exact else F.contains(label, F.collate(F.lit(x), "UNICODE_CI_AI")) for x in terms]
            return k.rlike(r"^D\d+[CN]$") & reduce(lambda a, b: a | b, hit)
        # A dimension has a code and a name column; either label may match.
        return F.array_distinct(F.transform(keys_where(matches), lambda k: F.regexp_replace(k, "[CN]$", "")))

    label = lambda text: keys_where(lambda k, v: normal_label(v) == F.collate(F.lit(text), "UNICODE_CI_AI"))
    # Two different headers of a table make it ambiguous; copies of one do not travel.
    headers = marked.filter("_header").select(table, F.map_entries(f).alias("e")).groupBy(table).agg(
        F.count(F.lit(1)).alias("header_count"), F.max(F.array_sort("e")).alias("e"))
    roles = headers.select(table, "header_count", F.map_from_entries("e").alias("h")).select(
        table, "header_count", label(HEADER_LABELS["value"]).alias("value_keys"), dimension(PERIOD_TERMS).alias("period_keys"),
        dimension([VARIABLE_TERM]).alias("variable_keys"),
        (dimension([classification, classification.replace("Tipos de ", "Tipo de ", 1)], exact=True) if classification else F.array(F.lit("-"))).alias("class_keys"))
    single = (
        (F.col("header_count") == 1) & (F.size("value_keys") == 1) & (F.size("period_keys") == 1) & (F.size("variable_keys") == 1) & (F.size("class_keys") == 1))
    joined = marked.filter(~F.col("_header")).join(roles.withColumn("single", single), table, "left")
    get = lambda key: F.try_element_at(f, key)
    if classification:
        name = get(F.concat(F.try_element_at("class_keys", F.lit(1)), F.lit("N")))
        joined = joined.filter(~F.coalesce(F.col("single"), F.lit(False)) | (normal_label(name) == F.collate(F.lit(category), "UNICODE_CI_AI")))
    decoded = special_value(get(F.try_element_at("value_keys", F.lit(1))))
    date = parse_year_month(get(F.concat(F.try_element_at("period_keys", F.lit(1)), F.lit("C"))))
    resolved = joined.select(
        *[c for c in rows.columns if c != fields], "single", date.alias("reference_date"), decoded.alias("v"),
        get(F.concat(F.try_element_at("variable_keys", F.lit(1)), F.lit("N"))).alias("variable"))
    status = (
        F.when(F.col("single").isNull(), F.lit("NO_HEADER")).when(~F.col("single"), F.lit("AMBIGUOUS_HEADER"))
        .when(F.col("reference_date").isNull(), F.lit("BAD_PERIOD")).when(F.col("v.status") == "INVALID", F.lit("BAD_VALUE"))
        .when(F.col("v.status") == "ABSENT", F.lit("ABSENT")).otherwise(F.lit("OK")))
    return resolved.select(*[c for c in rows.columns if c != fields], "variable", "reference_date", F.col("v.value").alias("value"), status.alias("status"))


def normalise_prices(rows: DataFrame, key: Sequence[str] = ("ticker", "reference_date")) -> DataFrame:
    """Price rows that satisfy the contract, one per key.

    Copies of a key must agree on prices and volume (nulls agree); `agrees` is false
    otherwise and such keys are left to the caller.
    """
    from factweave.operators.canonical import duplicate_agreement

    fields = ["open", "high", "low", "close", "volume"]
    return duplicate_agreement(passing_rows(rows, price_rules()), key, fields, fields)


def completed_sessions(rows: DataFrame, boundary: Column, date: str = "reference_date") -> DataFrame:
    """Rows strictly before the session boundary."""
    return rows.filter(F.col(date) < boundary)


def session_boundary(now_utc: Column, zone: str = "America/New_York") -> Column:
    """Current exchange date; its session is not complete."""
    return exchange_date(now_utc, zone)


def required_metrics(series: DataFrame, required: Sequence[str], keys: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """Required metrics that are missing and, with `exact`, metrics that are not required; with date counts.

    One aggregate; the required list is a literal.
    """
    wanted = F.array(*[F.lit(m) for m in required])
    per_metric = series.groupBy(*keys, "metric_id", "reference_date").count().groupBy(*keys, "metric_id").agg(F.count(F.lit(1)).alias("dates"))
    found = per_metric.groupBy(*keys).agg(F.collect_set(F.when(F.col("metric_id").isin(*required), F.col("metric_id"))).alias("_seen"))
    missing = found.select(*keys, F.explode(F.array_except(wanted, F.col("_seen"))).alias("metric_id"), F.lit(0).cast("bigint").alias("dates"), F.lit("MISSING").alias("status"))
    if not exact:
        return missing
    extra = per_metric.filter(~F.col("metric_id").isin(*required)).select(*keys, "metric_id", "dates", F.lit("UNEXPECTED").alias("status"))
    return missing.unionByName(extra)

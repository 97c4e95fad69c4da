"""Evidence rows, lineage and rule classifications.

Rule tables are literals inside expressions, so classification is a projection.
Lineage is an edge frame or an id array; it is expanded one hop by an equi-join on
the id. An id referenced by a large share of all rows is split by the adaptive skew
join; groups are collected only per lineage array, which one row already holds.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from factweave.functions.identity import content_id, number_token, packed_id, unpacked_id
from factweave.functions.numbers import finite_or_null, is_close, is_finite, significant_text
from factweave.functions.text import collapse_blanks, has_part, uses_words
from factweave.operators import lineage as L, rules as RULES
from factweave.operators.periods import YOY_FORMULA, comparison_family, growth_percent, paired_years
from factweave.operators.quality import blank, failed_rules

# --- fixed values: the common evidence schema ------------------------------------
EVIDENCE_SCHEMA = {
    "evidence_id": "string", "evidence_type": "string", "business_domain": "string", "entity": "string", "metric_id": "string", "reference_date": "date",
    "period_start": "date", "period_end": "date", "period_type": "string", "period_label": "string", "value": "double", "unit": "string",
    "frequency": "string", "claim": "string", "claim_kind": "string", "source": "string", "source_url": "string", "filing_date": "date",
    "accession_number": "string", "source_bronze_file": "string", "source_content_sha256": "string", "source_metric_id": "string",
    "source_evidence_ids": "array<string>", "is_interpretation": "boolean", "methodology_version": "string", "definition_context": "string",
}


def as_evidence(df: DataFrame, carry: Sequence[str] = (), **columns: Column) -> DataFrame:
    """Shape to the common schema; fields neither given nor present are null."""
    def pick(name: str, kind: str) -> Column:
        c = columns.get(name, F.col(name) if name in df.columns else F.lit(None))
        return c.cast(kind).alias(name)

    return df.select(*[pick(n, k) for n, k in EVIDENCE_SCHEMA.items()], *carry)


def literal_map(pairs: Mapping[str, str]) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), F.lit(v))])


def normalise_evidence(frame: DataFrame) -> DataFrame:
    """Sorted distinct lineage, interpretation flag from the type, defaults for optional text. An origin comes along."""
    return as_evidence(
        frame, [c for c in ("origin",) if c in frame.columns],
        source_evidence_ids=F.array_sort(F.array_distinct(F.coalesce("source_evidence_ids", F.array().cast("array<string>")))),
        is_interpretation=F.col("evidence_type") == "INTERPRETATION")


def evidence_rules() -> dict[str, Column]:
    required = ("business_domain", "claim", "claim_kind", "source", "methodology_version", "definition_context")
    rules = {"id_present": ~blank(F.col("evidence_id")), "type_known": F.col("evidence_type").isin(*RULES.EVIDENCE_TYPES)}
    rules |= {f"{c}_present": ~blank(F.col(c)) for c in required}
    rules["interpretation_has_source"] = (F.col("evidence_type") != "INTERPRETATION") | (F.size("source_evidence_ids") > 0)
    return rules


def evidence_violations(frame: DataFrame) -> DataFrame:
    return failed_rules(normalise_evidence(frame), evidence_rules())


def lineage_array(text: Column) -> Column:
    """Stored lineage text (a JSON array, or one bare id) to a real array."""
    decoded = F.from_json(text, "array<string>")
    return F.coalesce(decoded, F.when(F.trim(F.coalesce(text, F.lit(""))) != "", F.array(text)).otherwise(F.array().cast("array<string>")))


# --- adapters and registry ---------------------------------------------------------

FACT_IDENTITY = (
    "evidence_type", "business_domain", "entity", "metric_id", "reference_date", "period_start", "period_end", "period_type", "period_label", "unit",
    "claim", "source", "source_url", "filing_date", "accession_number", "source_bronze_file", "source_content_sha256",
)


GROWTH_PERIODS = ("QUARTER", "YTD", "FY")


def sign_kind(value: Column, up: str = "yoy_growth", down: str = "yoy_decline") -> Column:
    return F.when(value > 0, F.lit(up)).when(value < 0, F.lit(down)).when(value == 0, F.lit("unchanged"))


def adapt_facts(facts: DataFrame, domains: Mapping[str, tuple[str, str]], source: str, families: Mapping | None = None) -> DataFrame:
    """Reported period facts as FACT evidence with a content id."""
    version = F.col("definition_version")
    family = comparison_family(F.col("metric_id"), version, families or {})
    shaped = as_evidence(
        facts, claim_kind=F.lit("level"), source_metric_id=F.col("metric_id"), source_evidence_ids=F.array().cast("array<string>"), is_interpretation=F.lit(False),
        methodology_version=F.lit("1"), definition_context=_fact_context(family, version), **_fact_identity(_fact_fields(facts), domains, source))
    return shaped.withColumn("evidence_id", content_id([*FACT_IDENTITY, number_token(F.col("value"))], "fact", F.col("evidence_id")))


def _fact_context(family: Column, version: Column) -> Column:
    return F.concat(F.lit("definition_version="), family, F.lit(";reported_definition="), version)


def _fact_fields(facts: DataFrame, prefix: str = "") -> dict[str, Column]:
    """The columns of a fact; with `prefix` those of its prior, for all that the two may not share."""
    names = [c for c in (*FACT_IDENTITY, "filed_at", "value", "evidence_id") if c in facts.columns]
    return {c: F.col(prefix + c) if prefix + c in facts.columns else F.col(c) for c in names}


def _fact_identity(at: Mapping[str, Column], domains: Mapping[str, tuple[str, str]], source: str) -> dict[str, Column]:
    """The identifying evidence fields of a fact."""
    domain = literal_map({m: d for m, (d, _) in domains.items()})
    derived = {
        "evidence_type": F.lit("FACT"), "business_domain": F.coalesce(F.try_element_at(domain, at["metric_id"]), F.lit("Financial")), "reference_date": at["period_end"],
        "claim": F.concat(F.lit("Reported "), at["metric_id"], F.lit(" was "), significant_text(at["value"]), F.lit(" "), at["unit"], F.lit(" at "), at["period_end"].cast("string"), F.lit(".")),
        "source": F.lit(source), "filing_date": at["filed_at"]}
    return {**{c: at[c] for c in (*FACT_IDENTITY, "evidence_id") if c in at}, **derived}


def _fact_id(at: Mapping[str, Column], domains: Mapping[str, tuple[str, str]], source: str) -> Column:
    """The content id that `adapt_facts` gives a fact, from its narrow columns."""
    identity = _fact_identity(at, domains, source)
    fields = [identity.get(c, F.lit(None)).cast(EVIDENCE_SCHEMA[c]) for c in FACT_IDENTITY]
    explicit = identity["evidence_id"].cast("string") if "evidence_id" in identity else None
    return content_id([*fields, number_token(at["value"])], "fact", explicit)


def series_observations(series: DataFrame, source: str = "source", carry: Sequence[str] = ()) -> DataFrame:
    """Published series values as observations with a templated claim; columns in `carry` come along."""
    label = F.coalesce(F.try_element_at(literal_map(RULES.FACT_LABELS), F.col("metric_id")), F.replace(F.col("metric_id"), F.lit("_"), F.lit(" ")))
    suffix = F.coalesce(F.try_element_at(literal_map(RULES.UNIT_SUFFIXES), F.col("unit")), F.concat(F.lit(" "), "unit"))
    when = F.when(F.col("metric_id") == "usd_brl_sell_rate", F.concat(F.lit("em "), F.col("reference_date").cast("string"))).otherwise(
        F.concat(F.lit("no período "), F.date_format("reference_date", "MM/yyyy")))
    claim = F.concat(label, F.lit(" foi "), _decimal_comma(F.col("value")), suffix, F.lit(" "), when, F.lit("."))
    return _observation(series, claim, F.lit("level"), F.col("metric_id"), F.lit("reported_macro_fact;source_value_preserved"), [], carry)


def derive_changes(changes: DataFrame, operation: str = "difference") -> Derivation:
    """Derived changes as observations with their calculation edges.

    `changes` holds metric_id, source_metric_id, reference_date, value, unit, frequency,
    source, definition_context and the operand ids `evidence_id` and
    `previous_evidence_id` (null for snapshots). Verb and kind of the claim follow the
    sign and the metric's vocabulary. An `origin`, the current operand's row, comes along.
    """
    current, previous = F.col("evidence_id").alias("_current"), F.col("previous_evidence_id").alias("_previous")
    origin = [c for c in ("origin",) if c in changes.columns]
    rows = change_observations(changes.select("*", current, previous).drop("evidence_id", "previous_evidence_id"), ["_current"], ["_current", "_previous", *origin])
    roles = F.filter(F.array(
        F.struct(F.col("_current").alias("source_evidence_id"), F.lit("current").alias("role")),
        F.struct(F.col("_previous").alias("source_evidence_id"), F.lit("previous").alias("role"))), lambda e: e["source_evidence_id"].isNotNull())
    edges = rows.select(F.col("evidence_id").alias("observation_id"), F.explode(roles).alias("e")).select(
        "observation_id", "e.source_evidence_id", "e.role", F.lit(operation).alias("operation"))
    return Derivation(rows.drop("_current", "_previous"), edges, None)


def change_observations(changes: DataFrame, parents: Sequence[str] = (), carry: Sequence[str] = ()) -> DataFrame:
    """Derived changes as observations; `parents` are id columns that become the lineage."""
    metric, value = F.col("metric_id"), F.col("value")
    vocabulary = F.coalesce(F.try_element_at(literal_map({m: v for m, (v, _) in RULES.CHANGE_TEXTS.items()}), metric), F.lit("change"))
    text = F.coalesce(
        F.try_element_at(literal_map({m: t for m, (_, t) in RULES.CHANGE_TEXTS.items()}), metric),
        F.concat(F.replace(metric, F.lit("_"), F.lit(" ")), F.lit(" {verb} {number} "), "unit", F.lit(" no período {month}.")))

    def word(i: int) -> Column:
        up = literal_map({v: w[0][i] for v, w in RULES.CHANGE_WORDS.items()})[vocabulary]
        down = literal_map({v: w[1][i] for v, w in RULES.CHANGE_WORDS.items()})[vocabulary]
        return F.when(value == 0, F.lit(RULES.UNCHANGED[i])).when(value > 0, up).otherwise(down)

    claim = F.replace(F.replace(F.replace(text, F.lit("{verb}"), word(1)), F.lit("{number}"), _decimal_comma(F.abs(value))),
                      F.lit("{month}"), F.date_format("reference_date", "MM/yyyy"))
    return _observation(changes, claim, word(0), F.col("source_metric_id"), F.col("definition_context"), parents, carry)


def _decimal_comma(value: Column) -> Column:
    return F.replace(significant_text(value), F.lit("."), F.lit(","))


def _observation(df: DataFrame, claim: Column, kind: Column, source_metric: Column, context: Column, parents: Sequence[str],
                 carry: Sequence[str] = ()) -> DataFrame:
    shaped = as_evidence(
        df.withColumns({"_claim": claim, "_kind": kind, "_source_metric": source_metric, "_context": context}), carry,
        evidence_type=F.lit("OBSERVATION"), business_domain=F.lit("Macro"), claim=F.col("_claim"), claim_kind=F.col("_kind"),
        source_metric_id=F.col("_source_metric"), definition_context=F.col("_context"),
        source_evidence_ids=F.array_sort(F.array_compact(F.array(*[F.col(p) for p in parents]))) if parents else F.array().cast("array<string>"),
        is_interpretation=F.lit(False), methodology_version=F.lit("1"))
    identity = ["evidence_type", "entity", "metric_id", "reference_date", "claim", "source_metric_id", "source", "definition_context", "unit", "frequency"]
    return shaped.withColumn("evidence_id", content_id([*identity, number_token(F.col("value"))], "observation"))


def adapt_statements(statements: DataFrame, source: str) -> DataFrame:
    """Narrative statements as evidence; ids and text are kept as they are."""
    return as_evidence(
        statements, evidence_type=F.lit("OBSERVATION"), evidence_id=F.col("observation_id"), claim=F.col("observation_text"), source=F.lit(source),
        source_evidence_ids=F.array("evidence_id"), is_interpretation=F.lit(False), methodology_version=F.lit("1"), definition_context=F.lit("source_statement_preserved"))


def registry(frames: Sequence[DataFrame]) -> DataFrame:
    """One registry from all sources; check `id_collisions` before it is stored."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [normalise_evidence(f) for f in frames])


def origin(at: Mapping[str, Column] | None = None) -> Column:
    """An evidence row as the origin of a row derived from it: its id and what its node is made of, from `at`, else from the columns."""
    return F.struct(*[(F.col(c) if at is None else at[c].cast(EVIDENCE_SCHEMA[c])).alias(c) for c in ("evidence_id", *L.NODE_FIELDS)]).alias("origin")


def id_collisions(evidence: DataFrame) -> DataFrame:
    from factweave.operators.quality import duplicate_keys

    return duplicate_keys(evidence, ["evidence_id"])


# --- calculation lineage -------------------------------------------------------------


@dataclass(frozen=True)
class Derivation:
    """Facts and derived observations, calculation edges, and what was left out and why."""

    registry: DataFrame
    edges: DataFrame
    omissions: DataFrame


def derive_growth(facts: DataFrame, scope: Mapping[str, tuple[str, str]], source: str, families: Mapping | None = None, unique: bool = False,
                  keep: Callable[[DataFrame], DataFrame] | None = None, edge_fields: Sequence[str] = (), origins: bool = False) -> Derivation:
    """FACT rows, their year-over-year observations and both operands of every calculation.

    One window pass over the narrow facts gives pairs and omissions; claims and ids, of the prior too, are projections
    of its rows, and nothing is joined back. `keep` (such as staging) stores the walked facts, so that facts,
    observations and edges read what one pass has written; with unique facts all of them come from there.
    Columns of the facts in `edge_fields` come along with the edges. With `origins` an observation
    carries the evidence row of its current fact, for `lineage.with_origins`.
    """
    inside = F.col("metric_id").isin(*scope)
    flows = F.coalesce(F.col("period_type").isin(*GROWTH_PERIODS), F.lit(False))
    carry = [c for c in (*FACT_IDENTITY, "filed_at", "evidence_id") if c in facts.columns and c not in ("entity", "metric_id", "unit", "period_type")]
    walked = paired_years(facts.filter(inside & flows) if unique else facts.filter(inside), ("entity",), families=families or {}, carry=carry, unique=unique, keep_unpaired=True)
    base = F.col("prior_value")
    walked = walked.withColumn("derives", F.coalesce(F.col("paired") & is_finite(base) & (base > 0) & flows, F.lit(False)))
    others = facts.filter(~F.coalesce(inside, F.lit(False)) | ~flows) if unique else facts.filter(~F.coalesce(inside, F.lit(False)))
    rows = walked.unionByName(others.withColumn("derives", F.lit(False)), allowMissingColumns=True)
    rows = keep(rows) if keep else rows
    # Facts that occur twice are no rows of the walk.
    evidence = adapt_facts(rows if unique else facts, scope, source, families)
    # A filter on derived columns may be tried before the pairs are picked: a base that is not positive divides nothing.
    growth = growth_percent(F.col("value"), F.when(base > 0, base))
    pairs = rows.filter("derives").withColumns({"_current": _fact_id(_fact_fields(rows), scope, source), "_previous": _fact_id(_fact_fields(rows, "prior_"), scope, source)})
    version = F.col("definition_version")
    metric = F.concat("metric_id", F.lit("_yoy_growth"))
    child = content_id(["_current", "_previous", metric], "growth")
    domain = literal_map({m: d for m, (d, _) in scope.items()})
    context = _fact_context(comparison_family(F.col("metric_id"), version, families or {}), version)
    fact = {**_fact_identity(_fact_fields(rows), scope, source), "evidence_id": F.col("_current"), "source_metric_id": F.col("metric_id"), "definition_context": context}
    observed = as_evidence(
        pairs.withColumns({"_id": child, "_value": growth, "_metric": metric, **({"origin": origin(fact)} if origins else {})}).drop("claim", "claim_kind"), ["origin"] if origins else [],
        evidence_id=F.col("_id"), evidence_type=F.lit("OBSERVATION"), business_domain=F.coalesce(F.try_element_at(domain, F.col("metric_id")), F.lit("Financial")),
        reference_date=F.col("period_end"), value=F.col("_value"), unit=F.lit("percent"), source_metric_id=F.col("metric_id"), source=F.lit(source), filing_date=F.col("filed_at"),
        metric_id=F.col("_metric"), claim_kind=sign_kind(F.col("_value")), source_evidence_ids=F.array("_current"), is_interpretation=F.lit(False), methodology_version=F.lit("1"),
        claim=F.concat(F.lit("Metric "), "_metric", F.lit(" for "), "period_label", F.lit(" at "), F.col("period_end").cast("string"), F.lit(" is derived.")),
        definition_context=F.concat(context, F.lit(f";derivation_version=1;formula={YOY_FORMULA}")))
    edges = pairs.select(child.alias("observation_id"), *edge_fields, F.explode(F.array(
        F.struct(F.col("_current").alias("source_evidence_id"), F.lit("current").alias("role")),
        F.struct(F.col("_previous").alias("source_evidence_id"), F.lit("previous").alias("role")))).alias("e")).select(
        "observation_id", "e.source_evidence_id", "e.role", F.lit("yoy").alias("operation"), *edge_fields)
    reason = F.when(inside, F.lit(RULES.NO_BASELINE)).otherwise(F.lit(RULES.OUT_OF_SCOPE))
    omitted = rows.filter(~F.col("derives") & inside.isNotNull()).select(
        _fact_id(_fact_fields(rows), scope, source).alias("evidence_id"), "metric_id", "period_start", "period_end", "accession_number", reason.alias("reason"))
    return Derivation(registry([evidence, observed]), edges, omitted)


def recompute_lineage(evidence: DataFrame, edges: DataFrame) -> DataFrame:
    """Derived rows whose value, roles or operands do not hold up, with the broken rules.

    Every edge meets its operand once, operands of an observation are pivoted by role,
    and the result meets the observation once. Ids travel packed.
    """
    fields = ["value", "unit", "metric_id", "business_domain", "entity", "reference_date", "period_start", "period_end", "period_type", "period_label", "source"]
    nodes = evidence.select(packed_id(F.col("evidence_id")).alias("_source"), F.struct(*fields).alias("node"))
    asked = edges.select(packed_id(F.col("observation_id")).alias("_of"), packed_id(F.col("source_evidence_id")).alias("_source"), "role", "operation")
    joined = asked.join(nodes, "_source", "left")
    operands = joined.groupBy("_of").agg(
        F.count(F.lit(1)).alias("n_edges"), F.count("node").alias("n_known"),
        F.min("operation").alias("operation"), F.max("operation").alias("_other_operation"),
        F.count_if(F.col("role") == "current").alias("n_current"), F.count_if(F.col("role") == "previous").alias("n_previous"),
        F.max(F.when(F.col("role") == "current", F.col("node"))).alias("cur"), F.max(F.when(F.col("role") == "previous", F.col("node"))).alias("prev"),
        F.max(F.when(F.col("role") == "current", F.col("_source"))).alias("_current_id"))
    derived = evidence.filter(F.contains("definition_context", F.lit("derivation_version=1"))).select(
        packed_id(F.col("evidence_id")).alias("_id"), "value", "metric_id", "business_domain", "reference_date", "source_metric_id",
        F.transform("source_evidence_ids", packed_id).alias("_support"))
    rows = derived.join(operands, F.col("_id") == F.col("_of"), "full_outer")
    cur, prev = (lambda c: F.col(f"cur.{c}")), (lambda c: F.col(f"prev.{c}"))
    op = F.col("operation")
    snapshot = op == "snapshot"
    expected = (
        F.when(op.isin("yoy", "percent_change"), growth_percent(cur("value"), F.when(prev("value") != 0, prev("value"))))
        .when(op == "difference", cur("value") - prev("value")).when(snapshot, cur("value")))
    same = lambda c: cur(c).eqNullSafe(prev(c))
    month_day = lambda c: F.date_format(c, "MM-dd")
    yoy = (
        (F.year(cur("period_end")) == F.year(prev("period_end")) + 1) & month_day(cur("period_end")).eqNullSafe(month_day(prev("period_end")))
        & month_day(cur("period_start")).eqNullSafe(month_day(prev("period_start"))) & same("period_type") & same("period_label") & (prev("value") > 0)
        & F.col("metric_id").eqNullSafe(F.concat(cur("metric_id"), F.lit("_yoy_growth"))))
    rules = {
        "edges_present": F.col("n_edges").isNotNull(),
        "observation_known": F.col("_id").isNotNull(),
        "operands_known": F.col("n_known") == F.col("n_edges"),
        "roles_complete": (op == F.col("_other_operation")) & (F.col("n_current") == 1) & (F.col("n_previous") == F.when(snapshot, 0).otherwise(1)),
        "operands_compatible": snapshot | (same("metric_id") & same("business_domain") & same("entity") & same("unit") & (cur("metric_id") == F.col("source_metric_id"))
                                           & (cur("business_domain") == F.col("business_domain"))),
        "periods_compatible": F.when(op == "yoy", yoy).otherwise(snapshot | (prev("reference_date") < cur("reference_date"))),
        "support_is_current": F.col("_support").eqNullSafe(F.when(F.col("reference_date") == cur("reference_date"), F.array("_current_id")).otherwise(F.array().cast("array<binary>"))),
        "value_recomputes": is_close(F.col("value"), expected),
    }
    return failed_rules(rows, rules).select(unpacked_id(F.coalesce("_id", "_of")).alias("evidence_id"), "value", expected.alias("expected_value"), "violations")


def lineage_closure(rows: DataFrame, evidence: DataFrame, identity: str, own: bool = False, sources: str = "source_evidence_ids") -> DataFrame:
    """One hop: the direct sources of a row, and the row itself if `own`, with their types, metrics and source names.

    Ids and types stay aligned in id order; `missing` counts ids the registry lacks.
    """
    nodes = F.col("lineage")
    return L.with_lineage(rows, evidence, identity, sources, own).select(
        identity, L.field(nodes, "id").alias("lineage_ids"), L.field(nodes, "type").alias("lineage_types"), L.lineage_metrics(nodes).alias("lineage_metrics"),
        L.known(nodes, "source").alias("lineage_sources"), L.known(nodes, "context").alias("lineage_contexts"), L.same_period(nodes).alias("same_period"), "missing")


def lineage_orphans(rows: DataFrame, evidence: DataFrame, identity: str, sources: str = "source_evidence_ids", types: str | None = None) -> DataFrame:
    """Lineage ids the registry lacks, and ids recorded under another type. Ids travel packed."""
    entry = F.arrays_zip(F.col(sources).alias("id"), (F.col(types) if types else F.col(sources)).alias("type"))
    recorded = [F.col("e.type").alias("recorded_type")] if types else []
    exploded = rows.select(identity, F.explode(entry).alias("e")).select(packed_id(F.col(identity)).alias("_of"), packed_id(F.col("e.id")).alias("_source"), *recorded)
    known = F.col("evidence_type") if types else F.lit(True)
    joined = exploded.join(evidence.select(packed_id(F.col("evidence_id")).alias("_source"), known.alias("_known")), "_source", "left")
    unknown = F.col("_known").isNull()
    problem = F.when(unknown, F.lit("UNKNOWN_ID"))
    if types:
        problem = problem.when(F.col("_known") != F.col("recorded_type"), F.lit("TYPE_MISMATCH"))
    return joined.select("_of", "_source", problem.alias("problem")).filter(F.col("problem").isNotNull()).select(
        unpacked_id(F.col("_of")).alias(identity), unpacked_id(F.col("_source")).alias("source_evidence_id"), "problem")


def supporting_evidence(rows: DataFrame, evidence: DataFrame, sources: str = "source_evidence_ids") -> DataFrame:
    """Registry rows named in any lineage array."""
    named = rows.select(F.explode(sources).alias("evidence_id")).groupBy("evidence_id").agg(F.count(F.lit(1)).alias("references"))
    return evidence.join(named, "evidence_id")


def supporting_origins(rows: DataFrame) -> DataFrame:
    """`supporting_evidence` of rows that carry the registry row they name as `origin`: copies are counted before they travel, and no registry is met."""
    fields = ("evidence_id", *L.NODE_FIELDS)
    named = rows.filter(F.col("origin").isNotNull()).select(packed_id(F.col("origin.evidence_id")).alias("_id"), *[f"origin.{c}" for c in L.NODE_FIELDS])
    return named.groupBy("_id").agg(*[F.any_value(c).alias(c) for c in L.NODE_FIELDS], F.count(F.lit(1)).alias("references")).withColumn(
        "evidence_id", unpacked_id(F.col("_id"))).select(*fields, "references")


def definition_conflicts(rows: DataFrame, group: Sequence[str], context: str = "definition_context", series: Sequence[str] = ()) -> DataFrame:
    """Definition keys with more than one value inside a group.

    Interpretations carry no definition. With `series`, `population` is compared only
    within one series.
    """
    if "evidence_type" in rows.columns:
        rows = rows.filter(F.col("evidence_type") != "INTERPRETATION")
    text = F.coalesce(F.col(context), F.lit(""))
    keys = F.regexp_extract_all(text, F.lit(RULES.DEFINITION_TOKEN), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(RULES.DEFINITION_TOKEN), F.lit(2))
    tokens = rows.select(*group, *series, F.explode(F.arrays_zip(keys.alias("k"), values.alias("v"))).alias("t")).select(
        *group, *series, F.lower("t.k").alias("definition_key"), F.lower(F.trim("t.v")).alias("definition_value"))
    local = F.when(F.col("definition_key") == "population", F.concat_ws("/", *series)) if series else F.lit(None).cast("string")
    return (
        tokens.withColumn("series", local).groupBy(*group, "definition_key", "series")
        .agg(F.min("definition_value").alias("first_value"), F.max("definition_value").alias("last_value"))
        .filter("first_value <> last_value")
    )


# --- interpretations and classifications ----------------------------------------------


def _interpretation(rows: DataFrame, sources: Column, **columns: Column) -> DataFrame:
    shaped = as_evidence(
        rows.withColumn("_ids", F.array_sort(sources)), [c for c in ("origin",) if c in rows.columns], evidence_type=F.lit("INTERPRETATION"), source=F.lit("deterministic_rule_based_interpretation"),
        source_evidence_ids=F.col("_ids"), is_interpretation=F.lit(True), methodology_version=F.lit("1"),
        definition_context=F.lit("rule_based;non_causal;source_claim_preserved"), **columns)
    return shaped.withColumn("evidence_id", content_id(
        ["business_domain", "metric_id", "reference_date", "claim", F.array_join("source_evidence_ids", ",")], "interpretation"))


def interpretations(evidence: DataFrame, rules: Mapping[str, tuple[str, str, str]] = RULES.INTERPRETATIONS, origins: bool = False) -> DataFrame:
    """Allowlisted single-source interpretations of observations, which they carry as `origin` with `origins`."""
    value = finite_or_null(F.col("value"))
    predicate = literal_map({m: r[0] for m, r in rules.items()})[F.col("metric_id")]
    holds = (
        F.when(predicate == "positive_value", value > 0).when(predicate == "growth_claim", F.col("claim_kind").isin(*RULES.GROWTH_CLAIMS))
        .when(predicate == "decline_claim", F.col("claim_kind").isin(*RULES.DECLINE_CLAIMS)).otherwise(F.lit(False)))
    eligible = evidence.filter((F.col("evidence_type") == "OBSERVATION") & F.col("metric_id").isin(*rules) & holds)
    return _interpretation(
        eligible.withColumn("origin", origin()) if origins else eligible, F.array("evidence_id"), claim=literal_map({m: r[1] for m, r in rules.items()})[F.col("metric_id")],
        claim_kind=literal_map({m: r[2] for m, r in rules.items()})[F.col("metric_id")])


def joint_interpretations(evidence: DataFrame, keys: Sequence[str] = ("entity",), metrics: Sequence[str] = RULES.JOINT_METRICS, text: str = RULES.JOINT_TEXT,
                          kind: str = "joint_increase") -> DataFrame:
    """Two-source rule: both metrics positive with equal date, domain, period and definition.

    The pair comes from one pivoting aggregate; an ambiguous side gives nothing.
    """
    left, right = metrics
    shared = [*keys, "reference_date", "business_domain", "period_start", "period_end", "period_type", "period_label", "definition_context"]
    metric = F.col("metric_id")
    wide = evidence.filter((F.col("evidence_type") == "OBSERVATION") & metric.isin(left, right)).groupBy(*shared).agg(
        F.count_if(metric == left).alias("n_left"), F.count_if(metric == right).alias("n_right"), F.min("value").alias("_least"),
        F.max(F.when(metric == left, F.col("evidence_id"))).alias("_left"), F.max(F.when(metric == right, F.col("evidence_id"))).alias("_right"),
        F.max(F.when(metric == left, F.col("source_metric_id"))).alias("_ml"), F.max(F.when(metric == right, F.col("source_metric_id"))).alias("_mr"))
    both = wide.filter((F.col("n_left") == 1) & (F.col("n_right") == 1) & (F.col("_least") > 0)).drop("definition_context")
    name = left.removesuffix("_yoy_growth") + "_and_" + right
    return _interpretation(both, F.array("_left", "_right"), metric_id=F.lit(name), claim=F.lit(text), claim_kind=F.lit(kind), value=F.lit(None), unit=F.lit(None),
                           source_metric_id=F.array_join(F.array_sort(F.array("_ml", "_mr")), ";"))


def dimension(metric: Column, domain: Column, kind: Column, context: Column, source: Column) -> Column:
    """Six-dimension class of one evidence row; fixed precedence, null when no rule applies."""
    structured = ~blank(metric) & ~blank(source)
    social = reduce(lambda a, b: a | b, [(metric == m) & (domain == d) for m, d in RULES.SOCIAL_METRICS.items()])
    chain = (
        F.when(metric.isin(*RULES.ADOPTION_METRICS) & kind.isin(*RULES.ADOPTION_CLAIMS) & F.contains(context, F.lit("technology_adoption")), F.lit("TECHNOLOGICAL"))
        .when(metric.isin(*RULES.ECONOMIC_METRICS) & (domain == "Macro"), F.lit("ECONOMIC"))
        .when(social & kind.isin(*RULES.SOCIAL_CLAIMS), F.lit("SOCIAL")))
    for name, kinds in RULES.STRUCTURED_CLAIMS.items():
        chain = chain.when(structured & kind.isin(*kinds), F.lit(name))
    return chain


def evidence_dimension() -> Column:
    return dimension(*[F.col(c) for c in ("metric_id", "business_domain", "claim_kind", "definition_context", "source")])


# What the single-source interpretations and their ids are made of.
INTERPRETED = ("evidence_id", "evidence_type", "business_domain", "metric_id", "reference_date", "value", "claim_kind")
# What classification reads of the evidence, besides its lineage.
CLASSIFIED = (
    "evidence_id", "evidence_type", "business_domain", "entity", "metric_id", "reference_date", "period_start", "period_end", "period_type", "period_label", "value",
    "claim", "claim_kind", "source", "source_metric_id", "is_interpretation", "definition_context")


def _lined(rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """rows with their lineage, unless they carry it already."""
    return rows if "lineage" in evidence.columns else L.with_lineage(rows, evidence)


def classify_dimensions(evidence: DataFrame, lineage: bool = False) -> DataFrame:
    """Supported evidence once each, with its one-hop lineage; unsupported rows are left out.

    `status` is OK, UNKNOWN_SOURCE (lineage ids missing) or FORBIDDEN_WORDING. `lineage` keeps the nodes for later steps.
    """
    classed = evidence.withColumn("pestel_dimension", evidence_dimension()).filter(F.col("pestel_dimension").isNotNull())
    joined, nodes = _lined(classed, evidence), F.col("lineage")
    rationale = literal_map(RULES.RATIONALES)[F.col("pestel_dimension")]
    forbidden = F.coalesce(has_part(F.col("claim"), RULES.DIMENSION_WORDING), F.lit(False)) | has_part(rationale, RULES.DIMENSION_WORDING)
    status = F.when(F.col("missing") > 0, F.lit("UNKNOWN_SOURCE")).when(forbidden, F.lit("FORBIDDEN_WORDING")).otherwise(F.lit("OK"))
    ids = L.field(nodes, "id")
    return joined.select(
        content_id(["pestel_dimension", "claim", F.array_join(ids, ","), "reference_date"], "dimension").alias("pestel_id"),
        "evidence_id", "pestel_dimension", "business_domain", "entity", "metric_id", "reference_date", "period_start", "period_end", "period_type", "claim",
        rationale.alias("classification_rationale"), ids.alias("source_evidence_ids"), L.field(nodes, "type").alias("source_evidence_types"), L.lineage_metrics(nodes).alias("source_metric_ids"),
        F.array_join(L.known(nodes, "source"), ";").alias("source"), "is_interpretation", "definition_context", status.alias("status"), *(["lineage"] if lineage else []))


def _quadrant() -> tuple[Column, Column, Column]:
    """Internal category, external category, and the dimension that the external rule asks for."""
    value, kind, metric = finite_or_null(F.col("value")), F.lower("claim_kind"), F.col("metric_id")
    internal_domain = literal_map({m: d for m, (d, _) in RULES.INTERNAL_GROWTH.items()})
    inside = F.col("business_domain").isin(*RULES.INTERNAL_DOMAINS)
    allowed = inside & F.coalesce(F.try_element_at(internal_domain, metric) == F.col("business_domain"), F.lit(False))
    internal = F.when(allowed & (value > 0) & kind.isin(*RULES.STRENGTH_CLAIMS), F.lit("STRENGTH")).when(
        allowed & (value < 0) & kind.isin(*RULES.WEAKNESS_CLAIMS), F.lit("WEAKNESS"))
    hits = {name: ~F.coalesce(inside, F.lit(False)) & (metric == name) & (value > 0) & F.col("claim_kind").isin(*kinds) for name, _, _, kinds, *_ in RULES.EXTERNAL_RULES}
    chosen = lambda at: F.coalesce(*[F.when(hits[r[0]], F.lit(r[at])) for r in RULES.EXTERNAL_RULES])
    return internal, chosen(2), chosen(1)


def matched_dimensions(external: DataFrame, dimensions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per external evidence row (evidence_id, metric_id, source_metric_id, _dimension) the dimension records that name it, by its packed id `_key`.

    `problem`: why one of them, of whatever dimension, may not be combined; `source_pestel_ids` and `matched`:
    ids and merged nodes of those of the dimension asked for. A record meets the rows it names
    through an inverted index of packed ids; what is gathered per row is what its result lists. Only ids whose node
    has the metric of an external rule and no internal domain can be asked for: all others stay out of the index, and what a record
    says of itself is judged before it travels.
    """
    records = dimensions.filter("status = 'OK'")
    if "lineage" not in dimensions.columns:
        records = L.with_lineage(records, evidence, "pestel_id", own=False)
    fields = [c for c in ("period_start", "period_end", "period_type", "period_label") if c in records.columns]
    nodes, needed = F.col("lineage"), sorted({r[1] for r in RULES.EXTERNAL_RULES})
    askable = lambda n: n["metric"].isin(*[r[0] for r in RULES.EXTERNAL_RULES]) & ~F.coalesce(n["domain"].isin(*RULES.INTERNAL_DOMAINS), F.lit(False))
    own = L.record_problem(nodes, {"date": F.col("reference_date"), "domain": F.col("business_domain"), **{c: F.col(c) for c in fields}}, F.col("definition_context"))
    open_ids = records.withColumn("_named", F.array_intersect("source_evidence_ids", L.field(F.filter(nodes, askable), "id"))).filter(F.size("_named") > 0)
    named = open_ids.select(
        packed_id(F.col("pestel_id")).alias("_pestel_id"), "pestel_dimension", F.col("source_metric_ids").alias("_metrics"), F.coalesce(L.problem(nodes), own).alias("_problem"),
        F.when(F.col("pestel_dimension").isin(*needed), L.packed(nodes)).alias("_nodes"), F.explode("_named").alias("evidence_id")).withColumn("_key", packed_id(F.col("evidence_id"))).drop("evidence_id")
    asked = external.select(packed_id(F.col("evidence_id")).alias("_key"), "_dimension", F.array_union(F.array("metric_id"), L.metrics_of(F.col("source_metric_id"), F.lit(None))).alias("_own"))
    problem = F.when(~F.coalesce(F.arrays_overlap("_metrics", "_own"), F.lit(False)), F.lit("INCOMPATIBLE_DIMENSION")).otherwise(F.col("_problem"))
    right = F.col("pestel_dimension") == F.col("_dimension")
    return asked.join(named, "_key").groupBy("_key").agg(
        F.min(problem).alias("problem"), F.array_sort(F.transform(F.collect_set(F.when(right, F.col("_pestel_id"))), unpacked_id)).alias("source_pestel_ids"),
        L.merged(L.unpacked(F.flatten(F.collect_set(F.when(right, F.col("_nodes")))))).alias("matched"))


def classify_quadrants(evidence: DataFrame, dimensions: DataFrame) -> DataFrame:
    """Internal growth by sign, external changes by the dimension records that name them.

    An external row stands on the union of its matched records' lineage. `status` is OK, UNKNOWN_SOURCE,
    INCOMPATIBLE_METRICS, INCOMPATIBLE_PERIOD or INCOMPATIBLE_DEFINITION (sources that may not be combined, its
    own or those of a record that names it), INCOMPATIBLE_DIMENSION (such a record shares no metric or is of another
    domain), NO_DIMENSION (no record of the dimension asked for) or FORBIDDEN_WORDING (claim, assessment or rationale).
    """
    metric = F.col("metric_id")
    internal, external, needed = _quadrant()
    classed = evidence.withColumns({"swot_category": F.coalesce(internal, external), "_dimension": needed}).filter(F.col("swot_category").isNotNull())
    linked = matched_dimensions(classed.filter(F.col("_dimension").isNotNull()), dimensions, evidence)
    lined = _lined(classed, evidence)
    # Only external rows have records to meet; all others stay where they are.
    outside = lined.filter(F.col("_dimension").isNotNull()).withColumn("_key", packed_id(F.col("evidence_id"))).drop("evidence_id")
    joined = outside.join(linked, "_key", "left").withColumn("evidence_id", unpacked_id(F.col("_key"))).drop("_key")
    joined = joined.unionByName(lined.filter(F.col("_dimension").isNull()), allowMissingColumns=True)
    is_external = F.col("_dimension").isNotNull()
    pestel = F.coalesce("source_pestel_ids", F.array().cast("array<string>"))
    nodes = F.when(F.size("matched") > 0, F.col("matched")).otherwise(F.col("lineage"))
    joined = joined.withColumns({"_pestel": pestel, "_nodes": nodes, "_first": L.problem(F.col("lineage"))})
    nodes = F.col("_nodes")
    subject = literal_map({m: s for m, (_, s) in RULES.INTERNAL_GROWTH.items()})
    internal_text = F.concat(
        F.lit("The reported "), F.when(F.col("swot_category") == "STRENGTH", F.lit("expansion")).otherwise(F.lit("contraction")), F.lit(" in "),
        F.try_element_at(subject, metric), F.lit(" is classified as an internal "), F.lower("swot_category"), F.lit(" under the explicit metric allowlist."))
    assessment = F.when(is_external, literal_map({r[0]: r[5] for r in RULES.EXTERNAL_RULES})[metric]).otherwise(internal_text)
    rationale = F.when(is_external, literal_map({r[0]: r[6] for r in RULES.EXTERNAL_RULES})[metric]).otherwise(F.lit(RULES.INTERNAL_RATIONALE))
    worded = F.concat_ws(" | ", "claim", assessment, rationale)
    status = F.coalesce(
        F.when(F.col("missing") > 0, F.lit("UNKNOWN_SOURCE")), F.col("_first"), F.when(is_external, F.col("problem")),
        F.when(is_external & (F.size("_pestel") == 0), F.lit("NO_DIMENSION")), F.when(is_external, L.problem(nodes)),
        F.when(worded.rlike(RULES.QUADRANT_WORDING), F.lit("FORBIDDEN_WORDING")), F.lit("OK"))
    note = literal_map({r[0]: ";" + r[4] for r in RULES.EXTERNAL_RULES})
    ids = L.field(nodes, "id")
    return joined.withColumn("_assessment", assessment).select(
        content_id(["swot_category", "_assessment", "claim", F.array_join(ids, ","), F.array_join("_pestel", ","), "reference_date"], "quadrant").alias("swot_id"),
        "evidence_id", "swot_category", F.when(is_external, F.lit("EXTERNAL")).otherwise(F.lit("INTERNAL")).alias("scope"), "business_domain", "entity", "metric_id",
        "reference_date", "claim", F.col("_assessment").alias("assessment"), rationale.alias("classification_rationale"), ids.alias("source_evidence_ids"),
        L.field(nodes, "type").alias("source_evidence_types"), L.lineage_metrics(nodes).alias("source_metric_ids"), F.col("_pestel").alias("source_pestel_ids"),
        F.concat(F.array_join(L.known(nodes, "context"), ";"), F.when(is_external, note[metric]).otherwise(F.lit(""))).alias("definition_context"), status.alias("status"))


def cross_domain_pairs(evidence: DataFrame, keys: Sequence[str] = ("entity",), commerce: Sequence[str] = RULES.COMMERCE_METRICS,
                       fintech: Sequence[str] = RULES.FINTECH_METRICS) -> DataFrame:
    """Hypothesis and question rows for dates on which both domains have evidence.

    Per metric the highest evidence type counts and must be unique. `status` is OK,
    AMBIGUOUS or INCOMPATIBLE_PERIOD; metrics and types are counted first, so a date
    holds at most one row per listed metric when it is paired.
    """
    metric, domain = F.col("metric_id"), F.col("business_domain")
    listed = ((domain == "Commerce") & metric.isin(*commerce)) | ((domain == "Fintech") & metric.isin(*fintech))
    rank = F.create_map(*[x for k, v in RULES.EVIDENCE_PRIORITY.items() for x in (F.lit(k), F.lit(v))])[F.col("evidence_type")]
    group = [*keys, "reference_date"]
    payload = F.struct(
        packed_id(F.col("evidence_id")).alias("evidence_id"), F.transform("source_evidence_ids", packed_id).alias("source_evidence_ids"),
        "source_metric_id", "source", "period_type", "period_label", "period_start", "period_end", "evidence_type")
    by_type = evidence.filter(listed & F.col("reference_date").isNotNull()).groupBy(*group, "business_domain", "metric_id", rank.alias("rank")).agg(
        F.count(F.lit(1)).alias("n"), F.max(payload).alias("p"))
    # What is left, a row for each metric and type, is placed by the group once, for both steps that follow.
    best = by_type.repartition(*group).groupBy(*group, "business_domain", "metric_id").agg(F.max(F.struct("rank", "n", "p")).alias("b")).select(*group, "business_domain", "b.n", "b.p")
    label = F.concat_ws("|", "p.period_type", "p.period_label", F.col("p.period_start").cast("string"), F.col("p.period_end").cast("string"))
    paired = best.groupBy(*group).agg(
        F.count_if(domain == "Commerce").alias("n_commerce"), F.count_if(domain == "Fintech").alias("n_fintech"), F.max("n").alias("most"),
        F.min(label).alias("label_low"), F.max(label).alias("label_high"), F.min("p.period_start").alias("period_start"), F.max("p.period_end").alias("period_end"),
        F.collect_list("p").alias("rows")).filter("n_commerce > 0 AND n_fintech > 0")
    unpacked = lambda ids: F.array_sort(F.transform(ids, unpacked_id))
    ids = unpacked(F.array_distinct(F.flatten(F.transform("rows", lambda r: F.array_append(r["source_evidence_ids"], r["evidence_id"])))))
    interpretations_only = unpacked(F.transform(F.filter("rows", lambda r: r["evidence_type"] == "INTERPRETATION"), lambda r: r["evidence_id"]))
    collected = paired.select(
        *group, "period_start", "period_end", ids.alias("source_evidence_ids"), interpretations_only.alias("source_interpretation_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("rows", lambda r: F.split(r["source_metric_id"], ";"))))).alias("source_metric_ids"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("rows", lambda r: r["source"]))), ";").alias("source"),
        F.when(F.col("most") > 1, F.lit("AMBIGUOUS")).when(F.col("label_low") != F.col("label_high"), F.lit("INCOMPATIBLE_PERIOD")).otherwise(F.lit("OK")).alias("status"))
    identity = [*group, F.array_join("source_evidence_ids", ",")]
    hypothesis = content_id([F.lit(RULES.HYPOTHESIS), *identity], "hypothesis")
    question = content_id([F.lit(RULES.QUESTION), *identity, hypothesis], "question")
    none = F.array().cast("array<string>")
    return collected.withColumns({"_h": hypothesis, "_q": question}).withColumn("o", F.explode(F.array(
        F.struct(F.col("_h").alias("product_evidence_id"), F.lit("HYPOTHESIS").alias("product_evidence_type"), F.lit(RULES.HYPOTHESIS).alias("statement"), none.alias("source_hypothesis_ids")),
        F.struct(F.col("_q").alias("product_evidence_id"), F.lit("QUESTION_FOR_PRODUCT_DISCOVERY").alias("product_evidence_type"), F.lit(RULES.QUESTION).alias("statement"),
                 F.array("_h").alias("source_hypothesis_ids"))))).select("o.*", *group, "period_start", "period_end", "source_evidence_ids", "source_interpretation_ids",
                                                                   "source_metric_ids", "source", "status")


def product_violations(products: DataFrame) -> DataFrame:
    """Wording rules of hypotheses and questions."""
    statement, kind = collapse_blanks(F.col("statement")), F.col("product_evidence_type")
    starts = r"(?i)^(?:" + "|".join(RULES.QUESTION_STARTS) + r")\b"
    return failed_rules(products, {
        "type_known": kind.isin("HYPOTHESIS", "QUESTION_FOR_PRODUCT_DISCOVERY"),
        "wording_allowed": ~statement.rlike(RULES.PRODUCT_WORDING),
        "hypothesis_is_uncertain": (kind != "HYPOTHESIS") | uses_words(statement, RULES.UNCERTAIN_WORDS),
        "question_is_open": (kind == "HYPOTHESIS") | (statement.rlike(starts) & statement.endswith("?")),
        "lineage_present": F.size("source_evidence_ids") > 0,
        "hypothesis_linked": F.when(kind == "HYPOTHESIS", F.size("source_hypothesis_ids") == 0).otherwise(F.size("source_hypothesis_ids") > 0),
    })

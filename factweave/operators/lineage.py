"""Lineage carried beside rows: the compact nodes a record stands on, and whether they are compatible.

`with_lineage` gives every row the nodes of its one-hop lineage as an array. The row's own node is
built from the row, so only rows that name sources meet the registry, once, by the source id; all
others are a projection. Rows that carry their origin, the row they were derived from, meet nothing
(`with_origins`). What the nodes say (types, metrics, periods, definitions, conflicts) is then
computed inside the row, and records built on records merge arrays instead of joining again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from factweave.functions.identity import packed_id, unpacked_id
from factweave.operators import rules as RULES


def metrics_of(source_metric: Column, metric: Column) -> Column:
    """The metrics a row stands for: the listed source metrics, else its own."""
    return F.filter(F.split(F.coalesce(source_metric, metric, F.lit("")), ";"), lambda m: m != "")


def definition_tokens(context: Column, series: Column | None = None) -> Column:
    """Distinct `key=value` definitions of a context, lower-cased; a population is told apart by `series` where that is given."""
    text = F.coalesce(context, F.lit(""))
    keys, values = (F.regexp_extract_all(text, F.lit(RULES.DEFINITION_TOKEN), F.lit(i)) for i in (1, 2))
    key = lambda k: F.lower(k) if series is None else F.when(F.lower(k) == "population", F.concat(F.lit("population@"), series)).otherwise(F.lower(k))
    return F.array_distinct(F.zip_with(keys, values, lambda k, v: F.concat(key(k), F.lit("="), F.lower(F.trim(v)))))


def _key(token: Column) -> Column:
    return F.substring_index(token, "=", 1)


def conflicting(tokens: Column) -> Column:
    """Whether distinct tokens give one key two values."""
    return F.size(F.array_distinct(F.transform(tokens, _key))) < F.size(tokens)


# What a node is made of, besides the id.
NODE_FIELDS = ("evidence_type", "business_domain", "source_metric_id", "metric_id", "source", "reference_date", "period_type", "period_label", "period_start", "period_end", "definition_context")


def node(at: Callable[[str], Column] = F.col) -> Column:
    """The node of an evidence row, whose fields `at` gives. Interpretations define nothing."""
    tokens = F.when(at("evidence_type") == "INTERPRETATION", F.array().cast("array<string>")).otherwise(
        definition_tokens(at("definition_context"), F.concat_ws("/", at("business_domain"), at("metric_id"))))
    return F.struct(
        at("evidence_id").alias("id"), at("evidence_type").alias("type"), at("business_domain").alias("domain"),
        metrics_of(at("source_metric_id"), at("metric_id")).alias("metrics"), at("source").alias("source"), at("reference_date").alias("date"),
        at("period_type").alias("period_type"), at("period_label").alias("period_label"), at("period_start").alias("period_start"),
        at("period_end").alias("period_end"), at("definition_context").alias("context"), tokens.alias("tokens"), at("metric_id").alias("metric"))


def merged(nodes: Column) -> Column:
    """Distinct nodes in id order."""
    return F.array_sort(F.array_distinct(nodes))


def packed(nodes: Column) -> Column:
    """Nodes whose ids travel packed; `unpacked` gives them back."""
    return F.transform(nodes, lambda n: n.withField("id", packed_id(n["id"])))


def unpacked(nodes: Column) -> Column:
    return F.transform(nodes, lambda n: n.withField("id", unpacked_id(n["id"])))


def with_lineage(rows: DataFrame, evidence: DataFrame, identity: str = "evidence_id", sources: str = "source_evidence_ids", own: bool = True,
                 keep: Sequence[str] | None = None) -> DataFrame:
    """rows with `lineage`, the nodes of the row itself (if `own`: rows are evidence) and of the sources it names, in id order, and `missing`, how many of these ids the registry lacks.

    An id that the registry lacks has a node with nothing but the id. `keep`: the columns of the rows that
    leave, all by default; the fields of a node are needed if `own`. Ids travel packed.
    """
    listed = F.coalesce(F.array_distinct(F.array_compact(sources)), F.array().cast("array<string>"))
    ids = F.array_except(listed, F.array("evidence_id")) if own else listed
    columns = list(keep or rows.columns)
    given = rows.select(*columns, ids.alias("_ids"))
    # The registry travels with plain fields; nodes are built of the rows that were asked for.
    fields = evidence.select(packed_id(F.col("evidence_id")).alias("_id"), F.lit(True).alias("_known"), *NODE_FIELDS)
    kind = evidence.select(node().alias("_node")).schema["_node"].dataType
    unknown = F.struct(F.col("_id").alias("id"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields[1:]])
    asked = given.filter(F.size("_ids") > 0)
    met = asked.select(packed_id(F.col(identity)).alias("_of"), F.explode("_ids").alias("_id")).withColumn("_id", packed_id(F.col("_id"))).join(fields, "_id", "left").withColumn("evidence_id", F.col("_id"))
    found = met.groupBy("_of").agg(F.collect_list(F.when(F.col("_known"), node()).otherwise(unknown)).alias("_nodes"), F.count_if(F.col("_known").isNull()).alias("missing"))
    back = asked.select(packed_id(F.col(identity)).alias("_of"), *[c for c in columns if c != identity]).join(found, "_of").withColumns({
        identity: unpacked_id(F.col("_of")), "_nodes": unpacked(F.col("_nodes"))}).drop("_of")
    none = given.filter(F.size("_ids") == 0).drop("_ids").withColumns({"_nodes": F.array().cast(back.schema["_nodes"].dataType), "missing": F.lit(0).cast("long")})
    both = none.unionByName(back)
    return both.withColumn("lineage", merged(F.concat(F.array(node()), "_nodes") if own else F.col("_nodes"))).drop("_nodes")


def with_origins(rows: DataFrame) -> DataFrame:
    """rows with `lineage` and `missing` as `with_lineage` gives them, if `origin` holds the one evidence row that a row names as its source, null if it names none.

    Derived rows are made from the row of their source, so both nodes are a projection: nothing is staged, joined or exchanged.
    """
    own, source = node(), node(lambda name: F.col("origin")[name])
    return rows.withColumns({
        "lineage": F.when(F.col("origin").isNull(), F.array(own)).otherwise(merged(F.array(own, source))), "missing": F.lit(0).cast("long")}).drop("origin")


# --- what nodes say -----------------------------------------------------------------------


def field(nodes: Column, name: str) -> Column:
    return F.transform(nodes, lambda n: n[name])


def known(nodes: Column, name: str) -> Column:
    """Sorted distinct values of a field, nulls left out."""
    return F.array_sort(F.array_compact(F.array_distinct(field(nodes, name))))


def lineage_metrics(nodes: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.array_compact(field(nodes, "metrics")))))


def tokens_of(nodes: Column, local_population: bool = False) -> Column:
    """Definitions of all nodes; populations count per series only with `local_population`."""
    tokens = F.flatten(F.array_compact(field(nodes, "tokens")))
    if not local_population:
        tokens = F.transform(tokens, lambda t: F.regexp_replace(t, "^population@[^=]*=", "population="))
    return F.array_sort(F.array_distinct(tokens))


def same_period(nodes: Column, fields: Sequence[str] = ("date", "period_type", "period_label")) -> Column:
    """Whether the known values of each period field agree."""
    return _all([F.size(known(nodes, f)) <= 1 for f in fields])


def _all(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def problem(nodes: Column) -> Column:
    """Why nodes may not be combined: INCOMPATIBLE_METRICS, INCOMPATIBLE_PERIOD, INCOMPATIBLE_DEFINITION, or null."""
    barred = F.size(F.array_intersect(lineage_metrics(nodes), F.array(*[F.lit(m) for m in RULES.INCOMPATIBLE_METRICS]))) == len(RULES.INCOMPATIBLE_METRICS)
    return F.when(barred, F.lit("INCOMPATIBLE_METRICS")).when(~same_period(nodes), F.lit("INCOMPATIBLE_PERIOD")).when(conflicting(tokens_of(nodes)), F.lit("INCOMPATIBLE_DEFINITION"))


def record_problem(nodes: Column, record: dict[str, Column], context: Column) -> Column:
    """Why a record (its own date, domain, period fields and context) does not fit the nodes it names; null if it does.

    The record's domain is that of the first node. A period field counts where both sides know it.
    """
    dates = known(nodes, "date")
    off_date = (F.size(dates) > 0) & ((F.size(dates) != 1) | ~F.coalesce(F.element_at(dates, 1) == record["date"], F.lit(False)))
    off_domain = ~F.element_at(nodes, 1)["domain"].eqNullSafe(record["domain"])

    def off(name: str) -> Column:
        values = known(nodes, name)
        return (F.size(values) > 0) & record[name].isNotNull() & ((F.size(values) != 1) | (F.element_at(values, 1) != record[name]))

    off_period = _all([~F.coalesce(off(n), F.lit(False)) for n in ("period_start", "period_end", "period_type", "period_label") if n in record])
    theirs, ours = definition_tokens(context), tokens_of(nodes)
    shared = lambda tokens, others: F.array_sort(F.filter(tokens, lambda t: F.array_contains(F.transform(others, _key), _key(t))))
    differs = shared(theirs, ours) != shared(ours, theirs)
    return (
        F.when(off_date | ~off_period, F.lit("INCOMPATIBLE_PERIOD")).when(off_domain, F.lit("INCOMPATIBLE_DIMENSION")).when(differs, F.lit("INCOMPATIBLE_DEFINITION")))

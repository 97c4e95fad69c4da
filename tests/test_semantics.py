"""Hand-built frames for cases the tables do not hold."""

from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from factweave.functions import identity, numbers as N, text as T
from factweave.operators import asof as A, canonical as C, evidence as E, extraction as X, lineage as L, merge as M, normalise as NO, periods as P, quality as Q, ratios as R, rules as RULES

D = dt.date
FACT = "entity string, metric_id string, unit string, period_type string, period_start date, period_end date, reference_year int, period_label string, definition_version string, value double"


def fact(metric, end, value, start=None, kind="QUARTER", label="Q1", version="v1", entity="e"):
    return (entity, metric, "USD", kind, start, end, end.year, label, version, value)


def quarter(metric, year, value, **kw):
    return fact(metric, D(year, 3, 31), value, start=D(year, 1, 1), **kw)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# --- period comparison ----------------------------------------------------------


def test_growth_skips_gaps_and_bad_bases(spark):
    facts = spark.createDataFrame([
        quarter("a", 2000, 10.0), quarter("a", 2001, 15.0), quarter("a", 2003, 30.0),
        quarter("zero", 2000, 0.0), quarter("zero", 2001, 1.0), quarter("neg", 2000, -5.0), quarter("neg", 2001, 1.0),
        quarter("nan", 2000, math.nan), quarter("nan", 2001, 1.0)], FACT)
    assert rows(P.yoy_growth(facts), "metric_id", "reference_year", "value") == [("a_yoy_growth", 2001, 50.0)]


def test_growth_uses_the_year_of_the_period_end(spark):
    facts = spark.createDataFrame([quarter("a", 2000, 10.0), quarter("a", 2001, 20.0)], FACT).withColumn("reference_year", F.lit(1999))
    assert rows(P.yoy_growth(facts), "value") == [(100.0,)]


@pytest.mark.parametrize("unique", [True, False])
def test_ambiguous_periods_do_not_pair(spark, unique):
    facts = spark.createDataFrame([quarter("a", 2000, 10.0), quarter("a", 2001, 20.0), quarter("a", 2001, 21.0, label="other")], FACT)
    assert P.yoy_growth(facts, unique=unique).isEmpty()
    assert rows(P.ambiguous_periods(facts), "economic_year", "row_count") == [(2001, 2)]


def test_leap_february_pairs_by_month_but_not_by_signature(spark):
    facts = spark.createDataFrame([fact("a", D(2019, 2, 28), 10.0, D(2018, 12, 1)), fact("a", D(2020, 2, 29), 20.0, D(2019, 12, 1))], FACT)
    assert P.yoy_growth(facts).isEmpty()
    series = facts.select("entity", "metric_id", F.col("period_end").alias("reference_date"), "value")
    assert rows(P.month_change(series, back=12), "reference_date", "change") == [(D(2020, 2, 29), 100.0)]


def test_missing_month_gives_no_change_but_previous_observation_does(spark):
    series = spark.createDataFrame([("e", "m", D(2020, 1, 31), 1.0), ("e", "m", D(2020, 3, 31), 3.0)], "entity string, metric_id string, reference_date date, value double")
    assert P.month_change(series).isEmpty()
    assert rows(P.previous_observation_change(series), "change", "previous_reference_date") == [(2.0, D(2020, 1, 31))]


def test_zero_base_month_is_omitted_and_reported(spark):
    series = spark.createDataFrame([("e", "m", D(2020, 1, 31), 0.0), ("e", "m", D(2020, 2, 29), 3.0)], "entity string, metric_id string, reference_date date, value double")
    assert P.month_change(series).isEmpty()
    assert P.zero_base_months(series).count() == 1


def test_families_and_definition_context(spark):
    facts = spark.createDataFrame([
        quarter("tpv", 2023, 10.0, version="v2_recast_excludes_p2p"), quarter("tpv", 2024, 20.0, version="v2_excludes_p2p"), quarter("tpv", 2022, 5.0, version="v1_includes_p2p")], FACT)
    found = P.yoy_growth(facts, families=RULES.COMPARISON_FAMILIES)
    assert rows(found, "reference_year", "definition_context") == [(2024, "v2_excludes_p2p;prior=v2_recast_excludes_p2p")]


def test_qualifiers_are_judged_after_pairing(spark):
    base = spark.createDataFrame([fact("aum", D(y, 12, 31), v, kind="INSTANT", label="Q4") for y, v in ((2019, 1.0), (2020, 2.0), (2021, 4.0))], FACT)
    facts = base.withColumns({"scope": F.lit("total"), "value_qualifier": F.when(F.col("reference_year") == 2020, F.lit("approximate")).otherwise(F.lit("exact"))})
    assert P.yoy_qualified(facts).isEmpty()


def test_exact_period_join_is_null_safe(spark):
    facts = spark.createDataFrame([fact("a", D(2020, 3, 31), 6.0, kind="INSTANT", label=None), fact("b", D(2020, 3, 31), 3.0, kind="INSTANT", label=None)], FACT)
    assert rows(R.exact_period_join(facts, "a", "b"), "left_value", "right_value") == [(6.0, 3.0)]
    ratio = R.Ratio("r", "a", "b", unit="x", scale=None, same_definition=True)
    assert rows(R.period_ratio(facts, ratio), "value", "definition_context") == [(2.0, "a:v1;b:v1")]


def test_duplicated_metric_gives_no_ratio(spark):
    facts = spark.createDataFrame([quarter("a", 2020, 1.0), quarter("a", 2020, 2.0), quarter("b", 2020, 3.0)], FACT)
    assert R.exact_period_join(facts, "a", "b").isEmpty()
    assert R.duplicate_periods(facts, ["a", "b"]).count() == 1


def test_constant_and_short_series_have_no_correlation(spark):
    data = [("c", m, D(2020, i, 28), v) for i in (1, 2, 3) for m, v in (("a", 1.0), ("b", float(i)))] + [("s", m, D(2020, 1, 28), 1.0) for m in "ab"]
    series = spark.createDataFrame(data, "entity string, metric_id string, reference_date date, value double")
    found = Q.aligned_correlation(series, "a", "b", F.month("reference_date"), ["entity"])
    assert rows(found, "entity", "status", "correlation") == [("c", "CONSTANT", None), ("s", "TOO_FEW", None)]


# --- canonicalisation and merges -------------------------------------------------


FILING = "k string, filed_at date, accession_number string, value double"


def test_return_to_first_value_is_a_change_only_for_any(spark):
    data = [("x", D(2020, 1, 1), "1", 5.0), ("x", D(2020, 2, 1), "2", 6.0), ("x", D(2020, 3, 1), "3", 5.0)]
    random.Random(7).shuffle(data)
    facts = spark.createDataFrame(data, FILING)
    assert rows(C.latest_filing_wins(facts, ["k"], change="any"), "value", "occurrences", "has_value_change", "value_change") == [(5.0, 3, True, 0.0)]
    assert rows(C.latest_filing_wins(facts, ["k"], change="endpoints"), "has_value_change") == [(False,)]


def test_null_counts_as_a_value(spark):
    facts = spark.createDataFrame([("x", D(2020, 1, 1), "1", None), ("x", D(2020, 2, 1), "2", 6.0), ("y", None, None, None)], FILING)
    found = C.latest_filing_wins(facts, ["k"], change="any")
    assert rows(found, "k", "has_value_change", "value_change") == [("x", True, None), ("y", False, None)]


def test_replay_changes_nothing_and_conflicts_are_rows(spark):
    schema = "k string, value double, retrieved_at string"
    stored = spark.createDataFrame([("a", 1.0, "2"), ("b", None, "2")], schema)
    batch = spark.createDataFrame([("a", 1.0, "1"), ("b", None, "3"), ("c", 3.0, "3"), ("c", 3.0, "3")], schema)
    merged = M.append_only(stored, batch, ["k"], ["value"])
    assert rows(merged, "k", "merge_status", "retrieved_at") == [("a", "KEPT", "2"), ("b", "KEPT", "2"), ("c", "NEW", "3")]
    again = M.append_only(M.merged_rows(merged), batch, ["k"], ["value"])
    assert rows(again, "merge_status") == [("KEPT",)] * 3
    assert rows(M.keep_earliest(stored, batch, ["k"], "retrieved_at"), "k", "retrieved_at") == [("a", "1"), ("b", "2"), ("c", "3")]
    clash = M.append_only(stored, spark.createDataFrame([("a", 9.0, "9")], schema), ["k"], ["value"])
    assert rows(M.conflicts(clash), "k") == [("a",)]
    with pytest.raises(Q.ContractViolation):
        M.merged_rows(clash, strict=True)


# --- as-of ------------------------------------------------------------------------


AS_FACT = "entity string, reference_date date, filed_at date, accession_number string, value double"


def asof(spark, facts, day):
    return A.asof_bitemporal(spark.createDataFrame(facts, AS_FACT), spark.createDataFrame([("e", day)], "entity string, as_of date")).collect()[0]


def test_asof_needs_both_clocks_and_falls_back_past_invalid(spark):
    facts = [("e", D(2020, 1, 1), D(2020, 2, 1), "1", 10.0), ("e", D(2020, 3, 1), D(2020, 9, 1), "2", 20.0), ("e", D(2020, 2, 1), D(2020, 2, 2), "3", -1.0), ("e", D(2020, 2, 3), D(2020, 2, 4), "4", math.nan)]
    assert asof(spark, facts, D(2020, 6, 1)).value == 10.0
    assert asof(spark, facts, D(2020, 9, 1)).value == 20.0
    assert asof(spark, facts, D(2020, 1, 15)).outcome == "LOOKAHEAD"
    assert asof(spark, facts, D(2019, 1, 1)).outcome == "MISSING"
    assert asof(spark, facts[2:3], D(2020, 6, 1)).outcome == "INVALID"


def test_asof_tie_with_different_values_selects_nothing(spark):
    tie = [("e", D(2020, 1, 1), D(2020, 2, 1), "1", 10.0), ("e", D(2020, 1, 1), D(2020, 2, 1), "1", 11.0)]
    assert asof(spark, tie, D(2020, 6, 1)).outcome == "CONFLICT"
    assert asof(spark, tie[:1] * 2, D(2020, 6, 1)).value == 10.0


def test_latest_unavailable_row_never_falls_back(spark):
    schema = "entity string, reference_date date, value double, currency string, status string, quantity_reference_date date, quantity_filed_at date"
    data = spark.createDataFrame([
        ("e", D(2020, 1, 1), 5.0, "USD", "AVAILABLE", D(2019, 1, 1), D(2019, 1, 1)), ("e", D(2020, 2, 1), None, "USD", "UNAVAILABLE_LOOKAHEAD", None, None)], schema)
    asked = spark.createDataFrame([("e", D(2020, 1, 15)), ("e", D(2020, 3, 1)), ("e", D(2019, 1, 1))], "entity string, as_of date")
    assert rows(A.asof_no_fallback(data, asked), "as_of", "status", "value") == [
        (D(2019, 1, 1), "UNAVAILABLE_NO_ELIGIBLE_MARKET_CAP", None), (D(2020, 1, 15), "AVAILABLE", 5.0), (D(2020, 3, 1), "UNAVAILABLE_GOLD_MARKET_CAP", None)]


def test_asof_matches_brute_force(spark):
    r = random.Random(3)
    day = lambda: D(2020, 1, 1) + dt.timedelta(days=r.randrange(60))
    facts = [(r.choice("ab"), day(), day(), r.choice("123"), r.choice([-1.0, 1.0, 2.0, 3.0])) for _ in range(300)]
    asked = sorted({(r.choice("ab"), day()) for _ in range(80)})
    found = {(x.entity, x.as_of): x.value for x in A.asof_bitemporal(
        spark.createDataFrame(facts, AS_FACT), spark.createDataFrame(asked, "entity string, as_of date")).collect()}
    for entity, when in asked:
        usable = [f for f in facts if f[0] == entity and f[1] <= when and f[2] <= when and f[4] > 0]
        best = max((f[1:4] for f in usable), default=None)
        values = {f[4] for f in usable if f[1:4] == best}
        assert found[(entity, when)] == (values.pop() if len(values) == 1 else None)


# --- text and payloads ---------------------------------------------------------------


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).collect()[0].x


def test_html_text(spark):
    page = '<p title="a > b">A&amp;lt;<!-- no --><script>x("</p>")</script>&eacute;&nbsp;&#x41;<b>1 < 2</b></p>'
    df = spark.createDataFrame([(page,), ("<i>plain</i>  text",)], "html string")
    assert rows(T.with_html_text(df, "html"), "text") == [("A&lt; é A 1 < 2",), ("plain text",)]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["&", "#", "x", "X", ";", "amp", "lt", "notit", "&notin;", "&AMP", "&#39;", "&#x1F600;", "&#0;", "&#150;", "&#xD800;", "&#x110000;", "&#99999999999;",
                                          "&#1;", "&nosuch;", "&hellip", "é", " ", "1", "A", "\n"]), max_size=8).map("".join), min_size=1, max_size=40))
def test_references_decode_as_in_the_standard_library(spark, texts):
    import html

    from factweave.functions.text import unescaped

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [r.x for r in df.select("i", unescaped(F.col("t")).alias("x")).orderBy("i").collect()] == [html.unescape(t) for t in texts]


def test_wording_is_unicode_aware(spark):
    df = spark.createDataFrame([("Uma SOLUÇÃO nova",), ("resolução",), ("it  led   to more",)], "claim string")
    assert rows(X.wording_violations(df, ["claim"]), "claim") == [("Uma SOLUÇÃO nova",), ("it  led   to more",)]


@pytest.mark.parametrize("text,value", [("1,234.5", 1234.5), ("(1,234.5)", -1234.5), ("-3", -3.0), ("1d", None), ("NaN", None), ("", None)])
def test_reported_number(spark, text, value):
    assert one(spark, N.reported_number(F.col("t")), t=text) == value


@pytest.mark.parametrize("text,status,value", [("...", "ABSENT", None), ("..", "ABSENT", None), ("-", "VALUE", 0.0), ("1,5", "VALUE", 1.5), ("", "INVALID", None), ("x", "INVALID", None)])
def test_special_value(spark, text, status, value):
    got = one(spark, N.special_value(F.col("t")), t=text)
    assert (got.status, got.value) == (status, value)


def test_scaled_value_rounds_half_even(spark):
    assert one(spark, N.scaled_value(F.col("v"), F.lit(1), F.lit("USD")), v=2.5) == 2.0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, min_value=-1e14, max_value=1e14).map(lambda x: round(x, 3)), min_size=1, max_size=20))
def test_significant_text_agrees_with_python(spark, values):
    values = [v for v in values if v == 0 or abs(v) >= 1e-4] or [0.0]
    got = [r.x for r in spark.createDataFrame([(float(v),) for v in values], "v double").select(N.significant_text(F.col("v")).alias("x")).collect()]
    assert got == [f"{v:.15g}" if v else "0" for v in values]


def test_significant_text_of_ties_and_all_magnitudes(spark):
    import random

    rng = random.Random(3)
    values = [float(f"{rng.choice(['', '-'])}{rng.randint(1, 9)}.{rng.randrange(10**14):014d}5e{rng.randint(-3, 13)}") for _ in range(3000)]
    values += [rng.random() * 10.0 ** rng.randint(-300, 300) for _ in range(2000)] + [float(rng.randrange(10**17)) for _ in range(500)]
    values += [7.395484675701985, 999999999999999.5, 9999999999999995.0, 1e15, 1e-5, 0.0001, 1.7976931348623157e308, 123456789012345.5]
    values += [rng.randint(10 ** (15 - k), 10 ** (16 - k) - 1) + rng.randrange(1, 2 ** k, 2) / 2 ** k for k in range(1, 12) for _ in range(200)] + [float(rng.randint(10**15, 2 * 10**16) // 5 * 5) for _ in range(500)]
    got = [r.x for r in spark.createDataFrame([(v,) for v in values], "v double").select(N.significant_text(F.col("v")).alias("x")).collect()]
    assert [(v, g) for v, g in zip(values, got) if g != f"{v:.15g}"] == []


def test_text_of_a_number_leaves_its_caller_compilable(spark):
    df = spark.range(3).select(F.concat(F.lit("was "), N.significant_text(F.col("id") / 7)).alias("claim"))
    stages = df._jdf.queryExecution().debug().codegenToSeq()
    # The JVM compiles no method of more than 8,000 bytes.
    assert stages.size() and all(stages.apply(i)._3().maxMethodCodeSize() < 8000 for i in range(stages.size()))


def test_scaled_numbers_with_exponents(spark):
    rows = [("1e-13", 0.0, "NOT_INTEGRAL"), ("0.0000000000001", 0.0, "NOT_INTEGRAL"), ("1e40", 1e43, "OK"), ("12.5E3", 12500000.0, "OK"), ("12.5", 12500.0, "OK"), ("5e-3", 5.0, "OK"), ("5e-4", 0.5, "NOT_INTEGRAL"),
            ("1500e-5", 15.0, "OK"), ("1501e-5", 15.01, "NOT_INTEGRAL"), ("-1e2", -100000.0, "NEGATIVE"), ("1e400", None, "BAD_VALUE"), ("x", None, "BAD_VALUE"), (".5", 500.0, "OK"), ("7.", 7000.0, "OK")]
    df = spark.createDataFrame([(str(i), "202401", text) for i, (text, _, _) in enumerate(rows)], "k string, m string, v string")
    got = {r.k: (r.value, r.status) for r in NO.unpivot_scaled(df, ["k"], "m", [NO.WideColumn("v", "x", "count", 1000, integral=True)]).collect()}
    for i, (text, value, status) in enumerate(rows):
        assert got[str(i)][1] == status and (status == "NOT_INTEGRAL" or got[str(i)][0] == value), (text, got[str(i)])


def test_filter_on_the_status_repeats_no_parsing(spark):
    df = spark.range(3).select(F.col("id").cast("string").alias("k"), F.lit("202401").alias("m"), F.col("id").cast("string").alias("v"))
    rows = NO.unpivot_scaled(df, ["k"], "m", [NO.WideColumn("v", "x", "count", 1000, integral=True)])
    parses = lambda frame: frame._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract")
    assert 0 < parses(rows.filter("status = 'OK'")) <= parses(rows)


def test_content_id_keeps_fields_apart(spark):
    df = spark.createDataFrame([("a", None, "b", 0.0), ("a", "b", None, 0.0), ("a", "", "b", 0.0), ("a", None, "b", -0.0), ("ab", None, "", 0.0)], "x string, y string, z string, v double")
    ids = [r.i for r in df.select(identity.content_id(["x", "y", "z", identity.number_token(F.col("v"))]).alias("i")).collect()]
    assert ids[0] == ids[3] and len(set(ids)) == 4


@pytest.mark.parametrize("start,end,shape", [
    (None, D(2020, 12, 31), ("INSTANT", "FY")), (None, D(2020, 11, 30), ("INSTANT", None)), (D(2020, 1, 1), D(2020, 3, 31), ("QUARTER", "Q1")),
    (D(2020, 1, 1), D(2020, 6, 30), ("YTD", "H1")), (D(2020, 1, 1), D(2020, 9, 30), ("YTD", "9M")), (D(2020, 1, 1), D(2020, 12, 31), ("FY", "FY")), (D(2020, 1, 1), D(2020, 1, 31), ("OTHER", None))])
def test_classify_period(spark, start, end, shape):
    got = one(spark, NO.classify_period(F.col("s").cast("date"), F.col("e").cast("date")), s=start, e=end)
    assert tuple(got) == shape


def test_broken_release_tables_are_reported(spark):
    good = "The following table summarizes certain key performance metrics for the three-month periods ended March 31, 2024 and 2023 "
    table = " ".join(f"{label} (1) $ 1,000.5 (2.5)" for _, label, _, _ in RULES.KPI_LABELS) + " Capital expenditures"
    short = table.replace("NIMAL (1) $ 1,000.5 (2.5)", "NIMAL 7.5")
    docs = spark.createDataFrame([("ok", good + table), ("none", "text"), ("gap", good.replace("2023", "2022") + table), ("cut", good), ("short", good + short)], "d string, text string")
    found = X.kpi_table(docs, "text", ["d"])
    assert rows(found.filter("status <> 'OK'"), "d", "status") == [("cut", "NO_TABLE"), ("gap", "NO_COMPARATIVE_YEAR"), ("none", "NO_SUMMARY"), ("short", "COLUMN_COUNT")]
    assert rows(found.filter("metric_id = 'gmv'"), "reference_year", "value") == [(2023, -2500000.0), (2024, 1000500000.0)]
    assert rows(found.filter("metric_id = 'fintech_mau'"), "period_type", "value") == [("INSTANT", -2500000.0), ("INSTANT", 1000500000.0)]


# --- evidence -------------------------------------------------------------------------


def test_tampered_lineage_is_found(spark):
    facts = spark.createDataFrame([quarter("gmv", 2020, 10.0), quarter("gmv", 2021, 20.0)], FACT).withColumns({
        "filed_at": F.col("period_end"), "accession_number": F.lit("1")})
    derived = E.derive_growth(facts, {"gmv": ("Commerce", "USD")}, "s")
    assert E.recompute_lineage(derived.registry, derived.edges).isEmpty()
    assert rows(derived.omissions, "reason") == [(RULES.NO_BASELINE,)]
    wrong = derived.registry.withColumn("value", F.when(F.col("evidence_type") == "OBSERVATION", F.col("value") + 1).otherwise(F.col("value")))
    assert rows(E.recompute_lineage(wrong, derived.edges), "violations") == [(["value_recomputes"],)]
    swapped = derived.edges.withColumn("role", F.when(F.col("role") == "current", F.lit("previous")).otherwise(F.lit("current")))
    assert not E.recompute_lineage(derived.registry, swapped).isEmpty()
    assert not E.recompute_lineage(derived.registry, derived.edges.filter("role = 'current'")).isEmpty()


def test_packed_ids_are_told_apart_and_come_back(spark):
    digest = "0aff" * 16
    ids = [digest, digest.upper(), digest + "\n", digest[:-1], bytes.fromhex("61" * 32).decode(), "", "\x01", "lost", None]
    got = spark.createDataFrame([(i,) for i in ids], "i string").select("i", identity.packed_id(F.col("i")).alias("p")).select("i", "p", identity.unpacked_id(F.col("p")).alias("back")).collect()
    assert [r.back for r in got] == ids and len({bytes(r.p) for r in got if r.p is not None}) == len(ids) - 1
    assert len(got[0].p) == 33


def test_records_meet_only_rows_that_may_be_external(spark):
    """Rows of internal domains stay out of the index of ids; digests and plain ids come back from the packed form."""
    digest = "ab" * 32
    facts = E.as_evidence(
        spark.createDataFrame([("plain", "Macro", [], 1.0), (digest, "Macro", ["plain", "lost"], 2.0), ("inner", "Fintech", [digest], 3.0)], "evidence_id string, business_domain string, source_evidence_ids array<string>, value double"),
        evidence_type=F.lit("OBSERVATION"), metric_id=F.lit("selic_target_change_pp"), source_metric_id=F.lit("selic_target_annual"), claim=F.lit("c"), claim_kind=F.lit("increase"),
        source=F.lit("s"), reference_date=F.lit("2020-01-01").cast("date"), is_interpretation=F.lit(False), definition_context=F.lit("x=1"))
    lined = L.with_lineage(facts, facts, keep=E.CLASSIFIED)
    assert "source_evidence_ids" not in lined.columns
    ids = rows(lined.select("evidence_id", L.field(F.col("lineage"), "id").alias("ids"), "missing"), "evidence_id", "ids", "missing")
    assert ids == [(digest, [digest, "lost", "plain"], 1), ("inner", [digest, "inner"], 0), ("plain", ["plain"], 0)]
    dimensions = lined.select(
        F.concat(F.lit("p-"), "evidence_id").alias("pestel_id"), F.lit("ECONOMIC").alias("pestel_dimension"), F.array(F.lit("selic_target_annual")).alias("source_metric_ids"), "lineage",
        "definition_context", "reference_date", "business_domain", L.field(F.col("lineage"), "id").alias("source_evidence_ids"), F.lit("OK").alias("status"))
    asked = facts.withColumn("_dimension", F.lit("ECONOMIC"))
    met = E.matched_dimensions(asked, dimensions, facts).select(identity.unpacked_id(F.col("_key")).alias("evidence_id"), "source_pestel_ids")
    assert rows(met, "evidence_id", "source_pestel_ids") == [(digest, sorted(["p-" + digest, "p-inner"])), ("plain", sorted(["p-plain", "p-" + digest]))]


def test_lineage_flaws_stages_narrow_facts_only(spark, monkeypatch):
    from factweave.plans import catalogue, evidence as PE
    from factweave.plans.registry import Tables

    staged = []
    monkeypatch.setattr(PE, "stage", lambda df, name, real=PE.stage: staged.append((name, "claim" in df.columns)) or real(df, name))
    catalogue()["lineage_flaws"].plan(Tables(spark, "/root/testdata/sf0.001"))
    assert staged == [("facts", False)]


@pytest.mark.parametrize("metric,domain,kind,context,expected", [
    ("pix_transactions_count_monthly", "Macro", "technology_adoption", "technology_adoption", "TECHNOLOGICAL"), ("pix_transactions_count_monthly", "Macro", "level", "", "ECONOMIC"),
    ("fintech_mau", "Fintech", "level", "", "SOCIAL"), ("fintech_mau", "Commerce", "level", "", None), ("x", "Macro", "public_policy", "", "POLITICAL"),
    ("x", "Macro", "compliance_obligation", "", "LEGAL"), ("x", "Macro", "environmental_impact", "", "ENVIRONMENTAL"), ("x", "Macro", "level", "", None)])
def test_dimension_precedence(spark, metric, domain, kind, context, expected):
    column = E.dimension(*[F.col(c) for c in "mdkcs"])
    assert one(spark, column, m=metric, d=domain, k=kind, c=context, s="source") == expected


def test_fixed_product_texts_pass_their_own_rules(spark):
    df = spark.createDataFrame([
        ("HYPOTHESIS", RULES.HYPOTHESIS, ["e"], []), ("QUESTION_FOR_PRODUCT_DISCOVERY", RULES.QUESTION, ["e"], ["h"]), ("HYPOTHESIS", "This proves it may work.", ["e"], [])],
        "product_evidence_type string, statement string, source_evidence_ids array<string>, source_hypothesis_ids array<string>")
    assert rows(E.product_violations(df), "violations") == [(["wording_allowed"],)]


def test_strict_comparisons_refuse_ambiguous_rows(spark):
    facts = spark.createDataFrame([quarter("gmv", 2020, 10.0), quarter("gmv", 2021, 20.0), quarter("gmv", 2021, 21.0), quarter("tpv", 2021, 1.0)], FACT)
    series = spark.createDataFrame([("e", "m", D(2020, 1, 31), 1.0), ("e", "m", D(2020, 1, 31), 2.0)], "entity string, metric_id string, reference_date date, value double")
    assert P.yoy_growth(facts).isEmpty()
    for strict in (lambda: P.yoy_growth(facts, strict=True), lambda: R.exact_period_join(facts, "gmv", "tpv", strict=True), lambda: P.previous_observation_change(series, strict=True)):
        with pytest.raises(Q.ContractViolation):
            strict()
    assert not P.yoy_growth(facts.filter("value <> 21.0"), strict=True).isEmpty()


# --- plans --------------------------------------------------------------------------------


@pytest.mark.parametrize("key", ["asof_bitemporal", "asof_no_fallback", "asof_denominator", "valuation_status", "yoy_growth", "month_yoy", "prev_obs_change", "metric_suite",
                                 "classify_dimensions", "lineage_recompute", "merge_append_only", "kpi_table_extract", "header_described", "session_guard"])
def test_plans_have_no_cross_join_and_no_python(spark, key):
    import __spark_entry__ as entry

    plan = entry.queries()[key](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Python" not in plan


def test_sentences_lose_no_characters(spark):
    text = "Start here. 19.37.233.111 is an address. 2381 follows. 3x3"
    got = spark.createDataFrame([(text,)], "t string").select(T.sentences(F.col("t")).alias("s")).first().s
    assert got == ["Start here.", "19.37.233.111 is an address.", "2381 follows.", "3x3"]


def entry_plan(key):
    from factweave.plans import catalogue

    return catalogue()[key].plan


def test_a_leap_day_moved_and_back_is_the_same_day(spark):
    from factweave.plans import company

    orders = [(1, 9, D(2000, 2, 29), 10.0, "O", "1-URGENT")]
    lines = [(1, 1, D(2000, 2, 1), 5.0, "N")]
    t = type("T", (), {
        "orders": spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate date, o_totalprice double, o_orderstatus string, o_orderpriority string"),
        "lineitem": spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_shipdate date, l_extendedprice double, l_returnflag string"), "spark": spark})
    assert rows(entry_plan("gold_contract")(t), "entity", "reference_date", "violations") == [("9", D(2000, 2, 29), "row_expected")]


def test_prices_of_zero_break_the_contract_in_query_and_sql(spark):
    import __spark_entry__ as entry
    import duckdb

    ts = dt.datetime(2024, 1, 2, 10)
    events = [(1, "view", 7, ts, 0.0), (2, "view", 8, ts, 2.0), (3, "view", 8, ts + dt.timedelta(hours=1), 0.0), (4, "view", 9, ts, 3.0)]
    connection = duckdb.connect()
    connection.execute("CREATE TABLE events (event_id BIGINT, event_type VARCHAR, user_id BIGINT, ts TIMESTAMP, value DOUBLE)")
    connection.executemany("INSERT INTO events VALUES (?, ?, ?, ?, ?)", events)
    want = connection.execute(f"SELECT ticker FROM ({entry.oracle_sql()['ohlc_normalize']})").fetchall()
    t = type("T", (), {"events": spark.createDataFrame(events, "event_id long, event_type string, user_id long, ts timestamp_ntz, value double")})
    assert rows(entry_plan("ohlc_normalize")(t), "ticker") == want == [("view:9",)]


def test_release_amounts_round_by_the_exact_binary_value(spark):
    from factweave.plans.text import releases

    amounts = {1: "25000.00", 2: "15000.00", 3: "35000.00", 4: "75000.00"}
    orders = spark.createDataFrame([(k, k, D(1997, 2, 3), v) for k, v in amounts.items()], "o_orderkey long, o_custkey long, o_orderdate date, o_totalprice string").withColumn("o_totalprice", F.col("o_totalprice").cast("double"))
    html = {r.entity: r.html for r in releases(type("T", (), {"orders": orders})).collect()}
    assert all(f"was ${'%.1f' % (float(v) / 100000)}bn" in html[str(k)] for k, v in amounts.items())


def test_html_text_sql_decodes_as_the_operator(spark):
    import __spark_entry__ as entry
    import duckdb

    pages = ["a&amp b &ampx; &#38;#1; &#x80;&#0; &notit; &notin; &hellip;&#xD800; &#99999999999;", "<template>x</template><script>y</style></script>&nbsp;z  &lt;p&gt", "&", "&CounterClockwiseContourIntegral;&#x1F600&Tab;.", "none"]
    connection = duckdb.connect()
    connection.execute("CREATE TABLE pages (page_id INT, html VARCHAR)")
    connection.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(pages)))
    want = connection.execute(f"SELECT page_id, text FROM ({entry.oracle_sql()['html_text']})").fetchall()
    assert rows(T.with_html_text(spark.createDataFrame(list(enumerate(pages)), "page_id int, html string"), "html"), "page_id", "text") == sorted(want, key=repr)


def test_growth_moves_no_claims_or_ids(spark):
    """The walk over the years exchanges and sorts narrow facts only; ids are projections of its result, those of the prior too."""
    facts = spark.createDataFrame([("e", "gmv", "USD", "QUARTER", D(y, 1, 1), D(y, 3, 31), y, "Q1", "v1", float(y), D(y, 4, 20), f"a{y}") for y in (2020, 2021, 2022)], FACT + ", filed_at date, accession_number string")
    stored = []
    derived = E.derive_growth(facts, {"gmv": ("Commerce", "USD")}, "s", unique=True, keep=lambda df: stored.append(df) or df)
    assert not {"claim", "evidence_id", "prior_evidence_id"} & set(stored[0].columns)
    ids = {r.period_end: r.evidence_id for r in derived.registry.filter("evidence_type = 'FACT'").collect()}
    want = sorted((ids[D(y - b, 3, 31)], role) for y in (2021, 2022) for b, role in ((0, "current"), (1, "previous")))
    assert sorted((r.source_evidence_id, r.role) for r in derived.edges.collect()) == want
    assert [r.evidence_id for r in derived.omissions.collect()] == [ids[D(2020, 3, 31)]]


def test_facts_are_dealt_out_by_entity_over_many_tasks(spark):
    from factweave.plans import inputs as I
    from factweave.plans.registry import Tables
    from factweave.session import work_tasks

    facts = I.quarter_facts(Tables(spark, "/root/testdata/sf0.001"), ("net_revenue", "order_count"))
    assert facts.rdd.getNumPartitions() == work_tasks(spark)


def test_releases_are_dealt_out(spark):
    """A release costs far more than the bytes of its totals tell: their small partitions are not joined into one task."""
    from factweave.plans import text as PT
    from factweave.plans.registry import Tables
    from factweave.session import work_tasks

    assert PT.releases(Tables(spark, "/root/testdata/sf0.001")).rdd.getNumPartitions() == work_tasks(spark) >= 4 * spark.sparkContext.defaultParallelism


def test_numbers_are_read_once(spark, capsys):
    """Inside a lambda function nothing is shared: the pattern of a number stands in the plan as often as it runs."""
    spark.range(1).select(F.transform(F.array(F.lit("1")), N.reported_number).alias("x")).explain("extended")
    analysed = capsys.readouterr().out.split("== Optimized")[0].split("== Analyzed")[1]
    assert analysed.count(r"(\d+\.?\d*|\.\d+)") <= 3  # six when a value stood in the plan as often as it was named
    for text, value in (("(1,234.5)\n", -1234.5), (" (7) ", -7.0), ("(7", None), ("1e999", None), ("-1e999", None), ("((7))", None), ("(-7)", 7.0), (None, None)):
        assert one(spark, N.reported_number(F.col("t")), t=text) == value, text


def test_every_blank_collapses(spark):
    blanks = "\t\n\x0b\f\r \x85\xa0       　"
    for text in (f"{blanks}a{blanks}b{blanks}", *[f"{c}a{c}{c}b c{c}" for c in blanks], "a\x1cb", "​a", ""):
        want = __import__("re").sub(f"[{blanks} - ]+", " ", text).strip(" ")
        assert one(spark, T.collapse_blanks(F.col("t")), t=text) == want, repr(text)


def test_orphans_stage_only_what_is_read(spark, monkeypatch):
    import __spark_entry__ as entry
    from factweave.plans import evidence as PE

    staged = {}
    monkeypatch.setattr(PE, "stage", lambda df, name, real=PE.stage: staged.update({name: df}) or real(df, name))
    found = entry.queries()["lineage_orphans"](spark, "/root/testdata/sf0.001")
    assert "claim" not in staged["evidence"].columns and not found.isEmpty()
    assert staged["evidence"].filter("evidence_type = 'FACT' AND business_domain <> 'Commerce'").isEmpty()


def test_orphans_of_unknown_and_mistyped_sources(spark):
    evidence = spark.createDataFrame([("a", "FACT"), ("0" * 64, "FACT")], "evidence_id string, evidence_type string")
    rows = spark.createDataFrame([("r", ["a", "b", "0" * 64], ["FACT", "FACT", "OBSERVATION"]), ("s", ["a"], ["FACT"])], "id string, sources array<string>, types array<string>")
    got = sorted(tuple(r) for r in E.lineage_orphans(rows, evidence, "id", "sources", "types").collect())
    assert got == [("r", "0" * 64, "TYPE_MISMATCH"), ("r", "b", "UNKNOWN_ID")]


def _growing(spark, origins):
    facts = spark.createDataFrame([quarter(m, y, float(y - 2000), entity=e) for m in ("gmv", "other") for y in (2020, 2021, 2022) for e in "ab"], FACT).withColumns({
        "filed_at": F.col("period_end"), "accession_number": F.lit("1")})
    return E.derive_growth(facts, {"gmv": ("Commerce", "USD")}, "s", unique=True, origins=origins).registry


def test_origins_give_the_lineage_that_the_join_gives(spark):
    carried = L.with_origins(_growing(spark, True))
    joined = L.with_lineage(_growing(spark, False), _growing(spark, False))
    assert "Join" not in carried._jdf.queryExecution().optimizedPlan().toString()
    assert rows(carried, "evidence_id", "lineage", "missing") == rows(joined, "evidence_id", "lineage", "missing")
    assert {len(r.lineage) for r in carried.select("lineage").collect()} == {1, 2}


@pytest.mark.parametrize("key", ["classify_dimensions", "classify_quadrants", "supporting_evidence", "cross_domain_pairs"])
def test_evidence_is_not_written_whole(spark, monkeypatch, key):
    """Only the narrow facts are staged: the registry is a projection of them."""
    import __spark_entry__ as entry
    from factweave.plans import evidence as PE

    staged = {}
    monkeypatch.setattr(PE, "stage", lambda df, name, real=PE.stage: staged.update({name: df}) or real(df, name))
    entry.queries()[key](spark, "/root/testdata/sf0.001")
    assert list(staged) == ["facts"] and not {"claim", "evidence_id"} & set(staged["facts"].columns)


def test_supporting_origins_are_the_rows_that_the_join_finds(spark):
    evidence = _growing(spark, False)
    rules = {"gmv_yoy_growth": ("positive_value", "text", "kind")}
    got = E.supporting_origins(E.interpretations(evidence, rules, origins=True).unionByName(E.interpretations(evidence, rules, origins=True)))
    want = E.supporting_evidence(E.interpretations(evidence, rules).unionByName(E.interpretations(evidence, rules)), evidence)
    columns = ("evidence_id", *L.NODE_FIELDS, "references")
    assert rows(got, *columns) == rows(want, *columns) and rows(got, "references") == [(2,)] * 4


def test_pairs_of_domains_exchange_twice(spark):
    """Metrics and types are counted, then every group is placed once for both steps that follow."""
    text = F.col("id").cast("string")
    evidence = E.as_evidence(spark.range(9), **{c: text for c in ("evidence_id", "entity", "metric_id", "business_domain", "evidence_type")}, reference_date=F.date_from_unix_date(F.col("id").cast("int")))
    plan = E.cross_domain_pairs(evidence)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_rows_of_products_are_chosen_before_their_lineage_is_looked_up(spark, monkeypatch):
    """The chosen rows are exchanged twice and written once; lineage, members and strategy records read them from there."""
    from factweave.plans import strategy as S
    from factweave.plans.registry import Tables

    staged = {}
    monkeypatch.setattr(S, "stage", lambda df, name, real=S.stage: staged.update({name: df}) or real(df, name))
    found = S.products(Tables(spark, "/root/testdata/sf0.001"))
    assert list(staged) == ["paired-evidence", "chosen"] and not found.isEmpty()
    assert staged["chosen"]._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    assert "MAX(lineage" not in found._jdf.queryExecution().optimizedPlan().toString()

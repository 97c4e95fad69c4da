"""Round trips on temporary folders."""

from __future__ import annotations

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, StringType, StructType

from factweave.operators import merge as M, quality as Q
from factweave.sources import catalog, landing, scans, sinks
from factweave.sources.store import IndexedTable, Store, read_positions, write_ordered
from factweave.streaming.incremental import MergeTarget, merge_batch

SCHEMA = StructType().add("metric_id", StringType()).add("reference_date", DateType()).add("value", DoubleType()).add("source", StringType())


def series(spark, rows):
    return spark.createDataFrame(rows, "metric_id string, reference_date date, value double")


def test_typed_round_trip_and_unchanged_merge(spark, tmp_path):
    df = sinks.conform(series(spark, [("a", dt.date(2020, 1, 31), 1.0)]), SCHEMA, {"source": "ledger"})
    path = sinks.write_version(df, str(tmp_path), "1")
    stored = scans.read_typed(spark, path, SCHEMA)
    assert [tuple(r) for r in stored.collect()] == [("a", dt.date(2020, 1, 31), 1.0, "ledger")]
    replay = M.append_only(stored, df, ["metric_id", "reference_date"], ["value"])
    assert not sinks.changed(stored, replay)
    with pytest.raises(scans.SchemaMismatch):
        scans.read_typed(spark, path, StructType().add("metric_id", StringType()))


def test_catalog_loads_filters_and_reports_missing(spark, tmp_path):
    series(spark, [("a", dt.date(2020, 1, 31), 1.0), ("a", dt.date(2021, 1, 31), 2.0)]).write.parquet(str(tmp_path / "silver/macro_indicators"))
    assert catalog.load(spark, "macro_indicators", str(tmp_path), start=dt.date(2020, 6, 1)).count() == 1
    with pytest.raises(catalog.DatasetMissing):
        catalog.load(spark, "market_prices", str(tmp_path))
    with pytest.raises(KeyError):
        catalog.load(spark, "unknown", str(tmp_path))
    with pytest.raises(ValueError):
        catalog.load(spark, "macro_indicators", str(tmp_path), start=dt.date(2021, 1, 1), end=dt.date(2020, 1, 1))
    health = {r.dataset_id: (r.status, r.row_count, r.latest_date) for r in catalog.catalog_health(spark, str(tmp_path)).collect()}
    assert health["macro_indicators"] == ("AVAILABLE", 2, dt.date(2021, 1, 31)) and health["swot"] == ("MISSING", None, None)
    assert len(health) == len(catalog.DATASETS)


def test_landed_files_are_hashed_and_pinned(spark, tmp_path):
    (tmp_path / "a.htm").write_bytes(b"one")
    (tmp_path / "b.htm").write_bytes(b"two")
    landed = landing.landed_files(spark, str(tmp_path), "*.htm").withColumn("name", F.substring_index("source_file", "/", -1))
    approved = spark.createDataFrame([("a.htm", hashlib.sha256(b"one").hexdigest()), ("b.htm", "0"), ("c.htm", "0")], "name string, content_sha256 string")
    assert sorted((r.name, r.status) for r in landing.document_pins(landed, approved, "name").collect()) == [
        ("a.htm", "PINNED"), ("b.htm", "HASH_MISMATCH"), ("c.htm", "MISSING")]
    leaks = spark.createDataFrame([("https://x/?ApiKey=1",), ("https://x/",)], "url string")
    assert landing.credential_leaks(leaks, ["url"]).count() == 1


def test_rerun_batch_changes_nothing_and_conflicts_stay_aside(spark, tmp_path):
    schema = StructType().add("metric_id", StringType()).add("reference_date", DateType()).add("value", DoubleType())
    target = MergeTarget(str(tmp_path), schema, ["metric_id", "reference_date"], ["value"], F.year("reference_date").cast("string"))
    first = series(spark, [("a", dt.date(2020, 1, 31), 1.0), ("a", dt.date(2020, 1, 31), 1.0), ("c", dt.date(2020, 1, 31), 1.0), ("c", dt.date(2020, 1, 31), 2.0)])
    for _ in range(2):
        merge_batch(target, first, 0, "s")
    merge_batch(target, series(spark, [("a", dt.date(2020, 1, 31), 5.0), ("b", dt.date(2021, 1, 31), 2.0)]), 1, "s")
    merge_batch(target, first, 0, "s")
    assert sorted((r.metric_id, r.value) for r in target.accepted(spark).collect()) == [("a", 1.0), ("b", 2.0)]
    assert sorted(r.metric_id for r in target.conflicts(spark).collect()) == ["a", "c"]


def test_manifest_and_dictionary_checks(spark):
    actual = spark.createDataFrame([("a", 1), ("b", 2)], "metric_id string, n int")
    manifest = spark.createDataFrame([("a", 1), ("b", 3), ("c", 1)], "metric_id string, n int")
    assert sorted(r.metric_id for r in sinks.manifest_differences(actual, manifest, ["metric_id"], ["n"]).collect()) == ["b", "c"]
    dictionary = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", " ")], "metric_id string, unit string")
    assert sorted((r.metric_id, tuple(r.violations)) for r in Q.dictionary_violations(dictionary, "metric_id", ["unit"]).collect()) == [
        ("a", ("duplicate_id",)), ("b", ("unit_present",))]


def test_legacy_series_id(spark):
    old = spark.createDataFrame([(432, 1.0)], "series_code int, value double")
    assert scans.upgrade_legacy_series(old, "bcb_sgs").first().source_series_id == "bcb_sgs:432"


def _files(root):
    return sorted(str(p) for p in root.rglob("part-*.parquet"))


def test_merged_versions_are_replay_safe(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "k int, v double")
    store = Store(str(tmp_path / "table"), rows((1, 1.0)).schema, ["k"])
    first = store.merge(rows((1, 1.0), (2, None)), ["v"])[0]
    before = _files(tmp_path)
    again = store.merge(rows((2, None)), ["v"])[0]
    assert _files(tmp_path) == before
    second = store.merge(rows((2, None), (3, 3.0), (3, 3.0)), ["v"])[0]
    assert [(s.version, s.written) for s in (first, again, second)] == [(1, True), (1, False), (2, True)]
    with pytest.raises(Q.ContractViolation):
        store.merge(rows((1, 9.0), (4, 4.0)), ["v"])
    assert store.version(spark) == 2
    pairs = lambda df: sorted((r.k, r.v) for r in df.collect() if r.v is not None)
    assert pairs(store.read(spark)) == [(1, 1.0), (3, 3.0)] and pairs(store.read(spark, 1)) == [(1, 1.0)]


def test_a_small_batch_rewrites_only_its_buckets_and_files_stay_few(spark, tmp_path):
    frame = lambda ks: spark.createDataFrame([(k, float(k), f"2024-01-{k % 28 + 1:02d}") for k in ks], "k int, v double, day string")
    store = Store(str(tmp_path / "t"), frame([1]).schema, ["k"], buckets=8, bound="day")
    store.merge(frame(range(200)), ["v"])
    folders = {r[0]: r.folder for r in store.manifest(spark, 1).collect()}
    written = store.merge(frame([1000]), ["v"])[0]
    after = {r[0]: r.folder for r in store.manifest(spark, 2).collect()}
    assert written.buckets == 1 and sum(folders[b] != after[b] for b in folders) == 1
    for k in range(2000, 2012):
        store.merge(frame([k]), ["v"])
    assert store.read(spark).count() == 213 and len(store.read(spark).inputFiles()) <= 8
    assert len(store.expired(spark, keep=1)) > 0 and store.read(spark, 1).count() == 200
    store.vacuum(spark, keep=1)
    assert store.versions(spark) == [14] and store.read(spark).count() == 213 and store.expired(spark, keep=1) == []
    lone = Store(str(tmp_path / "u"), frame([1]).schema, ["k"], buckets=8, partition=F.col("day"), bound="day")
    lone.merge(frame(range(28)), ["v"])
    assert len(lone.read(spark, low="2024-01-28").inputFiles()) < len(lone.read(spark).inputFiles())


def test_a_failed_write_blocks_nothing(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "k int, v double")
    store = Store(str(tmp_path / "t"), rows((1, 1.0)).schema, ["k"], buckets=4)
    store.merge(rows((1, 1.0)), ["v"])
    # A writer stopped after its data and in the middle of its manifest.
    (tmp_path / "t" / "manifest" / "2").mkdir()
    (tmp_path / "t" / "manifest" / "2" / "part-0.parquet").write_bytes(b"half")
    rows((5, 5.0)).write.parquet(str(tmp_path / "t" / "data" / "lost" / "_bucket=1"))
    assert store.version(spark) == 1 and store.read(spark).count() == 1
    assert store.merge(rows((2, 2.0)), ["v"])[0].version == 2
    assert sorted(r.k for r in store.read(spark).collect()) == [1, 2] and any("lost" in p for p in store.expired(spark, keep=2))


def test_streamed_batches_keep_files_few_and_conflicts_apart(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "k int, v double")
    target = MergeTarget(str(tmp_path), StructType.fromDDL("k int, v double"), ["k"], ["v"], buckets=2)
    for i in range(12):
        merge_batch(target, rows((i, 1.0), (0, float(i + 1))), i, "s")
    merge_batch(target, rows((11, 1.0), (0, 12.0)), 11, "s")
    assert sorted((r.k, r.v) for r in target.accepted(spark).collect()) == [(i, 1.0) for i in range(12)]
    assert sorted(r.v for r in target.conflicts(spark).collect()) == [float(i) for i in range(2, 13)]
    assert len(target.accepted(spark).inputFiles()) <= 2


def test_stored_order_is_total_across_files(spark, tmp_path):
    table = spark.createDataFrame([(None if i % 7 == 0 else i % 5, i) for i in range(500)], "a int, b int").repartition(5)
    write_ordered(table, str(tmp_path / "t"), [F.col("a").asc_nulls_last(), F.col("b").desc()], 4)
    got = [(r.a, r.b) for r in read_positions(spark, str(tmp_path / "t"), table.schema).orderBy("position").collect()]
    assert got == sorted(((r.a, r.b) for r in table.collect()), key=lambda r: (r[0] is None, r[0] or 0, -r[1]))


def test_an_index_of_ids_prunes_buckets(spark, tmp_path):
    table = spark.createDataFrame([(i, [f"e{i // 3}", f"x{i % 2}"], [f"p{i}"] if i % 4 else None) for i in range(300)], "n int, es array<string>, ps array<string>")
    indexed = IndexedTable.write(table, str(tmp_path / "t"), ["es", "ps"], ["n"], 10)
    assert sorted(r.n for r in indexed.scan(spark, es="e7").collect()) == [21, 22, 23]
    assert [r.n for r in indexed.scan(spark, es="e7", ps="p22").collect()] == [22] and indexed.scan(spark, es="e7", ps="p1").count() == 0
    assert len(indexed.buckets_of(spark, "es", "e7")) <= 2 and len(indexed.buckets_of(spark, "es", "x1")) == 10
    assert len(indexed.scan(spark, es="e7").inputFiles()) > 0 and indexed.scan(spark, es="e7")._jdf.queryExecution().executedPlan().toString().count("PartitionFilters: [") == 1


def test_unreadable_datasets_are_invalid_not_missing(spark, tmp_path):
    datasets = {d: catalog.Dataset(d, "Silver", (), d) for d in ("none", "empty", "broken")}
    (tmp_path / "empty").mkdir()
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_bytes(b"PAR1 not parquet")
    found = {r.dataset_id: r.status for r in catalog.catalog_health(spark, str(tmp_path), datasets).collect()}
    assert found == {"none": "MISSING", "empty": "INVALID", "broken": "INVALID"}


def test_classified_scans_refuse_unknown_classes(spark):
    rows = spark.createDataFrame([("ECONOMIC", ["m"], ["e"])], "pestel_dimension string, source_metric_ids array<string>, source_evidence_ids array<string>")
    assert scans.scan_dimensions(rows, "ECONOMIC", source_evidence_id="e", metric="m").count() == 1
    for scan, name in ((scans.scan_dimensions, "dimension"), (scans.scan_quadrants, "category"), (scans.scan_quadrants, "scope"), (scans.scan_products, "kind")):
        with pytest.raises(ValueError):
            scan(rows, **{name: "OTHER"})


def test_a_broken_stored_schema_stops_the_streaming_merge(spark, tmp_path):
    target = MergeTarget(str(tmp_path), StructType.fromDDL("k int, v double"), ["k"], ["v"])
    assert target.accepted(spark).count() == 0
    (tmp_path / "accepted").write_text("a file where a folder belongs")
    with pytest.raises(Exception):  # not an empty table
        target.accepted(spark).collect()


def test_merge_exchanges_rows_once(spark, tmp_path, monkeypatch):
    """Stored and incoming rows are exchanged by bucket; the commit writes what the merge left, without an exchange of its own."""
    from factweave.sources import store as S

    plans = []
    monkeypatch.setattr(S, "stage", lambda df, name, real=S.stage: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or real(df, name))
    store = Store(str(tmp_path / "t"), StructType().add("k", "long").add("v", "long"), ["k"], buckets=8)
    store.merge(spark.range(500).selectExpr("id AS k", "id AS v"), ["v"])
    store.merge(spark.range(1000).selectExpr("id AS k", "id AS v"), ["v"])
    assert [plan.count("Exchange hashpartitioning") for name, plan in plans if name == "merge"] == [1, 1]
    assert all("Exchange hashpartitioning(_bucket" in plan for name, plan in plans if name == "merge")
    assert sorted(tuple(r) for r in store.read(spark).collect()) == [(i, i) for i in range(1000)]


def test_index_is_ordered_and_made_distinct_by_one_exchange(spark, tmp_path, monkeypatch):
    from factweave.sources import store as S

    plans = []
    monkeypatch.setattr(S, "write_ordered", lambda df, *a, real=S.write_ordered, **k: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, *a, **k))
    rows = spark.range(200, numPartitions=2).selectExpr("id", "array('x', concat('s-', id div 2)) AS ids")
    table = IndexedTable.write(rows, str(tmp_path / "t"), ["ids"], ["id"], buckets=4)
    assert len(plans) == 1 and "Exchange" not in plans[0]
    index = spark.read.parquet(str(tmp_path / "t" / "ids"))
    assert index.count() == index.distinct().count() and index.filter("id = 'x'").count() == 4
    found = [r.id for f in sorted(index.inputFiles()) for r in spark.read.parquet(f).collect()]
    assert found == sorted(found)
    assert sorted(r.id for r in table.scan(spark, ids="s-7").collect()) == [14, 15]


def test_export_tables_are_computed_once(spark, monkeypatch):
    import __spark_entry__ as entry
    from factweave.sources import exports

    plans = []
    monkeypatch.setattr(exports, "publish", lambda tables, *a, real=exports.publish: plans.extend(e.rows._jdf.queryExecution().executedPlan().toString() for e in tables.values()) or real(tables, *a))
    entry.queries()["export_validation"](spark, "/root/testdata/sf0.001")
    assert len(plans) == 4 and not any("Aggregate" in plan for plan in plans)

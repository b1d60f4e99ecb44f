import datetime as dt

import pytest
import sample
from conftest import ordered
from pyspark.sql import functions as F

from recordloom.operators import log as lg
from recordloom.operators import review as rv
from recordloom.operators import versions as vs
from recordloom.operators.changes import latest_records
from recordloom.operators.filters import complete_columns, identity_projection, keyword_filter, time_range
from recordloom.plans import recording, sharing
from recordloom.plans.consolidating import consolidate
from recordloom.rules import ORD, CleanRule, ColumnRule, ImportRule
from recordloom.sources import exports as ex
from recordloom.sources import snapshots as sn
from recordloom.sources.tables import append_rows, keyed_table, stamp_order, write_table


def test_latest_records(table):
    log = table("log_time code di name", [
        ("2026/01/01", "old", "DI-1", "Old name"), ("2026/02/02", "old ", "DI-1", "New name"),
        ("2026/01/15", "other", "DI-2", "Other name"), ("", "old", "DI-1", "no time"),
    ])
    assert {r["name"] for r in ordered(latest_records(log, ["code", "di"]))} == {"New name", "Other name"}
    with pytest.raises(ValueError, match="missing"):
        latest_records(log, ["absent"])
    with pytest.raises(ValueError, match="absent"):
        identity_projection(log, ["absent"])


def test_equal_times_go_to_the_later_row(table):
    log = table("log_time k v", [("t", "a", "1"), ("t", "a", "2"), ("", "b", "1"), ("", "b", "2")])
    assert sorted(r["v"] for r in ordered(latest_records(log, ["k"]))) == ["2", "2"]


def test_drop_unchanged(table):
    log = table("log_time k v", [("t1", "a", "1")])
    records = table("k v", [("a ", " 1"), ("a", "2"), ("b", "1")])
    kept = ordered(lg.drop_unchanged(records, log, ["k"], ["log_time", "k", "v", "absent"]))
    assert [(r["k"], r["v"]) for r in kept] == [("a", "2"), ("b", "1")]


def test_append_records_fills_and_orders(table):
    records = table("v extra key", [("1", "e", "K")])
    rows = lg.append_records(records, ["log_time", "k", "v", "extra"], ["log_time", "v", "gone"], "now", key_column="k", key=F.col("key"))
    assert rows.columns == ["log_time", "v", "extra", "k", ORD]
    assert list(rows.first())[:4] == ["now", "1", "e", "K"]


def test_merge_logs(table):
    left = table("code at", [("M1", "t1"), ("M2", "t1")])
    right = table("code at", [("M2", "t1"), ("M3", "t2"), ("M3", "t2")])
    merged = lg.merge_logs(left, right)
    assert [r["code"] for r in ordered(merged)] == ["M1", "M2", "M3"]
    assert merged.where("added").count() == 1
    once = ordered(merged.drop("added"))
    more = lg.merge_logs(table("code at", [tuple(r.values()) for r in once]), right)
    assert more.where("added").count() == 0


def test_append_and_align(table):
    old = table("material_code", [("A",)])
    new = table("material_code extra", [("B", "x")])
    assert {r.extra for r in append_rows(old, new).collect()} == {"", "x"}
    assert lg.alignment(None, ["a"]).action == "created"
    assert lg.alignment(["a"], ["a"]).action == "already aligned"
    change = lg.alignment(["a", "b"], ["c", "a"])
    assert (change.action, change.added, change.removed) == ("aligned", ("c",), ("b",))
    assert complete_columns(new, ["extra", "gone"]).first()[:2] == ("x", "")


def test_rewrite_is_checked(table):
    old = table("a b", [("1", "x"), ("1", "x"), ("2", "y")])
    good = lg.align_schema(old, ["b", "a", "c"])
    assert lg.check_rewrite(old, good, ["a", "b"]) == 3
    for bad in (good.limit(2), good.withColumn("c", F.lit("v")), good.withColumn("a", F.lit("1"))):
        with pytest.raises(lg.RewriteMismatch):
            lg.check_rewrite(old, bad, ["a", "b"])


def test_align_log_in_a_new_directory(spark, table, tmp_path):
    write_table(table("log_time code", [("t", "A"), ("t", "B")]), f"{tmp_path}/old", ["log_time", "code"])
    columns = ["log_time", "status", "code"]
    change = recording.align_log(spark, f"{tmp_path}/old", columns, f"{tmp_path}/new")
    assert change.added == ("status",)
    assert spark.read.parquet(f"{tmp_path}/new").columns == [*columns, ORD]
    assert recording.align_log(spark, f"{tmp_path}/new", columns, f"{tmp_path}/x").action == "already aligned"
    assert recording.align_log(spark, f"{tmp_path}/none", columns, f"{tmp_path}/made").action == "created"
    assert spark.read.parquet(f"{tmp_path}/made").count() == 0


def test_export_records_once(spark, table, tmp_path):
    result = consolidate(sample.tables(table, sample.rows()), sample.RULE, sample.RUN_DATE)
    columns = sample.LOG_COLUMNS
    schema = ", ".join(f"`{c}` string" for c in columns)
    write_table(spark.createDataFrame([], f"{schema}, {ORD} long"), f"{tmp_path}/log", columns)
    arguments = (
        sample.RULE, ["Lot", "Comment", " Name"], f"{tmp_path}/out", f"{tmp_path}/log",
        sample.CHANGES.identity, columns,
    )
    first = recording.export_and_record(result, *arguments, "2026/10/13 09:00:00")
    assert (first.rows, first.recorded) == (4, 4) and "Trays" in first.missing_headers
    again = recording.export_and_record(result, *arguments, "2026/10/14 09:00:00")
    assert again.recorded == 0
    log = spark.read.parquet(f"{tmp_path}/log")
    assert sorted(r.plant for r in log.collect()) == ["fern", "ivy", "moss", "moss"]
    text = spark.read.option("header", True).csv(f"{tmp_path}/out")
    assert text.columns == ["Lot", "Comment", "Name"]
    assert sorted(r[0] for r in text.collect()) == ["07", "late", "spring", "spring"]
    with pytest.raises(recording.NothingToExport):
        recording.export_and_record(result.where("status = 'x'"), *arguments, "n")


def test_merge_shared_log(spark, table, tmp_path):
    local = table("code at", [("M1", "t1"), ("M2", "t1")])
    shared = table("code at", [("M2", "t1"), ("M3", "t2")])
    assert recording.merge_shared_log(local, shared, f"{tmp_path}/all") == 1
    assert [r["code"] for r in ordered(spark.read.parquet(f"{tmp_path}/all"))] == ["M2", "M3", "M1"]


NOW = dt.datetime(2026, 11, 1, 9, 30)


def test_publish_and_fetch(spark, table, tmp_path):
    root = str(tmp_path)
    df = table("code name", [("M1", "名称,带逗号"), ("M2", "名称2")])
    entry = sn.publish_snapshot(df, root, "ra", NOW, "someone", area="ra")
    assert entry.version.startswith("20261101T093000-") and entry.rows == 2
    found, rows = sn.fetch_snapshot(spark, root, "ra", entry.version)
    assert [r["name"] for r in ordered(rows)] == ["名称,带逗号", "名称2"]
    assert found.sha256 == entry.sha256
    with pytest.raises(sn.SnapshotError):
        sn.fetch_snapshot(spark, root, "udi", entry.version)
    df.withColumn("name", F.lit("changed")).write.mode("overwrite").parquet(entry.path)
    with pytest.raises(sn.SnapshotError, match="hash"):
        sn.fetch_snapshot(spark, root, "ra", entry.version)
    df.drop("name").write.mode("overwrite").parquet(entry.path)
    with pytest.raises(sn.SnapshotError, match="columns"):
        sn.fetch_snapshot(spark, root, "ra", entry.version)


def test_digest_ignores_order_and_counts_repeats(table):
    def digest(rows):
        return sn.content_digest(table("a b", rows), ["a", "b"]).first().sha256

    rows = [("1", "x"), ("2", "y"), ("2", "y")]
    assert digest(rows) == digest(rows[::-1])
    assert len({digest(rows), digest(rows[:2]), digest([("1x", ""), *rows[1:]]), digest([])}) == 4


def test_sync_drops_expired_and_cleans_again(spark, table, tmp_path):
    root = str(tmp_path)
    rule = ImportRule(
        "ra", (ColumnRule("code"), ColumnRule("until"), ColumnRule("at"), ColumnRule("v")),
        clean=CleanRule(("code",), ("code", "v"), "at", join_comma=("v",)), expiry_field="until",
    )
    df = table("code until at v", [("A", "2020-01-01", "1", "old"), ("A", "", "2", "b"), ("A", "", "3", "c")])
    sn.publish_snapshot(df, root, "ra", NOW, "p")
    entry = sharing.sync_source(
        spark, root, "ra", rule, dt.date(2026, 1, 1), "now", "me", f"{root}/raw", f"{root}/clean"
    )
    assert entry.rows == 2
    assert spark.read.parquet(f"{root}/clean").first().v == "c,b"
    records = spark.createDataFrame([("ra", "old", "", 1, "", "")], sharing.SYNC_SCHEMA)
    assert [r.version for r in sharing.save_sync(records, entry).collect()] == [entry.version]
    with pytest.raises(ValueError, match="not been published"):
        sharing.sync_source(spark, root, "udi", rule, dt.date(2026, 1, 1), "n", "m", "x", "y")


def test_retention_protects_current_and_last_run(spark, table, tmp_path):
    root = str(tmp_path)
    versions = []
    for i in range(4):
        df = table("a", [(str(i),)])
        versions.append(sn.publish_snapshot(df, root, "ra", NOW + dt.timedelta(days=i), "p", area="x").version)
    last_run = spark.createDataFrame([("ra", versions[0])], "source string, version string")
    gone = sharing.expire_snapshots(spark, root, 1, last_run)
    assert gone.first().deleted == 2
    for version in (versions[0], versions[3]):
        sn.fetch_snapshot(spark, root, "ra", version)
    with pytest.raises(Exception):
        sn.fetch_snapshot(spark, root, "ra", versions[1])
    runs = spark.createDataFrame([("20260101T000000",), ("20260102T000000",), ("20260103T000000",), ("tmp",)], "run_id string")
    assert {r.run_id for r in vs.run_retention(runs, 1, "20260101T000000").collect()} == {"20260102T000000"}


def manifest_of(spark, rows):
    return spark.createDataFrame(rows, "source string, version string, publisher string, published_at string, area string")


def test_status_gates_and_drift(spark):
    current = spark.createDataFrame(
        [("a", "v2", "2026-01-01 10:00:00"), ("b", "v1", "2026-01-01 09:00:00")],
        "source string, version string, published_at string",
    )
    pair = "source string, version string"
    local = spark.createDataFrame([("a", "v2"), ("b", "v0")], pair)
    sources = spark.createDataFrame([("a",), ("b",), ("c",)], "source string")
    status = vs.version_status(sources, current, local, local)
    found = {r.source: (r.aligned, r.pending) for r in status.collect()}
    assert found == {"a": (True, False), "b": (False, True), "c": (False, False)}
    with pytest.raises(vs.NotAligned, match=r"b \(not aligned\), c \(not published\)"):
        vs.alignment_gate(status)
    vs.recent_gate(current, "2026-01-01 10:05:00", "warn")
    with pytest.raises(vs.RecentPublish, match="^a "):
        vs.recent_gate(current, "2026-01-01 10:05:00", "block")
    vs.recent_gate(current, "2026-01-01 10:10:00", "block")
    drift = vs.version_drift(local, current)
    assert [(r.source, r.start_version, r.end_version) for r in drift.collect()] == [("b", "v0", "v1")]
    assert [vs.drift_action(drift, p) for p in ("warn", "block", "auto_rerun")] == ["warn", "block", "auto_rerun"]
    assert vs.drift_action(vs.version_drift(local, local), "block") == "none"


def test_overwritten_recently_across_span_edges(spark):
    rows = [
        ("a", "v1", "p", "2026-01-01 10:09:50", "x"), ("a", "v2", "q", "2026-01-01 10:10:10", "x"),
        ("a", "v3", "q", "2026-01-01 10:12:00", "x"), ("a", "v4", "p", "2026-01-01 10:22:00", "x"),
        ("a", "v5", "q", "2026-01-01 10:31:59", "x"), ("b", "v1", "p", "2026-01-01 10:32:00", "x"),
    ]
    found = vs.overwritten_recently(manifest_of(spark, rows)).collect()
    assert sorted((r.version, r.replaced_version) for r in found) == [("v2", "v1"), ("v5", "v4")]


def test_review_page_and_ranges(table):
    log = table("log_time code", [("2026/01/05 10:00:00", "a"), ("2026/01/20 10:00:00", "b"), ("2026/03/01 10:00:00", "C")])
    january = time_range(log, "log_time", "2026/01/01 00:00:00", "2026/01/31 23:59:59")
    assert january.count() == 2
    assert time_range(log, "log_time", "2026/01/20 00:00:00", "2026/01/20 23:59:59").count() == 1
    assert time_range(log, "log_time").count() == 3
    page = rv.page(january, [ORD], 2, 1)
    assert page.total == 2 and [r.code for r in page.rows.collect()] == ["b"]
    assert rv.page(log, [ORD], 99, 2).page == 2 and rv.page(log.limit(0), [ORD], 3).page_count == 1
    assert rv.newest_first(log, " c ", 1).rows.first().code == "C"
    assert keyword_filter(log, ["code"], "  ").count() == 3


def test_exports(table):
    df = table("Catalog Quantity", [("001", "a\tb\\c\r\nd")])
    layout, missing = ex.export_layout(df, ["Quantity ", "", "Catalog", "Catalog"], ["Catalog", "Quantity", "Price"])
    assert layout.columns == ["Quantity", "_blank_1", "Catalog", "_blank_3", ORD] and missing == []
    assert list(layout.first())[1:4] == ["", "001", ""]
    assert ex.export_layout(df, ["Catalog"], ["Catalog", "Quantity"])[1] == ["Quantity"]
    assert ex.table_dump(df).first().line == "001\ta\\tb\\\\c\\r\\nd"
    assert ex.log_dump(df, ["log_time", "Catalog", "x"]).first().entry == '{"log_time":"<log_time>","Catalog":"001","x":""}'
    assert [tuple(r) for r in ex.cell_dump(df, F.col(ORD), ["Catalog"]).collect()] == [(0, "Catalog", "001")]
    assert ex.review_export(df, {"Catalog": "目录"}).columns == ["目录", ORD]


def test_source_counts_and_run_record(spark, table):
    found = rv.source_counts(spark, {"a": table("x", [("1",)]), "b": table("x", [("1",)]).limit(0), "c": "no_table"})
    assert [tuple(r) for r in found.collect()] == [("a", 1)]
    result = table("status", [("Ready",), ("Ready",), ("Conflict",)])
    versions = spark.createDataFrame([("b", "2"), ("a", "1"), ("c", "")], "source string, version string")
    row = vs.run_record(result, versions, "id", "at", "me").first()
    assert (row.versions, row.ready, row.conflict, row.duplicate) == ("a=1,b=2", 2, 1, 0)


def test_keyed_table_and_order_stamp(table):
    df = table("k v", [("b", "1"), ("a", "2"), ("b", "3"), (" b", "4"), ("", "5")])
    assert [(r["k"], r["v"]) for r in ordered(keyed_table(df, "k"))] == [("b", "3"), ("a", "2"), (" b", "4"), ("", "5")]
    stamped = stamp_order(df.orderBy("v"), 100)
    assert [r["v"] for r in ordered(stamped)] == ["1", "2", "3", "4", "5"]
    assert stamped.agg(F.min(ORD)).first()[0] >= 100

"""Commit logs, gated runs, stored results, row numbers."""

from __future__ import annotations

import datetime as dt
import random

import pytest
import sample
from conftest import ordered
from pyspark.sql import functions as F

from recordloom.operators import versions as vs
from recordloom.operators.changes import apply_changes, latest_records
from recordloom.plans import sharing
from recordloom.plans.consolidating import consolidate
from recordloom.plans.importing import import_source
from recordloom.plans.recording import NothingToExport, export_and_record
from recordloom.plans.results import store_result
from recordloom.plans.shared_run import RUN_SCHEMA, SharedStore, align, shared_run, shared_status
from recordloom.rules import ORD, CleanRule, ColumnRule, ImportRule
from recordloom.sources import commits
from recordloom.sources import snapshots as sn
from recordloom.sources.tables import numbered, stamp_lines
from test_scale import full_scans

NOW = dt.datetime(2026, 1, 5, 9, 30)
LATER = "2026-01-05 12:00:00"
TODAY = dt.date(2026, 1, 1)
PAIR = "source string, version string"


def test_numbers_are_consecutive_and_a_lost_race_takes_the_next(spark, tmp_path):
    log = f"{tmp_path}/log"
    assert commits.read_commits(spark, log, PAIR).count() == 0 and commits.last_commit(spark, log) == 0
    assert commits.append_commit(spark, log, {"source": "a", "version": "é\n1"}) == 1
    # a writer that saw no entry yet comes second
    assert commits.append_commit(spark, log, {"source": "a", "version": "2"}, first_try=1) == 2
    assert commits.append_commit(spark, log, {"source": "b", "version": None}) == 3
    found = commits.read_commits(spark, log, PAIR)
    assert sorted(tuple(r) for r in found.fillna("-").collect()) == [("a", "2", 2), ("a", "é\n1", 1), ("b", "-", 3)]
    assert {(r.source, r.version) for r in commits.newest(found, "source").collect()} == {("a", "2"), ("b", None)}


def test_a_broken_write_never_shows(spark, tmp_path):
    log = tmp_path / "log"
    commits.append_commit(spark, str(log), {"source": "a", "version": "1"})
    (log / ".half").write_text('{"source": "a", "ver')
    assert commits.read_commits(spark, str(log), PAIR).count() == 1
    assert commits.append_commit(spark, str(log), {"source": "a", "version": "2"}) == 2


def test_two_publishes_in_one_second(spark, table, tmp_path):
    root = str(tmp_path)
    for _ in range(4):
        # whichever hash is larger, the later publish is current
        for text in ("one", "two"):
            last = sn.publish_snapshot(table("a", [(text,)]), root, "ra", NOW, "p")
            current = vs.current_versions(sn.read_manifest(spark, root)).first()
            assert (current.version, current.published_at) == (last.version, "2026-01-05 09:30:00")
            assert sharing.current_version(spark, root, "ra") == last.version
            assert sn.fetch_snapshot(spark, root, "ra", last.version)[1].first().a == text
    assert [r.commit for r in sn.read_manifest(spark, root).orderBy("commit").collect()] == list(range(1, 9))


def test_retention_goes_by_commit(spark, table, tmp_path):
    root = str(tmp_path)
    made = [sn.publish_snapshot(table("a", [(str(i),)]), root, "ra", NOW, "p").version for i in range(5)]
    gone = vs.retention(sn.read_manifest(spark, root), 2)
    assert {r.version for r in gone.collect()} == set(made[:3])


def test_a_replaced_version_of_the_same_second_is_reported(spark, table, tmp_path):
    root = str(tmp_path)
    first = sn.publish_snapshot(table("a", [("1",)]), root, "ra", NOW, "p")
    second = sn.publish_snapshot(table("a", [("2",)]), root, "ra", NOW, "q")
    (row,) = vs.overwritten_recently(sn.read_manifest(spark, root)).collect()
    assert (row.version, row.replaced_version) == (second.version, first.version)


RULES = {
    "ra": ImportRule("ra", (ColumnRule("code"), ColumnRule("until"), ColumnRule("at"), ColumnRule("v")),
                     clean=CleanRule(("code",), ("code", "v"), "at", join_comma=("v",)), expiry_field="until"),
    "udi": ImportRule("udi", (ColumnRule("code"), ColumnRule("name"))),
}


@pytest.fixture
def store(tmp_path):
    return SharedStore(f"{tmp_path}/share", f"{tmp_path}/local")


@pytest.fixture
def publish(spark, table, store):
    def run(source, columns, rows, minute=0):
        return sn.publish_snapshot(table(columns, rows), store.root, source, NOW + dt.timedelta(minutes=minute), "p")

    def both():
        run("ra", "code until at v", [("A", "2020-01-01", "1", "old"), ("A", "", "2", "b"), ("A", "", "3", "c")])
        run("udi", "code name", [("A", "x"), ("B", "y")])

    run.both = both
    return run


def joined(tables):
    rows = tables["udi"].join(tables["ra"].select("code", "v"), "code", "left")
    status = F.when(F.col("v").isNull(), "Incomplete").otherwise("Ready")
    return rows.select("code", "name", "v", status.alias("status"), F.col("v").isNull().alias("is_missing"))


def start(spark, store, policy, run=joined, now=LATER, run_id="r1"):
    return shared_run(spark, store, RULES, run, policy, run_id, TODAY, lambda: now, "me")


def states(spark, store):
    return {r.source: (r.aligned, r.pending) for r in shared_status(spark, store, list(RULES)).collect()}


def test_align_run_pending_clears_and_a_new_version_blocks_again(spark, store, publish):
    with pytest.raises(vs.NotAligned, match=r"ra \(not published\), udi \(not published\)"):
        start(spark, store, "warn")
    publish.both()
    assert states(spark, store) == {"ra": (False, True), "udi": (False, True)}
    with pytest.raises(vs.NotAligned, match=r"ra \(not aligned\), udi \(not aligned\)"):
        start(spark, store, "warn")
    assert [r.source for r in align(spark, store, RULES, TODAY, LATER, "me")] == ["ra", "udi"]
    assert align(spark, store, RULES, TODAY, LATER, "me") == []
    assert states(spark, store) == {"ra": (True, True), "udi": (True, True)}
    outcome = start(spark, store, "warn")
    assert (outcome.action, outcome.notice, outcome.result.counts["Ready"], outcome.result.missing) == ("none", "", 1, 1)
    assert {(r.code, r.v) for r in outcome.result.read(spark).collect()} == {("A", "c,b"), ("B", None)}
    assert states(spark, store) == {"ra": (True, False), "udi": (True, False)}
    record = commits.read_commits(spark, f"{store.root}/runs", RUN_SCHEMA).first()
    assert (record.run_id, record.by, record.ready, record.incomplete, record.conflict) == ("r1", "me", 1, 1, 0)
    assert record.versions == ",".join(f"{s}={v}" for s, v in sorted(outcome.versions.items()))
    publish("ra", "code until at v", [("A", "", "9", "new")], 1)
    assert states(spark, store)["ra"] == (False, True)
    with pytest.raises(vs.NotAligned, match=r"^ra \(not aligned\)$"):
        start(spark, store, "warn")


@pytest.mark.parametrize("policy,turns,name", [("warn", 1, "x"), ("block", 1, "x"), ("auto_rerun", 2, "late")])
def test_a_publish_in_the_middle(spark, store, publish, policy, turns, name):
    publish.both()
    align(spark, store, RULES, TODAY, LATER, "me")
    seen = []

    def run(tables):
        seen.append(1)
        if len(seen) == 1:
            publish("udi", "code name", [("A", "late")], 1)
        return joined(tables)

    outcome = start(spark, store, policy, run)
    assert (outcome.action, len(seen)) == (policy, turns) and outcome.notice
    assert outcome.result.read(spark).where("code = 'A'").first().name == name
    # only the rerun used the newest version
    assert states(spark, store)["udi"] == ((True, False) if policy == "auto_rerun" else (False, True))


def test_block_waits_after_a_publish(spark, store, publish):
    publish.both()
    align(spark, store, RULES, TODAY, LATER, "me")
    with pytest.raises(vs.RecentPublish, match="ra .*udi"):
        start(spark, store, "block", now="2026-01-05 09:35:00")
    assert start(spark, store, "warn", now="2026-01-05 09:35:00").action == "none"
    assert start(spark, store, "block", run_id="r2").action == "none"


def test_align_refuses_a_tampered_snapshot(spark, store, publish, table):
    publish.both()
    path = sn.read_manifest(spark, store.root).where("source = 'ra'").first().path
    table("code until at v", [("A", "", "1", "forged")]).write.mode("append").parquet(path)
    with pytest.raises(sn.SnapshotError):
        align(spark, store, RULES, TODAY, LATER, "me")
    assert states(spark, store)["ra"] == (False, True)


def test_a_result_is_written_once_and_counted_by_that_write(spark, table, tmp_path):
    result = consolidate(sample.tables(table, sample.rows()), sample.RULE, sample.RUN_DATE)
    log = spark.createDataFrame([], ", ".join(f"`{c}` string" for c in sample.LOG_COLUMNS) + f", {ORD} long")
    result = apply_changes(result, latest_records(log, sample.CHANGES.identity), sample.CHANGES, sample.RULE.base_key)
    ready = F.col("status") == "Ready"
    broken = result.withColumns({
        "Action": F.when(ready, sample.CHANGES.action_stored).otherwise(F.col("Action")),
        "Changes": F.when(ready & (F.col("plant") == "fern"), " ").otherwise("said")})
    stored = store_result(broken, f"{tmp_path}/result", sample.CHANGES)
    back = stored.read(spark)
    assert stored.rows == back.count() == result.count()
    assert stored.counts == {r["status"]: r["n"] for r in back.groupBy("status").agg(F.count("*").alias("n")).collect()} | {
        s: 0 for s, n in stored.counts.items() if not n}
    assert stored.missing == back.where("is_missing").count()
    assert stored.undescribed == stored.undescribed_rows(spark, sample.CHANGES).count() == 1
    with pytest.raises(Exception, match="already exists"):
        store_result(broken, f"{tmp_path}/result", sample.CHANGES)


def test_export_runs_the_plan_once(spark, table, tmp_path):
    source = f"{tmp_path}/counted"
    rows = [("Ready", f"{i}", "v") for i in range(5)] + [("Incomplete", "x", "v")]
    table("status Name Lot", rows).write.parquet(source)
    log_path = f"{tmp_path}/log"
    table("log_time status Name Lot", [("2026/01/01 00:00:00", "Ready", "0", "v")]).write.parquet(log_path)
    rule = sample.RULE.__class__("s", "Name", ("Name",), sample.RULE.sources[:1], tuple(
        c for c in sample.RULE.columns if c.name in ("Name", "Lot")))
    done = []

    def run():
        done.append(export_and_record(
            spark.read.parquet(source), rule, ["Lot", "Name"], f"{tmp_path}/out", log_path, ["Name"],
            ["log_time", "status", "Name", "Lot"], "2026/02/01 00:00:00"))

    assert full_scans(spark, run, "counted") == 1
    assert (done[0].rows, done[0].recorded) == (5, 4)
    assert spark.read.parquet(log_path).count() == 5
    with pytest.raises(NothingToExport):
        export_and_record(spark.read.parquet(source).where("status = 'Conflict'"), rule, ["Lot"], f"{tmp_path}/no", log_path,
                          ["Name"], ["log_time", "Name"], "t")


def test_lines_are_numbered_as_a_sort_would(spark):
    rng = random.Random(6)
    rows = [(f"f{f:02d}", line, f"{f}-{line}") for f in range(6) for line in range(1, rng.randrange(2, 30)) if rng.random() < 0.8]
    shuffled = rng.sample(rows, len(rows))
    df = spark.createDataFrame(shuffled, "file string, line long, v string").select("v", F.struct("file", "line").alias(ORD)).repartition(5)
    out = stamp_lines(df, 1000).collect()
    assert [r.v for r in sorted(out, key=lambda r: r[ORD])] == [v for _, _, v in rows]
    assert len({r[ORD] for r in out}) == len(rows) and min(r[ORD] for r in out) >= 1000
    plan = stamp_lines(df)._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan


def test_stored_rows_are_numbered_without_gaps(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(1000).selectExpr("id % 3 as v").repartition(4).write.parquet(path)
    out = numbered(spark, path, 7)
    assert sorted(r[ORD] for r in out.collect()) == list(range(7, 1007))
    assert [r.v for r in ordered_rows(out)] == [r.v for r in ordered_rows(numbered(spark, path))]
    assert "rangepartitioning" not in out._jdf.queryExecution().toString()


def ordered_rows(df):
    return sorted(df.collect(), key=lambda r: r[ORD])


def test_import_writes_its_rows_twice_and_counts_in_passing(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("Code,Flag,Until\n" + "".join(f"{i},Yes,{2020 + i % 12}-01-01\n" for i in range(60)))
    rule = ImportRule("r", (ColumnRule("code", "Code", "required"), ColumnRule("flag", "Flag", accepted=("yes",)),
                            ColumnRule("until", "Until")), expiry_field="until")
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    result = import_source(spark, str(path), rule, TODAY, f"{tmp_path}/raw")
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    ran = store.executionsList(before, 1000)
    writes = sum("InsertIntoHadoopFsRelation" in ran.apply(i).physicalPlanDescription() for i in range(ran.size()))
    assert (result.rows, result.dropped_expired, writes) == (30, 30, 2)
    assert [r["code"] for r in ordered(spark.read.parquet(f"{tmp_path}/raw"))] == [str(i) for i in range(60) if i % 12 >= 6]


def test_only_buckets_that_differ_are_fetched(spark, table, tmp_path):
    root, cache = f"{tmp_path}/share", f"{tmp_path}/cache"
    rows = [(str(i), f"v{i}") for i in range(300)]

    def publish(rows, minute):
        return sn.publish_snapshot(
            table("k v", rows), root, "ra", NOW + dt.timedelta(minutes=minute), "p", buckets=16, bucket_by=["k"])

    def fetch(entry):
        _, df, fetched = sn.fetch_buckets(spark, root, "ra", entry.version, cache)
        return [(r["k"], r["v"]) for r in ordered(df)], fetched

    first = publish(rows, 0)
    assert first.sha256 == sn.content_digest(table("k v", rows), ["k", "v"]).first().sha256
    assert sum(b["rows"] for b in first.buckets) == 300
    assert fetch(first) == (rows, len(first.buckets)) and fetch(first) == (rows, 0)
    changed = [(k, "new" if k in ("7", "8", "9") else v) for k, v in rows]
    got, fetched = fetch(publish(changed, 1))
    assert got == changed and 1 <= fetched <= 3
    # the older version is whole again without reading anything
    assert fetch(first) == (rows, 0)
    # rows that only move are other rows: their order counts
    moved = list(reversed(rows))
    assert fetch(publish(moved, 2))[0] == moved


def test_a_tampered_bucket_is_refused_and_not_kept(spark, table, tmp_path):
    root, cache = f"{tmp_path}/share", f"{tmp_path}/cache"
    entry = sn.publish_snapshot(table("k v", [("a", "1"), ("b", "2")]), root, "ra", NOW, "p", buckets=4, bucket_by=["k"])
    forged = entry.buckets[0]["bucket"]
    table("k v", [("x", "y")]).write.mode("append").parquet(f"{entry.path}/_bucket={forged}")
    for _ in range(2):
        with pytest.raises(sn.SnapshotError, match="content hash differs"):
            sn.fetch_buckets(spark, root, "ra", entry.version, cache)
    assert commits.last_commit(spark, f"{cache}/index") == 0

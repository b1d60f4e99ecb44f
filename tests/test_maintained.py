"""The table of newest records, page indexes, comparison by position."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from recordloom.operators import review as rv
from recordloom.operators.changes import latest_records
from recordloom.plans.recording import record_ready
from recordloom.rules import ORD
from recordloom.sources import commits, latest
from recordloom.sources.tables import numbered
from test_scale import full_scans

LOG = f"log_time string, Name string, Lot string, v string, {ORD} long"


def batch(rng, start, n):
    times = ["", "2026/01/01", "2026/01/02", "2026/01/03"]
    return [(rng.choice(times), rng.choice(["a", " a", "b", "c", "d", ""]), rng.choice("xy"), str(rng.randrange(99)), start + i) for i in range(n)]


def as_rows(df):
    return sorted(tuple(r) for r in df.select("log_time", "Name", "Lot", "v", ORD).collect())


def test_random_appends_late_times_and_ties(spark, tmp_path):
    rng, rows, root = random.Random(12), [], f"{tmp_path}/latest"
    assert latest.read_latest(spark, root) is None
    for n in (30, 0, 1, 40, 5):
        rows += batch(rng, len(rows), n)
        log = spark.createDataFrame(rows, LOG)
        assert latest.merge_latest(spark, root, log, ["Name", "Lot"], buckets=4) == len(rows) - 1
        assert as_rows(latest.read_latest(spark, root)) == as_rows(latest_records(log, ["Name", "Lot"]))
    # merging again adds no state
    states = commits.last_commit(spark, f"{root}/states")
    latest.merge_latest(spark, root, spark.createDataFrame(rows, LOG), ["Name", "Lot"])
    assert commits.last_commit(spark, f"{root}/states") == states


def test_only_touched_buckets_are_written(spark, tmp_path):
    root = f"{tmp_path}/latest"
    rows = [("2026/01/01", f"n{i}", "x", "1", i) for i in range(200)]
    latest.merge_latest(spark, root, spark.createDataFrame(rows, LOG), ["Name", "Lot"], buckets=16)
    before = {p.bucket: p.path for p in latest._state(spark, root).paths}
    rows.append(("2026/01/02", "n7", "x", "2", 200))
    latest.merge_latest(spark, root, spark.createDataFrame(rows, LOG), ["Name", "Lot"])
    after = {p.bucket: p.path for p in latest._state(spark, root).paths}
    assert sum(before[b] != after[b] for b in before) == 1
    assert latest.read_latest(spark, root).where("Name = 'n7'").first().v == "2"


def test_a_merge_that_loses_the_race_starts_again(spark, tmp_path, monkeypatch):
    root, real, lost = f"{tmp_path}/latest", commits.commit_after, []
    rows = [("2026/01/01", "a", "x", "1", 0), ("2026/01/02", "b", "x", "1", 1)]
    log = spark.createDataFrame(rows, LOG)

    def late(spark, folder, last, entry):
        if not lost:
            lost.append(1)
            monkeypatch.setattr(latest, "commit_after", real)
            latest.merge_latest(spark, root, log.limit(2), ["Name", "Lot"], buckets=2)
        return real(spark, folder, last, entry)

    monkeypatch.setattr(latest, "commit_after", late)
    latest.merge_latest(spark, root, log, ["Name", "Lot"], buckets=2)
    assert as_rows(latest.read_latest(spark, root)) == as_rows(latest_records(log, ["Name", "Lot"]))


def test_recording_with_the_maintained_table(spark, table, tmp_path):
    paths = [f"{tmp_path}/log{i}" for i in range(2)]
    for path in paths:
        table("log_time status Name v", [("2026/01/01 00:00:00", "Ready", "a", "1"), ("2026/01/02 00:00:00", "Ready", "a", "2")]).write.parquet(path)
    for i, rows in enumerate([[("Ready", "a", "2"), ("Ready", "b", "1")], [("Ready", "b", "2")], [("Ready", "b", "2"), ("Ready", "a", "2")]]):
        ready = table("status Name v", rows)
        counts = [
            record_ready(ready, path, ["Name"], ["log_time", "status", "Name", "v"], f"2026/02/0{i + 1} 00:00:00", latest_root=root)
            for path, root in zip(paths, (None, f"{tmp_path}/latest"))]
        assert counts[0] == counts[1] == [1, 1, 0][i]
    both = [sorted(tuple(r) for r in spark.read.parquet(p).drop(ORD).collect()) for p in paths]
    assert both[0] == both[1]


def test_pages_of_an_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rv, "FILE_ROWS", 64)
    source, root = f"{tmp_path}/counted", f"{tmp_path}/index"
    spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"), F.lit("x").alias("v")).repartition(3).write.parquet(source)
    df = spark.read.parquet(source)
    index = rv.build_page_index(df, ["k"], root, "v1")
    for number, size in ((1, 10), (7, 33), (100, 10), (999, 64), (0, 0), (1, 5000)):
        want, got = rv.page(df, ["k"], number, size), rv.indexed_page(spark, index, number, size)
        assert (got.total, got.page, got.page_count, got.size) == (want.total, want.page, want.page_count, want.size)
        assert [r.k for r in got.rows.collect()] == [r.k for r in want.rows.collect()]

    def late():
        found = rv.build_page_index(df, ["k"], root, "v1")
        rv.indexed_page(spark, found, 50, 10).rows.collect()

    assert full_scans(spark, late, "counted") == 0
    page = rv.indexed_page(spark, index, 50, 10).rows
    assert len(page.inputFiles()) == 1 < len(index.files)
    assert rv.build_page_index(df.where("k < 5"), ["k"], root, "v2").files != index.files
    empty = rv.build_page_index(df.limit(0), ["k"], root, "v3")
    assert rv.indexed_page(spark, empty, 3).rows.count() == 0 and rv.indexed_page(spark, empty, 3).page == 1


def test_cells_differ_by_position_with_repeated_rows(spark, tmp_path):
    def stored(name, rows):
        spark.createDataFrame(rows, "a string, b string").coalesce(1).write.parquet(f"{tmp_path}/{name}")
        return numbered(spark, f"{tmp_path}/{name}")

    left = stored("l", [("x", "1"), ("x", "1"), ("x", "1"), ("y", "2")])
    right = stored("r", [("x", "1"), ("x", "3"), ("x", "1")])
    assert sorted(tuple(r) for r in rv.position_diff(left, right).collect()) == [
        (1, "b", "1", "3"), (3, "a", "y", None), (3, "b", "2", None)]
    with pytest.raises(ValueError, match="repeat"):
        rv.cell_diff(left, right, ["a"])

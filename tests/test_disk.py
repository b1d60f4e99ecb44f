"""What runs leave on disk, and what travels with a row: no second copy, no shuffle of a step that has ended."""

import time
from datetime import datetime

import pytest
from conftest import ordered
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (registers the queries)
from bindings import consolidation as con
from bindings import frames as fr
from bindings.registry import QUERIES
from recordloom.plans.results import store_result
from recordloom.rules import ORD
from recordloom.session import _WRITTEN, shuffles_freed, staged
from recordloom.sources.tables import stamp_order, write_table

DAY = datetime(1998, 1, 2)
#: Lines of equal keys in any order, whole copies, a line without a part.
LINES = [
    (2, 11, 1, 1, 5.0, 9.5, 0.06, 0.0, "N", "O", DAY), (1, 22, 2, 1, 1.0, 2.0, 0.0, 0.02, "R", "F", DAY),
    (1, 5, 1, 1, 3.0, 4.0, 0.1, 0.0, "A", "F", DAY), (2, 11, 1, 1, 5.0, 9.5, 0.06, 0.0, "N", "O", DAY),
    (1, 7, 1, 2, 3.0, 4.0, 0.1, 0.08, "A", "F", DAY), (3, None, 1, 1, None, 4.0, 0.0, 0.0, "R", "O", DAY),
]
ORDERS = [(k, k, "O", 10.0 * k, DAY, f"{k}-HIGH") for k in (1, 2, 3, 4)]
EVENTS = [(k, DAY, 1, "view", 1.0, "{}") for k in (1, 2, 4)]


@pytest.fixture
def tables(spark, tmp_path):
    for name, rows, schema in (
        ("lineitem", LINES, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
         "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"),
        ("orders", ORDERS, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        ("events", EVENTS, "event_id long, ts timestamp, user_id long, event_type string, value double, props string"),
    ):
        spark.createDataFrame(rows, schema).repartition(2).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def shuffle_files(spark):
    """Names of the shuffle files that are there; files go in the background."""
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (found.apply(i).getName() for i in range(found.size()))
    return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}


def left_by(spark, run, seconds=10):
    """Shuffle files that ``run`` leaves, and what it returns."""
    before = shuffle_files(spark)
    out, end = run(), time.time() + seconds
    while (more := shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.1)
    return more, out


def test_a_staged_table_leaves_no_shuffle_files(spark):
    rows = spark.range(500).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count()
    left, kept = left_by(spark, lambda: staged(rows, "counted"))
    assert not left and sorted(map(tuple, kept.collect())) == sorted((k, len(range(k, 500, 7))) for k in range(7))
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    assert spark.conf.get(name) == "false"
    with pytest.raises(ZeroDivisionError), shuffles_freed(spark):
        1 / 0
    assert spark.conf.get(name) == "false"


def test_numbered_lines_are_the_lines_in_their_order(spark, tables):
    whole, numbered = fr.order_lines(spark, tables), fr.order_lines_numbered(spark, tables)
    assert numbered.schema[ORD].dataType.simpleString() == "bigint"
    assert ordered(numbered) == ordered(whole) and len(ordered(whole)) == len(LINES)
    assert numbered.select(ORD).distinct().count() == len(LINES)


def test_consolidated_rows_shuffle_no_position_and_no_text(spark, tables):
    """consolidate_orders: positions of lines are numbers, conflict texts are made after the join."""
    found = con.sources(spark, tables)
    assert found["lines"].schema[ORD].dataType.simpleString() == found["flags"].schema[ORD].dataType.simpleString() == "bigint"
    plan = con.consolidated(spark, tables).drop(ORD)
    scans = [x for x in plan._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x and "__src_1#" in x]
    assert scans and not any("_first#" in x for x in scans)
    rows = {r.result_key: r for r in QUERIES["consolidate_orders"](spark, tables).collect()}
    assert rows["1::1"].row_conflict == "Lines：l_orderkey=1, l_linenumber=1 存在内容不同的重复记录"
    assert (rows["1::1"].Part, rows["1::1"]["Return Flags"], rows["1::2"].status) == ("5", "A,R", "Ready")
    assert rows["2::1"].status == "Incomplete" and rows["4::NONE"].is_missing and len(rows) == 5


def test_written_tables_and_results_leave_no_shuffle_files(spark, tmp_path):
    """exported_and_logged, shared runs: a stored log and a result are read from their files."""
    rows = spark.range(90).repartition(3, "id").select(F.col("id").cast("string").alias("v"), (F.col("id") * 7 % 90).alias(ORD))
    left, _ = left_by(spark, lambda: write_table(stamp_order(rows), f"{tmp_path}/log", ["v"]))
    assert not left and [r["v"] for r in ordered(spark.read.parquet(f"{tmp_path}/log"))] == [r["v"] for r in ordered(rows)]
    result = rows.select(F.lit("Ready").alias("status"), F.lit(False).alias("is_missing"), "v")
    left, stored = left_by(spark, lambda: store_result(result, f"{tmp_path}/result"))
    assert not left and (stored.rows, stored.counts["Ready"]) == (90, 90) == (stored.read(spark).count(),) * 2


@pytest.mark.parametrize("name", ["consolidate_with_history", "repeated_run"])
def test_history_is_compared_after_the_consolidation_is_stored(spark, tables, name):
    left, found = left_by(spark, lambda: QUERIES[name](spark, tables))
    scans = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x]
    assert not left and len(scans) == 2 and not any("l_partkey" in x or "o_custkey" in x for x in scans)
    rows = [tuple(r) for r in found.collect()]
    if name == "repeated_run":
        assert dict(rows) == {"Ready": 0, "Incomplete": 3, "Duplicate": 1, "Conflict": 1}
    else:
        assert sorted(r[:2] for r in rows) == [
            ("1::1", "Conflict"), ("1::2", "Duplicate"), ("2::1", "Incomplete"), ("3::1", "Incomplete"), ("4::NONE", "Incomplete")]


def test_shared_lines_are_published_with_a_number(spark, tables):
    """shared_run_auto_rerun: published, fetched and aligned lines hold each cell once."""
    before = set(_WRITTEN)
    found = QUERIES["shared_run_auto_rerun"](spark, tables)
    assert sorted((r.result_key, r.Customer, r.status, r.turns) for r in found.collect()) == [
        ("1::1", "C1", "Conflict", 2), ("1::2", "C1", "Ready", 2), ("2::1", "C2", "Incomplete", 2), ("3::1", "C3", "Incomplete", 2),
        ("4::NONE", "C4", "Incomplete", 2)]
    lines = [p for p in set(_WRITTEN) - before if "/lines-" in p]
    assert len(lines) == 1 and spark.read.parquet(lines[0]).schema[ORD].dataType.simpleString() == "bigint"


@pytest.mark.parametrize("name,want", [
    ("clean_lines", [("", "R", "1"), ("11", "N", "1"), ("22", "R", "2"), ("5", "A", "1"), ("7", "A", "1")]),
    ("join_distinct", [("", "R", "1"), ("11", "N", "1"), ("22", "R", "2"), ("5", "A", "1"), ("7", "A", "1")]),
    ("unique_conflict_summary", []),
])
def test_cleaning_steps_do_not_hold_each_others_shuffles(spark, tables, name, want):
    left, found = left_by(spark, lambda: QUERIES[name](spark, tables))
    scans = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x]
    assert not left and scans and all("struct<l_orderkey:bigint" not in x for x in scans)
    assert name == "clean_lines" or not any("l_extendedprice" in x for x in scans)
    names = {"clean_lines": ("l_partkey", "l_returnflag", "l_suppkey"), "join_distinct": ("l_partkey", "flags", "suppliers")}
    assert sorted(tuple(r[n] for n in names.get(name, ())) for r in found.collect()) == want


def test_clean_summary_of_stored_rows(spark, tmp_path):
    """unique_conflict_summary: groups in order of their first line, the newest values first."""
    lines = [(k, part, supp, 1, 1.0, 1.0, 0.0, 0.0, flag, "O", datetime(1998, 1, day)) for k, part, supp, flag, day in (
        (9, 4, 1, "A", 1), (8, 4, 2, "R", 2), (7, 3, 1, "N", 5), (6, 3, 2, "A", 4), (5, 2, 1, "A", 1), (5, 2, 1, "R", 2))]
    names = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
             "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp")
    spark.createDataFrame(lines, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = QUERIES["unique_conflict_summary"](spark, str(tmp_path)).collect()
    assert [(r.field, r.groups, r.examples) for r in found] == [("l_returnflag", 2, "3「N / A」；4「R / A」")]

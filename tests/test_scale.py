"""Hot keys give whole, equal results; plans stay free of what does not scale."""

import random
import re
from collections import defaultdict
from datetime import datetime

import pytest
import sample
from conftest import ordered
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (registers the queries)
from bindings import consolidation as con
from bindings.registry import QUERIES
from recordloom.columns import rows_differ
from recordloom.operators import clean as cl
from recordloom.operators import conflicts as cf
from recordloom.operators import match as m
from recordloom.operators import versions as vs
from recordloom.operators.changes import apply_changes, latest_records
from recordloom.operators.skew import numbered_within
from recordloom.plans.consolidating import consolidate
from recordloom.rules import CleanRule, MergeRecords

SMALL = "/root/testdata/sf0.001"


def skewed(n, seed):
    """Rows whose first key holds a third of everything."""
    rng = random.Random(seed)
    return [
        ("hot" if rng.random() < 0.34 else f"k{rng.randrange(40)}", str(rng.randrange(12)), str(rng.randrange(6)))
        for _ in range(n)
    ]


def test_hot_key_expansion_matches_brute_force(table):
    rows = skewed(3000, 1)
    keys = ["hot", *(f"k{i}" for i in range(45))]
    base = table("key", [(k,) for k in keys])
    found = ordered(m.expand_one_to_many(base, "key", table("k e v", rows), "k", ["e"], "src"))
    firsts = defaultdict(dict)
    for k, e, v in rows:
        firsts[k].setdefault(e, v)
    want = [(k, e, v) for k in keys for e, v in (firsts[k].items() if firsts[k] else [(None, None)])]
    assert [(r["key"], r["src"] and r["src"]["e"], r["src"] and r["src"]["v"]) for r in found] == want


def test_hot_key_conflicts_match_brute_force(table):
    rows = skewed(3000, 2)
    src = table("k e v", rows)
    seen = defaultdict(set)
    for k, e, v in rows:
        seen[k, e].add(v)
    want = {key: sorted(values) for key, values in seen.items() if len(values) > 1}
    cells = cf.conflict_cells(src, "k", ["e"], {"v": ["V"]})
    got = defaultdict(list)
    for r in cells.collect():
        got[r._match, r._expand_0].append(r.value)
    assert {k: sorted(v) for k, v in got.items()} == want
    noted = cf.cell_notes(cells, ["e"], "S").collect()
    assert {(r._match, r._expand_0): r.notes["V"] for r in noted} == {
        k: f"S：{k[0]}+{k[1]} 有多个候选值：{', '.join(v[:3])}" for k, v in want.items()
    }


def test_hot_key_clean_and_merge_match_brute_force(table):
    rows = skewed(3000, 3)
    src = table("g at v", rows)
    r = CleanRule(("g",), ("g", "at"), "at", join_comma=("v",), unique=("v",))
    latest, order = {}, []
    for i, (g, at, v) in enumerate(rows):
        if g not in order:
            order.append(g)
        latest[g, at] = (at, i, v)
    want = {}
    for g in order:
        newest = sorted((x for k, x in latest.items() if k[0] == g), reverse=True)
        want[g] = ",".join(dict.fromkeys(v for _, _, v in newest))
    found = ordered(cl.clean(src, r))
    assert [x["g"] for x in found] == order and {x["g"]: x["v"] for x in found} == want
    joined = m.join_records(
        m.collect_many_to_one(src, "g", ["v"]), {"c": (["v"], "", ",")}, MergeRecords()
    )
    distinct = defaultdict(dict)
    for g, _, v in rows:
        distinct[g][v] = 1
    assert {r._match: r.c for r in joined.collect()} == {g: ",".join(v) for g, v in distinct.items()}


def test_hot_source_publishes_match_brute_force(spark):
    rng = random.Random(4)
    rows = sorted(
        ("hot" if rng.random() < 0.4 else f"s{rng.randrange(5)}",
         f"2026-01-01 {rng.randrange(24):02d}:{rng.randrange(60):02d}:{rng.randrange(60):02d}",
         f"v{i:05d}", f"u{rng.randrange(3)}")
        for i in range(2000)
    )
    df = spark.createDataFrame(
        [(s, v, u, t, "x") for s, t, v, u in rows],
        "source string, version string, publisher string, published_at string, area string",
    )

    def seconds(t):
        h, mi, s = t[-8:].split(":")
        return int(h) * 3600 + int(mi) * 60 + int(s)

    want, last = set(), {}
    for s, t, v, u in rows:
        if s in last and last[s][2] != u and seconds(t) - seconds(last[s][0]) < 600:
            want.add((v, last[s][1]))
        last[s] = (t, v, u)
    got = {(r.version, r.replaced_version) for r in vs.overwritten_recently(df).collect()}
    assert got == want


def test_crowded_blank_identity(table):
    log = table("log_time Id v", [("t", "", "x"), ("t", "1", "y")])
    result = table("result_key status Id v", [("k", "Ready", " ", "x")] * 50 + [("j", "Ready", "1", "z")])
    result = result.withColumn("is_missing", F.lit(False)).withColumn("T", F.lit(""))
    rule = con_rule()
    found = apply_changes(result, latest_records(log, ["Id"]), rule, "Id")
    assert {r.status: r["count"] for r in found.groupBy("status").count().collect()} == {"Duplicate": 50, "Ready": 1}


def con_rule():
    from recordloom.rules import ChangeRule

    return ChangeRule(("Id",), ("Id", "v", "T"), "T")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_uses_what_does_not_scale(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(QUERIES[name](spark, SMALL))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert word not in text, word
    # the one thing broadcast on request is the table of crowded keys, a thousand rows at most
    lines = text.splitlines()
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            assert any("AS _parts" in below for below in lines[i + 1:i + 3]), lines[i:i + 3]


def test_sources_are_pruned_to_the_columns_in_use(spark):
    text = plan(QUERIES["lookup_one_to_one"](spark, SMALL))
    event_scans = [line for line in text.splitlines() if "FileScan" in line and "event_id" in line]
    assert event_scans and not any("props" in line or "user_id" in line for line in event_scans)


@pytest.mark.parametrize("name", ["cell_notes", "unique_conflict_summary", "retention"])
def test_ranked_filters_apply_before_the_shuffle(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_a_crowded_key_is_cut_into_parts(spark, table):
    from recordloom.operators.skew import PART, SIZE, cut

    rows = table("k v", [("hot", str(i)) for i in range(3000)] + [(f"k{i}", "x") for i in range(6000)])
    sizes = rows.groupBy("k").agg(F.count("*").alias(SIZE))
    total = rows.agg(F.count("*")).scalar()
    found = cut(rows, sizes, ["k"], [F.col("v")], total)
    assert found.count() == 9000
    parts = found.where("k = 'hot'").groupBy(PART).count()
    assert parts.count() > 300 and parts.agg(F.max("count")).first()[0] < 60
    assert found.where(f"k <> 'hot' and {PART} <> 0").count() == 0


def test_a_crowded_key_of_few_values_shrinks_before_the_join(spark, table):
    rows = table("k e v", [("hot", "1", str(i % 2)) for i in range(4000)] + [(f"k{i}", "1", "x") for i in range(4000)])
    found = cf.conflict_cells(rows, "k", ["e"], {"v": ["V"]})
    text = plan(found)
    assert sorted(r.value for r in found.collect()) == ["0", "1"]
    assert text.count("ExistingRDD") <= 2 and "Broadcast" not in text.replace("BroadcastHashJoin", "")
    last = cf.content_conflicts(rows, "k", ["e"], ["k", "v"], "S").collect()
    assert [(r._match, r.detail) for r in last] == [("hot", "S：k=hot, v=1 存在内容不同的重复记录")]


def test_null_and_blank_rows_are_told_apart_from_values(spark):
    rows = spark.createDataFrame([("a", None, "x"), ("a", "x", None), ("b", None, "x"), ("b", "", "x")], "k string, p string, q string")
    found = {r.k: r.d for r in rows.groupBy("k").agg(rows_differ(["p", "q"]).alias("d")).collect()}
    assert found == {"a": True, "b": False}


def test_late_pages_come_by_range(spark):
    from recordloom.operators import review

    df = spark.range(25_000).withColumn("v", 25_000 - F.col("id"))
    late = review.page(df, ["v"], 10**12)
    assert [r.v for r in late.rows.collect()] == list(range(24_901, 25_001)) and late.page_count == 250
    assert "TakeOrdered" not in plan(late.rows.select("v"))
    middle = review.page(df, [F.desc("v")], 150)
    assert [r.v for r in middle.rows.collect()] == list(range(25_000 - 14_900, 25_000 - 15_000, -1))


def test_repeated_keys_are_refused(table):
    from recordloom.operators.review import cell_diff

    rows = table("k v", [("a", "1"), ("a", "2")])
    with pytest.raises(ValueError, match="repeat"):
        cell_diff(rows, rows, ["k"])


def test_text_range_reaches_the_scan(spark, table, tmp_path):
    from recordloom.operators.filters import time_range

    table("log_time code", [("2026/01/05", "a")]).write.parquet(f"{tmp_path}/log")
    found = time_range(spark.read.parquet(f"{tmp_path}/log"), "log_time", "2026/01/01", "2026/01/31")
    assert "GreaterThanOrEqual(log_time,2026/01/01)" in plan(found)


def test_lookups_need_no_window(spark, table):
    """Base and lookups meet on one partitioning: an aggregate's exchange each, none for the joins."""
    data = sample.rows()
    text = plan(consolidate(sample.tables(table, data), sample.RULE, sample.RUN_DATE, notes=False))
    assert text.count("Window") == 0 and "Python" not in text


def test_status_counts_agree_with_the_rows(spark):
    counts = {r.status: r.rows for r in QUERIES["status_counts"](spark, SMALL).collect()}
    rows = con.consolidated(spark, SMALL).groupBy("status").count().collect()
    assert {k: v for k, v in counts.items() if v} == {r.status: r["count"] for r in rows}


def full_scans(spark, run, table):
    """Scans of ``table`` that ``run`` really makes, in all its jobs, without those that stop at their first row."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    ran = store.executionsList(before, 1000)
    found = 0
    for i in range(ran.size()):
        text = ran.apply(i).physicalPlanDescription()
        tree = text.split("== Initial Plan ==")[0]
        if re.search(r"(Collect|Global|Local)Limit", tree):
            continue
        for k in set(re.findall(r"Scan parquet\s+\((\d+)\)", tree)):
            node = re.search(rf"^\({k}\) Scan parquet.*?(?=^\(\d+\) |\Z)", text, re.S | re.M)
            found += node is not None and table in node.group(0)
    return found


@pytest.mark.parametrize("name,most", [
    ("consolidate_orders", 2), ("consolidation_notes", 3), ("expand_one_to_many", 1), ("conflict_cells", 2), ("join_records", 1)])
def test_the_lines_are_read_once_for_each_use(spark, name, most):
    """One aggregate of the expansion is stored and read by join, sizes, totals and conflicts."""
    def run():
        QUERIES[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()

    assert 0 < full_scans(spark, run, "lineitem") <= most


def test_a_merged_source_is_read_once_with_its_record(table):
    rows = table("k v w", [("a", "1", "x"), ("a", "2", "y"), (" a", "1", "z"), ("b", "", "q"), ("", "9", "9")])
    long = m.collect_many_to_one(rows, "k", ["v", "w"])
    for pick, w in (("first", "x"), ("last", "z")):
        joined = m.join_records(long, {"all": (["v"], "", ",")}, MergeRecords(), (), ["w"], pick)
        assert sorted((r[m.MATCH], r["all"], r["_record"]["w"]) for r in joined.collect()) == [("a", "1,2", w), ("b", "", "q")]


def test_conflicts_of_a_stored_pass_equal_those_found_alone(table):
    rng = random.Random(4)
    rows = table("k a b", [(rng.choice("pqr "), rng.choice(["", " ", "1", "2"]), rng.choice(["", "x"])) for _ in range(60)])
    marks = {"_differs": cf.several_tuples(["a", "b"]), **cf.several_values(["a", "b"], ["a", "b"])}
    keyed = m.pick_per_key(rows, "k", "row", several=marks)
    alone = cf.value_conflicts(rows, "k", ["a", "b"], "L").collect()
    assert sorted(alone) == sorted(cf.value_conflicts(rows, "k", ["a", "b"], "L", keyed.where("_differs").select(m.MATCH)).collect())
    targets = {"a": ["A"], "b": ["B", "A"]}
    cells = cf.conflict_cells(rows, "k", (), targets, ["a", "b"]).collect()
    assert cells and sorted(cells) == sorted(cf.conflict_cells(rows, "k", (), targets, ["a", "b"], keyed).collect())


def test_a_crowded_key_is_numbered_over_its_ranges(spark):
    """The ranges are not joined again, so the crowded key and the null one go over several."""
    rng = random.Random(8)
    rows = [(k, rng.randrange(400) if k == "hot" else i % 7, str(i)) for i, (k, *_) in enumerate(skewed(2000, 5))]
    rows += [(None, i % 90, f"n{i}") for i in range(700)]
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merging, "false")
    try:
        df = spark.createDataFrame(rows, "key string, at int, v string").repartition(3)
        found = numbered_within(df, "key", ["at"], "place").collect()
    finally:
        spark.conf.unset(merging)
    assert sorted((r.key or "", r.at, r.v) for r in found) == sorted((k or "", at, v) for k, at, v in rows)
    got, want = defaultdict(list), defaultdict(list)
    for r in sorted(found, key=lambda r: r.place):
        got[r.key].append((r.place, r.at))
    for k, at, _ in rows:
        want[k].append(at)
    assert got == {k: list(enumerate(sorted(v), 1)) for k, v in want.items()}


def test_expanded_lines_keep_their_place(spark, tmp_path):
    """Every line of an order has its place: of a crowded order, a repeated one, one without lines."""
    day = datetime(2026, 1, 2)
    orders = [(1, 7, "O", 1.0, day, "p"), (2, 7, "O", 1.0, day, "p"), (2, 7, "O", 1.0, day, "p"), (3, 7, "O", 1.0, day, "p")]
    numbers = [(1, n) for n in random.Random(6).sample(range(2, 3002, 2), 1500)] + [(2, 9), (2, 4), (2, 4), (2, 11)]
    lines = [(k, i % 50 + 1, 1, n, 1.0, 1.0, 0.0, 0.0, "N", "O", day) for i, (k, n) in enumerate(numbers)]
    names = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
    spark.createDataFrame(orders, names).write.parquet(f"{tmp_path}/orders.parquet")
    names = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
             "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp")
    spark.createDataFrame(lines, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = QUERIES["expand_one_to_many"](spark, str(tmp_path)).collect()
    want = [("1", str(n), i) for i, n in enumerate(range(2, 3002, 2), 1)]
    want += [("2", line, i) for i, line in enumerate(["4", "4", "9", "9", "11", "11"], 1)] + [("3", None, 1)]
    assert len(want) == 1507
    assert sorted((r.o_orderkey, r.place, r.line) for r in found) == sorted((k, i, n) for k, n, i in want)

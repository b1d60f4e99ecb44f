import dataclasses

import pytest
import sample
from conftest import ordered
from pyspark.sql import functions as F

from recordloom.operators import conflicts as cf
from recordloom.operators import match as m
from recordloom.operators.changes import MissingDescriptionError, apply_changes, latest_records
from recordloom.operators.log import append_records
from recordloom.operators.project import UnknownParameterError
from recordloom.operators.review import status_counts
from recordloom.operators.validate import SourceNotReady
from recordloom.plans.consolidating import consolidate, consolidate_with_history
from recordloom.rules import ORD, ChangeRule, MergeRecords, NoMatch


def run(table, data, rule=sample.RULE, **options):
    return consolidate(sample.tables(table, data), rule, sample.RUN_DATE, **options)


def change_source(rule, name, **changes):
    sources = tuple(
        dataclasses.replace(s, **changes) if s.name == name else s for s in rule.sources
    )
    return dataclasses.replace(rule, sources=sources)


def counts(df):
    return {r.status: r.rows for r in status_counts(df).collect()}


def test_sample_shape(table):
    found = run(table, sample.rows())
    assert counts(found) == {"Ready": 4, "Incomplete": 1, "Duplicate": 0, "Conflict": 0}
    rows = ordered(found)
    assert [r["result_key"] for r in rows] == ["fern/spring", "moss/spring", "moss/late", "ivy/07", "bare/MISSING"]
    fern, bare = rows[0], rows[-1]
    assert (bare["status"], bare["Lot"], bare["Trays"], bare["Title"]) == ("Incomplete", "MISSING", "MISSING", "BARE")
    assert (fern["Due"], fern["Season"], fern["Spare"], fern["Shelf"]) == ("2026-10-16", "autumn", "", "")
    assert (fern["Growers"], fern["Permit"]) == ("fern & sons", "permit of fern")
    assert fern["conflict_notes"] == {} and fern["row_conflict"] == ""


def test_contradicting_rows_conflict_with_notes(table):
    data = sample.rows()
    data["lots"].append(("ivy", "07", "9", "high", "x"))
    rows = {r["result_key"]: r for r in ordered(run(table, data))}
    assert {k for k, r in rows.items() if r["status"] == "Conflict"} == {"ivy/07"}
    assert rows["ivy/07"]["row_conflict"] == "Sowing book：plant=ivy, lot=07 存在内容不同的重复记录"
    assert rows["ivy/07"]["conflict_notes"] == {"Trays": "Sowing book：ivy+07 有多个候选值：2, 9"}


@pytest.mark.parametrize("other", [("fern", "spring", "1 ", "", "x"), ("fern", "spring", "1", "", "another")])
def test_white_space_and_unused_fields_conflict_without_notes(table, other):
    data = sample.rows()
    data["lots"].append(other)
    fern = ordered(run(table, data))[0]
    assert fern["status"] == "Conflict" and fern["conflict_notes"] == {}


def test_repeated_rows_are_no_conflict(table):
    data = sample.rows()
    data["lots"] += data["lots"]
    assert counts(run(table, data))["Conflict"] == 0


def test_text_of_other_fields_comes_from_the_last_differing_row(table):
    rows = [("k", "1", "a"), ("k", "1", "b"), ("k", "1", "c"), ("k", "1", "a"), ("j", "1", "a"), ("j", "1", "a")]
    found = cf.content_conflicts(table("k e v", rows), "k", ["e"], ["k", "v"], "S").collect()
    assert [(r._match, r.detail) for r in found] == [("k", "S：k=k, v=c 存在内容不同的重复记录")]


def test_merged_cells(table):
    data = sample.rows()
    data["growers"] += [("moss", "Lee", "2"), ("moss", "moss & sons", "1"), ("moss", "moss & sons", "5"), ("moss", "NA", "3"), ("moss", "Abt", "4")]
    moss = ordered(run(table, data))[1]
    assert moss["Growers"] == "moss & sons,Lee,Abt" and moss["status"] == "Ready"
    by_text = change_source(sample.RULE, "growers", merge=MergeRecords(order="sorted"))
    assert ordered(run(table, data, by_text))[1]["Growers"] == "Abt,Lee,moss & sons"


def test_value_conflict_lists_every_value_and_notes_three(table):
    data = sample.rows()
    data["growers"] = [("ivy", g, "1") for g in ("Dee", "Bob", "Cat", "Ann", "Bob", "")]
    rule = change_source(sample.RULE, "growers", merge=None, conflicts=True, compare_by=("grower",))
    ivy = ordered(run(table, data, rule))[3]
    assert ivy["row_conflict"] == "Growers：plant=ivy 存在多个不同值：Ann, Bob, Cat, Dee"
    assert ivy["conflict_notes"] == {"Growers": "Growers：ivy 有多个候选值：Ann, Bob, Cat"}
    assert ivy["Growers"] == "Dee"
    data["growers"].pop()
    last = change_source(rule, "growers", selected="last", conflicts=False)
    assert ordered(run(table, data, last))[3]["Growers"] == "Bob"


def test_no_match_actions(table):
    data = sample.rows()
    data["zones"] = data["zones"][1:]
    data["growers"] = data["growers"][:3]
    rows = ordered(run(table, data))
    assert (rows[0]["Zone"], rows[0]["status"]) == ("MISSING", "Incomplete") and rows[4]["Growers"] == ""
    assert rows[1]["status"] == "Ready"
    skip = change_source(sample.RULE, "lots", no_match=NoMatch("skip"))
    assert [r["Name"] for r in ordered(run(table, data, skip))] == ["fern", "moss", "moss", "ivy"]
    empty = change_source(sample.RULE, "lots", no_match=NoMatch("empty", "none"))
    bare = ordered(run(table, data, empty))[-1]
    assert (bare["Lot"], bare["Shelf"], bare["status"]) == ("none", "", "Incomplete")
    with pytest.raises(m.NoExpansionError, match="bare"):
        run(table, data, change_source(sample.RULE, "lots", no_match=NoMatch("error")))


def test_required_if_applicable_uses_the_source_condition(table):
    data = sample.rows()
    data["lots"] = [(p, lot, trays, " ", remark) for p, lot, trays, _, remark in data["lots"]]
    shelves = [(r["Shelf"].strip(), r["status"]) for r in ordered(run(table, data))[:4]]
    assert shelves == [("", "Ready"), ("MISSING", "Incomplete"), ("", "Ready"), ("MISSING", "Incomplete")]


def test_lookup_keys_are_trimmed_and_base_keys_are_not(table):
    data = sample.rows()
    data["species"][0] = (" fern", "FERN", "p")
    data["lots"] = [(f" {r[0]} ", *r[1:]) for r in data["lots"]]
    rows = ordered(run(table, data))
    assert rows[0]["Lot"] == "MISSING" and rows[0]["Zone"] == "MISSING"
    assert [(r["Lot"], r["status"]) for r in rows[1:4]] == [("spring", "Ready"), ("late", "Ready"), ("07", "Ready")]


def test_base_and_lookup_keep_the_last_row(table):
    data = sample.rows()
    data["species"].append(("fern", "Fern, renamed", "q"))
    data["zones"] = [("fern", "dry"), *data["zones"]]
    fern = ordered(run(table, data))[0]
    assert (fern["Title"], fern["Permit"], fern["Zone"]) == ("Fern, renamed", "q", "wet")


def test_a_base_column_with_a_reserved_name_is_refused(table):
    base, lots = table("plant _size n", [("a", "1", "2")]), table("plant lot", [("a", "1")])
    with pytest.raises(ValueError, match="_size"):
        m.expand_one_to_many(base, "plant", lots, "plant", ["lot"], "src")
    found = m.expand_one_to_many(base.drop("_size"), "plant", lots, "plant", ["lot"], "src")
    assert found.first().n == "2"


def test_missing_and_empty_tables_and_parameter(table):
    tables = sample.tables(table, sample.rows())
    with pytest.raises(SourceNotReady, match="zones"):
        consolidate({**tables, "zones": tables["zones"].limit(0)}, sample.RULE, sample.RUN_DATE)
    tables.pop("zones")
    with pytest.raises(SourceNotReady, match="zones"):
        consolidate(tables, sample.RULE, sample.RUN_DATE)
    with pytest.raises(UnknownParameterError):
        run(table, sample.rows(), dataclasses.replace(sample.RULE, parameters={}))


def history(table, result, changes=sample.CHANGES):
    ready = result.where("status = 'Ready'")
    return append_records(ready, sample.LOG_COLUMNS, sample.LOG_COLUMNS, "2026/10/01 08:00:00")


def again(table, data, log, **options):
    return consolidate_with_history(
        sample.tables(table, data), sample.RULE, sample.RUN_DATE, sample.CHANGES, log, **options
    )


def test_second_run_is_all_duplicates_then_a_change_shows(table):
    data = sample.rows()
    log = history(table, run(table, data)).cache()
    second = again(table, data, log)
    assert counts(second) == {"Ready": 0, "Incomplete": 1, "Duplicate": 4, "Conflict": 0}
    assert {r.Changes for r in second.select("Changes").collect()} == {""}
    assert counts(again(table, data, log, force=True))["Ready"] == 4
    data["zones"][1] = ("moss", "dry")
    data["species"][1] = ("moss", "Moss", "permit of moss")
    changed = [r for r in ordered(again(table, data, log)) if r["status"] == "Ready"]
    assert [(r["result_key"], r["Action"], r["Changes"]) for r in changed] == [
        (key, "Modify", "new Title; new Zone") for key in ("moss/spring", "moss/late")]


def test_conflict_rows_keep_status_but_get_an_action(table):
    data = sample.rows()
    log = history(table, run(table, data)).cache()
    data["lots"].append(("fern", "spring", "4", "low", "x"))
    fern = ordered(again(table, data, log))[0]
    assert (fern["status"], fern["Action"], fern["Changes"]) == ("Conflict", "Modify", "")


def test_unstored_column_cannot_prove_a_change(table):
    log = table("log_time Id Name", [("2026/01/01", "1", "a")])
    result = table("result_key status Id Name Price", [("1", "Ready", "1", "a ", "5")]).withColumn("is_missing", F.lit(False))
    rule = ChangeRule(("Id",), ("Id", "Name", "Price", "Text"), "Text")
    found = apply_changes(result.withColumn("Text", F.lit("")), latest_records(log, ["Id"]), rule, "Id").first()
    assert found.status == "Duplicate" and found.record_kind == "unchanged"


def test_source_description(table):
    log = table("log_time Id Name", [("2026/01/01", "1", "a")])
    result = table("result_key status Id Name Text", [("1", "Ready", "1", "b", " why ")]).withColumn("is_missing", F.lit(False))
    rule = ChangeRule(("Id",), ("Id", "Name", "Text"), "Text", mode="source")
    latest = latest_records(log, ["Id"])
    assert apply_changes(result, latest, rule, "Id").first().Text == "why"
    blank = result.withColumn("Text", F.lit(" "))
    with pytest.raises(MissingDescriptionError, match="1"):
        apply_changes(blank, latest, rule, "Id")
    quiet = dataclasses.replace(rule, missing_action="empty")
    assert apply_changes(blank, latest, quiet, "Id").first().Text == ""


def test_collect_many_to_one_keeps_or_drops_repeats(table):
    df = table("k v", [("a ", "1"), (" a", "1"), ("a ", "1"), ("", "2")])
    assert m.collect_many_to_one(df, "k", ["v"]).count() == 3
    assert m.collect_many_to_one(df, "k", ["v"], deduplicate=True).count() == 2
    assert ORD in m.collect_many_to_one(df, "k", ["v"]).columns

import datetime as dt

import pytest
from conftest import ordered
from pyspark.sql import functions as F

from recordloom.operators import clean as cl
from recordloom.operators import validate as va
from recordloom.operators.filters import drop_expired, expiry_counts
from recordloom.rules import ORD, CleanRule, ColumnRule, ImportRule

COLUMNS = "code cert_id cert_no effective name one_time method"
CERTS = [
    ("M1", "A-1", "CERT-1", "2020-01-01", "旧名字", "是", ""),
    ("M1", "A-1", "CERT-1", "2024-01-01", "新名字", "是", ""),
    ("M1", "A-2", "CERT-2", "2019-01-01", "另一个名字", "是", "EO"),
]


def rule(**changes):
    base = dict(
        group_by=("code",), dedupe_by=("code", "cert_id", "cert_no"), latest_by="effective",
        drop=("cert_id", "effective"), unique=("one_time",), conflict="error",
        join_comma=("cert_no",), join_backslash=("name", "method"),
    )
    return CleanRule(**{**base, **changes})


def test_clean_one_row_per_group(table):
    found = ordered(cl.clean(table(COLUMNS, CERTS), rule()))
    assert found == [{
        "code": "M1", "cert_no": "CERT-1,CERT-2", "name": "新名字\\另一个名字", "one_time": "是", "method": "EO",
    }]


def test_unique_conflict_policies(table):
    rows = CERTS[:2] + [("M1", "A-2", "CERT-2", "2019-01-01", "另一个名字", "否", "EO")]
    assert ordered(cl.clean(table(COLUMNS, rows), rule(conflict="latest")))[0]["one_time"] == "是"
    with pytest.raises(va.BatchRejected) as rejected:
        cl.clean(table(COLUMNS, rows), rule())
    assert rejected.value.violations.first().examples == "M1「是 / 否」"


def test_conflict_summary(table):
    rows = [
        (code, cert, cert, date, "n", flag, method)
        for code in ("M1", "M2")
        for cert, date, flag, method in (("A", "2024", "是", "x" * 30), ("B", "2023", "否", "EO"))
    ]
    r = rule(unique=("one_time", "method"), join_backslash=("name",))
    latest = cl.latest_per_key(table(COLUMNS, rows), r.dedupe_by, r.latest_by)
    conflicts = cl.unique_conflicts(latest, r)
    assert cl.conflict_totals(conflicts, r).first().asDict() == {"groups": 2, "cells": 4}
    found = {s.field: s for s in cl.unique_conflict_summary(conflicts, latest, r).collect()}
    assert found["one_time"].groups == 2
    assert found["one_time"].examples == "M1「是 / 否」；M2「是 / 否」"
    assert found["method"].examples.startswith("M1「" + "x" * 28 + "… / EO」")


def test_latest_is_textual_and_ties_go_to_the_later_row(table):
    rows = [("k", "9", "a"), ("k ", "10", "b"), ("k", "9 ", "c"), ("j", "", "d")]
    found = ordered(cl.latest_per_key(table("k at v", rows), ["k"], "at").drop("_first"))
    assert [r["v"] for r in found] == ["c", "d"]


def test_groups_keep_first_appearance_order(table):
    rows = [("B", "1", "x"), ("A", "5", "y"), ("B", "9", "z")]
    r = CleanRule(("g",), ("g", "at"), "at")
    assert [x["v"] for x in ordered(cl.clean(table("g at v", rows), r))] == ["z", "y"]


def test_join_keeps_distinct_values_newest_first(table):
    rows = [("g", "1", "a"), ("g", "2", "b"), ("g", "3", "a "), ("g", "4", " "), ("h", "1", "")]
    r = CleanRule(("g",), ("g", "at"), "at", join_comma=("v",))
    assert [x["v"] for x in ordered(cl.clean(table("g at v", rows), r))] == ["a,b", ""]


def test_drop_expired(table):
    rows = [("2026-01-09",), ("2026-01-10",), ("2026/1/11",), ("bad",), ("",), ("2026-02-30",), ("20260109",)]
    df = table("until", rows)
    kept = [r["until"] for r in ordered(drop_expired(df, "until", dt.date(2026, 1, 10)))]
    assert kept == ["2026-01-10", "2026/1/11", "bad", "", "2026-02-30"]
    assert list(expiry_counts(df, "until", dt.date(2026, 1, 10)).first()) == [5, 2]


RULE = ImportRule(
    name="s", label="S", data_row=4,
    columns=(
        ColumnRule("code", "Code", "required"),
        ColumnRule("agency", "Agency", "required"),
        ColumnRule("quantity", "Quantity"),
        ColumnRule("unit", "Unit", "required_if_applicable", required_when={
            "column": "quantity", "operator": "greater_than", "value": 1, "value_type": "number"}),
        ColumnRule("flag", "Flag", "", {"No": "否"}, ("No", "Yes")),
    ),
)


def numbered(df):
    return df.withColumn("row", (F.col(ORD) + 4).cast("int"))


def test_required_violations(table):
    df = numbered(table("code agency quantity unit flag", [
        ("", "x", "", "", ""), (" ", "", "1", "", ""), ("", "", "", "", ""), ("NA", "x", "", "", ""),
    ]))
    found = va.required_violations(df, RULE, "row")
    assert found.count() == 3
    assert [r.row_number for r in va.failed_rows(found).collect()] == [4, 5]
    assert [(r.field, r.failed_rows) for r in va.violation_counts(found).collect()] == [("code", 2), ("agency", 1)]
    assert list(va.violation_summary(found).first()) == [2, 3]


def test_conditional_and_accepted(table):
    df = numbered(table("code agency quantity unit flag", [
        ("a", "x", "2", "   ", "No"), ("a", "x", " 2.5 ", "", "maybe"), ("a", "x", "1", "", " yes "),
        ("a", "x", "two", "", ""), ("a", "x", "2", "u", ""),
    ]))
    found = va.conditional_violations(df, RULE, "row").orderBy("row_number").collect()
    assert [(r.row_number, r.condition) for r in found] == [
        (4, "Quantity（quantity） = 2 > 1"), (5, "Quantity（quantity） = 2.5 > 1"),
    ]
    wrong = va.accepted_violations(df, RULE, "row").collect()
    assert [(r.row_number, r.value, r.allowed) for r in wrong] == [(5, "maybe", "No / Yes")]


def test_gate_order(table):
    df = numbered(table("code agency quantity unit flag", [("a", "", "2", "", "maybe")]))
    fields = RULE.fields

    def failing(present, rows):
        with pytest.raises(va.BatchRejected) as rejected:
            va.batch_gate(present, rows, rows, rows, RULE, "row")
        return rejected.value.check

    assert failing(["code"], df) == "required_header"
    assert failing(["code", "agency"], df) == "conditional_header"
    assert failing(fields, df) == "required"
    df = df.withColumn("agency", F.lit("x"))
    assert failing(fields, df) == "conditional"
    df = df.withColumn("unit", F.lit("u"))
    assert failing(fields, df) == "accepted"
    va.batch_gate(fields, df, df.withColumn("flag", F.lit("YES")), df, RULE, "row")


def test_source_completeness(spark, table):
    df = table("a", [("1",)])
    va.source_completeness(spark, {"x": df})
    with pytest.raises(va.SourceNotReady, match="missing"):
        va.source_completeness(spark, {"x": df, "y": "no_such_table"})
    with pytest.raises(va.SourceNotReady, match="without rows"):
        va.source_completeness(spark, {"x": df.limit(0)})

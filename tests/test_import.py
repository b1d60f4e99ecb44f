import datetime as dt

import pytest
from conftest import ordered
from pyspark.sql import functions as F

from recordloom.operators.validate import BatchRejected
from recordloom.plans.importing import import_source
from recordloom.rules import ORD, CleanRule, ColumnRule, ImportRule
from recordloom.sources.delimited import HeaderError, read_headed

RULE = ImportRule(
    name="udi", label="UDI", header_row=2, data_row=4, empty_words=("NA",),
    columns=(
        ColumnRule("code", "产品代码", "required"),
        ColumnRule("flag", "标识", "required", {"No": "否", "Yes": "是"}, ("No", "Yes", "否")),
        ColumnRule("quantity", "数量"),
        ColumnRule("unit", "单元", "required_if_applicable", required_when={
            "column": "quantity", "operator": "greater_than", "value": 1, "value_type": "number"}),
        ColumnRule("until", "失效"),
        ColumnRule("absent", "没有"),
    ),
    expiry_field="until",
)
HEAD = "说明,,,,,\n产品代码,标识,数量,单元,失效,数量,别的\nnote,,,,,\n"
TODAY = dt.date(2026, 1, 1)


@pytest.fixture
def write(tmp_path):
    def run(text, name="a.csv"):
        folder = tmp_path / "in"
        folder.mkdir(exist_ok=True)
        (folder / name).write_text(text, encoding="utf-8")
        return str(folder)

    return run


def test_read_headed(spark, write):
    path = write(HEAD + '001,No,1,,,9,x\n\n"a,""b""",Yes, 2 ,u,,,\n,,,,,,\n,,,,,,\n')
    table = read_headed(spark, path, RULE)
    assert set(table.present) == {"code", "flag", "quantity", "unit", "until"}
    rows = ordered(table.rows)
    assert [r["code"] for r in rows] == ["001", "", 'a,"b"']
    assert rows[0]["quantity"] == "1" and rows[2]["quantity"] == " 2 " and rows[0]["absent"] == ""
    assert [r.line for r in table.rows.select(f"{ORD}.line").orderBy("line").collect()] == [4, 5, 6]


def test_line_numbers_hold_across_splits(spark, write):
    lines = [f"{i:06d},No,1,,,," for i in range(20000)]
    path = write(HEAD + "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = read_headed(spark, path, RULE).rows.cache()
        assert rows.count() == 20000
        assert rows.where(F.col(f"{ORD}.line") != F.col("code").cast("int") + 4).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_several_files_share_a_header(spark, write):
    write(HEAD + "1,No,,,,\n,,,,\n", "a.csv")
    path = write(HEAD + "2,No,,,,\n", "b.csv")
    assert [r["code"] for r in ordered(read_headed(spark, path, RULE).rows)] == ["1", "2"]
    write(HEAD.replace("单元", "其他") + "2,No,,,,\n", "c.csv")
    with pytest.raises(HeaderError):
        read_headed(spark, path, RULE)


def test_quoted_line_breaks(spark, write):
    path = write(HEAD.replace("单元", '"单\n元"') + 'x,No,1,"two\nlines",,\ny,No,1,,,\n')
    rule = ImportRule("u", tuple(
        ColumnRule(c.field, "单\n元") if c.field == "unit" else c for c in RULE.columns
    ), header_row=2, data_row=4)
    rows = ordered(read_headed(spark, path, rule, multi_line=True).rows)
    assert [(r["code"], r["unit"]) for r in rows] == [("x", "two\nlines"), ("y", "")]


def test_import_writes_mapped_rows(spark, write, tmp_path):
    path = write(HEAD + "1,No,1,,2025-12-31,\n2,Yes,1,,2026-01-01,\n,,,,,,\n3,否,NA,,bad,\n")
    result = import_source(spark, path, RULE, TODAY, f"{tmp_path}/raw")
    assert (result.rows, result.dropped_expired) == (3, 1)
    rows = ordered(spark.read.parquet(f"{tmp_path}/raw"))
    assert [(r["code"], r["flag"], r["quantity"]) for r in rows] == [("2", "是", "1"), ("", "", ""), ("3", "否", "NA")]


def test_a_rejected_file_leaves_the_table_alone(spark, write, tmp_path):
    target = f"{tmp_path}/raw"
    import_source(spark, write(HEAD + "1,No,1,,,\n"), RULE, TODAY, target)
    bad = HEAD + "1,No,1,,,\n2,No,2,,,\n3,No,2.5,   ,,\n"
    with pytest.raises(BatchRejected) as rejected:
        import_source(spark, write(bad), RULE, TODAY, target)
    assert rejected.value.check == "conditional"
    lines = sorted(r.row_number.line for r in rejected.value.violations.collect())
    assert lines == [5, 6]
    with pytest.raises(BatchRejected) as rejected:
        import_source(spark, write(HEAD + "1,maybe,1,,,\n"), RULE, TODAY, target)
    assert rejected.value.check == "accepted"
    with pytest.raises(BatchRejected) as rejected:
        import_source(spark, write(HEAD.replace("标识", "x") + "1,No,1,,,\n"), RULE, TODAY, target)
    assert rejected.value.check == "required_header"
    assert spark.read.parquet(target).count() == 1


def test_append_import_and_new_columns(spark, write, tmp_path):
    target = f"{tmp_path}/raw"
    narrow = ImportRule("n", RULE.columns[:2], header_row=2, data_row=4, replace=False)
    wide = ImportRule("n", RULE.columns[:3], header_row=2, data_row=4, replace=False)
    import_source(spark, write(HEAD + "1,No,5,,,\n"), narrow, TODAY, target)
    import_source(spark, write(HEAD + "2,No,6,,,\n"), narrow, TODAY, target)
    import_source(spark, write(HEAD + "3,No,7,,,\n"), wide, TODAY, target)
    import_source(spark, write(HEAD + "4,No,8,,,\n"), narrow, TODAY, target)
    rows = ordered(spark.read.parquet(target))
    assert [(r["code"], r["quantity"]) for r in rows] == [("1", ""), ("2", ""), ("3", "7"), ("4", "")]


def test_import_cleans_and_checks_the_cleaned_rows(spark, write, tmp_path):
    rule = ImportRule(
        "ra", RULE.columns, header_row=2, data_row=4,
        clean=CleanRule(("code",), ("code",), "until", drop=("until",)),
    )
    # the older row breaks the condition, but cleaning removes it
    path = write(HEAD + "1,No,2,,2020-01-01,\n1,No,1,,2021-01-01,\n")
    result = import_source(spark, path, rule, TODAY, f"{tmp_path}/raw", f"{tmp_path}/clean")
    assert (result.rows, result.cleaned_rows) == (2, 1)
    stored = spark.read.parquet(f"{tmp_path}/clean")
    assert "until" not in stored.columns and stored.first().quantity == "1"


def test_both_modes_read_the_same_rows(spark, write):
    width = 600
    titles = ",".join(f"t{i}" for i in range(width))
    body = [",".join(f"{r}.{i}" for i in range(width)) for r in range(3)]
    path = write("\n".join(["", titles, body[0], "", body[1], "", "", body[2], "," * (width - 1) + ",beyond", ",,", ""]) + "\n")
    rule = ImportRule("wide", tuple(ColumnRule(f"f{i}", f"t{i}") for i in range(width)), header_row=2, data_row=3)
    found = [ordered(read_headed(spark, path, rule, multi_line=m).rows) for m in (False, True)]
    assert found[0] == found[1] and len(found[0][0]) == width
    assert [r["f599"] for r in found[0]] == ["0.599", "", "1.599", "", "", "2.599", ""]


def test_quoted_breaks_keep_blank_rows_and_row_numbers(spark, write):
    path = write('A,B,C\n1,"x\n\ny",3\n\n4,"say ""hi""",6\n,"",\n')
    rule = ImportRule("q", tuple(ColumnRule(c.lower(), c) for c in "ABC"))
    table = read_headed(spark, path, rule, multi_line=True)
    rows = table.rows.select(f"{ORD}.line", "a", "b", "c").orderBy("line").collect()
    assert [tuple(r) for r in rows] == [(2, "1", "x\n\ny", "3"), (3, "", "", ""), (4, "4", 'say "hi"', "6")]

import datetime as dt

import pytest
from pyspark.sql import functions as F

from recordloom.functions import (
    ConditionError,
    accepted,
    check_condition,
    condition,
    describe_condition,
    is_blank,
    is_empty,
    map_values,
    parse_date,
    to_number,
    trim_text,
)
from recordloom.functions.text import WHITESPACE, trim_key


def test_to_number(values):
    given = ["2", "1.0", "1,000", " 2 ", "", "NA", "2套", None, "1d", "0x1p2", "1_000", "1e400", "-Inf", ".5", "5."]
    inf = float("inf")
    assert values(given, to_number) == [
        2, 1, 1000, 2, None, None, None, None, None, None, None, None, -inf, 0.5, 5,
    ]


def test_blank_and_empty_disagree_on_words(values):
    blank = ["", None, "   ", "　", "  \t\r\n", "​﻿"]
    filled = ["NA", "N/A", "nan", " 2 ", "0", "​x", "~"]
    assert values(blank, is_blank) == [True] * len(blank)
    assert values(filled, is_blank) == [False] * len(filled)
    assert values(["NA", "Not Applicable", "2", None, "　"], lambda c: is_empty(c, ["NA", "N/A"])) == [
        True, False, False, True, True,
    ]


def test_trim_knows_every_white_space(values):
    given = [f"{ch}x y{ch}" for ch in WHITESPACE] + ["", None, "~a~", "a", "​a"]
    want = ["x y"] * len(WHITESPACE) + ["", "", "~a~", "a", "​a"]
    assert values(given, trim_text) == want
    assert values(given, trim_key) == want


def test_map_values(values):
    assert values(["No", " No", "NA", "", None, "x"], lambda c: map_values(c, {"No": "否", "x": " ", "": "y"})) == [
        "否", " No", "NA", "", None, "x",
    ]


def test_accepted(values):
    assert values([" yes", "YES", "no", "", "　"], lambda c: accepted(c, ["Yes"])) == [
        True, True, False, True, True,
    ]


def test_parse_date(values):
    given = [
        "2023-02-03", "2023-2-3", "2023/2/3 10:00", "2023.02.03", "2023.2.3", "20230203",
        "2023-02-30", "2023", "2023-02", "T", "2023-02-03T01:02:03", "", None, "3/2/2023", "2023-02/03",
    ]
    day = dt.date(2023, 2, 3)
    assert values(given, parse_date) == [
        day, day, day, day, None, day, None, None, None, None, day, None, None, None, None,
    ]


def leaf(operator, value=None, kind=None, column="v"):
    spec = {"column": column, "operator": operator}
    if value is not None:
        spec["value"] = value
    if kind:
        spec["value_type"] = kind
    return spec


def test_number_operators_are_silent_on_text(values):
    def run(spec, cells):
        return values(cells, lambda c: condition(spec))

    assert run(leaf("greater_than", 1, "number"), ["2", " 2 ", "2.0", "10"]) == [True] * 4
    assert run(leaf("greater_than", 1, "number"), ["1", "0", "", "NA", "two", None]) == [False] * 6
    for operator in ("equals", "not_equals"):
        assert run(leaf(operator, 1, "number"), ["two", None]) == [False, False]
    assert run(leaf("not_in", [1, 2], "number"), ["two", "3", "1"]) == [False, True, False]


def test_text_operators(values):
    specs = [
        leaf("equals", "Yes"), leaf("not_equals", "No"), leaf("in", ["是", "Yes"]),
        leaf("not_in", ["No"]), leaf("is_not_empty"), leaf("is_empty"),
    ]
    assert [values([" Yes "], lambda c, s=s: condition(s))[0] for s in specs] == [True] * 5 + [False]


def test_groups(spark):
    row = spark.createDataFrame([("2", "Yes")], "a string, b string")
    more, yes, no = leaf("greater_than", 1, "number", "a"), leaf("equals", "Yes", column="b"), leaf("equals", "No", column="b")
    cases = [[more, yes], {"all": [more, yes]}, [more, no], {"any": [more, no]}, {"any": [no]}]
    found = row.select(*[condition(c).alias(str(i)) for i, c in enumerate(cases)]).first()
    assert list(found) == [True, True, False, True, False]


def test_expected_values_pass_through_the_map(values):
    maps = {"v": {"是": "Yes", "Y": "Yes"}}
    for written in ("是", "y", " Y ", "Yes"):
        assert values(["Yes", "No"], lambda c, w=written: condition(leaf("equals", w), maps)) == [True, False]


def test_describe(spark):
    row = spark.createDataFrame([("2",)], "quantity string")
    spec = leaf("greater_than", 1, "number", "quantity")
    text = describe_condition(spec, lambda name: f"x（{name}）", F.col)
    assert row.select(text.alias("t")).first().t == "x（quantity） = 2 > 1"
    listed = {"any": [leaf("in", ["a", "b"], column="quantity"), leaf("is_empty", column="quantity")]}
    assert row.select(describe_condition(listed).alias("t")).first().t == "quantity 属于 [a b] 或 quantity 为空"


@pytest.mark.parametrize("spec", [
    leaf("equals", "x", column="other"), leaf("like", "x"), leaf("greater_than", 1),
    leaf("is_empty", "x"), leaf("equals"), leaf("in", "x"), leaf("equals", "x", "number"),
    {"all": []}, {"all": [leaf("is_empty")], "column": "v"}, {"column": "v", "operator": "is_empty", "extra": 1},
    leaf("equals", "x", "date"), "text",
])
def test_bad_conditions(spec):
    with pytest.raises(ConditionError):
        check_condition(spec, ["v"])

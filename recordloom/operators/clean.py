"""Raw rows to one row per group: newest record, distinct values, uniqueness.

Every step is a partial aggregate. The values a group joins are reduced to
distinct (group, column, value) rows before anything is gathered, so a group
holding a large share of the rows costs no more than its distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.columns import col, data_columns, record
from recordloom.functions.text import trim_key, trim_text
from recordloom.operators.validate import BatchRejected
from recordloom.rules import ORD, CleanRule
from recordloom.session import staged

EXAMPLES = 2
EXAMPLE_WIDTH = 28


def latest_per_key(df: DataFrame, by: Sequence[str], latest_by: str) -> DataFrame:
    """Newest row per trimmed key, by text; a tie goes to the later row.

    ``_first`` keeps where the key first appeared, for the order of groups.
    """
    keys = [trim_key(col(f)).alias(f"_by_{i}") for i, f in enumerate(by)]
    newest = F.struct(
        trim_text(col(latest_by)).alias("latest"), F.col(ORD).alias("ord"),
        record(data_columns(df)).alias("row"),
    )
    grouped = df.groupBy(*keys).agg(F.max(newest).alias("_new"), F.min(ORD).alias("_first"))
    return grouped.select("_new.row.*", F.col("_new.ord").alias(ORD), "_first")


def collapse_groups(latest: DataFrame, rule: CleanRule, joined: DataFrame | None = None) -> DataFrame:
    """One row per group: the newest row's raw values, joined columns replaced."""
    groups = _groups(rule)
    names = [c for c in data_columns(latest) if c != "_first"]
    newest = F.struct(
        trim_text(col(rule.latest_by)).alias("latest"), F.col(ORD).alias("ord"),
        record(names).alias("row"),
    )
    head = latest.groupBy(*_group_columns(rule)).agg(
        F.max(newest).alias("_new"), F.min("_first").alias("_at")
    )
    joins = [*rule.join_comma, *rule.join_backslash]
    if joined is not None and joins:
        head = head.join(joined, groups, "left")
    cells = [
        (
            F.coalesce(F.col("_joined").getField(f"c{joins.index(name)}"), F.lit(""))
            if joined is not None and name in joins
            else F.col("_new.row").getField(name)
        ).alias(name)
        for name in names
    ]
    return head.select(*cells, F.col("_at").alias(ORD))


def join_distinct(latest: DataFrame, rule: CleanRule) -> DataFrame | None:
    """``(groups, _joined)``: distinct values of each joined column, newest first."""
    joins = [(f, ",") for f in rule.join_comma] + [(f, "\\") for f in rule.join_backslash]
    if not joins:
        return None
    values = distinct_values(latest, rule, [f for f, _ in joins])
    cells = []
    for i, (_, separator) in enumerate(joins):
        place = F.when(F.col("field") == i, F.struct("newest", "value"))
        gathered = F.sort_array(F.collect_list(place), asc=False)
        cells.append(F.array_join(gathered["value"], separator).alias(f"c{i}"))
    gathered = values.groupBy(*_groups(rule)).agg(*cells)
    return gathered.select(
        *_groups(rule), F.struct(*[F.col(f"c{i}") for i in range(len(joins))]).alias("_joined")
    )


def distinct_values(latest: DataFrame, rule: CleanRule, fields: Sequence[str]) -> DataFrame:
    """``(groups, field, value, newest)``: non-blank values of each group, once each."""
    cells = F.array(*[
        F.struct(F.lit(i).alias("field"), trim_text(col(f)).alias("value"))
        for i, f in enumerate(fields)
    ])
    at = F.struct(trim_text(col(rule.latest_by)).alias("latest"), F.col(ORD).alias("ord"))
    rows = latest.select(*_group_columns(rule), at.alias("at"), F.inline(cells))
    return (
        rows.where("value <> ''")
        .groupBy(*_groups(rule), "field", "value")
        .agg(F.max("at").alias("newest"))
    )


def unique_conflicts(latest: DataFrame, rule: CleanRule) -> DataFrame:
    """``(groups, field, position, value, newest, several)``: every value of cells with several.

    Long form, one row for each distinct value, so that nothing is cut and no group
    is gathered; ``several`` is the number of values of the cell.
    """
    groups = _groups(rule)
    values = distinct_values(latest, rule, rule.unique)
    counts = values.groupBy(*groups, "field").agg(F.count("*").alias("several")).where("several > 1")
    names = F.array(*map(F.lit, rule.unique))
    return values.join(counts, [*groups, "field"]).select(
        *groups,
        F.element_at(names, F.col("field") + 1).alias("field"),
        F.col("field").alias("position"), "value", "newest", "several",
    )


def unique_conflict_summary(conflicts: DataFrame, latest: DataFrame, rule: CleanRule) -> DataFrame:
    """Per column: number of groups and the first two examples, in group order.

    An example shows the two newest values; the cut is made here, for the message.
    """
    groups = _groups(rule)
    first = latest.groupBy(*_group_columns(rule)).agg(F.min("_first").alias("_at"))
    newest = Window.partitionBy(*groups, "field").orderBy(F.desc("newest"))
    top = conflicts.withColumn("_nth", F.row_number().over(newest)).where(F.col("_nth") <= EXAMPLES)
    two = F.transform(F.array_sort(F.collect_list(F.struct("_nth", "value"))), lambda x: x["value"])
    placed = top.groupBy(*groups, "field").agg(two.alias("values")).join(first, groups)
    order = Window.partitionBy("field").orderBy("_at")
    ranked = placed.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= EXAMPLES)
    short = F.transform(
        "values",
        lambda v: F.when(
            F.length(v) > EXAMPLE_WIDTH, F.concat(F.substring(v, 1, EXAMPLE_WIDTH), F.lit("…"))
        ).otherwise(v),
    )
    text = F.concat(
        F.concat_ws(" + ", *groups), F.lit("「"), F.array_join(short, " / "), F.lit("」")
    )
    examples = ranked.groupBy("field").agg(
        F.array_join(
            F.sort_array(F.collect_list(F.struct("_rank", text.alias("text"))))["text"], "；"
        ).alias("examples")
    )
    counts = placed.groupBy("field").agg(F.count("*").alias("groups"))
    return counts.join(examples, "field")


def conflict_totals(conflicts: DataFrame, rule: CleanRule) -> DataFrame:
    """One row: conflicting groups and conflicting cells."""
    groups = _groups(rule)
    cells = conflicts.groupBy(*groups, "field").agg(F.lit(1).alias("one"))
    return cells.agg(F.countDistinct(*groups).alias("groups"), F.count("*").alias("cells"))


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def clean(df: DataFrame, rule: CleanRule, keep_dropped: bool = False) -> DataFrame:
    """Newest row per key, one row per group, uniqueness policy, dropped columns.

    ``keep_dropped`` leaves the dropped columns in for checks that still need them. The
    newest rows are stored where groups, joined values and conflicts all read them, the
    joined values before they meet the groups: no step holds the shuffles of another.
    """
    latest = latest_per_key(df, rule.dedupe_by, rule.latest_by)
    if rule.join_comma or rule.join_backslash or rule.conflict == "error" and rule.unique:
        latest = staged(latest, "latest")
    if rule.conflict == "error" and rule.unique:
        conflicts = unique_conflicts(latest, rule)
        if conflicts.limit(1).count():
            raise BatchRejected(
                "unique", "columns that must be unique hold several values",
                unique_conflict_summary(conflicts, latest, rule),
            )
    joined = join_distinct(latest, rule)
    cleaned = collapse_groups(latest, rule, None if joined is None else staged(joined, "joined"))
    return cleaned if keep_dropped else drop_columns(cleaned, rule.drop)


def _groups(rule: CleanRule) -> list[str]:
    return [f"_group_{i}" for i in range(len(rule.group_by))]


def _group_columns(rule: CleanRule):
    return [trim_key(col(f)).alias(f"_group_{i}") for i, f in enumerate(rule.group_by)]

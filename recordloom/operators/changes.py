"""Comparison of result rows with the newest stored record of the same identity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.columns import col, data_columns, record
from recordloom.functions.text import trim_key, trim_text
from recordloom.rules import (
    CONFLICT,
    DUPLICATE,
    MODIFIED,
    NEW,
    ORD,
    READY,
    UNCHANGED,
    ChangeRule,
)


class MissingDescriptionError(ValueError):
    """A changed row has no description and the rule asks for one; ``rows`` holds all of them."""

    def __init__(self, key: str, rows: DataFrame):
        super().__init__(f"no change description for {key}")
        self.rows = rows


def comparable_columns(rule: ChangeRule, stored: Sequence[str]) -> list[str]:
    """Declared columns the stored table really has, without identity and derived ones."""
    declared = rule.fields if rule.compare is None else rule.compare
    left_out = {*rule.identity, rule.description_field, rule.action_field, *rule.ignore}
    return [c for c in declared if c in stored and c not in left_out]


def classify(result: DataFrame, latest: DataFrame, rule: ChangeRule) -> DataFrame:
    """Adds ``record_kind``, ``stored`` and ``changed_columns``.

    ``latest`` holds each trimmed identity once, so the left join keeps one row
    per result row and a crowded identity may be split on the left side.
    """
    compared = comparable_columns(rule, data_columns(latest))
    marks = [trim_key(col(f)).alias(f"_id_{i}") for i, f in enumerate(rule.identity)]
    ids = [f"_id_{i}" for i in range(len(rule.identity))]
    stored = latest.select(
        *marks,
        F.lit(True).alias("_known"),
        *[trim_text(col(c)).alias(f"_old_{i}") for i, c in enumerate(compared)],
    )
    joined = result.select("*", *marks).join(stored, ids, "left")
    none = F.array().cast("array<string>")
    differing = [
        F.when(trim_text(col(c)) != F.col(f"_old_{i}"), F.array(F.lit(c))).otherwise(none)
        for i, c in enumerate(compared)
    ]
    changed = F.flatten(F.array(*differing)) if differing else none
    known = F.col("_known").isNotNull()
    with_lists = joined.select(
        *[col(c) for c in result.columns],
        known.alias("stored"),
        F.when(known, changed).otherwise(none).alias("changed_columns"),
    )
    kind = (
        F.when(~F.col("stored"), NEW)
        .when(F.size("changed_columns") == 0, UNCHANGED)
        .otherwise(MODIFIED)
    )
    return with_lists.withColumn("record_kind", kind)


def describe_auto(changed: Column, rule: ChangeRule) -> Column:
    """One rendered template per changed column, joined; rendered once per rule."""
    names = comparable_columns(rule, [*rule.fields, *(rule.compare or ())])
    texts = {
        name: rule.template.replace("{column}", name).replace(
            "{chinese_name}", rule.labels.get(name, name)
        )
        for name in names
    }
    if not texts:
        return F.lit("")
    rendered = F.create_map(*[F.lit(part) for pair in texts.items() for part in pair])
    return F.array_join(F.transform(changed, lambda c: F.element_at(rendered, c)), rule.separator)


def describe_source(df: DataFrame, rule: ChangeRule, key: str) -> Column:
    """The description the source supplied; ``error`` raises when a changed row has none.

    The error names the first such row in row order and carries all of them as ``rows``.
    """
    text = trim_text(col(rule.description_field))
    if rule.missing_action != "empty":
        undescribed = df.where(
            (F.col("record_kind") == MODIFIED) & (F.col("status") != CONFLICT) & (text == "")
        )
        first = undescribed.agg(F.min_by(col(key), F.col(ORD))).first()[0]
        if first is not None:
            raise MissingDescriptionError(first, undescribed)
    return text


def record_action(rule: ChangeRule) -> Column:
    """Modify for a stored identity, Add otherwise, whatever the status."""
    return F.when(F.col("stored"), rule.action_stored).otherwise(rule.action_new)


def description(df: DataFrame, rule: ChangeRule, key: str) -> Column:
    """Text per kind; Conflict rows keep what they had."""
    if rule.mode == "source":
        changed = describe_source(df, rule, key)
    else:
        changed = describe_auto(F.col("changed_columns"), rule)
    text = (
        F.when(F.col("record_kind") == NEW, rule.on_new)
        .when(F.col("record_kind") == UNCHANGED, rule.on_unchanged)
        .otherwise(changed)
    )
    return F.when(F.col("status") == CONFLICT, col(rule.description_field)).otherwise(text)


def mark_duplicates(rule: ChangeRule, force: bool = False) -> Column:
    """Unchanged rows become Duplicate, Incomplete ones too; ``force`` leaves them.

    Without a description column any stored identity is a duplicate.
    """
    if force:
        return F.col("status")
    same = F.col("record_kind") == UNCHANGED if rule.description_field else F.col("stored")
    return F.when((F.col("status") != CONFLICT) & same, DUPLICATE).otherwise(F.col("status"))


def apply_changes(
    result: DataFrame, latest: DataFrame, rule: ChangeRule, key: str = "material_code",
    force: bool = False,
) -> DataFrame:
    """Action, description and status after comparison, in one projection."""
    compared = classify(result, latest, rule)
    derived = {}
    if rule.action_field:
        derived[rule.action_field] = record_action(rule)
    if rule.description_field:
        derived[rule.description_field] = description(compared, rule, key)
    derived["status"] = mark_duplicates(rule, force)
    is_changed = (
        F.lit(False)
        if not rule.description_field
        else (F.col("status") != CONFLICT) & (F.col("record_kind") == MODIFIED)
    )
    return compared.withColumns({**derived, "is_changed": is_changed})


def change_lists(result: DataFrame) -> DataFrame:
    """``(list, result_key)``: duplicate, changed and missing keys.

    A missing key is listed once however many rows carry it.
    """
    tags = F.array_compact(F.array(
        F.when(F.col("status") == DUPLICATE, "duplicate"),
        F.when(F.col("is_changed"), "changed"),
    ))
    listed = result.select(F.explode(tags).alias("list"), "result_key")
    missing = result.where("is_missing").select(F.lit("missing").alias("list"), "result_key")
    return listed.unionByName(missing.distinct())


def undescribed(rule: ChangeRule) -> Column:
    """Whether a row is Ready and marked Modify without a description."""
    if not rule.description_field or not rule.action_field:
        return F.lit(False)
    return (
        (F.col("status") == READY)
        & (col(rule.action_field) == rule.action_stored)
        & (trim_text(col(rule.description_field)) == "")
    )


def undescribed_changes(result: DataFrame, rule: ChangeRule) -> DataFrame:
    """The undescribed rows: normally none."""
    return result.where(undescribed(rule))


def latest_records(
    log: DataFrame, identity: Sequence[str], time_column: str = "log_time"
) -> DataFrame:
    """Newest log row per trimmed identity by time text; blank first, tie to the later row."""
    names = data_columns(log)
    missing = [f for f in identity if f not in names]
    if missing:
        raise ValueError(f"log is missing identity columns: {', '.join(missing)}")
    marks = [trim_key(col(f)).alias(f"_id_{i}") for i, f in enumerate(identity)]
    time = F.coalesce(col(time_column), F.lit("")) if time_column in names else F.lit("")
    newest = F.struct(time.alias("time"), F.col(ORD).alias("ord"), record(names).alias("row"))
    grouped = log.groupBy(*marks).agg(F.max(newest).alias("_new"))
    return grouped.select("_new.row.*", F.col("_new.ord").alias(ORD))

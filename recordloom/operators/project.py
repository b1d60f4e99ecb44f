"""Result layout: one projection for the cells, one for the completeness checks."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.columns import col
from recordloom.functions.conditions import condition
from recordloom.functions.text import is_blank
from recordloom.operators.match import concatenate, first_not_null
from recordloom.rules import (
    CONFLICT,
    INCOMPLETE,
    MISSING,
    READY,
    ConsolidationRule,
    OutputColumn,
)


class UnknownParameterError(KeyError):
    """A column asks for a run parameter that was not given."""


def parameter(rule: ConsolidationRule, key: str) -> Column:
    """Value of a run parameter; only text counts as a value."""
    if key not in rule.parameters:
        raise UnknownParameterError(key)
    value = rule.parameters[key]
    return F.lit(value if isinstance(value, str) else "")


def date_offset(rule: ConsolidationRule, column: OutputColumn, run_date: dt.date) -> Column:
    """Run date plus a number of days, as YYYY-MM-DD."""
    days = column.offset_days
    given = rule.parameters.get(column.offset_days_from) if column.offset_days_from else None
    if isinstance(given, (int, float)) and not isinstance(given, bool) and given == int(given):
        days = int(given)
    return F.date_format(F.date_add(F.lit(run_date), days), "yyyy-MM-dd")


def output_cell(
    rule: ConsolidationRule, column: OutputColumn, run_date: dt.date,
    records: Mapping[str, Column], merged: Mapping[str, Column],
) -> tuple[Column, Column]:
    """(cell, unmatched flag) of one output column on the matched row."""
    no = F.lit(False)
    if column.derived and not column.source:
        if column.transform == "date_offset":
            return date_offset(rule, column, run_date), no
        if column.transform == "change_description":
            return F.lit(""), no
    if column.presence == "user_defined":
        return parameter(rule, column.parameter), no
    if column.presence in ("", "optional"):
        return F.lit(""), no
    if not column.source:
        return F.lit(column.value), no
    source = records[column.source]
    fields = [source.getField(f) for f in column.fields]
    if column.transform == "concatenate":
        cell = concatenate(fields, column.separator, rule.empty_words)
    elif column.transform == "first_not_null":
        cell = first_not_null(fields, rule.empty_words)
    else:
        cell = fields[0]
    filled, unmatched = fill_missing(rule, column, source, cell)
    if column.name in merged:
        joined = merged[column.name]
        return F.coalesce(joined, filled), joined.isNull() & unmatched
    return filled, unmatched


def fill_missing(
    rule: ConsolidationRule, column: OutputColumn, source: Column, cell: Column
) -> tuple[Column, Column]:
    """What an unmatched source leaves in the cell, and whether that counts."""
    expansion = rule.expansion
    is_expansion = expansion is not None and column.source == expansion.name
    matched = next((s for s in rule.sources if s.name == column.source), None)
    action = "emit_incomplete"
    if is_expansion:
        action = expansion.no_match.action if expansion.no_match else ""
    elif matched is not None and matched.no_match is not None:
        action = matched.no_match.action
    if action == "empty":
        return F.when(source.isNull(), "").otherwise(cell), F.lit(False)
    in_key = is_expansion and column.fields[0] in expansion.expand_by
    text = rule.row_placeholder if in_key else MISSING
    return F.when(source.isNull(), text).otherwise(cell), source.isNull()


def required_here(
    rule: ConsolidationRule, column: OutputColumn, records: Mapping[str, Column]
) -> Column | None:
    """Whether the cell must be filled on this row; None means never."""
    if column.presence not in ("required", "required_if_applicable") or column.derived:
        return None
    if column.presence == "required":
        return F.lit(True)
    source = next((s for s in rule.sources if s.name == column.source), None)
    if source is None or not column.fields:
        return None
    conditions = {c.field: c.required_when for c in source.columns if c.required_when is not None}
    spec = next((conditions[f] for f in column.fields if f in conditions), None)
    if spec is None:
        return None
    maps = {c.field: c.value_map for c in source.columns}
    row = records[source.name]
    held = condition(spec, maps, rule.empty_words, row.getField)
    return row.isNotNull() & held


def project_rows(
    df: DataFrame, rule: ConsolidationRule, run_date: dt.date,
    records: Mapping[str, Column], merged: Mapping[str, Column],
    kept: list[Column], row_conflict: Column,
) -> DataFrame:
    """``kept`` columns, status, ``is_missing``, and every output column.

    The status of a conflicting row stays Conflict whatever is missing; whether
    something is missing is reported for those rows too.
    """
    cells, flags = {}, []
    for column in rule.columns:
        cell, unmatched = output_cell(rule, column, run_date, records, merged)
        cells[column.name] = cell
        flags.append(unmatched)
    checks = {c.name: required_here(rule, c, records) for c in rule.columns}
    checks = {name: check for name, check in checks.items() if check is not None}
    needed = {name: f"_required_{i}" for i, name in enumerate(checks)}
    first = df.select(
        *kept,
        row_conflict.alias("row_conflict"),
        _any(flags).alias("_unmatched"),
        *[check.alias(needed[name]) for name, check in checks.items()],
        *[cell.alias(name) for name, cell in cells.items()],
    )
    absent = {name: F.col(flag) & is_blank(col(name)) for name, flag in needed.items()}
    second = first.select(
        *[c for c in first.columns if c.startswith("__")],
        "row_conflict",
        (F.col("_unmatched") | _any(absent.values())).alias("is_missing"),
        *[
            F.when(absent[name], rule.row_placeholder).otherwise(col(name)).alias(name)
            if name in absent
            else col(name)
            for name in rule.names
        ],
    )
    return second


def resolve_status(row_conflict: Column, is_missing: Column) -> Column:
    """Conflict outranks Incomplete outranks Ready."""
    return (
        F.when(row_conflict != "", CONFLICT).when(is_missing, INCOMPLETE).otherwise(READY)
    )


def derived_fill(df: DataFrame, rule: ConsolidationRule) -> DataFrame:
    """A required action column still blank after change detection is Incomplete."""
    names = [
        c.name for c in rule.columns
        if c.transform == "record_action" and c.presence == "required"
    ]
    if not names:
        return df
    blank = _any([is_blank(col(name)) for name in names])
    fill = {
        name: F.when(is_blank(col(name)), rule.derived_placeholder).otherwise(col(name))
        for name in names
    }
    status = F.when(blank & (F.col("status") == READY), INCOMPLETE).otherwise(F.col("status"))
    return df.withColumns({**fill, "status": status, "is_missing": F.col("is_missing") | blank})


def _any(flags) -> Column:
    return reduce(Column.__or__, flags, F.lit(False))

"""Batch validation: rows in, one row per violation out."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.columns import col
from recordloom.functions.conditions import condition, describe_condition
from recordloom.functions.text import accepted, is_blank, trim_text
from recordloom.rules import ImportRule

VIOLATION_FIELDS = ("row_number", "position", "field", "label", "condition", "value", "allowed")


class BatchRejected(ValueError):
    """A check failed: nothing of the batch may be written."""

    def __init__(self, check: str, message: str, violations: DataFrame | None = None):
        super().__init__(message)
        self.check = check
        self.violations = violations


class SourceNotReady(ValueError):
    """A source table is missing or empty."""


Cell = Callable[[str], Column]


def required_violations(df: DataFrame, rule: ImportRule, row: str) -> DataFrame:
    """Blank required cells; rows that are blank throughout are not data."""
    return _violations(df, row, _required(rule, col))


def conditional_violations(df: DataFrame, rule: ImportRule, row: str) -> DataFrame:
    """Blank cells whose condition holds on the row, with the condition spelled out."""
    return _violations(df, row, _conditional(rule))


def accepted_violations(raw: DataFrame, rule: ImportRule, row: str) -> DataFrame:
    """Non-blank raw cells outside the accepted list."""
    return _violations(raw, row, _accepted(rule, col))


def failing(check: str, rule: ImportRule, cell: Cell = col) -> Column:
    """Whether a row fails ``required``, ``conditional`` or ``accepted``; ``cell`` finds a field's column."""
    made = {"required": lambda: _required(rule, cell), "accepted": lambda: _accepted(rule, cell), "conditional": lambda: _conditional(rule)}
    return reduce(Column.__or__, [failed for _, failed, _ in made[check]()], F.lit(False))


def _required(rule: ImportRule, cell: Cell) -> list[tuple]:
    wanted = [c for c in rule.columns if c.presence == "required"]
    has_data = reduce(Column.__or__, [~is_blank(cell(f)) for f in rule.fields], F.lit(False))
    return [(c, has_data & is_blank(cell(c.field)), {}) for c in wanted]


def _conditional(rule: ImportRule) -> list[tuple]:
    checks = []
    for c in rule.columns:
        if c.required_when is None:
            continue
        held = condition(c.required_when, rule.value_maps, rule.empty_words)
        text = describe_condition(_mapped_spec(c.required_when, rule), rule.title, col)
        checks.append((c, held & is_blank(col(c.field)), {"condition": text}))
    return checks


def _accepted(rule: ImportRule, cell: Cell) -> list[tuple]:
    checks = []
    for c in rule.columns:
        if c.accepted:
            extra = {"value": trim_text(cell(c.field)), "allowed": F.lit(" / ".join(c.accepted))}
            checks.append((c, ~accepted(cell(c.field), c.accepted), extra))
    return checks


def violation_counts(violations: DataFrame) -> DataFrame:
    """Distinct failing rows per column, largest first, ties by first appearance."""
    counts = violations.groupBy("field", "label").agg(
        F.countDistinct("row_number").alias("failed_rows"),
        F.min(F.struct("row_number", "position")).alias("first"),
    )
    return counts.orderBy(F.desc("failed_rows"), "first").select("field", "label", "failed_rows")


def failed_rows(violations: DataFrame) -> DataFrame:
    """Row numbers with at least one violation, ascending."""
    return violations.select("row_number").distinct().orderBy("row_number")


def violation_summary(violations: DataFrame) -> DataFrame:
    """One row: failing rows and failing cells."""
    return violations.agg(
        F.countDistinct("row_number").alias("failed_rows"), F.count("*").alias("failed_cells")
    )


def missing_headers(present: Iterable[str], rule: ImportRule) -> tuple[str, list[str]] | None:
    """The first failing header check and its columns, or None."""
    present = set(present)
    required = [c.field for c in rule.columns if c.presence == "required"]
    conditional = [c.field for c in rule.columns if c.required_when is not None]
    for check, fields in (("required_header", required), ("conditional_header", conditional)):
        absent = [f for f in fields if f not in present]
        if absent:
            return check, absent
    return None


def batch_gate(
    present: Iterable[str], rows: DataFrame, raw: DataFrame, conditional_rows: DataFrame,
    rule: ImportRule, row: str, failed: Mapping[str, int] | None = None,
) -> None:
    """Raise on the first failing check: headers, required, conditional, accepted.

    ``failed`` holds the failing rows of each cell check where a pass over the rows has
    counted them (:func:`failing` in an observation); no job is run then. Else each check
    is a ``limit(1)`` probe.
    """
    header_gate(present, rule)
    for check, violations in (
        ("required", required_violations(rows, rule, row)),
        ("conditional", conditional_violations(conditional_rows, rule, row)),
        ("accepted", accepted_violations(raw, rule, row)),
    ):
        if failed[check] if failed is not None else violations.limit(1).count():
            raise BatchRejected(check, f"{rule.label}: {check} check failed", violations)


def header_gate(present: Iterable[str], rule: ImportRule) -> None:
    """Raise when a required or condition-carrying column is absent; needs no row."""
    absent = missing_headers(present, rule)
    if absent:
        raise BatchRejected(absent[0], f"{rule.label}: missing columns {', '.join(absent[1])}")


def source_states(spark: SparkSession, tables: Mapping[str, str | DataFrame]) -> dict[str, str]:
    """``missing``, ``empty`` or ``ready`` for each source; a value is a catalog table name or a DataFrame."""
    states = {}
    for name, t in tables.items():
        if isinstance(t, str) and not spark.catalog.tableExists(t):
            states[name] = "missing"
        else:
            states[name] = "empty" if (spark.table(t) if isinstance(t, str) else t).isEmpty() else "ready"
    return states


def source_completeness(spark: SparkSession, tables: Mapping[str, str | DataFrame]) -> None:
    """Missing tables first, then empty ones, stop the run."""
    states = source_states(spark, tables)
    for state, said in (("missing", "missing source tables"), ("empty", "sources without rows")):
        found = [name for name, s in states.items() if s == state]
        if found:
            raise SourceNotReady(f"{said}: {', '.join(found)}")


def _mapped_spec(spec, rule: ImportRule):
    """The condition with expected values as the import stores them."""
    from recordloom.functions.conditions import _mapped

    if isinstance(spec, (list, tuple)):
        return [_mapped_spec(s, rule) for s in spec]
    for group in ("all", "any"):
        if group in spec:
            return {group: _mapped_spec(spec[group], rule)}
    mapping = rule.value_maps.get(spec.get("column")) or {}
    if "value" not in spec or not mapping:
        return spec
    value = spec["value"]
    if isinstance(value, (list, tuple)):
        return {**spec, "value": [_mapped(v, mapping) for v in value]}
    return {**spec, "value": _mapped(value, mapping)}


def _violations(df: DataFrame, row: str, checks: Sequence[tuple]) -> DataFrame:
    """One pass: failing rows first, then the array of their violations, exploded."""
    if not checks:
        empty = F.array().cast(
            "array<struct<position:int,field:string,label:string,condition:string,"
            "value:string,allowed:string>>"
        )
        return df.select(col(row).alias("row_number"), F.inline(empty))
    found = []
    for position, (c, failed, extra) in enumerate(checks):
        entry = F.struct(
            F.lit(position).alias("position"),
            F.lit(c.field).alias("field"),
            F.lit(c.header or c.field).alias("label"),
            *[
                extra.get(name, F.lit("")).alias(name)
                for name in ("condition", "value", "allowed")
            ],
        )
        found.append(F.when(failed, entry))
    failing = df.where(reduce(Column.__or__, [failed for _, failed, _ in checks]))
    return failing.select(
        col(row).alias("row_number"), F.inline(F.array_compact(F.array(*found)))
    )

"""Contradictions inside one source: per row, and per output cell.

Row texts come from small per-key aggregates. Cell candidates are distinct (key,
field, value) rows of contradictory keys only; nothing gathers a whole group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.columns import col, data_columns, rows_differ, values_differ
from recordloom.functions.text import trim_text
from recordloom.operators.match import MATCH, key_names, matchable
from recordloom.rules import ORD

# Wording and the number of candidates a note shows.
ROW_DIFFERS = " 存在内容不同的重复记录"
SEVERAL_VALUES = " 存在多个不同值："
CANDIDATES = " 有多个候选值："
LABEL_MARK = "："
NOTE_LIMIT = 3


def content_conflicts(
    src: DataFrame, match: str, expand_by: Sequence[str], compare_by: Sequence[str], label: str
) -> DataFrame:
    """``(keys, detail)`` for keys whose raw rows differ anywhere."""
    names = data_columns(src)
    keys = key_names(expand_by)
    text = content_text(match, expand_by, compare_by, label)
    if text is None:
        return _last_difference(src, match, expand_by, compare_by, label)
    differing = matchable(src, match, expand_by).groupBy(*keys).agg(rows_differ(names).alias("_differs"))
    return differing.where("_differs").select(*keys, text.alias("detail"))


def content_text(
    match: str, expand_by: Sequence[str], compare_by: Sequence[str], label: str,
    keys: Sequence[Column] = (),
) -> Column | None:
    """Row text from the key columns, or from ``keys`` with their values; None when it needs other fields."""
    known = dict(zip([match, *expand_by], keys or map(F.col, key_names(expand_by))))
    if any(f not in known for f in compare_by):
        return None
    return _content_text(label, {f: known[f] for f in compare_by})


def _content_text(label: str, values: Mapping[str, Column]) -> Column:
    parts = [F.concat(F.lit(f"{name}="), value) for name, value in values.items()]
    return F.concat(F.lit(label + LABEL_MARK), F.concat_ws(", ", *parts), F.lit(ROW_DIFFERS))


def _last_difference(src, match, expand_by, compare_by, label) -> DataFrame:
    """Fields outside the key: taken from the last row that differs from the first.

    Rows are reduced to distinct ones with their first and last place, so a key that
    repeats a few rows shrinks before any shuffle; a key's first row is the distinct
    row with its least place.
    """
    keys = key_names(expand_by)
    cells = [F.coalesce(col(f), F.lit("")).alias(f"c{i}") for i, f in enumerate(data_columns(src))]
    trimmed = [trim_text(col(f)).alias(f"t{i}") for i, f in enumerate(compare_by)]
    rows = matchable(src, match, expand_by).select(*keys, *trimmed, F.struct(*cells).alias("_row"), ORD)
    names = [f"t{i}" for i in range(len(compare_by))]
    distinct = rows.groupBy(*keys, *names, "_row").agg(F.min(ORD).alias("_first"), F.max(ORD).alias("_last"))
    begins = distinct.groupBy(*keys).agg(F.min("_first").alias("_begin"))
    last = (
        distinct.join(begins, keys).where(F.col("_first") != F.col("_begin"))
        .groupBy(*keys).agg(F.max_by(F.struct(*names), F.col("_last")).alias("_cmp"))
    )
    values = {f: F.col("_cmp").getField(n) for f, n in zip(compare_by, names)}
    return last.select(*keys, _content_text(label, values).alias("detail"))


def value_tuples(src: DataFrame, match: str, compare_by: Sequence[str]) -> DataFrame:
    """Distinct trimmed tuples per key; all-blank tuples do not count."""
    trimmed = [trim_text(col(f)).alias(f"v{i}") for i, f in enumerate(compare_by)]
    tuples = matchable(src, match).select(MATCH, *trimmed)
    filled = F.concat(*[F.col(f"v{i}") for i in range(len(compare_by))]) != ""
    return tuples.where(filled).distinct()


def filled(fields: Sequence[str]) -> Column:
    """Whether any of the fields holds text."""
    return F.concat(*[trim_text(col(f)) for f in fields]) != ""


def several_tuples(compare_by: Sequence[str]) -> Column:
    """Aggregate: whether a key has several distinct trimmed tuples that are not all blank."""
    return values_differ([trim_text(col(f)) for f in compare_by], filled(compare_by))


def several_values(fields: Sequence[str], only_filled: Sequence[str] = ()) -> dict[str, Column]:
    """Aggregates ``_several_i``: whether a key has several distinct trimmed values of the i-th field."""
    counted = filled(only_filled) if only_filled else None
    return {f"_several_{i}": values_differ([trim_text(col(f))], counted) for i, f in enumerate(fields)}


def value_conflicts(
    src: DataFrame, match: str, compare_by: Sequence[str], label: str, found: DataFrame | None = None,
) -> DataFrame:
    """``(_match, detail)`` for keys with several distinct tuples.

    ``found`` names these keys when an earlier pass told them (:func:`several_tuples`).
    """
    text = F.concat_ws("+", *[F.col(f"v{i}") for i in range(len(compare_by))])
    head = F.concat(F.lit(f"{label}{LABEL_MARK}{match}="), F.col(MATCH), F.lit(SEVERAL_VALUES))
    tuples = value_tuples(src, match, compare_by)
    if found is None:
        found = tuples.groupBy(MATCH).agg(F.count("*").alias("_several")).where("_several > 1").select(MATCH)
    return (
        tuples.join(found, MATCH, "left_semi").groupBy(MATCH).agg(F.collect_list(text).alias("values"))
        .select(MATCH, F.concat(head, F.array_join(F.sort_array("values"), ", ")).alias("detail"))
    )


def conflict_cells(
    src: DataFrame, match: str, expand_by: Sequence[str],
    field_columns: Mapping[str, Sequence[str]], only_filled: Sequence[str] = (),
    found: DataFrame | None = None,
) -> DataFrame:
    """``(keys, column, value)``: candidates of cells with several distinct values.

    ``field_columns`` maps a source field to the output columns it feeds.
    ``only_filled`` leaves out rows whose listed fields are all blank. A field
    with several values makes its key contradictory, so the keys need no other
    test. Fixed-width aggregates find the fields (:func:`several_values`; ``found`` has
    them when an earlier pass did); only rows of those keys are turned into cells,
    each distinct row once.
    """
    keys = key_names(expand_by)
    names = [f"f{i}" for i in range(len(field_columns))]
    marks = several_values(list(field_columns), only_filled)
    rows = matchable(src, match, expand_by)
    if only_filled:
        rows = rows.where(filled(only_filled))
    if found is None:
        found = rows.groupBy(*keys).agg(*[c.alias(n) for n, c in marks.items()])
    found = found.select(*keys, *marks).where(reduce(Column.__or__, [F.col(n) for n in marks]))
    rows = rows.select(*keys, *[trim_text(col(f)).alias(n) for f, n in zip(field_columns, names)])
    # repeated rows fall together before the shuffle; distinct ones of a key are spread by their values
    hit = rows.distinct().join(found, keys)
    cells = F.array(*[
        F.when(F.col(mark), F.struct(F.lit(i).alias("field"), F.col(n).alias("value")))
        for i, (n, mark) in enumerate(zip(names, marks))
    ])
    distinct = hit.select(*keys, F.inline(cells)).where("field is not null").distinct()
    targets = F.array(*[F.array(*map(F.lit, columns)) for columns in field_columns.values()])
    column = F.explode(F.element_at(targets, F.col("field") + 1)).alias("column")
    spread = distinct.select(*keys, column, "value")
    shared = [c for columns in field_columns.values() for c in columns]
    return spread.distinct() if len(shared) > len(set(shared)) else spread


def cell_notes(
    cells: DataFrame, expand_by: Sequence[str], label: str, limit: int = NOTE_LIMIT
) -> DataFrame:
    """``(keys, notes)``: map from output column to the note text.

    The ranked filter keeps at most ``limit`` candidates per cell on each side of
    the shuffle, and a key holds at most one note per output column.
    """
    keys = key_names(expand_by)
    order = Window.partitionBy(*keys, "column").orderBy("value")
    shown = cells.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= limit)
    note = F.concat(
        F.lit(label + LABEL_MARK),
        F.concat_ws("+", *keys),
        F.lit(CANDIDATES),
        F.array_join(F.sort_array(F.collect_list("value")), ", "),
    )
    return (
        shown.groupBy(*keys, "column")
        .agg(note.alias("note"))
        .groupBy(*keys)
        .agg(F.map_from_entries(F.collect_list(F.struct("column", "note"))).alias("notes"))
    )


def row_conflict_text(details: Sequence[Column]) -> Column:
    """The row's conflict lines, sorted, one per line; ``''`` when there are none."""
    if not details:
        return F.lit("")
    if len(details) == 1:
        return F.coalesce(details[0], F.lit(""))
    return F.concat_ws("\n", F.sort_array(F.array(*details)))


def conflict_list(result: DataFrame, column: str = "row_conflict") -> DataFrame:
    """Distinct conflict lines of a run."""
    lines = F.explode(F.split(F.col(column), "\n")).alias("detail")
    return result.where(F.col(column) != "").select(lines).distinct()

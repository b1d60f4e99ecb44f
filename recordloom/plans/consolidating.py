"""Sources to result rows: match, detect conflicts, project, compare with history."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.columns import col, data_columns, record, require_columns
from recordloom.functions.text import trim_key
from recordloom.operators import conflicts as cf
from recordloom.operators import match as m
from recordloom.operators.changes import apply_changes, latest_records
from recordloom.operators.project import derived_fill, project_rows, resolve_status
from recordloom.operators.validate import SourceNotReady, source_completeness
from recordloom.rules import ORD, ChangeRule, ConsolidationRule, MatchRule
from recordloom.session import staged
from recordloom.sources.tables import keyed_table


def consolidate(
    tables: Mapping[str, DataFrame], rule: ConsolidationRule, run_date: dt.date,
    notes: bool = True,
) -> DataFrame:
    """Result rows before comparison with history.

    Columns: ``result_key``, ``status``, the base key, the output columns,
    ``is_missing``, ``row_conflict``, ``conflict_notes`` (with ``notes``), and the
    row order (base position, expansion position).

    Plan: the base and every other source are reduced to one record per key and
    joined on the base key, one exchange each; the expansion comes last, so the
    wide rows are built once, after every narrow join, and the records of a
    crowded key are spread over many tasks.
    """
    absent = [s.name for s in rule.sources if s.name not in tables]
    if absent:
        raise SourceNotReady(f"missing source tables: {', '.join(absent)}")
    base = tables[rule.base_source]
    source_completeness(base.sparkSession, {s.name: tables[s.name] for s in rule.sources})
    names = {s.name: i for i, s in enumerate(rule.sources)}
    base_rule = next(s for s in rule.sources if s.name == rule.base_source)
    expansion = rule.expansion
    rows = _base_rows(tables[base_rule.name], base_rule, rule, names[base_rule.name])
    details: list[Column] = []
    note_columns: list[Column] = []
    merged: dict[str, Column] = {}
    for source in rule.sources:
        if source is base_rule or source is expansion:
            continue
        keyed = _one_per_key(tables[source.name], source, rule, names[source.name], notes)
        rows = m.attach(rows, "__key", keyed)
        i = names[source.name]
        if f"__detail_{i}" in keyed.columns:
            details.append(F.col(f"__detail_{i}"))
        if f"__notes_{i}" in keyed.columns:
            note_columns.append(F.col(f"__notes_{i}"))
        if f"__merged_{i}" in keyed.columns:
            for j, c in enumerate(_merged_columns(source, rule)):
                merged[c.name] = F.col(f"__merged_{i}").getField(f"m{j}")
    if expansion is not None:
        i = names[expansion.name]
        records = _expansion(tables[expansion.name], expansion, rule, i, notes)
        rows = m.expand_one_to_many(
            rows, "__key", tables[expansion.name], _match_field(expansion), expansion.expand_by,
            f"__src_{i}", expansion.no_match, records,
        )
        if f"__detail_{i}" in records.columns:
            details.append(F.col(f"__detail_{i}"))
        if f"__differs_{i}" in records.columns:
            details.append(_content_detail(expansion, i))
        if f"__notes_{i}" in records.columns:
            note_columns.append(F.col(f"__notes_{i}"))
    sources = {name: F.col(f"__src_{i}") for name, i in names.items()}
    kept = [
        F.col("__key"),
        F.col(ORD).alias("__ord"),
        _key(rule, tables, names).alias("__result_key"),
    ]
    if notes:
        kept.append(_all_notes(note_columns).alias("__notes"))
    projected = project_rows(
        rows, rule, run_date, sources, merged, kept, cf.row_conflict_text(details)
    )
    return projected.select(
        F.col("__result_key").alias("result_key"),
        resolve_status(F.col("row_conflict"), F.col("is_missing")).alias("status"),
        F.col("__key").alias(rule.base_key),
        *[col(c) for c in rule.names if c != rule.base_key],
        "is_missing",
        "row_conflict",
        *([F.col("__notes").alias("conflict_notes")] if notes else []),
        F.col("__ord").alias(ORD),
    )


def consolidate_with_history(
    tables: Mapping[str, DataFrame], rule: ConsolidationRule, run_date: dt.date,
    changes: ChangeRule, log: DataFrame, force: bool = False, notes: bool = True,
    time_column: str = "log_time",
) -> DataFrame:
    """Result rows after comparison with the newest log record of each identity.

    The rows are stored before they are compared, so that the shuffles of the consolidation
    are gone when those of the comparison come.
    """
    result = staged(consolidate(tables, rule, run_date, notes), "result")
    latest = latest_records(log, changes.identity, time_column)
    compared = apply_changes(result, latest, changes, rule.base_key, force)
    return derived_fill(compared, rule)


def staged_columns(rule: ConsolidationRule) -> list[str]:
    """The stored result layout: status, base key, output columns."""
    return ["status", rule.base_key, *[c for c in rule.names if c != rule.base_key]]


def _match_field(source: MatchRule) -> str:
    return source.match


def _fields(source: MatchRule, rule: ConsolidationRule) -> list[str]:
    """The fields of a source the result really reads."""
    used = [f for c in rule.columns if c.source == source.name for f in c.fields]
    used += [f for c in source.columns if c.required_when is not None for f in _condition_fields(c.required_when)]
    if source is rule.expansion:
        used += list(source.expand_by)
        used += list(rule.result_identity)
    return list(dict.fromkeys(used))


def _condition_fields(spec) -> list[str]:
    if isinstance(spec, (list, tuple)):
        return [f for s in spec for f in _condition_fields(s)]
    for group in ("all", "any"):
        if group in spec:
            return _condition_fields(spec[group])
    return [spec["column"]]


def _known(df: DataFrame, fields: list[str], source: MatchRule, rule: ConsolidationRule) -> list[str]:
    """Drop identity fields the expansion table does not have; anything else must exist."""
    optional = set(rule.result_identity)
    require_columns(df, [f for f in fields if f not in optional], source.name)
    return [f for f in fields if f in df.columns]


def _base_rows(df: DataFrame, source: MatchRule, rule: ConsolidationRule, i: int) -> DataFrame:
    fields = _known(df, _fields(source, rule), source, rule)
    needed = list(dict.fromkeys([source.match, *fields]))
    keyed = keyed_table(df.select(*[col(f) for f in needed], F.col(ORD)), source.match)
    struct = record(fields) if fields else F.struct(F.lit(True).alias("_known"))
    return keyed.select(col(source.match).alias("__key"), struct.alias(f"__src_{i}"), F.col(ORD))


def _one_per_key(
    df: DataFrame, source: MatchRule, rule: ConsolidationRule, i: int, notes: bool
) -> DataFrame:
    """``(_match, __src_i, …)`` with conflict text, notes and merged cells where declared."""
    fields = _known(df, _fields(source, rule), source, rule) or [source.match]
    if source.cardinality == "one_to_one":
        needed = list(dict.fromkeys([source.match, *fields]))
        keyed = keyed_table(df.select(*[col(f) for f in needed], F.col(ORD)), source.match)
        return keyed.select(col(source.match).alias(m.MATCH), record(fields).alias(f"__src_{i}"))
    name = f"__src_{i}"
    if source.merge is not None and (columns := _merged_columns(source, rule)):
        cells = {f"m{j}": (c.fields, c.separator, c.record_separator) for j, c in enumerate(columns)}
        read = sorted({f for c in columns for f in c.fields})
        own = _own_fields(source, rule, columns)
        long = m.collect_many_to_one(df, source.match, list(dict.fromkeys([*read, *own])))
        joined = m.join_records(long, cells, source.merge, rule.empty_words, own, source.selected)
        known = F.col("_record") if own else F.struct(F.lit(True).alias("_known"))
        # the fields that only merged cells read are not needed beside them
        blank = [F.lit("").alias(f) for f in fields if f not in own]
        whole = F.struct(*[known.getField(f).alias(f) for f in own], *blank)
        return joined.select(m.MATCH, whole.alias(name), F.struct(*cells).alias(f"__merged_{i}"))
    if source.merge is not None or not (source.conflicts and source.compare_by):
        return m.pick_per_key(df, source.match, name, source.selected, fields)
    targets = _field_columns(source, rule, source.compare_by) if notes else {}
    marks = {"_differs": cf.several_tuples(source.compare_by), **cf.several_values(list(targets), source.compare_by)}
    keyed = staged(m.pick_per_key(df, source.match, name, source.selected, fields, marks), "keyed")
    differing = keyed.where("_differs")
    found = cf.value_conflicts(df, source.match, source.compare_by, source.title, differing.select(m.MATCH))
    out = keyed.drop(*marks).join(found.withColumnRenamed("detail", f"__detail_{i}"), m.MATCH, "left")
    if targets:
        cells = cf.conflict_cells(df, source.match, (), targets, source.compare_by, differing)
        noted = cf.cell_notes(cells, (), source.title)
        out = out.join(noted.withColumnRenamed("notes", f"__notes_{i}"), m.MATCH, "left")
    return out


def _expansion(
    df: DataFrame, source: MatchRule, rule: ConsolidationRule, i: int, notes: bool
) -> DataFrame:
    """Records per (match, expansion) key with notes, and conflict text or whether there is one.

    One pass over the source is stored; the join, the sizes of keys, the contradictions
    and the fields that contradict are all read from it. Only the candidates of notes
    need the source's rows again. A text that the key alone gives is made after the join
    (:func:`_content_detail`), so that it is not shuffled.
    """
    fields = _known(df, _fields(source, rule), source, rule)
    keys = m.key_names(source.expand_by)
    targets = _field_columns(source, rule, data_columns(df)) if source.conflicts and notes else {}
    marks = cf.several_values(list(targets))
    records = staged(m.expansion_records(
        df, source.match, source.expand_by, f"__src_{i}", fields, source.conflicts, marks), "expansion")
    if not source.conflicts:
        return records
    out = records.drop("_differs", *marks)
    text = cf.content_text(source.match, source.expand_by, source.compare_by, source.title)
    if text is None:
        found = cf.content_conflicts(
            df, source.match, source.expand_by, source.compare_by, source.title
        )
        out = out.join(found.withColumnRenamed("detail", f"__detail_{i}"), keys, "left")
    else:
        out = records.withColumnRenamed("_differs", f"__differs_{i}").drop(*marks)
    if targets:
        cells = cf.conflict_cells(df, source.match, source.expand_by, targets, found=records)
        noted = cf.cell_notes(cells, source.expand_by, source.title)
        out = out.join(noted.withColumnRenamed("notes", f"__notes_{i}"), keys, "left")
    return out


def _content_detail(source: MatchRule, i: int) -> Column:
    """Conflict text of an expanded row, from the base key that its record met and the record's own cells."""
    record = F.col(f"__src_{i}")
    keys = [F.col("__key"), *[trim_key(record.getField(f)) for f in source.expand_by]]
    text = cf.content_text(source.match, source.expand_by, source.compare_by, source.title, keys)
    return F.when(F.col(f"__differs_{i}"), text)


def _own_fields(source: MatchRule, rule: ConsolidationRule, merged) -> list[str]:
    """The fields of a merged source that are read from the picked record itself."""
    others = [f for c in rule.columns if c.source == source.name and c not in merged for f in c.fields]
    others += [f for c in source.columns if c.required_when is not None for f in _condition_fields(c.required_when)]
    return list(dict.fromkeys(others))


def _merged_columns(source: MatchRule, rule: ConsolidationRule):
    return [
        c for c in rule.columns
        if source.merge is not None and c.source == source.name and c.record_separator
        and not (c.derived and not c.source)
        and c.presence not in ("", "optional", "user_defined")
    ]


def _field_columns(source: MatchRule, rule: ConsolidationRule, fields) -> dict[str, list[str]]:
    """Source field to the output columns it feeds, in output order."""
    targets: dict[str, list[str]] = {}
    for c in rule.columns:
        if c.source != source.name:
            continue
        for f in c.fields:
            if f in fields and c.name not in targets.setdefault(f, []):
                targets[f].append(c.name)
    return targets


def _key(rule: ConsolidationRule, tables: Mapping[str, DataFrame], names: Mapping[str, int]) -> Column:
    expansion = rule.expansion
    parts = []
    for field in rule.result_identity:
        own = F.col("__key") if field == rule.base_key else F.lit("")
        if expansion is not None and field in tables[expansion.name].columns:
            found = F.col(f"__src_{names[expansion.name]}")
            own = F.when(found.isNotNull(), found.getField(field)).otherwise(own)
        parts.append(own)
    return m.result_key(parts, rule.separator, rule.row_placeholder)


def _all_notes(columns: list[Column]) -> Column:
    empty = F.create_map().cast("map<string,string>")
    filled = [F.coalesce(c, empty) for c in columns]
    return reduce(lambda a, b: F.map_concat(a, b), filled) if filled else empty

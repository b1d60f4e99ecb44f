"""Lookups on the base key.

Every source is reduced to one record per key (or per key and expansion key)
before it meets the base, so lookups never multiply a crowded key; the expansion,
where one base key may meet very many records, is cut into parts by key size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.columns import col, data_columns, record, rows_differ, values_differ
from recordloom.functions.text import is_empty, trim_key, trim_text
from recordloom.operators.skew import PART, PARTS, SIZE, cut, repeat
from recordloom.rules import ORD, MergeRecords, NoMatch
from recordloom.session import staged
from recordloom.sources.tables import keyed_table

MATCH = "_match"


class NoExpansionError(ValueError):
    """A base key has no expansion record and the source forbids that."""


def match_keys(match: str, expand_by: Sequence[str] = ()) -> list[Column]:
    """Trimmed key columns ``_match``, ``_expand_0``, ``_expand_1``, …"""
    keys = [trim_key(col(match)).alias(MATCH)]
    keys += [trim_key(col(f)).alias(f"_expand_{i}") for i, f in enumerate(expand_by)]
    return keys


def key_names(expand_by: Sequence[str] = ()) -> list[str]:
    return [MATCH] + [f"_expand_{i}" for i in range(len(expand_by))]


def matchable(src: DataFrame, match: str, expand_by: Sequence[str] = ()) -> DataFrame:
    """Rows whose key parts are all non-blank, with the trimmed key columns in front."""
    keyed = src.select(*match_keys(match, expand_by), *[col(c) for c in src.columns])
    for name in key_names(expand_by):
        keyed = keyed.where(F.col(name) != "")
    return keyed


def lookup_one_to_one(
    base: DataFrame, base_key: str, src: DataFrame, key: str, name: str,
    fields: Sequence[str] | None = None,
) -> DataFrame:
    """Raw-key lookup, last row wins; struct column ``name`` is null when unmatched."""
    fields = list(fields if fields is not None else data_columns(src))
    needed = list(dict.fromkeys([key, *fields]))
    narrow = src.select(*[col(f) for f in needed], F.col(ORD))
    keyed = keyed_table(narrow, key).select(col(key).alias(MATCH), record(fields).alias(name))
    return attach(base, base_key, keyed)


def lookup_many_to_one(
    base: DataFrame, base_key: str, src: DataFrame, key: str, name: str,
    pick: str = "first", fields: Sequence[str] | None = None,
) -> DataFrame:
    """Trimmed-key lookup of the first or last record of each key."""
    return attach(base, base_key, pick_per_key(src, key, name, pick, fields))


def pick_per_key(
    src: DataFrame, key: str, name: str, pick: str = "first",
    fields: Sequence[str] | None = None, several: Mapping[str, Column] | None = None,
) -> DataFrame:
    """``(_match, name)``: one record per trimmed key, and the aggregates ``several`` of the same pass."""
    fields = list(fields if fields is not None else data_columns(src))
    several = several or {}
    chosen = F.max if pick == "last" else F.min
    placed = F.struct(F.col(ORD).alias("at"), record(fields).alias("row"))
    grouped = matchable(src, key).groupBy(MATCH).agg(
        chosen(placed).alias("_row"), *[c.alias(n) for n, c in several.items()])
    return grouped.select(MATCH, F.col("_row.row").alias(name), *several)


def attach(base: DataFrame, base_key: str, keyed: DataFrame) -> DataFrame:
    """Left join of a frame that holds each ``_match`` once."""
    return base.join(keyed, col(base_key) == keyed[MATCH], "left").drop(MATCH)


def expansion_records(
    src: DataFrame, match: str, expand_by: Sequence[str], name: str,
    fields: Sequence[str] | None = None, conflicts: bool = False,
    several: Mapping[str, Column] | None = None,
) -> DataFrame:
    """First record and first position per (match, expansion) key.

    With ``conflicts`` the same aggregate tells whether raw rows of a key differ;
    ``several`` names more aggregates to carry. Store the result when it is read more
    than once: sizes, join and conflicts then need no other pass over the source.
    """
    names = data_columns(src)
    fields = list(fields if fields is not None else names)
    keys = key_names(expand_by)
    more = dict(several or {})
    if conflicts:
        more["_differs"] = rows_differ(names)
    head = F.min(F.struct(F.col(ORD).alias("at"), record(fields).alias("row"))).alias("_head")
    grouped = matchable(src, match, expand_by).groupBy(*keys).agg(head, *[c.alias(n) for n, c in more.items()])
    return grouped.select(*keys, F.col("_head.row").alias(name), F.col("_head.at").alias("_first"), *more)


def expand_one_to_many(
    base: DataFrame, base_key: str, src: DataFrame, match: str, expand_by: Sequence[str],
    name: str, no_match: NoMatch | None = None, records: DataFrame | None = None,
) -> DataFrame:
    """One row per expansion key of each base row, in first-appearance order.

    Base keys without a record follow ``no_match``: ``skip`` drops them,
    ``error`` raises, anything else leaves one row with a null record. The row
    order becomes (base order, expansion order).

    The source is read once: its records are stored, and their number per key tells
    unmatched base keys and crowded ones; the wide join then runs on (key, part), so the
    records of one crowded key are spread over many tasks. ``records`` is the stored
    result of :func:`expansion_records` and may carry more columns.
    """
    clash = {PART, PARTS, SIZE, "_first", *key_names(expand_by)} & set(base.columns)
    if clash:
        raise ValueError(f"the base has reserved columns: {', '.join(sorted(clash))}")
    if records is None:
        records = staged(expansion_records(src, match, expand_by, name), "expansion")
    action = no_match.action if no_match else "emit_incomplete"
    keys = key_names(expand_by)
    sizes = records.groupBy(MATCH).agg(F.count("*").alias(SIZE))
    sized = base.join(
        sizes, col(base_key) == sizes[MATCH], "inner" if action == "skip" else "left"
    ).drop(MATCH)
    if action == "error":
        found = sized.where(F.col(SIZE).isNull()).select(col(base_key)).limit(1).collect()
        if found:
            raise NoExpansionError(f"No expansion record found for {found[0][0]}")
    total = sizes.agg(F.sum(SIZE)).scalar()
    copies = repeat(sized, total)
    parts = cut(records, sizes, [MATCH], [F.col(k) for k in keys[1:]], total)
    kept = [F.col(c) for c in records.columns if c not in (*keys, "_first")]
    on = (col(base_key) == parts[MATCH]) & (copies[PART] == parts[PART])
    joined = copies.join(parts, on, "inner" if action == "skip" else "left")
    # by the key, so that the position travels only where the row order is used
    real = joined.where(F.col(MATCH).isNotNull() | F.col(SIZE).isNull())
    order = F.struct(F.col(ORD).alias("base"), F.col("_first").alias("expansion"))
    return real.select(*[col(c) for c in data_columns(base)], *kept, order.alias(ORD))


def collect_many_to_one(
    src: DataFrame, key: str, fields: Sequence[str], deduplicate: bool = False
) -> DataFrame:
    """All records of each trimmed key, long form ``(_match, fields…, _ord)``.

    The records stay rows; only the cell they end in is ever gathered.
    """
    rows = matchable(src, key)
    if not deduplicate:
        return rows.select(MATCH, *[col(f) for f in fields], ORD)
    grouped = rows.groupBy(MATCH, *[col(c) for c in data_columns(src)]).agg(F.min(ORD).alias(ORD))
    return grouped.select(MATCH, *[col(f) for f in fields], ORD)


def join_records(
    rows: DataFrame, cells: dict[str, tuple[Sequence[str], str, str]],
    merge: MergeRecords, empty_words: Sequence[str] = (),
    fields: Sequence[str] = (), pick: str = "first",
) -> DataFrame:
    """``(_match, one text per cell)`` from long-form records.

    ``cells`` maps an output name to (fields, separator, record separator). Equal
    items are reduced by a partial aggregate first, so what is gathered per key
    is the content of the cell and nothing more. With ``fields`` the same pass adds
    ``_record``, these fields of the key's first or last record.
    """
    kinds = [F.struct(F.lit(i).alias("cell"), concatenate([col(f) for f in names], sep, empty_words).alias("item"))
             for i, (names, sep, _) in enumerate(cells.values())]
    chosen = F.max if pick == "last" else F.min
    whole, one, best = [], [], []
    if fields:
        # the record travels as one more cell, of which a partial aggregate keeps one row
        kinds.append(F.struct(F.lit(len(cells)).alias("cell"), F.lit("").alias("item")))
        whole = [F.when(F.col("cell") == len(cells), F.struct(ORD, record(fields).alias("row"))).alias("_placed")]
        one, best = [chosen("_placed").alias("_placed")], [chosen("_placed")["row"].alias("_record")]
    spread = rows.select(MATCH, ORD, *[col(f) for f in fields], F.inline(F.array(*kinds)))
    distinct = (
        spread.select(MATCH, ORD, "cell", "item", *whole)
        .groupBy(MATCH, "cell", "item")
        .agg(F.min(ORD).alias("first"), *one)
    )
    place = F.struct("item") if merge.order == "sorted" else F.struct("first", "item")
    outputs = []
    for i, (name, (_, _, record_separator)) in enumerate(cells.items()):
        wanted = (F.col("cell") == i) & (F.col("item") != "")
        gathered = F.sort_array(F.collect_list(F.when(wanted, place)))
        outputs.append(F.array_join(gathered["item"], record_separator).alias(name))
    return distinct.groupBy(MATCH).agg(*outputs, *best)


def concatenate(cells: Sequence[Column], separator: str, empty_words: Sequence[str] = ()) -> Column:
    """Trimmed non-empty parts joined by the separator."""
    parts = [F.when(~is_empty(c, empty_words), trim_text(c)) for c in cells]
    return F.concat_ws(separator, *parts)


def first_not_null(cells: Sequence[Column], empty_words: Sequence[str] = ()) -> Column:
    """The first non-empty cell; ``''`` when there is none."""
    return F.coalesce(*[F.when(~is_empty(c, empty_words), c) for c in cells], F.lit(""))


def result_key(parts: Sequence[Column], separator: str, placeholder: str) -> Column:
    """Trimmed identity parts joined; a blank part reads as the placeholder."""
    return F.concat_ws(
        separator,
        *[F.coalesce(F.nullif(trim_text(p), F.lit("")), F.lit(placeholder)) for p in parts],
    )

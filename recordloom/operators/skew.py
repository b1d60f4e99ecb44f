"""Spreading the rows of crowded keys over several tasks.

A key is crowded when it holds more than one thousandth of all rows. There can be
at most a thousand such keys whatever the size of the data, so their table is
small by construction and may be broadcast. A crowded key gets one part for each
thousandth it holds; its many rows are cut by a hash of the row, and the one row
that meets them on the other side is repeated once per part. Where the rows of a key
are numbered, they are cut by their order instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.columns import col
from recordloom.session import staged

SHARES = 1000
PART, PARTS, SIZE = "_part", "_parts", "_size"


def crowded(sizes: DataFrame, keys: Sequence[str], total: Column) -> DataFrame:
    """``(keys, _parts)`` of the crowded keys in ``sizes`` (``keys`` and ``_size``).

    ``total`` is the number of all rows, usually a scalar subquery.
    """
    return sizes.select(*keys, _parts(total).alias(PARTS)).where(F.col(PARTS) > 1)


def cut(
    rows: DataFrame, sizes: DataFrame, keys: Sequence[str], by: Sequence[Column], total: Column
) -> DataFrame:
    """Adds the part of every row: 0 unless its key is crowded."""
    few = F.broadcast(crowded(sizes, keys, total))
    part = F.coalesce(F.pmod(F.xxhash64(*by), F.col(PARTS)), F.lit(0).cast("long"))
    marked = rows.join(few, list(keys), "left")
    return marked.select(*[f"`{c}`" for c in rows.columns], part.alias(PART))


def repeat(sized: DataFrame, total: Column) -> DataFrame:
    """One copy per part of rows that carry their key's ``_size`` (null counts as 0)."""
    parts = F.coalesce(_parts(total), F.lit(1).cast("long"))
    numbers = F.sequence(F.lit(0).cast("long"), parts - 1)
    return sized.select("*", F.explode(numbers).alias(PART))


def _parts(total: Column) -> Column:
    """Thousandths held by a key of that ``_size``, at least one."""
    return F.greatest(F.ceil(F.col(SIZE) * SHARES / total), F.lit(1).cast("long"))


def numbered_within(rows: DataFrame, key: str, order: Sequence[str], name: str) -> DataFrame:
    """Adds ``name``: the number of a row among those of its key, from 1, along ``order``.

    One range exchange by key and order cuts a crowded key into as many ranges as it fills,
    and each range numbers its own rows. A key that goes on from an earlier range starts
    after its rows there; a range has at most one such key, so their table is small.
    Rows of a key that are equal in ``order`` take their numbers in any turn.
    """
    ranged = rows.repartitionByRange(col(key), *map(col, order)).withColumn("_range", F.spark_partition_id())
    ranged = staged(ranged, "ranged")
    held = ranged.groupBy(col(key).alias("_key"), F.col("_range").alias("_in")).agg(F.count("*").alias("_held"))
    before = Window.partitionBy("_key").orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select("_key", "_in", F.sum("_held").over(before).alias("_start")).where(F.col("_start") > 0)
    turn = F.row_number().over(Window.partitionBy("_range", col(key)).orderBy(*map(col, order)))
    numbered = ranged.withColumn("_turn", turn)
    met = numbered.join(starts, col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_in")), "left")
    place = F.col("_turn") + F.coalesce("_start", F.lit(0).cast("long"))
    return met.select(*[col(c) for c in rows.columns], place.alias(name))

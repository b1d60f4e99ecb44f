"""Small column helpers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.rules import ORD


def col(name: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def data_columns(df: DataFrame) -> list[str]:
    """All columns but the row-order column."""
    return [name for name in df.columns if name != ORD]


def record(names: Iterable[str]) -> Column:
    """The named columns as one struct."""
    return F.struct(*[col(name).alias(name) for name in names])


def rows_differ(names: Iterable[str]) -> Column:
    """Aggregate: whether the rows of a group differ anywhere.

    Two independently seeded 64-bit row hashes, compared by minimum and maximum:
    four fixed-width buffers, so the aggregate hashes in place and the shuffle
    carries no second copy of the row. Null reads as blank, as everywhere in text
    tables. The test is by hash: rows that differ could agree with a chance of 2**-128.
    """
    return values_differ([col(name) for name in names])


def values_differ(values: Iterable[Column], counted: Column | None = None) -> Column:
    """As :func:`rows_differ`, of any columns; rows for which ``counted`` is false do not count."""
    cells = [F.coalesce(v.cast("string"), F.lit("")) for v in values]
    first = F.xxhash64(*cells)
    second = F.xxhash64(F.lit("second"), *cells)
    if counted is not None:
        first, second = F.when(counted, first), F.when(counted, second)
        return F.coalesce((F.min(first) != F.max(first)) | (F.min(second) != F.max(second)), F.lit(False))
    return (F.min(first) != F.max(first)) | (F.min(second) != F.max(second))


def require_columns(df: DataFrame, names: Iterable[str], what: str) -> None:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing columns {', '.join(missing)}")

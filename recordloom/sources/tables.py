"""All-text tables with an explicit row order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.columns import col, data_columns
from recordloom.rules import ORD
from recordloom.session import shuffles_freed

_LAST_START = 2**62


def as_text(
    df: DataFrame,
    order_by: Sequence[str] = (),
    decimals: int | None = None,
    timestamp_format: str | None = None,
) -> DataFrame:
    """Every column as a string, null as ``''``.

    The text is exact: all digits of a number, the fraction of a timestamp.
    ``decimals`` rounds floating numbers to a fixed number of places instead,
    ``timestamp_format`` writes timestamps in a narrower format.

    ``order_by`` names the columns that give the rows a total order; they are
    kept, still typed, in the row-order column (one column as itself, several as
    a struct).
    """
    cells = [
        F.coalesce(_text(f, decimals, timestamp_format), F.lit("")).alias(f.name)
        for f in df.schema.fields
        if f.name != ORD
    ]
    if len(order_by) == 1:
        cells.append(col(order_by[0]).alias(ORD))
    elif order_by:
        cells.append(F.struct(*[col(name) for name in order_by]).alias(ORD))
    elif ORD in df.columns:
        cells.append(F.col(ORD))
    return df.select(*cells)


def _text(f: T.StructField, decimals: int | None, timestamp_format: str | None) -> Column:
    c = col(f.name)
    if decimals is not None and isinstance(f.dataType, (T.DoubleType, T.FloatType)):
        # beyond the decimal type's width a number has no fraction to round
        return F.coalesce(c.try_cast(T.DecimalType(36, decimals)).cast("string"), c.cast("string"))
    if timestamp_format is not None and isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, timestamp_format)
    return c.cast("string")


def stamp_order(df: DataFrame, start: int = 0) -> DataFrame:
    """Replace the row order by one growing number for storage.

    One range shuffle by the old order; ids then grow along it. ``start`` puts a
    later batch after everything stored. The numbers have gaps, so a table takes
    thousands of very large batches before it would have to be numbered again.
    """
    if start > _LAST_START:
        raise OverflowError("row numbers are used up: stamp the whole table again")
    return stamp_order_by(df, [ORD], start)


def stamp_order_by(df: DataFrame, order_by: Sequence[str], start: int = 0) -> DataFrame:
    """As :func:`stamp_order`, along columns of the rows: a typed table is numbered before it is made text."""
    at = F.lit(start).cast("long") + F.monotonically_increasing_id()
    return df.orderBy(*map(col, order_by)).withColumn(ORD, at)


def stamp_lines(df: DataFrame, start: int = 0) -> DataFrame:
    """Replace a row order (file, line) by one growing number, without a sort or a range exchange.

    A file's numbers begin after the lines of the files before it, in the order of their
    names: a table of one row per file tells where. ``df`` is read twice, of its order only
    the first time; store it first. Numbers follow the lines, so they have gaps where lines
    were left out. ``start`` puts a later batch after everything stored.
    """
    place = F.struct(F.col(f"{ORD}.file").alias("_file"), F.col(f"{ORD}.line").alias("_line"))
    files = df.select(place.alias("_at")).groupBy(F.col("_at._file").alias("_file")).agg(F.max("_at._line").alias("_lines"))
    return _shifted(df.withColumn("_file", F.col(f"{ORD}.file")), files, F.col(f"{ORD}.line"), start)


def numbered(spark: SparkSession, path: str, start: int = 0) -> DataFrame:
    """A stored Parquet table with the position of each row as its row order, from ``start`` without gaps.

    Positions go through the files in the order of their names and through each file in its
    own: two phases, the rows of each file and the running starts, and no sort of rows.
    """
    rows = spark.read.parquet(path)
    placed = rows.select(
        *[col(c) for c in data_columns(rows)], F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.row_index").alias(ORD))
    files = rows.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    files = files.groupBy("_file").agg((F.max("_at") + 1).alias("_lines"))
    return _shifted(placed, files, F.col(ORD), start)


def _shifted(rows: DataFrame, files: DataFrame, within: Column, start: int) -> DataFrame:
    """``rows`` with ``_file`` numbered by file and place within it; one row per file in one small window."""
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("_file", (F.coalesce(F.sum("_lines").over(before), F.lit(0)) + start).alias("_start"))
    met = rows.join(starts, "_file")
    return met.select(*[col(c) for c in data_columns(rows) if c != "_file"], (F.col("_start") + within).alias(ORD))


def next_start(stored: DataFrame) -> int:
    """The number that follows everything stored (one small aggregate)."""
    newest = stored.agg(F.max(ORD)).first()[0]
    return 0 if newest is None else newest + 1


def write_table(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Rebuild the table with exactly these columns; no rows still leaves a schema."""
    kept = list(columns) + ([ORD] if ORD in df.columns else [])
    with shuffles_freed(df.sparkSession):
        df.select(*[col(name) for name in kept]).write.mode("overwrite").parquet(path)


def append_rows(existing: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of both, no de-duplication; a column missing on one side is ``''``."""
    both = existing.unionByName(new, allowMissingColumns=True)
    return both.fillna("", subset=data_columns(both))


def keyed_table(df: DataFrame, key: str | None = None) -> DataFrame:
    """One row per raw key: the last row's values at the first row's position.

    A partial aggregate per key, so a repeated key shrinks before the shuffle.
    Without a key every row keeps its own position.
    """
    if key is None:
        return df
    others = [name for name in data_columns(df) if name != key]
    placed = F.struct(F.col(ORD), *[col(name) for name in others])
    grouped = df.groupBy(col(key)).agg(F.max(placed).alias("_last"), F.min(ORD).alias("_first"))
    values = {name: F.col("_last").getField(name) for name in others}
    values[key] = col(key)
    return grouped.select(
        *[values[name].alias(name) for name in data_columns(df)], F.col("_first").alias(ORD)
    )

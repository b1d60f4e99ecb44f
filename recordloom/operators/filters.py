"""Row filters and column projections."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.columns import col, require_columns
from recordloom.functions.text import WHITESPACE, parse_date, trim_text
from recordloom.rules import ORD, READY


def expired(field: str, today: dt.date) -> Column:
    """True for a parsable date before ``today``; today and anything unparsable stay."""
    return F.coalesce(parse_date(col(field)) < F.lit(today), F.lit(False))


def drop_expired(df: DataFrame, field: str, today: dt.date) -> DataFrame:
    return df.where(~expired(field, today))


def expiry_counts(df: DataFrame, field: str, today: dt.date) -> DataFrame:
    """One row: how many rows stay and how many are dropped."""
    gone = expired(field, today)
    return df.agg(
        F.count(F.when(~gone, 1)).alias("kept"), F.count(F.when(gone, 1)).alias("dropped")
    )


def keyword_filter(df: DataFrame, columns: Sequence[str], query: str) -> DataFrame:
    """Rows where any column contains the query, in any case; an empty query keeps all."""
    wanted = query.lower().strip(WHITESPACE)
    if not wanted:
        return df
    hits = [F.lower(F.coalesce(col(c), F.lit(""))).contains(wanted) for c in columns]
    return df.where(reduce(Column.__or__, hits))


def time_range(df: DataFrame, column: str, start: str = "", end: str = "") -> DataFrame:
    """Inclusive text comparison; an empty bound is open. Reaches the scan as is."""
    if start:
        df = df.where(col(column) >= start)
    if end:
        keep = col(column) <= end
        df = df.where(keep if start else keep | col(column).isNull())
    return df


def by_key(df: DataFrame, column: str, code: str) -> DataFrame:
    """Rows of one exact key."""
    return df.where(col(column) == code)


def status_filter(df: DataFrame, status: str = READY) -> DataFrame:
    return df.where(F.col("status") == status)


def identity_projection(log: DataFrame, identity: Sequence[str]) -> DataFrame:
    require_columns(log, identity, "identity")
    return log.select(*[col(name) for name in identity])


def complete_columns(log: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The configured columns in order, trimmed; absent or null reads as ``''``."""
    cells = [
        (trim_text(col(name)) if name in log.columns else F.lit("")).alias(name)
        for name in columns
    ]
    return log.select(*cells, *([F.col(ORD)] if ORD in log.columns else []))

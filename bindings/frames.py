"""The driver's tables as all-text staging tables, and the same tables in SQL.

Some cells are made untidy by a fixed rule on the id (padding, blanks, NA), so
that trimming, blank handling and unmatched keys really occur. Every row of every
table is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions.text import WHITESPACE
from recordloom.rules import ORD
from recordloom.session import staged
from recordloom.sources.tables import as_text, stamp_order_by

WIDE_SPACE = "　"
INVISIBLE = "​﻿"
HARD_SPACE = " \t"

LINE_ORDER = [
    "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice",
    "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
]


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def orders_text(spark: SparkSession, sf: str) -> DataFrame:
    return as_text(load(spark, sf, "orders"), ["o_orderkey"], decimals=2)


def customer_text(spark: SparkSession, sf: str) -> DataFrame:
    return as_text(load(spark, sf, "customer"), ["c_custkey"], decimals=2)


def events_text(spark: SparkSession, sf: str) -> DataFrame:
    return as_text(load(spark, sf, "events"), ["event_id"])


def lineitem_text(spark: SparkSession, sf: str) -> DataFrame:
    return as_text(load(spark, sf, "lineitem"), LINE_ORDER, decimals=2)


def lines_numbered(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of :func:`lineitem_text` in the same order, which is one stored number.

    The typed rows are sorted and numbered once. A step that shuffles lines then carries
    a ``long`` for their order, not all their columns a second time.
    """
    return as_text(staged(stamp_order_by(load(spark, sf, "lineitem"), LINE_ORDER), "lines"), decimals=2)


def base_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with some keys padded: a padded base key finds no trimmed match."""
    df = orders_text(spark, sf)
    padded = F.when(F.col(ORD) % 13 == 0, F.concat(F.lit(" "), F.col("o_orderkey")))
    return df.withColumn("o_orderkey", F.coalesce(padded, F.col("o_orderkey")))


def order_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with some keys padded and a zero tax left blank."""
    return untidy_lines(lineitem_text(spark, sf), F.col(ORD)["l_partkey"])


def order_lines_numbered(spark: SparkSession, sf: str) -> DataFrame:
    """As :func:`order_lines`, on :func:`lines_numbered`."""
    return untidy_lines(lines_numbered(spark, sf), F.col("l_partkey").try_cast("long"))


def untidy_lines(df: DataFrame, part: Column) -> DataFrame:
    key = F.concat(F.lit(" "), F.col("l_orderkey"), F.lit(WIDE_SPACE))
    return df.withColumns({
        "l_orderkey": F.when(part % 11 == 0, key).otherwise(F.col("l_orderkey")),
        "l_tax": F.when(F.col("l_tax") == "0.00", "").otherwise(F.col("l_tax")),
    })


def untidy_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts with one untidy text cell ``v`` of eight kinds."""
    kind = F.col("p_partkey") % 8
    size = F.col("p_size").cast("string")
    v: Column = (
        F.when(kind == 0, F.col("p_name"))
        .when(kind == 1, F.concat(F.lit("  "), F.col("p_brand"), F.lit(WIDE_SPACE)))
        .when(kind == 2, F.lit(" NA "))
        .when(kind == 3, F.lit(""))
        .when(kind == 4, F.lit(HARD_SPACE))
        .when(kind == 5, F.lit(INVISIBLE))
        .when(kind == 6, F.concat(F.lit(" "), size, F.lit(".5 ")))
        .otherwise(F.concat(F.lit("1,"), F.lpad(size, 3, "0")))
    )
    return load(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size", v.alias("v"))


# --- the same in SQL ---


def trim(x: str) -> str:
    return f"trim(coalesce({x}, ''), '{WHITESPACE}')"


def blank(x: str) -> str:
    return f"regexp_full_match(coalesce({x}, ''), '[{WHITESPACE}\\p{{Cf}}]*')"


def empty(x: str, words: tuple[str, ...] = ("NA", "N/A", "nan")) -> str:
    listed = ", ".join(f"'{w}'" for w in ("", *words))
    return f"({trim(x)} in ({listed}))"


def number(x: str) -> str:
    text = f"replace({trim(x)}, ',', '')"
    return (
        f"case when regexp_full_match({text}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')"
        f" then try_cast({text} as double) end"
    )


def date(x: str) -> str:
    text = trim(f"split_part(split_part({trim(x)}, ' ', 1), 'T', 1)")
    return (
        f"case when regexp_full_match({text}, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}') then try_cast({text} as date)"
        f" when regexp_full_match({text}, '[0-9]{{4}}/[0-9]{{1,2}}/[0-9]{{1,2}}') then try_cast(replace({text}, '/', '-') as date)"
        f" when regexp_full_match({text}, '[0-9]{{4}}\\.[0-9]{{2}}\\.[0-9]{{2}}') then try_cast(replace({text}, '.', '-') as date)"
        f" when regexp_full_match({text}, '[0-9]{{8}}') then try_cast(substr({text}, 1, 4) || '-' || substr({text}, 5, 2) || '-' || substr({text}, 7, 2) as date) end"
    )


def money(x: str) -> str:
    return f"cast(cast({x} as decimal(20,2)) as varchar)"


def stamp(x: str) -> str:
    return f"cast({x} as varchar)"


ORDERS = f"""orders_t as (
  select cast(o_orderkey as varchar) as o_orderkey, cast(o_custkey as varchar) as o_custkey,
    o_orderstatus, {money('o_totalprice')} as o_totalprice, {stamp('o_orderdate')} as o_orderdate,
    o_orderpriority, o_orderkey as ord from orders)"""

CUSTOMER = f"""customer_t as (
  select cast(c_custkey as varchar) as c_custkey, c_name, cast(c_nationkey as varchar) as c_nationkey,
    {money('c_acctbal')} as c_acctbal, c_mktsegment, c_custkey as ord from customer)"""

EVENTS = f"""events_t as (
  select cast(event_id as varchar) as event_id, {stamp('ts')} as ts, cast(user_id as varchar) as user_id,
    event_type, cast(value as varchar) as value, props, event_id as ord from events)"""

LINES = f"""lineitem_t as (
  select cast(l_orderkey as varchar) as l_orderkey, cast(l_partkey as varchar) as l_partkey,
    cast(l_suppkey as varchar) as l_suppkey, cast(l_linenumber as varchar) as l_linenumber,
    {money('l_quantity')} as l_quantity, {money('l_extendedprice')} as l_extendedprice,
    {money('l_discount')} as l_discount, {money('l_tax')} as l_tax, l_returnflag, l_linestatus,
    {stamp('l_shipdate')} as l_shipdate, l_partkey as partkey,
    row_number() over (order by {', '.join(LINE_ORDER)}) as ord from lineitem)"""

BASE_ORDERS = f"""{ORDERS}, base as (
  select case when ord % 13 = 0 then ' ' || o_orderkey else o_orderkey end as o_orderkey,
    o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, ord from orders_t)"""

ORDER_LINES = f"""{LINES}, lines as (
  select case when partkey % 11 = 0 then ' ' || l_orderkey || '{WIDE_SPACE}' else l_orderkey end as l_orderkey,
    l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount,
    case when l_tax = '0.00' then '' else l_tax end as l_tax, l_returnflag, l_linestatus, l_shipdate, ord
  from lineitem_t)"""

PARTS = f"""parts as (
  select p_partkey, p_brand, p_type, p_size, case p_partkey % 8
    when 0 then p_name when 1 then '  ' || p_brand || '{WIDE_SPACE}' when 2 then ' NA ' when 3 then ''
    when 4 then '{HARD_SPACE}' when 5 then '{INVISIBLE}'
    when 6 then ' ' || cast(p_size as varchar) || '.5 '
    else '1,' || lpad(cast(p_size as varchar), 3, '0') end as v from part)"""

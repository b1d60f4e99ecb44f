"""Lookups on the base key and projections of matched rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings import frames as fr
from bindings.registry import query
from recordloom.operators import match as m
from recordloom.operators.skew import numbered_within
from recordloom.rules import ORD, MergeRecords, NoMatch
from recordloom.sources.tables import as_text, keyed_table

DATED = ["o_orderdate", "o_orderkey"]


def dated_orders(spark, sf):
    """Orders in date order."""
    return as_text(fr.load(spark, sf, "orders"), DATED, decimals=2)


@query("keyed_table", f"""with {fr.ORDERS}, placed as (select *, row_number() over (order by o_orderdate, ord) as pos from orders_t),
ranked as (select *, row_number() over (partition by o_custkey order by pos desc) as rn,
  first_value(o_orderkey) over (partition by o_custkey order by pos) as first_order from placed)
select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, first_order
from ranked where rn = 1""")
def keyed_orders(spark, sf):
    keyed = keyed_table(dated_orders(spark, sf), "o_custkey")
    first = F.col(ORD)["o_orderkey"].cast("string")
    return keyed.withColumn("first_order", first).drop(ORD)


ORDER_NAMES = ("o_orderkey", "o_orderstatus", "o_orderdate", "o_orderpriority")


@query("lookup_one_to_one", f"""with {fr.BASE_ORDERS}, {fr.EVENTS}
select o_orderkey, e.event_type, e.value from base left join events_t e on e.event_id = o_orderkey""")
def lookup_one_to_one(spark, sf):
    matched = m.lookup_one_to_one(
        fr.base_orders(spark, sf), "o_orderkey", fr.events_text(spark, sf), "event_id", "event",
        ["event_type", "value"],
    )
    return matched.select("o_orderkey", "event.event_type", "event.value")


def _picked(order: str) -> str:
    return f"""(select * from (select *, row_number() over (partition by o_custkey order by o_orderdate {order}, ord {order}) as rn
      from orders_t) where rn = 1)"""


@query("lookup_many_to_one", f"""with {fr.ORDERS}, {fr.CUSTOMER}, padded as (
  select case when ord % 13 = 0 then ' ' || c_custkey else c_custkey end as c_custkey from customer_t)
select c_custkey, a.o_orderkey as first_order, a.o_orderdate as first_date, b.o_orderkey as last_order, b.o_orderdate as last_date
from padded left join {_picked('asc')} a on a.o_custkey = c_custkey
left join {_picked('desc')} b on b.o_custkey = c_custkey""")
def lookup_many_to_one(spark, sf):
    """First and last order of every customer; a padded base key finds none."""
    padded = F.when(F.col(ORD) % 13 == 0, F.concat(F.lit(" "), F.col("c_custkey"))).otherwise(F.col("c_custkey"))
    rows = fr.customer_text(spark, sf).withColumn("c_custkey", padded)
    orders = dated_orders(spark, sf)
    for pick in ("first", "last"):
        rows = m.lookup_many_to_one(rows, "c_custkey", orders, "o_custkey", pick, pick, ORDER_NAMES)
    return rows.select(
        "c_custkey", F.col("first.o_orderkey").alias("first_order"),
        F.col("first.o_orderdate").alias("first_date"),
        F.col("last.o_orderkey").alias("last_order"), F.col("last.o_orderdate").alias("last_date"),
    )


def _first_lines(more: str = "") -> str:
    return f"""first_lines as (
  select k, n, arg_min(l_partkey, ord) as part, arg_min(l_quantity, ord) as quantity, arg_min(l_shipdate, ord) as shipped{more}
  from (select *, {fr.trim('l_orderkey')} as k, {fr.trim('l_linenumber')} as n from lines)
  where k <> '' and n <> '' group by k, n)"""


FIRST_LINES = _first_lines()


@query("expand_one_to_many", f"""with {fr.BASE_ORDERS}, {fr.ORDER_LINES}, {_first_lines(", min(ord) as first_ord")}
select o_orderkey, n as line, part, quantity, shipped, row_number() over (partition by o_orderkey order by first_ord) as place
from base left join first_lines on k = o_orderkey""")
def expand_one_to_many(spark, sf):
    rows = m.expand_one_to_many(
        fr.base_orders(spark, sf), "o_orderkey", fr.order_lines(spark, sf), "l_orderkey",
        ["l_linenumber"], "line", NoMatch("emit_incomplete", "MISSING"),
    )
    lines = rows.select(
        "o_orderkey", F.trim(F.col("line.l_linenumber")).alias("line"),
        F.col("line.l_partkey").alias("part"), F.col("line.l_quantity").alias("quantity"),
        F.col(f"{ORD}.expansion.l_shipdate").cast("string").alias("shipped"), ORD,
    )
    return numbered_within(lines, "o_orderkey", [ORD], "place").drop(ORD)


@query("expand_skipping_unmatched", f"""with {fr.BASE_ORDERS}, {fr.ORDER_LINES}, {FIRST_LINES}
select o_orderkey, n as line, part from base join first_lines on k = o_orderkey""")
def expand_skipping_unmatched(spark, sf):
    rows = m.expand_one_to_many(
        fr.base_orders(spark, sf), "o_orderkey", fr.order_lines(spark, sf), "l_orderkey",
        ["l_linenumber"], "line", NoMatch("skip"),
    )
    return rows.select(
        "o_orderkey", F.col("line.l_linenumber").alias("line"), F.col("line.l_partkey").alias("part")
    )


@query("collect_many_to_one", f"""with {fr.ORDER_LINES}
select {fr.trim('l_orderkey')} as l_orderkey, l_returnflag, l_linestatus from (
  select distinct l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
    l_returnflag, l_linestatus, l_shipdate from lines) where {fr.trim('l_orderkey')} <> ''""")
def collect_many_to_one(spark, sf):
    """Every line comes twice, so that removing repeats shows."""
    twice = fr.order_lines(spark, sf).unionByName(fr.order_lines(spark, sf))
    rows = m.collect_many_to_one(
        twice, "l_orderkey", ["l_returnflag", "l_linestatus"], deduplicate=True
    )
    return rows.select(F.col(m.MATCH).alias("l_orderkey"), "l_returnflag", "l_linestatus")


def _merged(field: str, separator: str, order: str) -> str:
    return f"""(select k, string_agg(item, '{separator}' order by {order}) as text from (
      select {fr.trim('l_orderkey')} as k, {field} as item, min(ord) as first from lines group by all) group by k)"""


@query("join_records", f"""with {fr.ORDER_LINES}
select a.k as l_orderkey, a.text as flags, b.text as pairs
from {_merged('l_returnflag', ',', 'first')} a join {_merged("l_returnflag || '-' || l_linestatus", ';', 'first')} b using (k)""")
def join_records(spark, sf):
    long = m.collect_many_to_one(
        fr.order_lines(spark, sf), "l_orderkey", ["l_returnflag", "l_linestatus"]
    )
    cells = {"flags": (["l_returnflag"], "", ","), "pairs": (["l_returnflag", "l_linestatus"], "-", ";")}
    joined = m.join_records(long, cells, MergeRecords())
    return joined.select(F.col(m.MATCH).alias("l_orderkey"), "flags", "pairs")


@query("join_records_sorted", f"""with {fr.ORDER_LINES}
select k as l_orderkey, text as dates from {_merged('substr(l_shipdate, 1, 7)', ',', 'item')}""")
def join_records_sorted(spark, sf):
    lines = fr.order_lines(spark, sf).withColumn("month", F.substring("l_shipdate", 1, 7))
    long = m.collect_many_to_one(lines, "l_orderkey", ["month"])
    joined = m.join_records(long, {"dates": (["month"], "", ",")}, MergeRecords(order="sorted"))
    return joined.select(F.col(m.MATCH).alias("l_orderkey"), "dates")


@query("concatenated_fields", f"""with {fr.PARTS}
select p_partkey, concat_ws('+', case when not {fr.empty('v')} then {fr.trim('v')} end, p_brand,
  case when not {fr.empty('p_type')} then p_type end) as joined,
  coalesce(case when not {fr.empty('v')} then v end, p_brand, '') as first_filled from parts""")
def concatenated_fields(spark, sf):
    cells = [F.col("v"), F.col("p_brand"), F.col("p_type")]
    words = ("NA", "N/A", "nan")
    return fr.untidy_parts(spark, sf).select(
        "p_partkey", m.concatenate(cells, "+", words).alias("joined"),
        m.first_not_null(cells, words).alias("first_filled"),
    )


@query("result_keys", f"""with {fr.PARTS}
select cast(p_partkey as varchar) || '::' || coalesce(nullif({fr.trim('v')}, ''), 'MISSING') as result_key from parts""")
def result_keys(spark, sf):
    key = m.result_key([F.col("p_partkey").cast("string"), F.col("v")], "::", "MISSING")
    return fr.untidy_parts(spark, sf).select(key.alias("result_key"))

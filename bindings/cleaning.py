"""Newest record per key, one row per group, uniqueness checks, on order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings import frames as fr
from bindings.registry import query
from recordloom.operators import clean as cl
from recordloom.rules import ORD, CleanRule
from recordloom.session import staged

RULE = CleanRule(
    group_by=("l_partkey",), dedupe_by=("l_partkey", "l_suppkey"), latest_by="l_shipdate",
    drop=("l_tax", "l_discount"), unique=("l_linestatus", "l_returnflag"),
    join_comma=("l_returnflag",), join_backslash=("l_suppkey",),
)

NAMES = (
    "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, "
    "l_tax, l_returnflag, l_linestatus, l_shipdate"
)
LATEST = f"""{fr.LINES}, latest as (
  select * from (select *, row_number() over (partition by l_partkey, l_suppkey order by l_shipdate desc, ord desc) as rn,
    min(ord) over (partition by l_partkey, l_suppkey) as first_ord from lineitem_t) where rn = 1)"""


def latest_lines(spark, sf):
    return cl.latest_per_key(fr.lineitem_text(spark, sf), RULE.dedupe_by, RULE.latest_by)


def stored_latest(spark, sf):
    """As :func:`latest_lines`, of lines whose order is a number, written once for several readers."""
    return staged(cl.latest_per_key(fr.lines_numbered(spark, sf), RULE.dedupe_by, RULE.latest_by), "latest")


@query("latest_per_key", f"with {LATEST} select {NAMES} from latest")
def latest_per_key(spark, sf):
    return latest_lines(spark, sf).drop(ORD, "_first")


@query("collapse_groups", f"""with {LATEST}
select {NAMES} from (select *, row_number() over (partition by l_partkey order by l_shipdate desc, ord desc) as g from latest)
where g = 1""")
def collapse_groups(spark, sf):
    return cl.collapse_groups(latest_lines(spark, sf), RULE).drop(ORD)


def _distinct(field: str) -> str:
    return f"""(select l_partkey, {field} as value, max(l_shipdate || lpad(cast(ord as varchar), 12, '0')) as newest
      from latest where {field} <> '' group by l_partkey, {field})"""


def _joined(field: str, separator: str) -> str:
    return f"""(select l_partkey, string_agg(value, '{separator}' order by newest desc) as text
      from {_distinct(field)} group by l_partkey)"""


@query("join_distinct", f"""with {LATEST}
select a.l_partkey, a.text as flags, b.text as suppliers
from {_joined('l_returnflag', ',')} a join {_joined('l_suppkey', chr(92))} b using (l_partkey)""")
def join_distinct(spark, sf):
    joined = cl.join_distinct(stored_latest(spark, sf), RULE)
    return joined.select(
        F.col("_group_0").alias("l_partkey"), F.col("_joined.c0").alias("flags"),
        F.col("_joined.c1").alias("suppliers"),
    )


@query("clean_lines", f"""with {LATEST}
select l.l_orderkey, l.l_partkey, b.text as l_suppkey, l.l_linenumber, l.l_quantity, l.l_extendedprice,
  a.text as l_returnflag, l.l_linestatus, l.l_shipdate
from (select *, row_number() over (partition by l_partkey order by l_shipdate desc, ord desc) as g from latest) l
join {_joined('l_returnflag', ',')} a using (l_partkey) join {_joined('l_suppkey', chr(92))} b using (l_partkey)
where g = 1""")
def clean_lines(spark, sf):
    return cl.clean(fr.lines_numbered(spark, sf), RULE).drop(ORD)


@query("clean_dropped_columns", f"""with {fr.LINES}
select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag, l_linestatus, l_shipdate
from lineitem_t""")
def clean_dropped_columns(spark, sf):
    return cl.drop_columns(fr.lineitem_text(spark, sf), RULE.drop).drop(ORD)


def _ranked(field: str, position: int) -> str:
    return f"""select l_partkey, '{field}' as field, {position} as position, value, newest,
      row_number() over (partition by l_partkey order by newest desc) as rn from {_distinct(field)}"""


CONFLICTS = f"""{LATEST}, ranked as ({_ranked('l_linestatus', 0)} union all {_ranked('l_returnflag', 1)}),
conflicts as (select l_partkey, field, position, string_agg(value, ' / ' order by newest desc) as shown
  from ranked where rn <= 2 group by l_partkey, field, position having count(*) > 1)"""


@query("unique_conflicts", f"""with {CONFLICTS}
select l_partkey, field, value, several from (
  select l_partkey, field, value, count(*) over (partition by l_partkey, field) as several from ranked) where several > 1""")
def unique_conflicts(spark, sf):
    found = cl.unique_conflicts(latest_lines(spark, sf), RULE)
    return found.select(F.col("_group_0").alias("l_partkey"), "field", "value", "several")


@query("unique_conflict_totals", f"""with {CONFLICTS}
select count(distinct l_partkey) as groups, count(*) as cells from conflicts""")
def unique_conflict_totals(spark, sf):
    return cl.conflict_totals(cl.unique_conflicts(latest_lines(spark, sf), RULE), RULE)


@query("unique_conflict_summary", f"""with {CONFLICTS}, placed as (
  select c.*, row_number() over (partition by field order by first_at) as place from conflicts c
  join (select l_partkey, min(first_ord) as first_at from latest group by l_partkey) using (l_partkey))
select field, count(*) as groups,
  string_agg(l_partkey || '「' || shown || '」', '；' order by place) filter (where place <= 2) as examples
from placed group by field""")
def unique_conflict_summary(spark, sf):
    latest = stored_latest(spark, sf)
    return cl.unique_conflict_summary(cl.unique_conflicts(latest, RULE), latest, RULE)

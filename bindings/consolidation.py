"""Orders consolidated with their lines, events and return flags."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from bindings import frames as fr
from bindings.registry import query
from recordloom.functions.text import trim_text
from recordloom.operators import conflicts as cf
from recordloom.operators.filters import status_filter
from recordloom.operators.match import key_names
from recordloom.operators.review import status_counts
from recordloom.plans.consolidating import consolidate
from recordloom.rules import (
    ORD,
    ColumnRule,
    ConsolidationRule,
    MatchRule,
    MergeRecords,
    NoMatch,
    OutputColumn,
)
from recordloom.sources.exports import export_layout

RUN_DATE = dt.date(2026, 10, 13)
TAXED = {"column": "l_discount", "operator": "greater_than", "value": "0.05", "value_type": "number"}

RULE = ConsolidationRule(
    base_source="orders",
    base_key="o_orderkey",
    result_identity=("o_orderkey", "l_linenumber"),
    sources=(
        MatchRule("orders", "o_orderkey", label="Orders"),
        MatchRule(
            "lines", "l_orderkey", "one_to_many", "Lines", expand_by=("l_linenumber",),
            no_match=NoMatch("emit_incomplete", "NONE"), compare_by=("l_orderkey", "l_linenumber"),
            conflicts=True, columns=(ColumnRule("l_tax", required_when=TAXED),),
        ),
        MatchRule("events", "event_id", label="Events"),
        MatchRule(
            "flags", "l_orderkey", "many_to_one", "Flags", no_match=NoMatch("empty"),
            merge=MergeRecords(deduplicate=True),
        ),
        MatchRule(
            "priorities", "o_custkey", "many_to_one", "Priorities", no_match=NoMatch("empty"),
            compare_by=("o_orderpriority", "o_orderstatus"), conflicts=True, selected="last",
        ),
    ),
    columns=(
        OutputColumn("Order Number", source="orders", fields=("o_orderkey",)),
        OutputColumn("Line Number", source="lines", fields=("l_linenumber",)),
        OutputColumn("Customer", source="orders", fields=("o_custkey",)),
        OutputColumn("Part", source="lines", fields=("l_partkey",)),
        OutputColumn("Quantity", source="lines", fields=("l_quantity",)),
        OutputColumn("Tax", "required_if_applicable", "lines", ("l_tax",)),
        OutputColumn("Event Type", source="events", fields=("event_type",)),
        OutputColumn(
            "Return Flags", "required_if_applicable", "flags", ("l_returnflag",),
            "concatenate", record_separator=",",
        ),
        OutputColumn(
            "Flag Pairs", "required_if_applicable", "flags", ("l_returnflag", "l_linestatus"),
            "concatenate", separator="-", record_separator=";",
        ),
        OutputColumn("Priority", "required_if_applicable", "priorities", ("o_orderpriority",), "first_not_null"),
        OutputColumn("Terms", "required_if_applicable", "lines", ("l_discount", "l_tax"), "concatenate", separator="/"),
        OutputColumn("Data Scope", "user_defined", parameter="data_scope"),
        OutputColumn("Kind", value="Order line"),
        OutputColumn("Channel", "optional"),
        OutputColumn("Publish Date", transform="date_offset", offset_days_from="lead_days"),
        OutputColumn("Choose Action", transform="record_action"),
        OutputColumn("Change Description", "required_if_applicable", transform="change_description"),
    ),
    parameters={"data_scope": "CN", "lead_days": 5},
)


def sources(spark, sf):
    lines = fr.order_lines_numbered(spark, sf)
    return {
        "orders": fr.base_orders(spark, sf), "lines": lines, "events": fr.events_text(spark, sf),
        "flags": lines, "priorities": fr.orders_text(spark, sf),
    }


def consolidated(spark, sf, notes=False):
    return consolidate(sources(spark, sf), RULE, RUN_DATE, notes)


# --- SQL ---

_ROW = (
    "row(l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, "
    "l_tax, l_returnflag, l_linestatus, l_shipdate)"
)
KEYED = f"""keyed as (select *, {fr.trim('l_orderkey')} as k, {fr.trim('l_linenumber')} as n from lines)"""
EXPANDED = f"""{KEYED}, expanded as (
  select k, n, min(ord) as first_ord, count(distinct {_ROW}) > 1 as differs,
    arg_min(l_linenumber, ord) as l_linenumber, arg_min(l_partkey, ord) as l_partkey,
    arg_min(l_quantity, ord) as l_quantity, arg_min(l_discount, ord) as l_discount, arg_min(l_tax, ord) as l_tax
  from keyed where k <> '' and n <> '' group by k, n)"""
TUPLES = """tuples as (select distinct o_custkey as k, o_orderpriority as p, o_orderstatus as s from orders_t
  where o_orderpriority || o_orderstatus <> ''),
several as (select k, 'Priorities：o_custkey=' || k || ' 存在多个不同值：' || string_agg(p || '+' || s, ', ' order by p || '+' || s) as detail
  from tuples group by k having count(*) > 1)"""


def _merged(field: str, separator: str) -> str:
    return f"""(select k, string_agg(item, '{separator}' order by first) as text from (
      select k, {field} as item, min(ord) as first from keyed group by all) group by k)"""


MATCHED = f"""{fr.BASE_ORDERS}, {fr.ORDER_LINES}, {fr.EVENTS}, {EXPANDED}, {TUPLES},
matched as (select b.o_orderkey as key, b.o_custkey as customer, x.k is not null as has_line, x.*,
    e.event_type, e.event_id is not null as has_event, f.text as flags, g.text as pairs,
    p.o_orderpriority as priority, s.detail as several,
    case when x.differs then 'Lines：l_orderkey=' || x.k || ', l_linenumber=' || x.n || ' 存在内容不同的重复记录' end as content
  from base b left join expanded x on x.k = b.o_orderkey
  left join events_t e on e.event_id = b.o_orderkey
  left join {_merged('l_returnflag', ',')} f on f.k = b.o_orderkey
  left join {_merged("l_returnflag || '-' || l_linestatus", ';')} g on g.k = b.o_orderkey
  left join (select o_custkey, arg_max(o_orderpriority, ord) as o_orderpriority from orders_t group by 1) p on p.o_custkey = b.o_orderkey
  left join several s on s.k = b.o_orderkey),
cells as (select *, {fr.trim('key')} || '::' || coalesce(n, 'NONE') as result_key,
    has_line and coalesce(try_cast(l_discount as double) > 0.05, false) and l_tax = '' as tax_missing,
    array_to_string(list_sort(list_filter([content, several], lambda x: x is not null)), chr(10)) as row_conflict
  from matched),
result as (select result_key, key as o_orderkey,
    case when row_conflict <> '' then 'Conflict' when not has_line or not has_event or tax_missing then 'Incomplete' else 'Ready' end as status,
    not has_line or not has_event or tax_missing as is_missing, row_conflict,
    key as "Order Number", coalesce(l_linenumber, 'NONE') as "Line Number", customer as "Customer",
    coalesce(l_partkey, 'MISSING') as "Part", coalesce(l_quantity, 'MISSING') as "Quantity",
    case when not has_line then 'MISSING' when tax_missing then 'NONE' else l_tax end as "Tax",
    coalesce(event_type, 'MISSING') as "Event Type", coalesce(flags, '') as "Return Flags", coalesce(pairs, '') as "Flag Pairs",
    coalesce(priority, '') as "Priority",
    case when not has_line then 'MISSING' else concat_ws('/', nullif(l_discount, ''), nullif(l_tax, '')) end as "Terms",
    'CN' as "Data Scope", 'Order line' as "Kind", '' as "Channel", '2026-10-18' as "Publish Date",
    '' as "Choose Action", '' as "Change Description", n, first_ord, k
  from cells)"""
RESULT = MATCHED


@query("consolidate_orders", f"with {RESULT} select * exclude (n, first_ord, k) from result")
def consolidate_orders(spark, sf):
    return consolidated(spark, sf).drop(ORD)


@query("status_counts", f"""with {RESULT}
select s.status, count(r.status) as rows from (values ('Ready'), ('Incomplete'), ('Duplicate'), ('Conflict')) s(status)
left join result r on r.status = s.status group by s.status""")
def consolidated_status_counts(spark, sf):
    return status_counts(consolidated(spark, sf))


@query("ready_rows", f"""with {RESULT} select result_key, "Part", "Quantity" from result where status = 'Ready'""")
def ready_rows(spark, sf):
    return status_filter(consolidated(spark, sf)).select("result_key", "Part", "Quantity")


HEADERS = ["Order Number", " Line \n Number", "Comment", "", "Part", "Part", "Quantity", "Return  Flags"]


@query("export_layout", f"""with {RESULT}
select "Order Number", "Line Number", '' as "Comment", '' as "_blank_3", "Part", '' as "_blank_5", "Quantity", "Return Flags"
from result where status = 'Ready'""")
def ready_export(spark, sf):
    layout, _ = export_layout(status_filter(consolidated(spark, sf)), HEADERS, RULE.names)
    return layout.drop(ORD)


# --- conflicts ---

FIELD_COLUMNS = {"l_partkey": ["Part"], "l_quantity": ["Quantity"], "l_discount": ["Terms"], "l_tax": ["Tax", "Terms"]}


@query("content_conflicts", f"""with {fr.ORDER_LINES}, {EXPANDED}
select k as l_orderkey, n as l_linenumber, 'Lines：l_orderkey=' || k || ', l_linenumber=' || n || ' 存在内容不同的重复记录' as detail
from expanded where differs""")
def content_conflicts(spark, sf):
    found = cf.content_conflicts(
        fr.order_lines(spark, sf), "l_orderkey", ["l_linenumber"], ["l_orderkey", "l_linenumber"], "Lines"
    )
    return found.toDF("l_orderkey", "l_linenumber", "detail")


@query("value_conflicts", f"""with {fr.ORDERS}, tuples as (select distinct o_custkey as k, o_orderpriority as p from orders_t)
select k as o_custkey, 'Orders：o_custkey=' || k || ' 存在多个不同值：' || string_agg(p, ', ' order by p) as detail
from tuples group by k having count(*) > 1""")
def value_conflicts(spark, sf):
    found = cf.value_conflicts(fr.orders_text(spark, sf), "o_custkey", ["o_orderpriority"], "Orders")
    return found.toDF("o_custkey", "detail")


def line_cells(spark, sf):
    lines = fr.order_lines(spark, sf)
    return cf.conflict_cells(lines, "l_orderkey", ["l_linenumber"], FIELD_COLUMNS)


def _field(name: str, column: str) -> str:
    return f"""select k, n, '{column}' as col, {fr.trim(name)} as value, count(distinct {fr.trim(name)}) over (partition by k, n) as several
      from keyed where k <> '' and n <> ''"""


CELLS = f"""{fr.ORDER_LINES}, {KEYED}, candidates as (select distinct k, n, col, value from (
  {_field('l_partkey', 'Part')} union all {_field('l_quantity', 'Quantity')} union all {_field('l_discount', 'Terms')}
  union all {_field('l_tax', 'Tax')} union all {_field('l_tax', 'Terms')}) where several > 1)"""
NOTES = f"""{CELLS}, notes as (select k, n, col, 'Lines：' || k || '+' || n || ' 有多个候选值：' || string_agg(value, ', ' order by value) as note
  from (select *, row_number() over (partition by k, n, col order by value) as rn from candidates) where rn <= 3 group by k, n, col)"""


@query("conflict_cells", f"""with {CELLS} select k as l_orderkey, n as l_linenumber, col as "column", value from candidates""")
def conflict_cells(spark, sf):
    return line_cells(spark, sf).toDF("l_orderkey", "l_linenumber", "column", "value")


@query("cell_notes", f"""with {NOTES} select k as l_orderkey, n as l_linenumber, col as "column", note from notes""")
def cell_notes(spark, sf):
    noted = cf.cell_notes(line_cells(spark, sf), ["l_linenumber"], "Lines")
    return noted.select(*key_names(["l_linenumber"]), F.explode("notes")).toDF(
        "l_orderkey", "l_linenumber", "column", "note"
    )


@query("consolidation_notes", f"""with {NOTES}, base as (select case when o_orderkey % 13 = 0 then ' ' || cast(o_orderkey as varchar)
    else cast(o_orderkey as varchar) end as o_orderkey from orders), {fr.ORDERS}, {TUPLES},
priority as (select k, 'Priorities：' || k || ' 有多个候选值：' || string_agg(p, ', ' order by p) as note from (
    select k, p, row_number() over (partition by k order by p) as rn from (select distinct k, p from tuples)) where rn <= 3
    group by k having count(*) > 1),
rows_out as (select b.o_orderkey, n.n, n.k from base b left join (select distinct k, n from keyed where k <> '' and n <> '') n on n.k = b.o_orderkey)
select {fr.trim('r.o_orderkey')} || '::' || r.n as result_key, n.col as "column", n.note from rows_out r join notes n on n.k = r.k and n.n = r.n
union all select {fr.trim('r.o_orderkey')} || '::' || coalesce(r.n, 'NONE'), 'Priority', p.note from rows_out r join priority p on p.k = r.o_orderkey""")
def consolidation_notes(spark, sf):
    rows = consolidated(spark, sf, notes=True)
    return rows.select("result_key", F.explode("conflict_notes")).toDF("result_key", "column", "note")


@query("row_conflicts", f"with {RESULT} select result_key, row_conflict from result where row_conflict <> ''")
def row_conflicts(spark, sf):
    return consolidated(spark, sf).where("row_conflict <> ''").select("result_key", "row_conflict")


@query("conflict_list", f"""with {RESULT}
select distinct unnest(string_split(row_conflict, chr(10))) as detail from result where row_conflict <> ''""")
def conflict_list(spark, sf):
    return cf.conflict_list(consolidated(spark, sf))


@query("missing_keys", f"with {RESULT} select distinct result_key from result where is_missing")
def missing_keys(spark, sf):
    return consolidated(spark, sf).where("is_missing").select("result_key").distinct()


@query("unmatched_cells", f"""with {RESULT}
select "Line Number" = 'NONE' as no_line, "Event Type" = 'MISSING' as no_event, status, count(*) as rows from result group by all""")
def unmatched_cells(spark, sf):
    rows = consolidated(spark, sf)
    return rows.groupBy(
        (trim_text(F.col("Line Number")) == "NONE").alias("no_line"),
        (F.col("Event Type") == "MISSING").alias("no_event"), "status",
    ).agg(F.count("*").alias("rows"))

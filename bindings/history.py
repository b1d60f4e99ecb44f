"""Comparison with stored records, and the operation log, on orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings import consolidation as con
from bindings import frames as fr
from bindings.registry import query
from recordloom.columns import data_columns
from recordloom.operators import changes as ch
from recordloom.operators import log as lg
from recordloom.operators.project import derived_fill
from recordloom.operators.review import cell_diff, status_counts
from recordloom.plans.consolidating import consolidate, consolidate_with_history
from recordloom.plans.recording import records_to_log
from recordloom.session import staged
from recordloom.rules import ORD, ChangeRule, ConsolidationRule, OutputColumn
from recordloom.sources.tables import append_rows

FIELDS = ("Order", "Customer", "Price", "Date", "Priority", "Choose Action", "Change Description")
LOG_COLUMNS = (
    "log_time", "status", "Order", "Customer", "Price", "Priority", "Choose Action",
    "Change Description", "order_code", "operation", "details",
)
IDENTITY = ("Order", "Customer")
CHANGES = ChangeRule(
    identity=IDENTITY, fields=FIELDS, description_field="Change Description",
    action_field="Choose Action", labels={"Price": "价格"}, template="{chinese_name}变更",
)
NOW = "2026/10/13 09:30:00"


def results(spark, sf):
    """Orders as result rows; some Conflict, some Incomplete."""
    df = fr.orders_text(spark, sf)
    i = F.col(ORD)
    return df.select(
        F.concat_ws("::", "o_orderkey", "o_custkey").alias("result_key"),
        F.when(i % 17 == 0, "Conflict").when(i % 19 == 0, "Incomplete").otherwise("Ready").alias("status"),
        F.col("o_orderkey").alias("order_code"), F.col("o_orderkey").alias("Order"),
        F.col("o_custkey").alias("Customer"), F.col("o_totalprice").alias("Price"),
        F.col("o_orderdate").alias("Date"), F.col("o_orderpriority").alias("Priority"),
        F.lit("").alias("Choose Action"), F.lit("").alias("Change Description"),
        (i % 19 == 0).alias("is_missing"), F.col(ORD),
    )


def stored_log(spark, sf):
    """Four generations; blank times, equal times and padded identities occur.

    Orders whose key leaves 0 modulo 3 end up stored unchanged, 1 changed, 2 absent.
    """
    df = fr.orders_text(spark, sf)
    i = F.col(ORD)
    generation = F.explode(F.sequence(F.lit(1), F.lit(4))).alias("g")
    rows = df.select("*", i.alias("i"), generation).where("i % 3 < 2 and (g <> 2 or i % 12 = 0)")
    newest = F.col("g") == 3
    price = F.when(newest & (F.col("i") % 3 == 0), F.col("o_totalprice")).otherwise(
        F.concat(F.lit("9"), F.col("o_totalprice"))
    )
    priority = F.when(newest & (F.col("i") % 6 == 1), "9-NONE").otherwise(
        F.concat(F.col("o_orderpriority"), F.lit(" "))
    )
    return rows.select(
        F.when(F.col("g") == 4, "").when(F.col("g") == 1, "2026/01/01 10:00:00")
        .otherwise("2026/02/02 10:00:00").alias("log_time"),
        F.lit("Ready").alias("status"),
        F.concat(F.lit(" "), F.col("o_orderkey")).alias("Order"), F.col("o_custkey").alias("Customer"),
        price.alias("Price"), priority.alias("Priority"), F.lit("").alias("Choose Action"),
        F.lit("").alias("Change Description"), F.col("o_orderkey").alias("order_code"),
        F.lit("export").alias("operation"), F.lit(None).cast("string").alias("details"),
        F.struct("g", "i").alias(ORD),
    )


RESULTS = f"""{fr.ORDERS}, results as (select o_orderkey || '::' || o_custkey as result_key,
  case when ord % 17 = 0 then 'Conflict' when ord % 19 = 0 then 'Incomplete' else 'Ready' end as status,
  o_orderkey as order_code, o_orderkey as "Order", o_custkey as "Customer", o_totalprice as "Price",
  o_orderdate as "Date", o_orderpriority as "Priority", ord % 19 = 0 as is_missing, ord as i from orders_t)"""
LOG = f"""log as (select case when g = 4 then '' when g = 1 then '2026/01/01 10:00:00' else '2026/02/02 10:00:00' end as log_time,
  'Ready' as status, ' ' || o_orderkey as "Order", o_custkey as "Customer",
  case when g = 3 and ord % 3 = 0 then o_totalprice else '9' || o_totalprice end as "Price",
  case when g = 3 and ord % 6 = 1 then '9-NONE' else o_orderpriority || ' ' end as "Priority",
  '' as "Choose Action", '' as "Change Description", o_orderkey as order_code, 'export' as operation,
  cast(null as varchar) as details, g, ord as i
  from orders_t, (values (1), (2), (3), (4)) gens(g) where ord % 3 < 2 and (g <> 2 or ord % 12 = 0))"""
LATEST = f"""{RESULTS}, {LOG}, latest as (select * from (select *, row_number() over (partition by {fr.trim('"Order"')}, {fr.trim('"Customer"')}
  order by log_time desc, g desc, i desc) as rn from log) where rn = 1)"""
_PRICE = f"""{fr.trim('r."Price"')} <> {fr.trim('l."Price"')}"""
_PRIORITY = f"""{fr.trim('r."Priority"')} <> {fr.trim('l."Priority"')}"""
COMPARED = f"""{LATEST}, compared as (select r.*, l.i is not null as stored,
    case when l.i is null then 'new' when ({_PRICE}) or ({_PRIORITY}) then 'modified' else 'unchanged' end as record_kind,
    concat_ws(',', case when l.i is not null and {_PRICE} then 'Price' end, case when l.i is not null and {_PRIORITY} then 'Priority' end) as changed,
    concat_ws('; ', case when {_PRICE} then '价格变更' end, case when {_PRIORITY} then 'Priority变更' end) as text
  from results r left join latest l on {fr.trim('l."Order"')} = r."Order" and {fr.trim('l."Customer"')} = r."Customer"),
applied as (select *, case when stored then 'Modify' else 'Add' end as action,
    case when status = 'Conflict' then '' when record_kind = 'modified' then text else '' end as description,
    case when status <> 'Conflict' and record_kind = 'unchanged' then 'Duplicate' else status end as new_status,
    status <> 'Conflict' and record_kind = 'modified' as is_changed from compared)"""


@query("latest_records", f"""with {LATEST} select log_time, "Order", "Customer", "Price", "Priority", order_code from latest""")
def latest_records(spark, sf):
    latest = ch.latest_records(stored_log(spark, sf), IDENTITY)
    return latest.select("log_time", "Order", "Customer", "Price", "Priority", "order_code")


def applied(spark, sf, force=False, rule=CHANGES):
    latest = ch.latest_records(stored_log(spark, sf), IDENTITY)
    return ch.apply_changes(results(spark, sf), latest, rule, "order_code", force)


@query("classify_records", f"with {COMPARED} select result_key, stored, record_kind, changed from compared")
def classify_records(spark, sf):
    latest = ch.latest_records(stored_log(spark, sf), IDENTITY)
    found = ch.classify(results(spark, sf), latest, CHANGES)
    return found.select(
        "result_key", "stored", "record_kind", F.array_join("changed_columns", ",").alias("changed")
    )


@query("change_descriptions", f"""with {COMPARED}
select result_key, new_status as status, action as "Choose Action", description as "Change Description" from applied""")
def change_descriptions(spark, sf):
    return applied(spark, sf).select("result_key", "status", "Choose Action", "Change Description")


@query("source_descriptions", f"""with {COMPARED}
select result_key, new_status as status, case when status <> 'Conflict' and record_kind <> 'modified' then ''
  else "Priority" end as "Priority" from applied""")
def source_descriptions(spark, sf):
    rule = ChangeRule(
        identity=IDENTITY, fields=FIELDS, description_field="Priority", mode="source",
        compare=("Price", "Customer"), missing_action="error",
    )
    latest = ch.latest_records(stored_log(spark, sf), IDENTITY)
    rows = ch.apply_changes(results(spark, sf), latest, rule, "order_code")
    return rows.select("result_key", "status", "Priority")


@query("forced_statuses", f"""with {COMPARED} select result_key, status, action as "Choose Action" from applied""")
def forced_statuses(spark, sf):
    return applied(spark, sf, force=True).select("result_key", "status", "Choose Action")


@query("identity_duplicates", f"""with {COMPARED}
select result_key, case when status <> 'Conflict' and stored then 'Duplicate' else status end as status from applied""")
def identity_duplicates(spark, sf):
    rule = ChangeRule(identity=IDENTITY, fields=FIELDS, action_field="Choose Action")
    return applied(spark, sf, rule=rule).select("result_key", "status")


@query("change_lists", f"""with {COMPARED}
select 'duplicate' as list, result_key from applied where new_status = 'Duplicate'
union all select 'changed', result_key from applied where is_changed
union all select distinct 'missing', result_key from applied where is_missing""")
def change_lists(spark, sf):
    return ch.change_lists(applied(spark, sf))


@query("undescribed_changes", f"""with {COMPARED}
select result_key from applied where new_status = 'Ready' and action = 'Modify' and record_kind = 'unchanged'
union all select result_key from applied where status = 'Ready' and action = 'Modify' and record_kind = 'unchanged'""")
def undescribed_changes(spark, sf):
    return ch.undescribed_changes(applied(spark, sf, force=True), CHANGES).select("result_key")


@query("derived_fill", f"""with {RESULTS}
select result_key, case when status = 'Ready' and i % 5 = 0 then 'Incomplete' else status end as status,
  case when i % 5 = 0 then 'MISSING' else 'Add' end as "Choose Action", is_missing or i % 5 = 0 as is_missing from results""")
def derived_fill_query(spark, sf):
    rule = ConsolidationRule(
        "orders", "order_code", ("order_code",), (),
        (OutputColumn("Choose Action", transform="record_action"),),
    )
    gap = F.col(ORD) % 5 == 0
    rows = results(spark, sf).withColumn("Choose Action", F.when(gap, " ").otherwise("Add"))
    return derived_fill(rows, rule).select("result_key", "status", "Choose Action", "is_missing")


# --- log ---


def ready_records(spark, sf):
    rows = results(spark, sf).where("status = 'Ready'")
    return rows.select("status", "order_code", *FIELDS, ORD)


NEW_RECORDS = f"""{LATEST}, fresh as (select r.* from results r
  left join latest l on {fr.trim('l."Order"')} = r."Order" and {fr.trim('l."Customer"')} = r."Customer"
  where r.status = 'Ready' and (l.i is null or ({_PRICE}) or ({_PRIORITY})))"""


@query("drop_unchanged", f"""with {NEW_RECORDS} select order_code, "Price", "Date" from fresh""")
def drop_unchanged(spark, sf):
    log = stored_log(spark, sf).drop("operation", "details")
    fresh = lg.drop_unchanged(ready_records(spark, sf), log, IDENTITY, LOG_COLUMNS)
    return fresh.select("order_code", "Price", "Date")


@query("record_ready", f"""with {NEW_RECORDS}
select '{NOW}' as log_time, status, "Order", "Customer", "Price", "Priority", '' as "Choose Action",
  '' as "Change Description", order_code from fresh""")
def record_ready(spark, sf):
    log = stored_log(spark, sf).drop("operation", "details")
    rows = records_to_log(ready_records(spark, sf), log, IDENTITY, LOG_COLUMNS, NOW)
    return rows.drop(ORD)


@query("append_records", f"""with {RESULTS}
select '{NOW}' as log_time, status, "Order", "Customer", "Price", "Priority", '' as "Choose Action", '' as "Change Description",
  order_code, '' as operation, '' as details from results where status = 'Ready'""")
def append_records(spark, sf):
    log = stored_log(spark, sf)
    rows = lg.append_records(ready_records(spark, sf), data_columns(log), LOG_COLUMNS, NOW)
    return rows.drop(ORD)


@query("append_operation", f"""with {RESULTS}, {LOG} select log_time, order_code, operation, details from log
union all select '{NOW}', null, 'Cleanup', 'kept 5'""")
def append_operation(spark, sf):
    log = lg.append_operation(stored_log(spark, sf), NOW, "Cleanup", "kept 5")
    return log.select("log_time", "order_code", "operation", "details")


def log_halves(spark, sf):
    """Two overlapping logs that repeat rows inside and across."""
    df = fr.orders_text(spark, sf).select("o_custkey", "o_orderstatus", "o_orderpriority", ORD)
    left = df.where("o_orderstatus <> 'F'")
    right = df.where("o_orderstatus <> 'O'")
    return left, right


@query("merge_logs", """with l as (select distinct cast(o_custkey as varchar) as o_custkey, o_orderstatus, o_orderpriority
  from orders where o_orderstatus <> 'F'),
r as (select distinct cast(o_custkey as varchar) as o_custkey, o_orderstatus, o_orderpriority from orders where o_orderstatus <> 'O')
select *, false as added from l union all select *, true from (select * from r except select * from l)""")
def merge_logs(spark, sf):
    return lg.merge_logs(*log_halves(spark, sf)).drop(ORD)


@query("append_missing_columns", f"""with {fr.ORDERS}
select o_orderkey, o_custkey, '' as o_orderpriority from orders_t
union all select o_orderkey, '', o_orderpriority from orders_t""")
def append_missing_columns(spark, sf):
    df = fr.orders_text(spark, sf).drop(ORD)
    return append_rows(df.select("o_orderkey", "o_custkey"), df.select("o_orderkey", "o_orderpriority"))


LAYOUT = ["o_orderpriority", "note", "o_orderkey", "o_orderstatus"]


@query("align_schema", f"""with {fr.ORDERS} select o_orderpriority, '' as note, o_orderkey, o_orderstatus from orders_t""")
def align_schema(spark, sf):
    return lg.align_schema(fr.orders_text(spark, sf), LAYOUT).drop(ORD)


@query("verify_rewrite", f"""with {fr.ORDERS}, new_rows as (select o_orderkey, case when ord % 100 = 0 then '' else o_orderstatus end as o_orderstatus,
  o_orderpriority from orders_t)
select (select count(*) from orders_t) as old_rows, (select count(*) from new_rows) as new_rows,
  (select count(*) from orders where o_orderkey % 250 = 0) as filled_added,
  (select count(*) from (select o_orderkey, o_orderstatus, o_orderpriority from orders_t except select * from new_rows)) as old_not_new,
  (select count(*) from (select * from new_rows except select o_orderkey, o_orderstatus, o_orderpriority from orders_t)) as new_not_old""")
def verify_rewrite(spark, sf):
    old = fr.orders_text(spark, sf)
    i = F.col(ORD)
    new = lg.align_schema(old, LAYOUT).withColumns({
        "note": F.when(i % 250 == 0, "kept").otherwise(""),
        "o_orderstatus": F.when(i % 100 == 0, "").otherwise(F.col("o_orderstatus")),
    })
    return lg.verify_rewrite(old, new, ["o_orderkey", "o_orderstatus", "o_orderpriority"])


@query("cell_diff", f"""with {fr.ORDERS}, r as (select o_orderkey, o_orderstatus, case when ord % 5 = 0 then '' else o_orderpriority end as o_orderpriority
  from orders_t where o_orderstatus <> 'P'), j as (select o_orderkey, l.o_orderstatus as s1, r.o_orderstatus as s2, l.o_orderpriority as p1, r.o_orderpriority as p2
  from orders_t l full join r using (o_orderkey))
select o_orderkey, 'o_orderstatus' as "column", s1 as left_value, s2 as right_value from j where s1 is distinct from s2
union all select o_orderkey, 'o_orderpriority', p1, p2 from j where p1 is distinct from p2""")
def differing_cells(spark, sf):
    names = ["o_orderkey", "o_orderstatus", "o_orderpriority"]
    left = fr.orders_text(spark, sf)
    blank = F.when(F.col(ORD) % 5 == 0, "").otherwise(F.col("o_orderpriority"))
    right = left.where("o_orderstatus <> 'P'").withColumn("o_orderpriority", blank)
    return cell_diff(left.select(*names), right.select(*names), ["o_orderkey"])


# --- whole run against history ---

RUN_CHANGES = ChangeRule(
    identity=("Order Number", "Line Number"), fields=tuple(con.RULE.names),
    description_field="Change Description", action_field="Choose Action",
    ignore=("Publish Date",), template="{column}变更",
)
RUN_LOG = (
    "log_time", "status", "Order Number", "Line Number", "Customer", "Part", "Quantity", "Tax",
    "Event Type", "Return Flags", "Publish Date", "Choose Action", "Change Description", "o_orderkey",
)


def run_log(tables, edited=True):
    """What an earlier run over these tables recorded; some quantities differed, some rows were absent."""
    ready = consolidate(tables, con.RULE, con.RUN_DATE, False).where("status = 'Ready'")
    if edited:
        i = F.col(ORD)["base"]
        older = F.when(i % 5 == 0, "1").otherwise(F.col("Quantity"))
        ready = ready.where(i % 7 != 0).withColumn("Quantity", older)
    return staged(lg.append_records(ready, RUN_LOG, RUN_LOG, "2026/10/01 08:00:00"), "run-log")


@query("consolidate_with_history", f"""with {con.RESULT.replace("result as (", "result as materialized (")},
prepared as materialized (select *, {fr.trim('"Order Number"')} as o from result),
log as materialized (select o as logged, "Line Number" as l,
    case when cast(k as bigint) % 5 = 0 then '1' else "Quantity" end as q from prepared
  where status = 'Ready' and cast(k as bigint) % 7 <> 0)
select result_key, case when status = 'Conflict' or logged is null or q <> "Quantity" then status else 'Duplicate' end as status,
  "Part", "Quantity", case when logged is null then 'Add' else 'Modify' end as "Choose Action",
  case when status <> 'Conflict' and q <> "Quantity" then 'Quantity变更' else '' end as "Change Description"
from prepared left join log on logged = o and l = "Line Number" """)
def consolidate_with_history_query(spark, sf):
    tables = con.sources(spark, sf)
    rows = consolidate_with_history(tables, con.RULE, con.RUN_DATE, RUN_CHANGES, run_log(tables), notes=False)
    return rows.select(
        "result_key", "status", "Part", "Quantity", "Choose Action", "Change Description"
    )


@query("repeated_run", f"""with {con.RESULT}
select s.status, count(r.status) as rows from (values ('Ready'), ('Incomplete'), ('Duplicate'), ('Conflict')) s(status)
left join (select case when status = 'Ready' then 'Duplicate' else status end as status from result) r on r.status = s.status
group by s.status""")
def repeated_run(spark, sf):
    tables = con.sources(spark, sf)
    rows = consolidate_with_history(
        tables, con.RULE, con.RUN_DATE, RUN_CHANGES, run_log(tables, edited=False), notes=False)
    return status_counts(rows)

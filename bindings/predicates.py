"""Text, number and date rules; filters; validation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from bindings import frames as fr
from bindings.registry import query
from recordloom.functions import (
    accepted,
    condition,
    describe_condition,
    is_blank,
    is_empty,
    map_values,
    to_number,
    trim_text,
)
from recordloom.operators import filters, validate
from recordloom.rules import ORD, ColumnRule, ImportRule

WORDS = ("NA", "N/A", "nan")


@query("text_normalization", f"""with {fr.PARTS}
select p_partkey, {fr.trim('v')} as trimmed, {fr.blank('v')} as blank, {fr.empty('v')} as empty from parts""")
def text_normalization(spark, sf):
    return fr.untidy_parts(spark, sf).select(
        "p_partkey", trim_text(F.col("v")).alias("trimmed"), is_blank(F.col("v")).alias("blank"),
        is_empty(F.col("v"), WORDS).alias("empty"),
    )


@query("number_parsing", f"""with {fr.PARTS}
select p_partkey, coalesce(cast(cast({fr.number('v')} as decimal(12,2)) as varchar), 'none') as parsed from parts""")
def number_parsing(spark, sf):
    parsed = to_number(F.col("v")).cast("decimal(12,2)").cast("string")
    return fr.untidy_parts(spark, sf).select(
        "p_partkey", F.coalesce(parsed, F.lit("none")).alias("parsed")
    )


def _flag(spec):
    return condition(spec, empty_words=WORDS)


@query("text_conditions", f"""with {fr.PARTS}
select p_partkey, {fr.trim('v')} = 'NA' as eq, {fr.trim('v')} <> 'NA' as ne,
  {fr.trim('v')} in ('NA', 'Brand#7') as listed, {fr.trim('v')} not in ('NA', 'Brand#7') as unlisted,
  {fr.empty('v')} as empty, not {fr.empty('v')} as filled from parts""")
def text_conditions(spark, sf):
    leaf = {
        "eq": {"column": "v", "operator": "equals", "value": "NA"},
        "ne": {"column": "v", "operator": "not_equals", "value": " NA "},
        "listed": {"column": "v", "operator": "in", "value": ["NA", "Brand#7"]},
        "unlisted": {"column": "v", "operator": "not_in", "value": ["NA", "Brand#7"]},
        "empty": {"column": "v", "operator": "is_empty"},
        "filled": {"column": "v", "operator": "is_not_empty"},
    }
    return fr.untidy_parts(spark, sf).select(
        "p_partkey", *[_flag(spec).alias(name) for name, spec in leaf.items()]
    )


def _number_sql(test: str) -> str:
    return f"coalesce({fr.number('v')} {test}, false)"


@query("number_conditions", f"""with {fr.PARTS}
select p_partkey, {_number_sql('= 1010')} as eq, {_number_sql('<> 1010')} as ne,
  {_number_sql('in (7.5, 1020)')} as listed, {_number_sql('not in (7.5, 1020)')} as unlisted,
  {_number_sql('> 20.5')} as gt, {_number_sql('>= 20.5')} as ge,
  {_number_sql('< 20.5')} as lt, {_number_sql('<= 20.5')} as le from parts""")
def number_conditions(spark, sf):
    def leaf(operator, value):
        return {"column": "v", "operator": operator, "value": value, "value_type": "number"}

    flags = {
        "eq": leaf("equals", "1,010"), "ne": leaf("not_equals", 1010),
        "listed": leaf("in", ["7.5", "1,020"]), "unlisted": leaf("not_in", ["7.5", "1,020"]),
        "gt": leaf("greater_than", 20.5), "ge": leaf("greater_or_equal", 20.5),
        "lt": leaf("less_than", 20.5), "le": leaf("less_or_equal", 20.5),
    }
    return fr.untidy_parts(spark, sf).select(
        "p_partkey", *[_flag(spec).alias(name) for name, spec in flags.items()]
    )


GROUPED = {"any": [
    {"all": [
        {"column": "v", "operator": "greater_than", "value": 1000, "value_type": "number"},
        {"column": "p_type", "operator": "in", "value": ["eco", "SMALL"]},
    ]},
    [{"column": "p_brand", "operator": "equals", "value": "Brand#7"},
     {"column": "v", "operator": "is_not_empty"}],
]}


@query("grouped_conditions", f"""with {fr.PARTS}
select p_partkey from parts where ({_number_sql('> 1000')} and {fr.trim('p_type')} in ('ECONOMY', 'SMALL'))
  or ({fr.trim('p_brand')} = 'Brand#7' and not {fr.empty('v')})""")
def grouped_conditions(spark, sf):
    maps = {"p_type": {"ECO": "ECONOMY"}}
    rows = fr.untidy_parts(spark, sf)
    return rows.where(condition(GROUPED, maps, WORDS)).select("p_partkey")


@query("condition_description", f"""with {fr.PARTS}
select p_partkey, 'Value = ' || {fr.trim('v')} || ' > 1000 且 Type = ' || {fr.trim('p_type')} || ' 属于 [ECONOMY SMALL] 且 Brand 不为空' as described
from parts""")
def condition_description(spark, sf):
    spec = [
        {"column": "v", "operator": "greater_than", "value": 1000, "value_type": "number"},
        {"column": "p_type", "operator": "in", "value": ["ECONOMY", "SMALL"]},
        {"column": "p_brand", "operator": "is_not_empty"},
    ]
    titles = {"v": "Value", "p_type": "Type", "p_brand": "Brand"}
    return fr.untidy_parts(spark, sf).select(
        "p_partkey", describe_condition(spec, titles.get, F.col).alias("described")
    )


@query("value_mapping", """select event_id, case event_type when 'click' then 'Click' when 'view' then 'View'
  else event_type end as mapped from events""")
def value_mapping(spark, sf):
    mapping = {"click": "Click", "view": "View", "error": " ", "Signup": "never"}
    mapped = map_values(F.col("event_type"), mapping)
    return fr.load(spark, sf, "events").select("event_id", mapped.alias("mapped"))


@query("accepted_values", f"""with {fr.PARTS}
select p_partkey, ({fr.trim('v')} = '' or lower({fr.trim('v')}) in ('na', 'brand#7', 'red widget')) as ok from parts""")
def accepted_values(spark, sf):
    ok = accepted(F.col("v"), ["na", " BRAND#7", "Red Widget"])
    return fr.untidy_parts(spark, sf).select("p_partkey", ok.alias("ok"))


TODAY = dt.date(1998, 6, 15)
_EXPIRES_SQL = """case l_partkey % 6 when 0 then strftime(l_shipdate, '%Y-%m-%d 00:00:00')
  when 1 then strftime(l_shipdate, '%Y/%m/%dT08:30:00') when 2 then strftime(l_shipdate, '%Y.%m.%d')
  when 3 then strftime(l_shipdate, '%Y%m%d') when 4 then strftime(l_shipdate, '%Y-02-30') else 'n/a' end"""


def dated_lines(spark, sf):
    kind = F.col("l_partkey") % 6
    d = F.col("l_shipdate")
    text = (
        F.when(kind == 0, F.date_format(d, "yyyy-MM-dd HH:mm:ss"))
        .when(kind == 1, F.date_format(d, "yyyy/MM/dd'T08:30:00'"))
        .when(kind == 2, F.date_format(d, "yyyy.MM.dd"))
        .when(kind == 3, F.date_format(d, "yyyyMMdd"))
        .when(kind == 4, F.date_format(d, "yyyy'-02-30'"))
        .otherwise("n/a")
    )
    return fr.load(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", text.alias("expires")
    )


@query("expiry_filter", f"""with dated as (select l_orderkey, l_linenumber, l_partkey, {_EXPIRES_SQL} as expires from lineitem)
select * from dated where coalesce({fr.date('expires')} >= date '1998-06-15', true)""")
def expiry_filter(spark, sf):
    return filters.drop_expired(dated_lines(spark, sf), "expires", TODAY)


@query("expiry_counts", f"""with dated as (select {_EXPIRES_SQL} as expires from lineitem),
flagged as (select coalesce({fr.date('expires')} < date '1998-06-15', false) as gone from dated)
select count(*) filter (where not gone) as kept, count(*) filter (where gone) as dropped from flagged""")
def expiry_counts(spark, sf):
    return filters.expiry_counts(dated_lines(spark, sf), "expires", TODAY)


@query("keyword_search", f"""with {fr.EVENTS}
select event_id, ts, user_id, event_type, value, props from events_t
where lower(event_type) like '%pur%' or lower(props) like '%pur%'""")
def keyword_search(spark, sf):
    found = filters.keyword_filter(fr.events_text(spark, sf), ["event_type", "props"], " PUR ")
    return found.drop(ORD)


@query("log_time_range", """with t as (select cast(event_id as varchar) as event_id, event_type,
  strftime(ts, '%Y/%m/%d %H:%M:%S') as log_time from events)
select * from t where log_time >= '2024/01/05 00:00:00' and log_time <= '2024/01/12 23:59:59'""")
def log_time_range(spark, sf):
    log = fr.load(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("event_id"), "event_type",
        F.date_format("ts", "yyyy/MM/dd HH:mm:ss").alias("log_time"),
    )
    return filters.time_range(log, "log_time", "2024/01/05 00:00:00", "2024/01/12 23:59:59")


@query("log_by_key", f"""with {fr.ORDERS}
select o_orderkey, o_custkey, o_orderdate from orders_t where o_custkey = '7'""")
def log_by_key(spark, sf):
    found = filters.by_key(fr.orders_text(spark, sf), "o_custkey", "7")
    return found.select("o_orderkey", "o_custkey", "o_orderdate")


@query("log_identities", f"with {fr.ORDERS} select o_custkey, o_orderkey from orders_t")
def log_identities(spark, sf):
    return filters.identity_projection(fr.orders_text(spark, sf), ["o_custkey", "o_orderkey"])


@query("complete_log_columns", f"""with {fr.PARTS}
select cast(p_partkey as varchar) as code, {fr.trim('v')} as v, '' as absent from parts""")
def complete_log_columns(spark, sf):
    log = fr.untidy_parts(spark, sf).select(F.col("p_partkey").cast("string").alias("code"), "v")
    return filters.complete_columns(log, ["code", "v", "absent"])


# --- validation ---

PURCHASE = {"column": "event_type", "operator": "in", "value": ["Purchase", "view"]}
EVENT_RULE = ImportRule(
    name="events", label="Events",
    columns=(
        ColumnRule("event_id", "Id", "required"),
        ColumnRule("event_type", "Type", "required", {"Purchase": "purchase"},
                   ("Click", "VIEW", "purchase", "signup")),
        ColumnRule("value", "Value", "required"),
        ColumnRule("props", "Properties", "required_if_applicable", required_when=PURCHASE),
    ),
)


def staged_events(spark, sf):
    """Some values blank, some properties blank, some rows blank throughout."""
    df = fr.events_text(spark, sf)
    i = F.col(ORD)
    hollow = i % 101 == 0

    def cell(name, gap, text):
        return F.when(hollow, "").when(gap, text).otherwise(F.col(name)).alias(name)

    return df.select(
        cell("event_id", F.lit(False), ""), cell("event_type", i % 17 == 0, " "),
        cell("value", i % 7 == 0, fr.WIDE_SPACE), cell("props", i % 5 == 0, fr.INVISIBLE),
        i.alias("row"), F.col(ORD),
    )


STAGED = f"""{fr.EVENTS}, staged as (select ord as row,
  case when ord % 101 = 0 then '' else event_id end as event_id,
  case when ord % 101 = 0 then '' when ord % 17 = 0 then ' ' else event_type end as event_type,
  case when ord % 101 = 0 then '' when ord % 7 = 0 then '{fr.WIDE_SPACE}' else value end as value,
  case when ord % 101 = 0 then '' when ord % 5 = 0 then '{fr.INVISIBLE}' else props end as props from events_t)"""
_DATA = " or ".join(f"not {fr.blank(c)}" for c in ("event_id", "event_type", "value", "props"))
REQUIRED = f"""required as (
  select row, 0 as position, 'event_id' as field, 'Id' as label from staged where ({_DATA}) and {fr.blank('event_id')}
  union all select row, 1, 'event_type', 'Type' from staged where ({_DATA}) and {fr.blank('event_type')}
  union all select row, 2, 'value', 'Value' from staged where ({_DATA}) and {fr.blank('value')})"""


@query("required_violations", f"with {STAGED}, {REQUIRED} select row as row_number, field, label from required")
def required_violations(spark, sf):
    found = validate.required_violations(staged_events(spark, sf), EVENT_RULE, "row")
    return found.select("row_number", "field", "label")


@query("conditional_violations", f"""with {STAGED}
select row as row_number, 'props' as field,
  'Type（event_type） = ' || {fr.trim('event_type')} || ' 属于 [purchase view]' as condition
from staged where {fr.trim('event_type')} in ('purchase', 'view') and {fr.blank('props')}""")
def conditional_violations(spark, sf):
    found = validate.conditional_violations(staged_events(spark, sf), EVENT_RULE, "row")
    return found.select("row_number", "field", "condition")


@query("accepted_violations", f"""with {STAGED}
select row as row_number, 'event_type' as field, {fr.trim('event_type')} as value, 'Click / VIEW / purchase / signup' as allowed
from staged where {fr.trim('event_type')} <> '' and lower({fr.trim('event_type')}) not in ('click', 'view', 'purchase', 'signup')""")
def accepted_violations(spark, sf):
    found = validate.accepted_violations(staged_events(spark, sf), EVENT_RULE, "row")
    return found.select("row_number", "field", "value", "allowed")


@query("violation_counts", f"""with {STAGED}, {REQUIRED}
select field, label, count(distinct row) as failed_rows from required group by field, label""")
def violation_counts(spark, sf):
    found = validate.required_violations(staged_events(spark, sf), EVENT_RULE, "row")
    return validate.violation_counts(found)


@query("failed_rows", f"with {STAGED}, {REQUIRED} select distinct row as row_number from required")
def failed_rows(spark, sf):
    found = validate.required_violations(staged_events(spark, sf), EVENT_RULE, "row")
    return validate.failed_rows(found)


@query("violation_summary", f"""with {STAGED}, {REQUIRED}
select count(distinct row) as failed_rows, count(*) as failed_cells from required""")
def violation_summary(spark, sf):
    found = validate.required_violations(staged_events(spark, sf), EVENT_RULE, "row")
    return validate.violation_summary(found)


@query("batch_gate", f"""with {STAGED}, {REQUIRED}
select 'required' as failed_check, count(*) as violations from required""")
def batch_gate(spark, sf):
    rows = staged_events(spark, sf)
    try:
        validate.batch_gate(EVENT_RULE.fields, rows, rows, rows, EVENT_RULE, "row")
    except validate.BatchRejected as rejected:
        counted = rejected.violations.agg(F.count("*").alias("violations"))
        return counted.select(F.lit(rejected.check).alias("failed_check"), "violations")
    return rows.agg(F.count("*").alias("violations")).select(
        F.lit("none").alias("failed_check"), "violations"
    )

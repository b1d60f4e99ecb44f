"""Review pages, dumps and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings import frames as fr
from bindings.registry import query
from recordloom.operators import review as rv
from recordloom.operators.filters import keyword_filter
from recordloom.rules import ORD
from recordloom.sources import exports as ex
from recordloom.sources.tables import as_text

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


@query("text_table", f"""with {fr.LINES}
select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag,
  l_linestatus, l_shipdate from lineitem_t""")
def text_table(spark, sf):
    return as_text(fr.load(spark, sf, "lineitem"), decimals=2)


@query("exact_text", f"""with {fr.EVENTS} select event_id, ts, user_id, event_type, value, props from events_t""")
def exact_text(spark, sf):
    return as_text(fr.load(spark, sf, "events"))


def _page(found):
    return found.rows.withColumns({
        "total": F.lit(found.total).cast("long"), "page_count": F.lit(found.page_count).cast("long"),
    })


@query("review_page", f"""with {fr.EVENTS}, found as (select * from events_t where lower(props) like '%7%' or lower(event_type) like '%7%')
select event_id, ts, event_type, props, (select count(*) from found) as total,
  (select greatest((count(*) + 99) // 100, 1) from found) as page_count
from found order by ts, ord limit 100 offset 100""")
def review_page(spark, sf):
    found = keyword_filter(fr.events_text(spark, sf), ["props", "event_type"], "7")
    page = rv.page(found, ["ts", ORD], 2)
    return _page(page).select("event_id", "ts", "event_type", "props", "total", "page_count")


@query("last_review_page", f"""with {fr.CUSTOMER}
select c_custkey, c_name, (select count(*) from customer) as total, (select greatest((count(*) + 99) // 100, 1) from customer) as page_count
from customer_t order by ord limit 100 offset (select greatest((count(*) + 99) // 100, 1) * 100 - 100 from customer)""")
def last_review_page(spark, sf):
    page = rv.page(fr.customer_text(spark, sf), [ORD], 10**9)
    return _page(page).select("c_custkey", "c_name", "total", "page_count")


AUDIT = f"""{fr.EVENTS}, audit as (select ts as at, 'user' || user_id as actor, '' as role, '' as username, '' as machine,
  event_type as action, '' as target, props as detail, 'ok' as result, ord from events_t)"""


def audit_table(spark, sf):
    """Audit entries appended from events; columns the event lacks are blank."""
    e = fr.events_text(spark, sf).select(
        F.col("ts").alias("at"), F.concat(F.lit("user"), "user_id").alias("actor"),
        F.col("event_type").alias("action"), F.col("props").alias("detail"), F.lit("ok").alias("result"), ORD,
    )
    empty = spark.createDataFrame([], ", ".join(f"`{c}` string" for c in ex.AUDIT_COLUMNS))
    return ex.audit_events(empty, e)


@query("append_audit", f"with {AUDIT} select * exclude (ord) from audit")
def append_audit(spark, sf):
    return audit_table(spark, sf).drop(ORD)


@query("newest_audit", f"""with {AUDIT} select * exclude (ord) from audit where action = 'purchase' or detail like '%purchase%'
order by ord desc limit 50 offset 50""")
def newest_audit(spark, sf):
    return rv.newest_first(audit_table(spark, sf), " Purchase", 2, 50).rows.drop(ORD)


@query("review_export", f"""with {fr.CUSTOMER} select c_custkey as "编号", c_name as "名称", c_acctbal as "余额" from customer_t""")
def review_export(spark, sf):
    labels = {"c_custkey": "编号", "c_name": "名称", "c_acctbal": "余额"}
    return ex.review_export(fr.customer_text(spark, sf), labels).drop(ORD)


@query("cell_dump", f"""with {fr.PARTS} select p_partkey as "row", 'v' as "column", v as text from parts where v <> ''
union all select p_partkey, 'p_brand', p_brand from parts union all select p_partkey, 'p_type', p_type from parts""")
def cell_dump(spark, sf):
    return ex.cell_dump(fr.untidy_parts(spark, sf), F.col("p_partkey"), ["v", "p_brand", "p_type"])


_ESCAPED = r"""replace(replace(replace(replace(text, '\', '\\'), chr(9), '\t'), chr(13), '\r'), chr(10), '\n')"""


@query("table_dump", f"""select cast(doc_id as varchar) || chr(9) || lang || chr(9) || {_ESCAPED} as line from documents""")
def table_dump(spark, sf):
    docs = as_text(fr.load(spark, sf, "documents").select("doc_id", "lang", "text"), ["doc_id"])
    return ex.table_dump(docs).orderBy(ORD).drop(ORD)


@query("log_dump", f"""with {fr.ORDERS}
select cast(to_json({{'log_time': '<log_time>', 'o_custkey': o_custkey, 'o_orderkey': o_orderkey, 'absent': '', 'o_orderpriority': o_orderpriority}}) as varchar) as entry
from orders_t""")
def log_dump(spark, sf):
    columns = ["log_time", "o_custkey", "o_orderkey", "absent", "o_orderpriority"]
    return ex.log_dump(fr.orders_text(spark, sf), columns).drop(ORD)


@query("source_counts", " union all ".join(
    f"select '{t}' as source, count(*) as rows from {t}" for t in TABLES
))
def source_counts(spark, sf):
    return rv.source_counts(spark, {t: fr.load(spark, sf, t) for t in TABLES})

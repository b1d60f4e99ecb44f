"""What is kept beside stored tables: newest records, page indexes, positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings import frames as fr
from bindings import history as hi
from bindings.registry import query
from recordloom.operators import review as rv
from recordloom.rules import ORD
from recordloom.session import new_path
from recordloom.sources.latest import merge_latest, read_latest
from recordloom.sources.tables import numbered


@query("maintained_latest", f"""with {hi.LATEST} select log_time, "Order", "Customer", "Price", "Priority", order_code from latest""")
def maintained_latest(spark, sf):
    """Four generations of the log, merged one after the other as they are appended."""
    root, log = new_path(spark, "latest"), hi.stored_log(spark, sf)
    for generation in (1, 2, 3, 4):
        grown = log.where(F.col(f"{ORD}.g") <= generation)
        place = F.col(f"{ORD}.g").cast("long") * F.lit(2**40) + F.col(f"{ORD}.i")
        merge_latest(spark, root, grown.withColumn(ORD, place), hi.IDENTITY, buckets=8)
    return read_latest(spark, root).select("log_time", "Order", "Customer", "Price", "Priority", "order_code")


@query("indexed_review_page", f"""with {fr.EVENTS}, pages as (select count(*) as total, greatest((count(*) + 99) // 100, 1) as page_count from events_t)
select event_id, ts, event_type, total, page_count from events_t, pages
order by ts, ord limit 100 offset (select least(7, page_count) * 100 - 100 from pages)""")
def indexed_review_page(spark, sf):
    """The seventh page of all events by time, from an index that an earlier page made."""
    root, events = new_path(spark, "index"), fr.events_text(spark, sf)
    rv.indexed_page(spark, rv.build_page_index(events, ["ts", ORD], root, "v1"), 1)
    page = rv.indexed_page(spark, rv.build_page_index(events, ["ts", ORD], root, "v1"), 7)
    return page.rows.select(
        "event_id", "ts", "event_type", F.lit(page.total).cast("long").alias("total"),
        F.lit(page.page_count).cast("long").alias("page_count"))


@query("position_diff", f"""with {fr.ORDERS}, l as (select *, row_number() over (order by ord) - 1 as position from orders_t),
r as (select o_orderkey, o_custkey, case when ord % 5 = 0 then '' else o_orderpriority end as o_orderpriority,
    row_number() over (order by again, ord) - 1 as position
  from (select *, 0 as again from orders_t union all select *, 1 from orders_t where ord % 1000 = 0)),
j as (select position, l.o_orderkey as k1, r.o_orderkey as k2, l.o_custkey as c1, r.o_custkey as c2, l.o_orderpriority as p1, r.o_orderpriority as p2
  from l full join r using (position))
select position, 'o_orderkey' as "column", k1 as left_value, k2 as right_value from j where k1 is distinct from k2
union all select position, 'o_custkey', c1, c2 from j where c1 is distinct from c2
union all select position, 'o_orderpriority', p1, p2 from j where p1 is distinct from p2""")
def position_diff(spark, sf):
    """Stored orders against a copy with blanked cells and some rows once more at its end, row by row."""
    names = ["o_orderkey", "o_custkey", "o_orderpriority"]
    left = fr.orders_text(spark, sf).select(*names, ORD)
    again = left.where(F.col(ORD) % 1000 == 0)
    blank = F.when(F.col(ORD) % 5 == 0, "").otherwise(F.col("o_orderpriority"))
    right = left.withColumn("again", F.lit(0)).unionByName(again.withColumn("again", F.lit(1))).withColumn("o_orderpriority", blank)
    paths = new_path(spark, "left"), new_path(spark, "right")
    left.orderBy(ORD).select(*names).write.parquet(paths[0])
    right.orderBy("again", ORD).select(*names).write.parquet(paths[1])
    return rv.position_diff(numbered(spark, paths[0]), numbered(spark, paths[1]))

"""Operators that write files and read them back, in the session's shared folder."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from bindings import frames as fr
from bindings.registry import query
from recordloom.rules import ORD, ColumnRule, ImportRule
from recordloom.session import new_path
from recordloom.sources import snapshots as sn
from recordloom.sources.delimited import read_headed
from recordloom.sources.tables import write_table

NAMES = ["o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus"]
LAYOUT = ImportRule("orders", tuple(ColumnRule(n, n) for n in NAMES), header_row=1, data_row=2)
NOW = dt.datetime(2026, 11, 1, 9, 30)


def _delimited(spark, sf, broken: bool):
    """Orders as delimited text, some cells with a quote and, if ``broken``, a line break; read back."""
    orders = fr.orders_text(spark, sf)
    mark = F.concat("o_orderpriority", F.lit('\n"x",' if broken else '"x",'))
    cells = orders.select(
        "o_orderkey", "o_custkey", F.when(F.col(ORD) % 3 == 0, mark).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"), "o_orderstatus")
    path = new_path(spark, "delimited")
    cells.write.option("header", True).option("escape", '"').csv(path)
    return read_headed(spark, path, LAYOUT, multi_line=broken).rows.drop(ORD)


def _delimited_sql(mark: str) -> str:
    return f"""with {fr.ORDERS} select o_orderkey, o_custkey,
  case when ord % 3 = 0 then o_orderpriority || {mark} else o_orderpriority end as o_orderpriority, o_orderstatus from orders_t"""


@query("delimited_lines", _delimited_sql("'\"x\",'"))
def delimited_lines(spark, sf):
    return _delimited(spark, sf, False)


@query("delimited_quoted_breaks", _delimited_sql("chr(10) || '\"x\",'"))
def delimited_quoted_breaks(spark, sf):
    return _delimited(spark, sf, True)


@query("written_table", f"""with {fr.CUSTOMER} select c_custkey, c_mktsegment from customer_t""")
def written_table(spark, sf):
    path = new_path(spark, "table")
    write_table(fr.customer_text(spark, sf), path, ["c_custkey", "c_mktsegment"])
    return spark.read.parquet(path).drop(ORD)


@query("published_snapshot", f"""with {fr.ORDERS} select o_orderkey, o_custkey, o_totalprice, o_orderstatus from orders_t""")
def published_snapshot(spark, sf):
    """Published twice with a change in between; the first version is fetched and verified."""
    names = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"]
    root, orders = new_path(spark, "snapshots"), fr.orders_text(spark, sf)
    first = sn.publish_snapshot(orders, root, "orders", NOW, "one", columns=names)
    changed = orders.withColumn("o_orderstatus", F.lit("X"))
    sn.publish_snapshot(changed, root, "orders", NOW + dt.timedelta(minutes=1), "two", columns=names)
    return sn.fetch_snapshot(spark, root, "orders", first.version)[1].select(*names)


@query("refused_snapshots", """select (select count(*) from orders) as rows, 'content hash differs' as tampered, 'no snapshot' as absent""")
def refused_snapshots(spark, sf):
    """What is said of a snapshot whose files were changed after publishing, and of one never published."""
    root, orders = new_path(spark, "snapshots"), fr.orders_text(spark, sf)
    entry = sn.publish_snapshot(orders, root, "orders", NOW, "one")
    orders.withColumn("o_orderkey", F.reverse("o_orderkey")).write.mode("overwrite").parquet(entry.path)
    said = []
    for version in (entry.version, "none"):
        try:
            sn.fetch_snapshot(spark, root, "orders", version)
            said.append("fetched")
        except sn.SnapshotError as error:
            said.append(next(x for x in ("content hash differs", "no snapshot", str(error)) if x in str(error)))
    rows = spark.read.parquet(entry.path).agg(F.count("*").alias("rows"))
    return rows.select("rows", F.lit(said[0]).alias("tampered"), F.lit(said[1]).alias("absent"))

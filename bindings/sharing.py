"""Snapshots and versions, on a publish history derived from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings import consolidation as con
from bindings import frames as fr
from bindings.registry import query
from recordloom.columns import data_columns
from recordloom.operators import versions as vs
from recordloom.rules import ORD
from recordloom.sources.snapshots import content_digest


def manifest(spark, sf):
    """One publish per order: seven sources, two of them to an area, four publishers."""
    o = fr.load(spark, sf, "orders")
    source = F.col("o_custkey") % 7
    at = F.col("o_orderdate") + F.make_dt_interval(mins=(F.col("o_orderkey") % 60).cast("int"))
    rows = o.select(
        F.concat(F.lit("src"), source).alias("source"),
        F.concat(F.lit("area"), F.floor(source / 2)).alias("area"),
        F.concat(F.lit("user"), F.col("o_custkey") % 4).alias("publisher"),
        at.alias("at"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("hash"),
    )
    return rows.select(
        "source", "area", "publisher",
        F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("published_at"),
        F.concat(F.date_format("at", "yyyyMMdd'T'HHmmss"), F.lit("-"), F.substring("hash", 1, 8)).alias("version"),
    )


MANIFEST = """manifest as (select 'src' || (o_custkey % 7) as source, 'area' || ((o_custkey % 7) // 2) as area,
  'user' || (o_custkey % 4) as publisher,
  strftime(o_orderdate + to_minutes(o_orderkey % 60), '%Y-%m-%d %H:%M:%S') as published_at,
  strftime(o_orderdate + to_minutes(o_orderkey % 60), '%Y%m%dT%H%M%S') || '-' || substr(sha256(cast(o_orderkey as varchar)), 1, 8) as version
  from orders)"""
CURRENT = f"""{MANIFEST}, current as (select source, version, published_at from (
  select *, row_number() over (partition by source order by published_at desc, version desc) as rn from manifest) where rn = 1)"""
EARLY = """early as (select source, version from (select *, row_number() over (partition by source order by published_at desc, version desc) as rn
  from manifest where published_at < '2001-07-20') where rn = 1 and source <> 'src6')"""


def current(spark, sf):
    return vs.current_versions(manifest(spark, sf))


def early(spark, sf):
    """Current versions at an earlier moment; one source is unknown there."""
    rows = manifest(spark, sf).where("published_at < '2001-07-20'")
    return vs.current_versions(rows).where("source <> 'src6'")


@query("current_versions", f"with {CURRENT} select source, version, published_at from current")
def current_versions(spark, sf):
    return current(spark, sf)


RETENTION = f"""{CURRENT}, {EARLY}, versions as (select distinct area, version from manifest),
protected as (select distinct 'area' || (cast(substr(source, 4) as bigint) // 2) as area, version
  from (select source, version from current union all select source, version from early)),
gone as (select area, version from (select *, row_number() over (partition by area order by version desc) as rn from versions) v
  where rn > 5 and not exists (select 1 from protected p where p.area = v.area and p.version = v.version))"""


def expired(spark, sf):
    areas = F.concat(F.lit("area"), F.floor(F.substring("source", 4, 9).cast("int") / 2))
    protected = vs.protected_versions(current(spark, sf), early(spark, sf), areas)
    return vs.retention(manifest(spark, sf), 5, protected)


@query("retention", f"with {RETENTION} select area, version from gone")
def retention(spark, sf):
    return expired(spark, sf)


@query("retention_counts", f"with {RETENTION} select area, count(*) as deleted from gone group by area")
def retention_counts(spark, sf):
    return vs.deleted_counts(expired(spark, sf))


RUNS = """runs as (select distinct case when o_orderstatus = 'P' then 'tmp-' else '' end ||
  strftime(o_orderdate, '%Y%m%dT%H%M%S') as run_id from orders)"""


@query("run_retention", f"""with {RUNS}, ids as (select run_id, row_number() over (order by run_id desc) as rn from runs
  where run_id not like 'tmp-%') select run_id from ids where rn > 5 and run_id <> '19970528T000000'""")
def run_retention(spark, sf):
    o = fr.load(spark, sf, "orders")
    prefix = F.when(F.col("o_orderstatus") == "P", "tmp-").otherwise("")
    runs = o.select(F.concat(prefix, F.date_format("o_orderdate", "yyyyMMdd'T'HHmmss")).alias("run_id"))
    return vs.run_retention(runs, 5, "19970528T000000")


SOURCES = """sources as (select 'src' || (n_nationkey % 9) as source from nation group by all)"""
STATUS = f"""{CURRENT}, {EARLY}, {SOURCES}, local as (select source, version from current where source < 'src3'
  union all select source, version from early where source >= 'src3'),
status as (select s.source, c.version is not null as published, coalesce(c.published_at, '') as published_at,
  coalesce(c.version, '') as current_version, coalesce(l.version, '') as local_version,
  coalesce(l.version = c.version, false) as aligned, c.version is not null and e.version is distinct from c.version as pending
  from sources s left join current c using (source) left join local l using (source) left join early e using (source))"""


def status(spark, sf):
    sources = fr.load(spark, sf, "nation").select(
        F.concat(F.lit("src"), F.col("n_nationkey") % 9).alias("source")
    ).distinct()
    now, before = current(spark, sf), early(spark, sf)
    local = now.where("source < 'src3'").unionByName(before.where("source >= 'src3'"))
    return vs.version_status(sources, now, local, before)


@query("version_status", f"with {STATUS} select * from status")
def version_status(spark, sf):
    return status(spark, sf)


@query("unaligned_sources", f"""with {STATUS}
select source, case when published then 'not aligned' else 'not published' end as reason from status where not aligned""")
def unaligned_sources(spark, sf):
    return vs.unaligned_sources(status(spark, sf))


@query("recent_publishes", f"""with {CURRENT} select source, version, published_at from current
where strptime(published_at, '%Y-%m-%d %H:%M:%S') > timestamp '2001-08-02 00:00:00' - interval 1440 minutes""")
def recent_publishes(spark, sf):
    return vs.recent_publishes(current(spark, sf), "2001-08-02 00:00:00", 1440)


@query("overwritten_recently", f"""with {MANIFEST}, seen as (select *,
  lag(version) over w as replaced_version, lag(publisher) over w as replaced_publisher, lag(published_at) over w as before
  from manifest window w as (partition by source order by published_at, version, publisher))
select source, version, publisher, published_at, replaced_version, replaced_publisher from seen
where replaced_version <> version and replaced_publisher <> publisher
  and strptime(before, '%Y-%m-%d %H:%M:%S') > strptime(published_at, '%Y-%m-%d %H:%M:%S') - interval 10 minutes""")
def overwritten_recently(spark, sf):
    return vs.overwritten_recently(manifest(spark, sf))


@query("version_drift", f"""with {CURRENT}, {EARLY}
select source, coalesce(e.version, '') as start_version, coalesce(c.version, '') as end_version
from early e full join current c using (source) where e.version is distinct from c.version""")
def version_drift(spark, sf):
    return vs.version_drift(early(spark, sf), current(spark, sf))


@query("upsert_sync", f"""with {CURRENT}, {EARLY}
select source, version from current where source >= 'src4' union all
select source, version from early where source not in (select source from current where source >= 'src4')""")
def upsert_sync(spark, sf):
    new = current(spark, sf).where("source >= 'src4'").select("source", "version")
    return vs.upsert_sync(early(spark, sf).select("source", "version"), new)


@query("run_record", f"""with {con.RESULT}, {CURRENT}
select '20261013T093000' as run_id, '2026-10-13 09:30:00' as at, 'operator' as "by",
  (select string_agg(source || '=' || version, ',' order by source) from current) as versions,
  count(*) filter (where status = 'Ready') as ready, count(*) filter (where status = 'Incomplete') as incomplete,
  count(*) filter (where status = 'Duplicate') as duplicate, count(*) filter (where status = 'Conflict') as conflict from result""")
def run_record(spark, sf):
    rows = con.consolidated(spark, sf)
    return vs.run_record(rows, current(spark, sf), "20261013T093000", "2026-10-13 09:30:00", "operator")


_LINE_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]
_TEXT = " || ".join(f"cast(length({c}) as varchar) || ':' || {c}" for c in _LINE_COLUMNS)
_SUM = ", ".join(
    f"cast(sum(cast(cast('0x' || substr(h, {1 + 16 * i}, 16) as ubigint) as hugeint)) as varchar) as s{i}" for i in range(4)
)


@query("snapshot_digest", f"""with {fr.LINES}, hashed as (select sha256({_TEXT}) as h from lineitem_t),
sums as (select count(*) as rows, {_SUM} from hashed),
digest as (select rows, sha256('{",".join(_LINE_COLUMNS)}' || '|' || cast(rows as varchar) || '|' || s0 || '|' || s1 || '|' || s2 || '|' || s3) as sha256 from sums)
select rows, sha256, '20261101T093000-' || substr(sha256, 1, 8) as version from digest""")
def snapshot_digest(spark, sf):
    df = fr.lineitem_text(spark, sf)
    found = content_digest(df, data_columns(df.drop(ORD)))
    version = F.concat(F.lit("20261101T093000-"), F.substring("sha256", 1, 8))
    return found.withColumn("version", version)


@query("snapshot_verification", """select count(*) as rows, true as same_digest, false as same_after_edit from lineitem""")
def snapshot_verification(spark, sf):
    """The digest survives a repartition and notices a changed cell."""
    df = fr.lineitem_text(spark, sf).drop(ORD)
    one = content_digest(df, df.columns)
    again = content_digest(df.repartition("l_suppkey"), df.columns)
    edited = F.when(F.col("l_partkey") == "1", "X").otherwise(F.col("l_linestatus"))
    other = content_digest(df.withColumn("l_linestatus", edited), df.columns)
    both = one.join(again.toDF("rows", "again"), "rows").join(other.toDF("rows", "other"), "rows")
    return both.select(
        "rows", (F.col("sha256") == F.col("again")).alias("same_digest"),
        (F.col("sha256") == F.col("other")).alias("same_after_edit"),
    )

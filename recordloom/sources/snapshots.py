"""Published snapshots: a Parquet directory per version and a manifest entry written last.

The manifest is a commit log: the last entry of a source is its current version, whatever
the clocks of two publishers say.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from recordloom.columns import col, data_columns
from recordloom.rules import ORD
from recordloom.sources.commits import append_commit, read_commits

MANIFEST_SCHEMA = (
    "source string, area string, version string, format string, columns array<string>, "
    "rows long, cleaned_rows long, sha256 string, app_version string, publisher string, "
    "published_at string, path string, buckets array<struct<bucket:int,rows:long,sha256:string>>"
)
BUCKET = "_bucket"
_SLICES = 4
_SLICE_WIDTH = 16


class SnapshotError(ValueError):
    """The stored snapshot is not what its manifest says."""


def content_digest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row ``(rows, sha256)``, the same for the same multiset of rows.

    A hash per row over length-prefixed cells, cut into slices that are summed as
    decimals; one more hash over the column list, the row count and the sums. No
    sort and no gathering, so it is one pass with a one-row shuffle.
    """
    return _hashed_rows(df, columns).agg(*_sums()).select("rows", _whole(columns).alias("sha256"))


def bucket_digests(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(bucket, rows, sha256)`` of rows that carry their bucket; the row order counts here, if there is one."""
    named = [*columns, ORD] if ORD in df.columns else list(columns)
    cells = df.withColumn(ORD, F.to_json(F.struct(ORD))) if ORD in df.columns else df
    hashed = _hashed_rows(cells, named, F.col(BUCKET))
    return hashed.groupBy(BUCKET).agg(*_sums()).select(F.col(BUCKET).alias("bucket"), "rows", _whole(named).alias("sha256"))


def _hashed_rows(df: DataFrame, columns: Sequence[str], *kept: Column) -> DataFrame:
    cells = [F.coalesce(col(c), F.lit("")) for c in columns]
    text = F.concat(*[
        part for c in cells for part in (F.length(c).cast("string"), F.lit(":"), c)
    ])
    return df.select(*kept, F.sha2(text, 256).alias("h"))


def _sums() -> list[Column]:
    slices = [
        F.conv(F.substring("h", 1 + i * _SLICE_WIDTH, _SLICE_WIDTH), 16, 10).cast("decimal(28,0)")
        for i in range(_SLICES)
    ]
    sums = [F.coalesce(F.sum(s), F.lit(0)).cast("decimal(38,0)").alias(f"s{i}") for i, s in enumerate(slices)]
    return [F.count("*").alias("rows"), *sums]


def _whole(columns: Sequence[str]) -> Column:
    text = F.concat_ws(
        "|", F.lit(",".join(columns)), F.col("rows").cast("string"),
        *[F.col(f"s{i}").cast("string") for i in range(_SLICES)],
    )
    return F.sha2(text, 256)


def version_text(now: dt.datetime, sha256: str) -> str:
    return f"{now:%Y%m%dT%H%M%S}-{sha256[:8]}"


def publish_snapshot(
    df: DataFrame, root: str, source: str, now: dt.datetime, publisher: str,
    area: str | None = None, columns: Sequence[str] | None = None, cleaned_rows: int = 0,
    app_version: str = "", buckets: int = 0, bucket_by: Sequence[str] = (),
) -> Row:
    """Write the table, read it back for its digest, then commit the manifest entry.

    The version becomes current with the entry, so a failed write never shows; of two
    publishers at one moment the later entry wins. The digest describes the stored
    files, not a second run of the plan.

    With ``buckets`` the files lie in so many directories, by a hash of ``bucket_by`` (all
    columns, if none are named), and the entry has a digest for each: a consumer then
    fetches only those that it does not hold.
    """
    columns = list(columns or data_columns(df))
    if not source or not columns:
        raise ValueError("source and columns are required")
    spark = df.sparkSession
    area = area or source
    path = f"{root}/published/{area}/{now:%Y%m%dT%H%M%S}-{uuid.uuid4().hex}"
    kept = columns + ([ORD] if ORD in df.columns else [])
    rows, held = df.select(*[col(c) for c in kept]), None
    if buckets:
        by = [F.coalesce(col(c), F.lit("")) for c in bucket_by or columns]
        rows = rows.withColumn(BUCKET, F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int"))
        rows.write.partitionBy(BUCKET).parquet(path)
        written = spark.read.schema(rows.schema).parquet(path)
        held = [r.asDict() for r in bucket_digests(written, columns).orderBy("bucket").collect()]
    else:
        rows.write.parquet(path)
        written = spark.read.schema(rows.schema).parquet(path)
    found = content_digest(written, columns).first()
    entry = dict(
        source=source, area=area, version=version_text(now, found.sha256), format="parquet",
        columns=columns, rows=found.rows, cleaned_rows=cleaned_rows, sha256=found.sha256,
        app_version=app_version, publisher=publisher,
        published_at=f"{now:%Y-%m-%d %H:%M:%S}", path=path, buckets=held,
    )
    number = append_commit(spark, f"{root}/manifest", entry)
    return Row(**entry, commit=number)


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """All manifest entries with their ``commit``; a store nobody published to reads as empty."""
    return read_commits(spark, f"{root}/manifest", MANIFEST_SCHEMA)


def fetch_snapshot(
    spark: SparkSession, root: str, source: str, version: str
) -> tuple[Row, DataFrame]:
    """The manifest row and the verified rows; any mismatch raises, never an older version."""
    wanted = (F.col("source") == source) & (F.col("version") == version)
    entries = read_manifest(spark, root).where(wanted).orderBy(F.desc("commit")).limit(1).collect()
    if not entries:
        raise SnapshotError(f"no snapshot {source}/{version}")
    entry = entries[0]
    df = spark.read.parquet(entry.path).drop(BUCKET)
    verify_snapshot(df, entry)
    return entry, df


def fetch_buckets(
    spark: SparkSession, root: str, source: str, version: str, cache: str
) -> tuple[Row, DataFrame, int]:
    """The manifest row, the rows of a version, and how many of its buckets had to be fetched.

    Buckets are kept below ``cache`` by their digest, so only those that no earlier version
    brought are read from the published files and verified, in one pass; any mismatch raises
    and nothing of it is kept. A version without buckets is fetched whole.
    """
    wanted = (F.col("source") == source) & (F.col("version") == version)
    entry = read_manifest(spark, root).where(wanted).orderBy(F.desc("commit")).first()
    if entry is None or not entry.buckets:
        return *fetch_snapshot(spark, root, source, version), 0
    held = _cached(spark, cache)
    missing = [b for b in entry.buckets if b.sha256 not in held]
    if missing:
        published = spark.read.option("basePath", entry.path).parquet(*[f"{entry.path}/{BUCKET}={b.bucket}" for b in missing])
        columns = [c for c in data_columns(published) if c != BUCKET]
        if set(columns) != set(entry.columns):
            raise SnapshotError(f"{entry.version}: column names differ from the manifest")
        found = {r.bucket: (r.rows, r.sha256) for r in bucket_digests(published, entry.columns).collect()}
        if found != {b.bucket: (b.rows, b.sha256) for b in missing}:
            raise SnapshotError(f"{entry.version}: content hash differs, publish again")
        path = f"{cache}/data/{uuid.uuid4().hex}"
        published.write.partitionBy(BUCKET).parquet(path)
        append_commit(spark, f"{cache}/index", {
            "buckets": [{"sha256": b.sha256, "path": f"{path}/{BUCKET}={b.bucket}"} for b in missing]})
        held = _cached(spark, cache)
    paths = [held[b.sha256] for b in entry.buckets]
    rows = spark.read.parquet(*paths)
    return entry, rows.select(*[c for c in (*entry.columns, ORD) if c in rows.columns]), len(missing)


def _cached(spark: SparkSession, cache: str) -> dict[str, str]:
    """Digest to path of the buckets that are kept: one entry for each bucket ever fetched."""
    entries = read_commits(spark, f"{cache}/index", "buckets array<struct<sha256:string,path:string>>")
    return {r.sha256: r.path for r in entries.select(F.inline("buckets")).collect()}


def verify_snapshot(df: DataFrame, entry: Row) -> None:
    columns = data_columns(df)
    if len(columns) != len(entry.columns):
        raise SnapshotError(f"{entry.version}: {len(columns)} columns, manifest has {len(entry.columns)}")
    if set(columns) != set(entry.columns):
        raise SnapshotError(f"{entry.version}: column names differ from the manifest")
    found = content_digest(df, entry.columns).first()
    if found.sha256 != entry.sha256 or not entry.version.endswith(found.sha256[:8]):
        raise SnapshotError(f"{entry.version}: content hash differs, publish again")
    if found.rows != entry.rows:
        raise SnapshotError(f"{entry.version}: {found.rows} rows, manifest has {entry.rows}")


def delete_versions(spark: SparkSession, root: str, deleted: DataFrame) -> int:
    """Remove the data of the versions ``(area, version)`` and report how many went.

    The paths come one at a time; manifest rows stay as history.
    """
    paths = (
        read_manifest(spark, root).join(deleted, ["area", "version"], "left_semi")
        .select("path").distinct()
    )
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    for row in paths.toLocalIterator():
        path = hadoop(row.path)
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone

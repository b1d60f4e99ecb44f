"""Publishing a source and aligning a consumer with a published version."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from recordloom.columns import data_columns
from recordloom.operators.clean import clean
from recordloom.operators.filters import drop_expired
from recordloom.operators.log import align_schema
from recordloom.operators.versions import (
    current_versions,
    deleted_counts,
    retention,
    upsert_sync,
)
from recordloom.rules import ImportRule
from recordloom.session import stable
from recordloom.sources.snapshots import delete_versions, fetch_buckets, fetch_snapshot, read_manifest
from recordloom.sources.tables import write_table

SYNC_SCHEMA = (
    "source string, version string, sha256 string, rows long, synced_at string, synced_by string"
)


def current_version(spark: SparkSession, root: str, source: str) -> str | None:
    found = current_versions(read_manifest(spark, root).where(F.col("source") == source)).first()
    return None if found is None else found.version


def sync_source(
    spark: SparkSession, root: str, source: str, rule: ImportRule, today: dt.date, now: str,
    who: str, raw_path: str, cleaned_path: str, version: str | None = None, cache: str | None = None,
) -> Row:
    """Fetch and verify a version, drop expired rows, store, clean again, report the record.

    A version that fails verification stops here; an older one is never used. With ``cache``
    only the buckets that no earlier version brought are fetched.
    """
    version = version or current_version(spark, root, source)
    if version is None:
        raise ValueError(f"{source} has not been published")
    if cache is None:
        entry, df = fetch_snapshot(spark, root, source, version)
    else:
        entry, df, _ = fetch_buckets(spark, root, source, version, cache)
    if rule.expiry_field:
        df = drop_expired(df, rule.expiry_field, today)
    write_table(df, raw_path, list(entry.columns))
    stored = spark.read.parquet(raw_path)
    if rule.clean:
        cleaned = clean(align_schema(stored, rule.fields), rule.clean)
        write_table(cleaned, cleaned_path, [c for c in data_columns(cleaned) if c in rule.fields])
    return Row(
        source=source, version=version, sha256=entry.sha256, rows=stored.count(),
        synced_at=now, synced_by=who,
    )


def save_sync(records: DataFrame, entry: Row) -> DataFrame:
    """The sync table with the record of one source replaced."""
    one = records.sparkSession.createDataFrame([tuple(entry)], SYNC_SCHEMA)
    return upsert_sync(records, one)


def expire_snapshots(
    spark: SparkSession, root: str, keep: int, last_run: DataFrame
) -> DataFrame:
    """Delete old versions; deleted entries per area."""
    manifest = read_manifest(spark, root)
    areas = manifest.select("source", "area").distinct()
    used = current_versions(manifest).select("source", "version").unionByName(
        last_run.select("source", "version")
    )
    protected = used.join(areas, "source").select("area", "version").distinct()
    gone = stable(retention(manifest, keep, protected))
    delete_versions(spark, root, gone)
    return deleted_counts(gone)


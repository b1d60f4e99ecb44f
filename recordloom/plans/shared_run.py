"""A consolidation over published sources: aligned, pinned, compared at its end, recorded.

No lock is held. A consumer reads immutable tables of the versions that it aligned with,
so a run sees one state of every source from its first job to its last; what was
published meanwhile is found afterwards by comparing versions.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from recordloom.operators.versions import (
    alignment_gate,
    current_versions,
    drift_action,
    recent_gate,
    version_drift,
    version_status,
)
from recordloom.plans.results import StoredResult, store_result
from recordloom.plans.sharing import SYNC_SCHEMA, sync_source
from recordloom.rules import STATUSES, ChangeRule, ImportRule
from recordloom.sources.commits import append_commit, newest, read_commits
from recordloom.sources.snapshots import read_manifest

RUN_SCHEMA = "run_id string, at string, by string, versions string, result string, action string, " + ", ".join(
    f"{s.lower()} long" for s in STATUSES)
#: What a run says when sources changed meanwhile, by action.
NOTICES = {
    "none": "",
    "warn": "Sources were published during the run; align and run again.",
    "block": "Sources were published during the run; this result holds the versions it began with only.",
    "auto_rerun": "Sources were published during the run; aligned and run again once.",
}


@dataclass(frozen=True)
class SharedStore:
    """Where sources are published, and where this consumer keeps its aligned tables and sync records."""

    root: str
    local: str

    def tables_path(self, source: str, version: str, cleaned: bool) -> str:
        return f"{self.local}/tables/{source}/{version}/{'cleaned' if cleaned else 'raw'}"


@dataclass(frozen=True)
class RunOutcome:
    """One run: the stored result, the versions it read, what was decided about drift."""

    result: StoredResult
    versions: Mapping[str, str]
    action: str
    notice: str


Consolidate = Callable[[Mapping[str, DataFrame]], DataFrame]


def synced_versions(spark: SparkSession, store: SharedStore) -> DataFrame:
    """The last sync record of each source."""
    return newest(read_commits(spark, f"{store.local}/sync", SYNC_SCHEMA), "source").drop("commit")


def last_run_versions(spark: SparkSession, store: SharedStore) -> DataFrame:
    """``(source, version)`` that the last recorded run used."""
    runs = read_commits(spark, f"{store.root}/runs", RUN_SCHEMA)
    last = runs.agg(F.max(F.struct("commit", "versions"))["versions"].alias("versions"))
    pair = F.explode(F.split("versions", ",")).alias("pair")
    return last.select(pair).where("pair <> ''").select(
        F.substring_index("pair", "=", 1).alias("source"), F.substring_index("pair", "=", -1).alias("version"))


def shared_status(spark: SparkSession, store: SharedStore, sources: Sequence[str]) -> DataFrame:
    """Per configured source: current and local version, aligned, pending."""
    listed = spark.createDataFrame([(s,) for s in sources], "source string")
    current = current_versions(read_manifest(spark, store.root))
    return version_status(listed, current, synced_versions(spark, store), last_run_versions(spark, store))


def align(
    spark: SparkSession, store: SharedStore, rules: Mapping[str, ImportRule], today: dt.date, now: str, who: str,
) -> list[Row]:
    """Fetch every source that lags behind: verified, expired rows dropped, cleaned again, recorded.

    Tables of a version that this consumer had before are written again under a name of
    their own, never over what a run may be reading.
    """
    behind = shared_status(spark, store, list(rules)).where("published and not aligned").orderBy("source").collect()
    done = []
    for row in behind:
        source, version = row.source, row.current_version
        place = f"{version}@{now.replace(' ', 'T').replace(':', '')}"
        entry = sync_source(
            spark, store.root, source, rules[source], today, now, who,
            store.tables_path(source, place, False), store.tables_path(source, place, True), version, f"{store.local}/cache/{source}")
        record = {**entry.asDict(), "place": place}
        append_commit(spark, f"{store.local}/sync", record)
        done.append(entry)
    return done


def pinned_tables(
    spark: SparkSession, store: SharedStore, rules: Mapping[str, ImportRule], versions: Mapping[str, str],
) -> dict[str, DataFrame]:
    """The local tables of these versions, cleaned where the source has a clean rule."""
    records = newest(read_commits(spark, f"{store.local}/sync", SYNC_SCHEMA + ", place string"), "source", "version")
    places = {(r.source, r.version): r.place for r in records.collect()}
    return {
        s: spark.read.parquet(store.tables_path(s, places[s, v], rules[s].clean is not None)) for s, v in versions.items()}


def shared_run(
    spark: SparkSession, store: SharedStore, rules: Mapping[str, ImportRule], consolidate: Consolidate,
    policy: str, run_id: str, today: dt.date, now: Callable[[], str], by: str, changes: ChangeRule | None = None,
) -> RunOutcome:
    """Gate, pin, run, compare, record.

    Unaligned or unpublished sources refuse the run; so does a publish of the last minutes
    under ``block``. When versions changed meanwhile, ``block`` and ``warn`` keep the result
    of the pinned versions and say so, ``auto_rerun`` aligns and runs once more. The result
    is written once per run of the plan, and its counts go to the run's record.
    """
    alignment_gate(shared_status(spark, store, list(rules)))
    current = current_versions(read_manifest(spark, store.root)).where(F.col("source").isin(list(rules)))
    recent_gate(current, now(), policy)
    start = _local_versions(spark, store, rules)

    def run(versions: Mapping[str, str], turn: int) -> StoredResult:
        result = consolidate(pinned_tables(spark, store, rules, versions))
        return store_result(result, f"{store.root}/consolidated/{run_id}/{turn}", changes)

    result, used = run(start, 1), start
    begun = spark.createDataFrame(list(start.items()), "source string, version string")
    now_current = current_versions(read_manifest(spark, store.root)).where(F.col("source").isin(list(rules)))
    action = drift_action(version_drift(begun, now_current), policy)
    if action == "auto_rerun":
        align(spark, store, rules, today, now(), by)
        used = _local_versions(spark, store, rules)
        result = run(used, 2)
    record_run(spark, store, result, used, action, run_id, now(), by)
    return RunOutcome(result, used, action, NOTICES[action])


def record_run(
    spark: SparkSession, store: SharedStore, result: StoredResult, versions: Mapping[str, str],
    action: str, run_id: str, at: str, by: str,
) -> int:
    """Commit the run's record: versions used and counts by status, from the result's own write."""
    return append_commit(spark, f"{store.root}/runs", {
        "run_id": run_id, "at": at, "by": by, "result": result.path, "action": action,
        "versions": ",".join(f"{s}={v}" for s, v in sorted(versions.items())),
        **{s.lower(): n for s, n in result.counts.items()}})


def _local_versions(spark: SparkSession, store: SharedStore, rules: Mapping[str, ImportRule]) -> dict[str, str]:
    rows = synced_versions(spark, store).where(F.col("source").isin(list(rules))).collect()
    return {r.source: r.version for r in rows}

"""Published versions: retention, alignment, recent and overwriting publishes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.columns import col
from recordloom.rules import STATUSES

WINDOW_MINUTES = 10
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


class NotAligned(ValueError):
    """A source is unpublished or not aligned with the current version."""


class RecentPublish(ValueError):
    """A source was published moments ago and the policy says wait."""


def _place(manifest: DataFrame) -> list[str]:
    """What orders the publishes of a source: the commit number, or else time and version."""
    return ["commit"] if "commit" in manifest.columns else ["published_at", "version"]


def current_versions(manifest: DataFrame) -> DataFrame:
    """``(source, version, published_at)``: the newest publish of each source.

    A committed manifest knows which came last, also of two in one second.
    """
    newest = F.struct(*dict.fromkeys([*_place(manifest), "published_at", "version"]))
    return (
        manifest.groupBy("source")
        .agg(F.max(newest).alias("_new"))
        .select("source", "_new.version", "_new.published_at")
    )


def retention(
    manifest: DataFrame, keep: int, protected: DataFrame | None = None, area: str = "area"
) -> DataFrame:
    """``(area, version)`` to delete: all but the newest ``keep`` and the protected ones.

    What stays is ranked with a bounded filter and what goes is an anti join, so
    an area with very many versions is never sorted in one task.
    """
    keep = keep if keep >= 1 else 5
    last = F.max("commit" if "commit" in manifest.columns else "version").alias("_last")
    versions = manifest.groupBy(col(area).alias("area"), "version").agg(last)
    order = Window.partitionBy("area").orderBy(F.desc("_last"), F.desc("version"))
    kept = versions.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= keep)
    gone = versions.drop("_last").join(kept.select("area", "version"), ["area", "version"], "left_anti")
    if protected is not None:
        gone = gone.join(protected.select("area", "version"), ["area", "version"], "left_anti")
    return gone


def protected_versions(current: DataFrame, last_run: DataFrame, areas: Column) -> DataFrame:
    """Current versions and those of the last run, by area (``areas`` maps ``source``)."""
    both = current.select("source", "version").unionByName(last_run.select("source", "version"))
    return both.where("version <> ''").select(areas.alias("area"), "version").distinct()


def run_retention(runs: DataFrame, keep: int, last_run: str = "") -> DataFrame:
    """``run_id`` to delete: well-formed ids beyond the newest ``keep``, never the last run's."""
    keep = keep if keep >= 1 else 5
    ids = runs.select("run_id").where(F.col("run_id").rlike(r"\A[0-9]{8}T[0-9]{6}\z")).distinct()
    kept = ids.orderBy(F.desc("run_id")).limit(keep)
    return ids.join(kept, "run_id", "left_anti").where(F.col("run_id") != last_run)


def deleted_counts(deleted: DataFrame, area: str = "area") -> DataFrame:
    """Deleted entries per area."""
    return deleted.groupBy(col(area).alias("area")).agg(F.count("*").alias("deleted"))


def version_status(
    sources: DataFrame, current: DataFrame, local: DataFrame, last_run: DataFrame
) -> DataFrame:
    """Per source: published time, aligned, pending."""
    published = current.select("source", F.col("version").alias("current_version"), "published_at")
    synced = local.select("source", F.col("version").alias("local_version"))
    used = last_run.select("source", F.col("version").alias("run_version"))
    joined = (
        sources.select("source")
        .join(published, "source", "left")
        .join(synced, "source", "left")
        .join(used, "source", "left")
    )
    known = F.col("current_version").isNotNull()
    aligned = known & (F.coalesce("local_version", F.lit("")) != "") & (
        F.col("local_version") == F.col("current_version")
    )
    pending = known & ~F.col("run_version").eqNullSafe(F.col("current_version"))
    return joined.select(
        "source",
        known.alias("published"),
        F.coalesce("published_at", F.lit("")).alias("published_at"),
        F.coalesce("current_version", F.lit("")).alias("current_version"),
        F.coalesce("local_version", F.lit("")).alias("local_version"),
        F.coalesce(aligned, F.lit(False)).alias("aligned"),
        pending.alias("pending"),
    )


def unaligned_sources(status: DataFrame) -> DataFrame:
    """``(source, reason)`` of every source that blocks a run."""
    reason = F.when(~F.col("published"), "not published").otherwise("not aligned")
    same = F.col("local_version") == F.col("current_version")
    return status.where(~F.col("published") | ~same).select("source", reason.alias("reason"))


def alignment_gate(status: DataFrame) -> None:
    """Raise with the blocking sources (one row per configured source)."""
    found = unaligned_sources(status).orderBy("source").collect()
    if found:
        raise NotAligned(", ".join(f"{row.source} ({row.reason})" for row in found))


def recent_publishes(current: DataFrame, now: str, minutes: int = WINDOW_MINUTES) -> DataFrame:
    """Sources published less than ``minutes`` before ``now``."""
    age = _seconds(F.lit(now)) - _seconds(F.col("published_at"))
    return current.where(age < minutes * 60).select("source", "version", "published_at")


def recent_gate(current: DataFrame, now: str, policy: str, minutes: int = WINDOW_MINUTES) -> None:
    """The ``block`` policy refuses to start right after a publish."""
    if policy != "block":
        return
    found = recent_publishes(current, now, minutes).orderBy("source").collect()
    if found:
        raise RecentPublish(", ".join(f"{row.source} ({row.published_at})" for row in found))


def overwritten_recently(manifest: DataFrame, minutes: int = WINDOW_MINUTES) -> DataFrame:
    """Publishes that replaced another publisher's different version within ``minutes``.

    Only the previous publish inside the time limit matters, so rows are cut into
    spans of that length and each span's last row is also handed to the next
    span: a source with very many publishes is spread over its spans.
    """
    span = F.floor(_seconds(F.col("published_at")) / (minutes * 60))
    tie = F.col("commit") if "commit" in manifest.columns else F.lit(0)
    rows = manifest.select("source", "version", "publisher", "published_at", span.alias("_span"), tie.alias("_tie"))
    event = F.struct("published_at", "_tie", "version", "publisher")
    carried = (
        rows.groupBy("source", "_span")
        .agg(F.max(event).alias("_e"))
        .select(
            "source", "_e.version", "_e.publisher", "_e.published_at",
            (F.col("_span") + 1).alias("_span"), F.col("_e._tie").alias("_tie"), F.lit(True).alias("_carried"),
        )
    )
    both = rows.withColumn("_carried", F.lit(False)).unionByName(carried)
    order = Window.partitionBy("source", "_span").orderBy("published_at", "_tie", "version", "publisher")
    previous = F.lag(F.struct("version", "publisher", "published_at")).over(order)
    seen = both.withColumn("_prev", previous).where(~F.col("_carried"))
    close = _seconds(F.col("published_at")) - _seconds(F.col("_prev.published_at")) < minutes * 60
    return seen.where(
        F.col("_prev").isNotNull()
        & (F.col("_prev.version") != F.col("version"))
        & (F.col("_prev.publisher") != "")
        & (F.col("_prev.publisher") != F.col("publisher"))
        & close
    ).select(
        "source", "version", "publisher", "published_at",
        F.col("_prev.version").alias("replaced_version"),
        F.col("_prev.publisher").alias("replaced_publisher"),
    )


def version_drift(start: DataFrame, end: DataFrame) -> DataFrame:
    """Sources whose version changed, appeared or vanished between two readings."""
    before = start.where("version <> ''").select("source", F.col("version").alias("start_version"))
    after = end.where("version <> ''").select("source", F.col("version").alias("end_version"))
    joined = before.join(after, "source", "full_outer")
    return joined.where(~F.col("start_version").eqNullSafe(F.col("end_version"))).select(
        "source",
        F.coalesce("start_version", F.lit("")).alias("start_version"),
        F.coalesce("end_version", F.lit("")).alias("end_version"),
    )


def drift_action(drift: DataFrame, policy: str) -> str:
    """``none`` without drift, else ``block``, ``auto_rerun`` or ``warn`` by policy."""
    if drift.isEmpty():
        return "none"
    return policy if policy in ("block", "auto_rerun") else "warn"


def upsert_sync(records: DataFrame, new: DataFrame) -> DataFrame:
    """Replace the record of each source in ``new``, keep the others."""
    return records.join(new.select("source"), "source", "left_anti").unionByName(new)


def run_record(
    result: DataFrame, versions: DataFrame, run_id: str, at: str, by: str
) -> DataFrame:
    """One row per run: the versions used and the four counts."""
    counts = result.agg(
        *[F.count(F.when(F.col("status") == s, 1)).alias(s.lower()) for s in STATUSES]
    )
    used = versions.where("version <> ''").agg(
        F.array_join(
            F.sort_array(F.collect_list(F.concat_ws("=", "source", "version"))), ","
        ).alias("versions")
    )
    names = ["versions", *[s.lower() for s in STATUSES]]
    both = counts.unionByName(used, allowMissingColumns=True)
    one = both.agg(*[F.max(name).alias(name) for name in names])
    return one.select(
        F.lit(run_id).alias("run_id"), F.lit(at).alias("at"), F.lit(by).alias("by"), *names
    )


def _seconds(text: Column) -> Column:
    """Seconds of a publish time; null when it is not one."""
    return F.unix_timestamp(F.try_to_timestamp(text, F.lit(TIME_FORMAT)))

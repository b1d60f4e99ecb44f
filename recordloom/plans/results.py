"""A consolidation result, written once and read back by everything that follows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from recordloom.operators.changes import undescribed, undescribed_changes
from recordloom.rules import STATUSES, ChangeRule
from recordloom.session import shuffles_freed


@dataclass(frozen=True)
class StoredResult:
    """Where a result lies and what its one write counted."""

    path: str
    rows: int
    counts: dict[str, int]
    missing: int
    undescribed: int

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)

    def undescribed_rows(self, spark: SparkSession, changes: ChangeRule) -> DataFrame:
        """Ready changes that nothing describes; a safety net, empty in good runs."""
        return undescribed_changes(self.read(spark), changes)


def store_result(result: DataFrame, path: str, changes: ChangeRule | None = None) -> StoredResult:
    """Run the plan of ``result`` once: the rows go to ``path``, the counts come from the same write.

    Export, record, review and the run's record then read the stored rows. ``path`` must be
    new: a result is never replaced, so a reader keeps the one it began with. Without
    ``changes`` no row counts as undescribed.
    """
    seen = Observation()
    counts = [F.count(F.when(F.col("status") == s, 1)).alias(s) for s in STATUSES]
    silent = F.lit(False) if changes is None else undescribed(changes)
    counted = result.observe(
        seen, F.count(F.lit(1)).alias("rows"), *counts,
        F.count(F.when(F.col("is_missing"), 1)).alias("missing"), F.count(F.when(silent, 1)).alias("undescribed"))
    with shuffles_freed(result.sparkSession):
        counted.write.parquet(path)
    found = seen.get
    return StoredResult(
        path, found["rows"], {s: found[s] for s in STATUSES}, found["missing"], found["undescribed"])

"""One source file set to its staging tables, all or nothing."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from recordloom.columns import col
from recordloom.functions.text import map_values
from recordloom.operators.clean import clean
from recordloom.operators.filters import expired
from recordloom.operators.validate import batch_gate, failing, header_gate
from recordloom.rules import ORD, ImportRule
from recordloom.session import staged
from recordloom.sources.delimited import read_headed
from recordloom.sources.tables import append_rows, next_start, stamp_lines, write_table


@dataclass(frozen=True)
class ImportResult:
    rows: int
    cleaned_rows: int
    dropped_expired: int


def mapped_rows(raw: DataFrame, rule: ImportRule) -> DataFrame:
    """Cells after value mapping, in one projection."""
    cells = [map_values(col(c.field), c.value_map).alias(c.field) for c in rule.columns]
    return raw.select(*cells, F.col(ORD))


def import_source(
    spark: SparkSession, paths: str | Sequence[str], rule: ImportRule, today: dt.date,
    raw_path: str, cleaned_path: str | None = None, **read_options,
) -> ImportResult:
    """Read, map, drop expired rows, clean, check, and only then publish.

    The rows are staged once; that write also counts what is dropped and what fails each
    check, so the gate runs no job of its own. Cleaned rows are staged the same way, with
    the conditional check. Only then are the tables written, from the staged files: two
    writes of the input, whatever the checks. Row numbers come from the files' lines,
    without a sort.
    """
    table = read_headed(spark, paths, rule, **read_options)
    header_gate(table.present, rule)
    gone = expired(rule.expiry_field, today) if rule.expiry_field else F.lit(False)
    both = table.rows.select(
        *[col(c.field).alias(f"__raw_{i}") for i, c in enumerate(rule.columns)],
        *[map_values(col(c.field), c.value_map).alias(c.field) for c in rule.columns],
        F.col(ORD),
    ).withColumn("_gone", gone)
    untouched = {c.field: F.col(f"__raw_{i}") for i, c in enumerate(rule.columns)}
    checks = {"required": failing("required", rule), "accepted": failing("accepted", rule, untouched.__getitem__)}
    if rule.clean is None:
        checks["conditional"] = failing("conditional", rule)
    seen = Observation()
    kept = ~F.col("_gone")
    counts = [F.count(F.when(kept & failed, 1)).alias(check) for check, failed in checks.items()]
    marked = staged(both.observe(
        seen, F.count(F.when(kept, 1)).alias("rows"), F.count(F.when(~kept, 1)).alias("dropped"), *counts), "import")
    found = dict(seen.get)
    whole = marked.where(kept)
    rows = whole.select(*[col(f) for f in rule.fields], F.col(ORD))
    raw = whole.select(*[untouched[f].alias(f) for f in rule.fields], F.col(ORD))
    cleaned = None
    if rule.clean:
        again = Observation()
        cleaned = staged(clean(rows, rule.clean, keep_dropped=True).observe(
            again, F.count(F.lit(1)).alias("cleaned"), F.count(F.when(failing("conditional", rule), 1)).alias("conditional")), "cleaned")
        found |= again.get
    batch_gate(table.present, rows, raw, rows if cleaned is None else cleaned, rule, ORD, found)
    _store(spark, rows, rule, raw_path)
    if cleaned is not None:
        fields = [f for f in rule.fields if f not in rule.clean.drop]
        write_table(stamp_lines(cleaned), cleaned_path or f"{raw_path}_cleaned", fields)
    return ImportResult(found["rows"], found.get("cleaned", 0), found["dropped"])


def _store(spark: SparkSession, rows: DataFrame, rule: ImportRule, path: str) -> None:
    if rule.replace:
        write_table(stamp_lines(rows), path, rule.fields)
        return
    stored = read_table(spark, path)
    if stored is None:
        write_table(stamp_lines(rows), path, rule.fields)
    elif set(rule.fields) <= set(stored.columns):
        fresh = stamp_lines(rows, next_start(stored))
        blank = [c for c in stored.columns if c not in fresh.columns]
        whole = fresh.select("*", *[F.lit("").alias(c) for c in blank])
        whole.select(*[col(c) for c in stored.columns]).write.mode("append").parquet(path)
    else:
        fresh = stamp_lines(rows, next_start(stored))
        widened = staged(append_rows(stored, fresh), "widened")
        write_table(widened, path, [c for c in widened.columns if c != ORD])


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A stored table, or None when it does not exist yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None

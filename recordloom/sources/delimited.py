"""Delimited text whose header sits on a given row."""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.rules import ORD, ImportRule
from recordloom.session import stable


class HeaderError(ValueError):
    """No header row, or files of one read that do not share it."""


@dataclass(frozen=True)
class HeadedTable:
    """Raw cells by field, in file order, and the fields the header really had."""

    rows: DataFrame
    present: tuple[str, ...]


def read_headed(
    spark: SparkSession, paths: str | Sequence[str], rule: ImportRule,
    sep: str = ",", multi_line: bool = False,
) -> HeadedTable:
    """Header at ``rule.header_row``, data from ``rule.data_row``, everything text.

    Titles match exactly and the first of a repeated title wins; unknown titles
    are ignored, an absent column reads ``''``. Rows count from 1, blank ones too.
    Blank rows at the end of a file are cut, those in between stay; a row with a
    cell beyond the header is not blank. The row order is (file, row).

    Lines are written once to the checkpoint folder with the ids they were read
    with; numbers are then the id within its file block plus the lines of the blocks
    before, so files stay splittable. ``multi_line`` lets a quoted cell hold line
    breaks: a line that leaves a quote open goes on in the next, and counts as one
    row with it. A quote that is never closed makes the rest of its file one row.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": str(multi_line).lower()}
    lines = _number(_text_lines(spark, paths))
    if multi_line:
        lines = _join_open_quotes(lines)
    heads = lines.where(F.col("line") == rule.header_row).select("value").distinct()
    text = [row.value for row in heads.limit(2).collect()]
    title_row = _one_header([next(csv.reader(io.StringIO(t), delimiter=sep), []) for t in text])
    schema = ", ".join(f"c{i} string" for i in range(len(title_row)))
    cells = F.from_csv("value", F.lit(schema), options)
    filled = F.coalesce(F.translate("value", sep + '"\r\n', ""), F.lit("")) != ""
    parsed = lines.select("file", "block", "line", filled.alias("filled"), cells.alias("cells"))
    positions = _positions(title_row, rule)
    return HeadedTable(_data_rows(parsed, positions, rule), tuple(positions))


def _text_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.text(paths).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
    )


def _number(lines: DataFrame) -> DataFrame:
    """Adds ``line``, 1-based within its file."""
    lines = stable(lines)
    blocks = lines.groupBy("file", "block").agg(
        F.min("id").alias("first_id"), F.count("*").alias("n")
    )
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(
        "file", "block",
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first_id") + 1).alias("shift"),
    )
    joined = lines.join(starts, ["file", "block"])
    return joined.withColumn("line", F.col("id") + F.col("shift")).drop("shift", "id")


def _join_open_quotes(lines: DataFrame) -> DataFrame:
    """Lines that a quoted break parts, joined again and numbered as rows.

    An odd number of quotes before a line means that it continues a cell. Counts of
    quotes and rows are summed up per file block first, so no file is one task's work;
    ``block`` becomes that of a row's first line.
    """
    own = lines.withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    sums = own.groupBy("file", "block").agg(F.sum("quotes").alias("sum"))
    opened = sums.select("file", "block", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("opened"))
    odd = (F.col("opened") + F.coalesce(F.sum("quotes").over(inside), F.lit(0))) % 2
    marked = stable(own.join(opened, ["file", "block"]).select(
        "file", "block", "line", "value", F.when(odd == 0, F.col("line")).alias("start")))
    ends = marked.groupBy("file", "block").agg(F.max("start").alias("last"), F.count("start").alias("rows"))
    carried = ends.select(
        "file", "block", F.max("last").over(before).alias("last"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows"))
    upto = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    placed = marked.join(carried, ["file", "block"]).select(
        "file", "block", "line", "value", F.coalesce(F.max("start").over(upto), "last").alias("start"),
        (F.col("rows") + F.count("start").over(upto)).alias("row"))
    parts = F.array_sort(F.collect_list(F.struct("line", "value")))
    return placed.groupBy("file", "start").agg(
        F.min("block").alias("block"), F.max("row").alias("line"),
        F.array_join(F.transform(parts, lambda x: x["value"]), "\n").alias("value"))


def _one_header(heads: list[list]) -> list:
    if not heads or not heads[0]:
        raise HeaderError("no header row")
    if len(heads) > 1:
        raise HeaderError("the files do not share one header row")
    return heads[0]


def _positions(titles: Sequence[str], rule: ImportRule) -> dict[str, int]:
    """Field to header position; first title and first rule win."""
    by_title: dict[str, str] = {}
    for c in rule.columns:
        by_title.setdefault(c.header, c.field)
    found: dict[str, int] = {}
    for position, title in enumerate(titles):
        if title in by_title:
            found.setdefault(by_title[title], position)
    return found


def _data_rows(parsed: DataFrame, positions: dict[str, int], rule: ImportRule) -> DataFrame:
    """Data rows up to the last filled one of their file.

    Joined per file block, a few rows each, so that one very large file is not
    one task's work.
    """
    cell = F.col("cells")
    ends = parsed.groupBy("file", "block").agg(F.max(F.when(F.col("filled"), F.col("line"))).alias("end"))
    last = F.max("end").over(Window.partitionBy("file")).alias("last")
    kept = parsed.where(F.col("line") >= rule.data_row).join(
        ends.select("file", "block", last), ["file", "block"]
    )
    values = [
        (
            F.coalesce(cell.getField(f"c{positions[f]}"), F.lit("")) if f in positions else F.lit("")
        ).alias(f)
        for f in rule.fields
    ]
    return kept.where(F.col("line") <= F.col("last")).select(
        *values, F.struct("file", "line").alias(ORD)
    )

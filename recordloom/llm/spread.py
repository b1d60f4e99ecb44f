"""A join of very many rows with one row for each of their keys, whatever a key holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.operators.skew import PART, SIZE, cut, repeat


def spread_join(rows: DataFrame, key: str, named: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``named``, which holds every ``key`` of ``rows`` once and none is null.

    A key with more than a thousandth of all rows is cut into parts by the rows' places in
    their partitions, also where these rows are all equal. ``rows`` has to be a stored table.
    """
    sizes = rows.groupBy(key).agg(F.count("*").alias(SIZE))
    total = sizes.agg(F.sum(SIZE)).scalar()
    placed = rows.withColumn("_place", F.monotonically_increasing_id())
    parts = cut(placed, sizes, [key], [F.col("_place")], total).drop("_place")
    copies = repeat(named.join(sizes, key), total).drop(SIZE)
    return parts.join(copies, [key, PART]).drop(PART)

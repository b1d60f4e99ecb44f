"""Connected components by passing the least label along edges and jumping to labels of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for every end of an edge (a, b): the least vertex that it is linked to.

    Any orderable type. Each round is written to the shared folder; the rounds grow
    with the logarithm of the longest chain, not with its length.
    """
    both = staged(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("n")).select(
        "v", F.least("v", "n").alias("label")), "labels")
    while True:
        around = (
            both.join(labels, both.b == labels.v).groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near")))
        nearer = labels.join(around, "v").select("v", "label", F.least("label", "near").alias("new"))
        # a vertex's label is a vertex itself: take over what that one has by now
        jump = labels.select(F.col("v").alias("new"), F.col("label").alias("further"))
        moved = staged(
            nearer.join(jump, "new", "left")
            .select("v", F.least("new", F.coalesce("further", "new")).alias("now"), "label"), "labels")
        changed = not moved.where("now <> label").isEmpty()
        labels = moved.select("v", F.col("now").alias("label"))
        if not changed:
            return labels

"""A Merkle manifest of a dataset, with a version of the tree for every tampered leaf.

Each row is a leaf. The leaves of a group, in the order of their ids, form a tree
whose nodes have three children; the groups' roots, in the order of the groups,
form one more tree. Trees are cut into aligned blocks of ``3 ** HEIGHT`` nodes, so
that Spark builds all blocks of a level at once, and a level has the 2187th part of
the nodes of the one below.

Within a block the tree is persistent: a tampered leaf makes a version that copies
the leaf's ancestors and shares every other node. A version leaves its block as one
digest and is continued through the upper blocks along their untouched nodes, which
stand beside each block in a table of their own; so the versions of one group never
meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.llm.common import staged

ARITY = 3
#: Levels of a block.
HEIGHT = 7
#: Blocks of a group that share one copy of the group's way to the root.
NEIGHBOURS = 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

STEPS = "array<struct<left:string,right:string>>"
RESULT = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def digest_of(text: str) -> str:
    return sha256(text.encode()).hexdigest()


class Versions:
    """Trees of digests that share nodes. A node never changes; a version adds the nodes on one way down."""

    def __init__(self, leaves: Sequence[str], levels: int):
        self.digests = list(leaves)
        self.children: list[tuple[int, ...]] = [()] * len(leaves)
        self.levels = levels
        row = list(range(len(leaves)))
        for _ in range(levels):
            row = [self._node(tuple(row[i: i + ARITY])) for i in range(0, len(row), ARITY)]
        (self.root,) = row

    def _node(self, children: tuple[int, ...]) -> int:
        self.digests.append(digest_of("".join([self.digests[c] for c in children])))
        self.children.append(children)
        return len(self.digests) - 1

    def way(self, place: int) -> list[tuple[tuple[int, ...], int]]:
        """The children of every ancestor of a leaf and which of them is taken, from the root down."""
        taken, node, held = [], self.root, ARITY**self.levels
        for _ in range(self.levels):
            held //= ARITY
            turn = place // held % ARITY
            taken.append((self.children[node], turn))
            node = self.children[node][turn]
        return taken

    def siblings(self, place: int) -> list[tuple[str, str]]:
        """Digests left and right of a leaf's way, from the leaf up."""
        d = self.digests
        return [
            ("".join([d[c] for c in run[:turn]]), "".join([d[c] for c in run[turn + 1:]]))
            for run, turn in reversed(self.way(place))]

    def replaced(self, place: int, digest: str) -> int:
        """The root of the version with another leaf at ``place``: only the leaf and its ancestors are new."""
        self.digests.append(digest)
        self.children.append(())
        node = len(self.digests) - 1
        for run, turn in reversed(self.way(place)):
            node = self._node((*run[:turn], node, *run[turn + 1:]))
        return node


def levels_of(total: int, height: int) -> int:
    """Levels of a block in a tree of ``total`` nodes: all of them, or as many as leave one node."""
    levels = 0
    while levels < height and ARITY**levels < total:
        levels += 1
    return levels


def leaf_digest(cells: Sequence[Column]) -> Column:
    """Lower-case hexadecimal sha256 of the cells: ``-`` for null, else byte count, colon, value."""
    parts = []
    for cell in cells:
        text = cell.cast("string")
        said = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
        parts.append(F.coalesce(said, F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def dataset_manifest(
    docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "source", order: str = "doc_id",
    tampered: Mapping[str, Column] | None = None, height: int = HEIGHT,
) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)``, one row per row of ``docs``.

    ``tampered`` maps a field to its value after tampering; rows that it leaves as they
    are have no version of their own. ``proof_sha256`` hashes the siblings of the leaf from
    the lowest level to the root, ``folded_root`` is the root of the row's version, and
    ``verified`` tells whether it is the untampered one.

    Null is a value of its own in every field; a null group comes first and a null id comes
    first in its group. Rows with equal ids are ordered by their digests. Equal rows share
    one entry with their number until their block is built, so copies add nothing to the
    shuffles before. Texts are hashed whole in the scan and go no further. Other columns of
    ``docs`` are not read. No rows give no rows. ``order`` has to hold whole numbers.
    """
    digest = leaf_digest([F.col(f"`{f}`") for f in fields])
    other = leaf_digest([(tampered or {}).get(f, F.col(f"`{f}`")) for f in fields])
    rows = docs.select(
        F.col(f"`{group}`").cast("string").alias("tree"), F.col(f"`{order}`").cast("long").alias("id"),
        F.unhex(digest).alias("leaf"), F.when(other != digest, F.unhex(other)).alias("changed"))
    counted = rows.groupBy("tree", "id", "leaf", "changed").agg(F.count("*").alias("n"))
    leaves = positioned(counted, ["id", "leaf", "changed"])
    blocks = staged(packed(leaves, ["id", "leaf", "changed"], height), "blocks")

    roots = staged(blocks.mapInArrow(_block_roots(height), "tree string, pos long, digest string, total long"), "roots")
    upper = ascended(roots, height)
    groups = upper.where("pos = 0").select(
        F.lit("").alias("tree"), F.col("tree").alias("group"), "top", F.col("total").alias("blocks"), F.lit(1).alias("n"))
    listed = positioned(groups, ["group", "top", "blocks"])
    last = ascended(listed.select("tree", "pos", F.col("top").alias("digest"), "total"), height)
    lots = F.explode(F.sequence(F.lit(0).cast("long"), _lot(F.col("blocks") - 1))).alias("lot")
    above = listed.join(last.select("pos", F.col("steps").alias("further"), F.col("top").alias("root")), "pos").select(
        "group", lots, "further", "root")
    beside = upper.select("tree", "pos", _lot(F.col("pos")).alias("lot"), "steps", F.col("top").alias("subroot"))
    beside = beside.join(above, beside["tree"].eqNullSafe(above["group"]) & (beside["lot"] == above["lot"])).select(
        F.col("tree").alias("of"), F.col("pos").alias("at"), F.concat("steps", "further").alias("steps"), "subroot", "root")
    met = blocks.join(beside, blocks["tree"].eqNullSafe(beside["of"]) & (blocks["pos"] == beside["at"]))
    return met.select("total", "rows", "steps", "subroot", "root").mapInArrow(_block_versions(height), RESULT)


def _lot(pos: Column) -> Column:
    return F.floor(pos / NEIGHBOURS).cast("long")


def positioned(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``pos``, the rows before it in its ``tree``, and the ``total`` of the tree.

    A row counts ``n`` times. One range exchange puts the rows in order; each partition
    numbers its own, and a table of (partition, tree) counts, whose size is the number of
    partitions and trees, tells where each begins.
    """
    keys = ["tree", *order]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())
    schema = T.StructType([*placed.schema.fields, T.StructField("before", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            trees = batch.column("tree").dictionary_encode("encode")
            codes = trees.indices.to_numpy(zero_copy_only=False)
            n = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
            sums = np.concatenate([[0], np.cumsum(n)])
            starts = np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1])
            base = np.repeat(sums[starts], np.diff(np.concatenate([starts, [len(n)]])))
            before = sums[:-1] - base
            first = trees.dictionary[codes[0]].as_py()
            if seen and first == tree:
                before[: starts[1] if len(starts) > 1 else len(n)] += seen
            tree, seen = trees.dictionary[codes[-1]].as_py(), int(before[-1] + n[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before)], names=schema.names)

    rows = staged(placed.mapInArrow(run, schema), "placed")
    counts = rows.groupBy("tree", "part").agg(F.sum("n").alias("held"))
    along = Window.partitionBy("tree").orderBy("part")
    starts = counts.select(
        F.col("tree").alias("_tree"), F.col("part").alias("_part"),
        (F.sum("held").over(along) - F.col("held")).alias("_start"),
        F.sum("held").over(Window.partitionBy("tree")).alias("total"))
    met = rows.join(starts, rows["tree"].eqNullSafe(starts["_tree"]) & (rows["part"] == starts["_part"]))
    return met.select("tree", *order, "n", (F.col("_start") + F.col("before")).alias("pos"), "total")


def packed(rows: DataFrame, fields: Sequence[str], height: int) -> DataFrame:
    """``(tree, pos, total, rows)``: one row per block, its entries in order; copies are cut at its bounds."""
    size = ARITY**height
    ends = F.col("pos") + F.col("n")
    cut = rows.select(
        "*", F.explode(F.sequence(F.floor(F.col("pos") / size), F.floor((ends - 1) / size))).alias("block"))
    first = F.greatest("pos", F.col("block") * size)
    entry = F.struct(first.alias("first"), (F.least(ends, (F.col("block") + 1) * size) - first).alias("n"), *fields)
    return cut.groupBy("tree", F.col("block").cast("long").alias("pos")).agg(
        F.max("total").alias("total"), F.sort_array(F.collect_list(entry)).alias("rows"))


def ascended(nodes: DataFrame, height: int) -> DataFrame:
    """``(tree, pos, total, steps, top)`` of nodes ``(tree, pos, digest, total)``.

    ``steps`` are the digests left and right of a node's way to the ``top`` of its tree,
    from below. Block by block, then the same for the blocks' roots.
    """
    size = ARITY**height
    most = nodes.agg(F.max("total")).first()[0] or 0
    entry = F.struct("pos", "digest")
    blocks = nodes.groupBy("tree", F.floor(F.col("pos") / size).cast("long").alias("block")).agg(
        F.max("total").alias("total"), F.sort_array(F.collect_list(entry)).alias("rows"))
    out = f"tree string, pos long, total long, block long, steps {STEPS}, top string"
    inner = staged(blocks.mapInArrow(_block_steps(height), out), "steps")
    if most <= size:
        return inner.drop("block")
    roots = inner.where(F.col("pos") % size == 0).select(
        "tree", F.col("block").alias("pos"), F.col("top").alias("digest"), F.ceil(F.col("total") / size).alias("total"))
    upper = ascended(roots, height).select(
        F.col("tree").alias("of"), F.col("pos").alias("at"), F.col("steps").alias("further"), F.col("top").alias("peak"))
    met = inner.join(upper, inner["tree"].eqNullSafe(upper["of"]) & (inner["block"] == upper["at"]))
    return met.select("tree", "pos", "total", F.concat("steps", "further").alias("steps"), F.col("peak").alias("top"))


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Block rows one at a time, whatever a batch holds."""
    for batch in batches:
        for i in range(batch.num_rows):
            (row,) = batch.slice(i, 1).to_pylist()
            yield row


def _leaves(rows: list[dict]) -> list[str]:
    return [d for r in rows for d in [r["leaf"].hex()] * r["n"]]


def _block_roots(height: int) -> Batches:
    def run(batches):
        for row in _each(batches):
            tree = Versions(_leaves(row["rows"]), levels_of(row["total"], height))
            total = -(-row["total"] // ARITY**height)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["tree"]], pa.string()), pa.array([row["pos"]]), pa.array([tree.digests[tree.root]]),
                 pa.array([total])], names=["tree", "pos", "digest", "total"])

    return run


def _block_steps(height: int) -> Batches:
    kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))

    def run(batches):
        for row in _each(batches):
            tree = Versions([r["digest"] for r in row["rows"]], levels_of(row["total"], height))
            n = len(row["rows"])
            steps = [[{"left": a, "right": b} for a, b in tree.siblings(i)] for i in range(n)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["tree"]] * n, pa.string()), pa.array([r["pos"] for r in row["rows"]]),
                 pa.array([row["total"]] * n), pa.array([row["block"]] * n), pa.array(steps, kind),
                 pa.array([tree.digests[tree.root]] * n)], names=["tree", "pos", "total", "block", "steps", "top"])

    return run


def _block_versions(height: int) -> Batches:
    """Proofs of a block's leaves, and the tampered leaves' versions continued to the root."""

    def run(batches):
        for row in _each(batches):
            tree = Versions(_leaves(row["rows"]), levels_of(row["total"], height))
            base = len(tree.digests)
            upper = [(s["left"], s["right"]) for s in row["steps"]]
            further = "".join([a + b for a, b in upper])
            root, out, place = row["root"], [], 0
            for r in row["rows"]:
                for _ in range(r["n"]):
                    inner = tree.siblings(place)
                    proof = digest_of("".join([a + b for a, b in inner]) + further)
                    folded = root
                    if r["changed"] is not None:
                        folded = tree.digests[tree.replaced(place, r["changed"].hex())]
                        for left, right in upper:
                            folded = digest_of(left + folded + right)
                        # the next version starts from the untouched tree again
                        del tree.digests[base:], tree.children[base:]
                    out.append((r["id"], r["leaf"].hex(), row["subroot"], root, proof, folded, folded == root))
                    place += 1
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), *[pa.array(c, pa.string()) for c in columns[1:6]],
                 pa.array(columns[6], pa.bool_())], names=[part.split()[0] for part in RESULT.split(", ")])

    return run

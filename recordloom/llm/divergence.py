"""How far the sources of a language differ in their words.

The counts of a group (a source in a language) over a block of term ids form a segment
tree. Nodes are hash-consed: equal counts give the same node, in every group. Two groups
diverge by the sum of the prices of their leaves; a walk over both trees at once keeps
equal pairs of nodes as one, so they are priced once. Spark cuts terms into blocks and groups into lots, and a task compares two lots over one block.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.common import cut_batches, staged, text_buffers
from recordloom.llm.spread import spread_join
from recordloom.llm.stretches import word_stretches

#: Documents of a language that a term has to occur in.
FEW = 10
SCALE = 1_000_000_000
TOP = 10
#: Terms of a block and groups of a lot, on average.
BLOCK, LOT = 2048, 32
#: (group, term) pairs that a task holds before it passes them on.
HELD = 1 << 17
#: Pairs of groups that are walked down at once.
PAIRS = 256

#: A-Z become a-z; what is neither a letter nor beyond ASCII parts words.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

COUNTS = "lang string, source string, term string, n long, docs long"
PRICED = "lang string, block long, source string, other string, at int, value long"


def source_divergence(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
    few: int = FEW, top: int = TOP, block: int = BLOCK, lot: int = LOT,
) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how each source differs, and by which terms.

    A language keeps the terms of at least ``few`` of its documents. Part ``pair`` prices
    every other source of the language, part ``term`` the ``top`` kept terms that are more
    frequent in the source than in its language. All arithmetic is exact.

    Nulls in text, language and source read as ''. Texts without terms count as documents of
    their group; a language without kept terms gives pairs of value 0. Every row is a document,
    also if it repeats another. Ties rank by the item's bytes. Other columns are not read. No
    rows give no rows.
    """
    read = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))]
    counted = docs.select(*read).mapInArrow(_count, COUNTS)
    counts = staged(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")

    frequent = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    frequent = staged(frequent.where(F.col("docs") >= few).select("lang", "term", "n"), "frequent")
    sizes = frequent.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("total"))
    blocks = sizes.withColumn("blocks", F.ceil(F.col("v") / block).cast("long"))
    ids = spread_join(frequent, "lang", blocks).withColumn("block", F.pmod(F.xxhash64("term"), "blocks"))
    inside = Window.partitionBy("lang", "block")
    at = (F.row_number().over(inside.orderBy("term")) - 1).alias("at")
    kept = staged(ids.select("lang", "block", at, "term", "n", F.count("*").over(inside).cast("int").alias("size")), "kept")

    held = counts.where("term is not null").select("lang", "source", "term", "n").join(kept.drop("n"), ["lang", "term"])
    entries = F.collect_list(F.struct("at", "n")).alias("entries")
    rows = staged(held.groupBy("lang", "source", "block").agg(entries, F.sum("n").alias("n")), "entries")
    totals = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").fillna(0, ["total"])
    lots = groups.groupBy("lang").agg(F.ceil(F.count("*") / lot).cast("long").alias("lots"))
    about = lots.join(blocks.select("lang", "v", "blocks"), "lang", "left").fillna(0, ["v", "blocks"])
    groups = staged(spread_join(staged(groups, "totals"), "lang", about).withColumn("lot", F.pmod(F.xxhash64("source"), "lots")), "groups")

    shapes = kept.groupBy("lang", "block").agg(F.first("size").alias("size"), F.collect_list(F.struct("at", "n")).alias("entries"))
    placed = groups.where("v > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    placed = placed.join(rows.drop("n"), ["lang", "source", "block"], "left").join(shapes.select("lang", "block", "size"), ["lang", "block"])
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)).alias("with")
    paired = placed.select("lang", "block", "source", "lot", "total", "v", "size", "entries", numbers)
    paired = paired.withColumn("one", F.least("lot", "with")).withColumn("two", F.greatest("lot", "with")).drop("with")
    # the language's own counts go to the tasks that hold a lot whole
    own = shapes.join(about.join(sizes.select("lang", "total"), "lang"), "lang").withColumn(
        "one", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)))
    own = own.select(
        "lang", "block", F.lit(None).cast("string").alias("source"), F.col("one").alias("lot"), "total", "v", "size", "entries",
        "one", F.col("one").alias("two"))
    priced = staged(paired.unionByName(own).groupBy("lang", "block", "one", "two").applyInArrow(_price(top), PRICED), "priced")

    pairs = _all_pairs(groups, lot).join(
        priced.where("other is not null").groupBy("lang", "source", "other").agg(F.sum("value").alias("value")),
        ["lang", "source", "other"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), F.coalesce("value", F.lit(0)).alias("value"))
    words = priced.where("other is null").join(kept.select("lang", "block", "at", "term"), ["lang", "block", "at"])
    words = words.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = words.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(ranked)


def _all_pairs(groups: DataFrame, lot: int) -> DataFrame:
    """``(lang, source, other)``: the pairs that the result lists, met by (language, lot)."""
    others = groups.select("lang", F.col("lot").alias("with"), F.col("source").alias("other"))
    asked = groups.select("lang", "source", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)).alias("with"))
    return asked.join(others, ["lang", "with"]).where("source <> other").drop("with")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of every term of a group, added up over many texts; a null term names the group."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    for batch in cut_batches(batches, "text"):
        data, offsets = text_buffers(batch.column("text"))
        said = data.tobytes()
        for lang, source, a, b in zip(
                batch.column("lang").to_pylist(), batch.column("source").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
            counts, docs = held.setdefault((lang, source), (Counter(), Counter()))
            distinct: set[bytes] = set()
            for words in word_stretches(said[a:b], _WORDS):
                counts.update(words)
                distinct.update(words)
            docs.update(distinct)
        if sum(len(c) for c, _ in held.values()) > HELD:
            yield from _passed(held)
            held = {}
    yield from _passed(held)


def _passed(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), (counts, docs) in held.items():
        terms = list(counts)
        n = len(terms) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * n), pa.array([source] * n), pa.array([*terms, None], pa.binary()).cast(pa.string()),
             pa.array([*counts.values(), 0], pa.int64()), pa.array([*(docs[t] for t in terms), 0], pa.int64())],
            names=["lang", "source", "term", "n", "docs"])


class Trees:
    """Segment trees over ``0 .. 2 ** levels - 1`` that share their nodes; a leaf is its count."""

    def __init__(self, levels: int):
        self.levels = levels
        self.left: list[int] = []
        self.right: list[int] = []
        self.made: dict[tuple[int, int], int] = {}
        #: The nodes that stand for zeros only, from the leaves up.
        self.zeros = [self._node(0, -1)]
        for _ in range(levels):
            self.zeros.append(self._node(self.zeros[-1], self.zeros[-1]))

    def _node(self, left: int, right: int) -> int:
        """The one node with these children; a leaf has its count and -1."""
        found = self.made.get((left, right))
        if found is None:
            found = self.made[left, right] = len(self.left)
            self.left.append(left)
            self.right.append(right)
        return found

    def tree(self, entries: list[tuple[int, int]]) -> int:
        """The root of a tree with counts at ascending places, zero elsewhere."""
        row = {at: self._node(n, -1) for at, n in entries}
        for zero in self.zeros[:-1]:
            row = {p: self._node(row.get(2 * p, zero), row.get(2 * p + 1, zero)) for p in dict.fromkeys(at >> 1 for at in row)}
        return row.get(0, self.zeros[-1])


def leaf_shares(trees: Trees, totals: list[int], v: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each leaf stands, by node, and the share of each group's leaves there; exact at any size."""
    leaves = [i for i, r in enumerate(trees.right) if r < 0]
    place = np.zeros(len(trees.left), np.int64)
    place[leaves] = np.arange(len(leaves))
    counts = [trees.left[i] for i in leaves]
    # a count beyond a group's total is another group's
    return place, np.array(
        [[1 + SCALE * (n + 2) // (total + 2 * v) if n <= total else 0 for n in counts] for total in totals], np.int64)


def priced(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Shares are at most 1 + ``SCALE``, so squares fit."""
    return (p - q) * (p - q) // (p + q)


def walked(trees: Trees, pairs: np.ndarray, place: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """The price of each pair of trees, given as rows (group, group, root, root).

    All pairs are walked down together, a level at a time. A pair of nodes that two groups
    meet again and again is one entry with its number: it is gone down from, and its leaves
    are priced, once.
    """
    if len(pairs) > PAIRS:
        return np.concatenate([walked(trees, pairs[i: i + PAIRS], place, shares) for i in range(0, len(pairs), PAIRS)])
    children, nodes = (np.array(trees.left), np.array(trees.right)), len(trees.left)
    of, a, b = np.arange(len(pairs)), pairs[:, 2], pairs[:, 3]
    times = np.ones(len(pairs), np.int64)
    for _ in range(trees.levels):
        met = np.concatenate([(of * nodes + side[a]) * nodes + side[b] for side in children])
        order = np.argsort(met, kind="stable")
        met, times = met[order], np.concatenate([times, times])[order]
        starts = np.concatenate([[0], np.flatnonzero(met[1:] != met[:-1]) + 1])
        met, times = met[starts], np.add.reduceat(times, starts)
        met, b = np.divmod(met, nodes)
        of, a = np.divmod(met, nodes)
    cost = times * priced(shares[pairs[of, 0], place[a]], shares[pairs[of, 1], place[b]])
    return np.add.reduceat(cost, np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1]))


def raised(trees: Trees, root: int, own: int, place: np.ndarray, p: np.ndarray, q: np.ndarray, top: int) -> list[tuple[int, int]]:
    """(-price, place) of the ``top`` leaves that are positive in the first tree and have the larger share there."""
    known: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def best(a: int, b: int, level: int) -> list[tuple[int, int]]:
        found = known.get((a, b))
        if found is None:
            if a == trees.zeros[level]:
                found = []
            elif not level:
                one, two = int(p[place[a]]), int(q[place[b]])
                found = [(-((one - two) ** 2 // (one + two)), 0)] if one > two else []
            else:
                half = 1 << level - 1
                found = best(trees.left[a], trees.left[b], level - 1)
                later = best(trees.right[a], trees.right[b], level - 1)
                if later:
                    found = sorted([*found, *((x, at + half) for x, at in later)])[:top]
            known[a, b] = found
        return found

    return best(root, own, trees.levels)


def _price(top: int):
    def run(rows: pa.Table) -> pa.Table:
        held = rows.to_pylist()
        size, v, lang, block = held[0]["size"], held[0]["v"], held[0]["lang"], held[0]["block"]
        trees = Trees(max(size - 1, 0).bit_length())
        groups = sorted((r for r in held if r["source"] is not None), key=lambda r: r["source"])
        owns = [r for r in held if r["source"] is None]
        roots = [trees.tree(sorted((e["at"], e["n"]) for e in r["entries"] or ())) for r in groups + owns]
        place, shares = leaf_shares(trees, [r["total"] for r in groups + owns], v)
        across = held[0]["one"] != held[0]["two"]
        pairs = np.array([
            (i, j, roots[i], roots[j]) for i, a in enumerate(groups) for j in range(i + 1, len(groups))
            if not across or a["lot"] != groups[j]["lot"]], np.int64).reshape(-1, 4)
        out: list[tuple[str, str | None, int | None, int]] = []
        if len(pairs):
            # places beyond the block's terms are zero in every tree
            zero, beyond = place[trees.zeros[0]], (1 << trees.levels) - size
            values = walked(trees, pairs, place, shares) - beyond * priced(shares[pairs[:, 0], zero], shares[pairs[:, 1], zero])
            for i, j, value in zip(pairs[:, 0].tolist(), pairs[:, 1].tolist(), values.tolist()):
                a, b = groups[i]["source"], groups[j]["source"]
                out += [(a, b, None, value), (b, a, None, value)]
        for i, r in enumerate(groups if owns else ()):
            found = raised(trees, roots[i], roots[-1], place, shares[i], shares[-1], top)
            out += [(r["source"], None, at, -x) for x, at in found]
        n = len(out)
        columns = list(zip(*out)) or [(), (), (), ()]
        return pa.table({
            "lang": pa.array([lang] * n, pa.string()), "block": pa.array([block] * n, pa.int64()),
            "source": pa.array(columns[0], pa.string()), "other": pa.array(columns[1], pa.string()),
            "at": pa.array(columns[2], pa.int32()), "value": pa.array(columns[3], pa.int64())})

    return run

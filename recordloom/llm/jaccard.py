"""Near duplicates: a chosen-path join on sets of word n-grams.

Each run starts with all sets in one node and splits nodes recursively: a node
samples one or two of its minimum-hash functions, and a set goes to the child named
by the n-gram that has its minimum, so two sets share a child with the probability
of their Jaccard similarity. Nodes of a few sets are compared by brute force; so
are those at the last level, in blocks, however large: a leaf of n sets has at most about
the root of n blocks, each is streamed past every other, and what is written is one row
for each set and one for each pair of blocks that links join. Runs repeat until a pair at
the threshold is met with the target probability.

Documents with equal sets form one class, and only one of each takes part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import cut_batches, group_bounds, row_keys, staged, whole_groups
from recordloom.llm.components import components
from recordloom.llm.folding import SPACE, fold
from recordloom.llm.hashing import BASES, Prefix, mix

#: Levels of splitting, and the size from which a node is split while levels remain.
LEVELS, SMALL = 3, 48
#: Sets, and n-grams, of a block; a task compares two blocks.
BLOCK, GRAMS = 128, 2_000_000
#: Standard deviations by which the share of equal minima may miss before a pair is passed over.
DOUBT = 6
#: One node in so many samples two functions, the others one: 1 / threshold on average for 0.8.
_SEED = 20260802


def second_sample(threshold: float) -> float:
    """The probability that a node samples a second function: so that 1 / threshold are sampled."""
    return min(1.0, 1 / threshold - 1)


def met(threshold: float, levels: int = LEVELS) -> float:
    """The probability that one run brings two sets of this similarity to a common leaf."""
    two, apart = second_sample(threshold), 0.0
    for _ in range(levels):
        lost = 1 - threshold + threshold * apart
        apart = (1 - two) * lost + two * lost * lost
    return 1 - apart


def runs_needed(threshold: float, recall: float) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - met(threshold)))


def gram_hashes(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of all texts, and row offsets; fewer words are one gram."""
    points, rows, _ = fold(texts)
    gaps = np.flatnonzero(points == SPACE)
    first_word = np.searchsorted(gaps, rows)
    starts = np.concatenate([[0], gaps + 1])[: len(gaps)]
    words = Prefix(mix(points.astype(np.uint64) + np.uint64(1)), BASES[0]).at(starts, gaps)
    count = np.diff(first_word)
    grams = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    offsets = np.concatenate([[0], np.cumsum(grams)])
    row = np.repeat(np.arange(len(texts)), grams)
    at = np.arange(offsets[-1]) - offsets[row] + first_word[row]
    hashes = Prefix(words, BASES[1]).at(at, at + np.minimum(count, n)[row])
    return hashes, offsets


def _signatures(n: int, functions: int):
    """Keys, two sums that tell sets apart, the set's size and its minima."""
    factors = np.random.default_rng(_SEED).integers(0, 2**32, functions, dtype=np.uint32) | np.uint32(1)

    def run(batches):
        for batch in cut_batches(batches, "_text"):
            hashes, offsets = gram_hashes([t or "" for t in batch.column(2).to_pylist()], n)
            some = np.flatnonzero(np.diff(offsets))
            if not len(some):
                continue
            parts = [np.unique(hashes[offsets[i]: offsets[i + 1]]) for i in some.tolist()]
            sizes = np.array([len(p) for p in parts])
            distinct = np.concatenate(parts)
            starts = np.cumsum(sizes) - sizes
            first = np.add.reduceat(mix(distinct), starts).view(np.int64)
            second = np.add.reduceat(mix(distinct ^ np.uint64(_SEED)), starts).view(np.int64)
            low = (distinct >> np.uint64(17)).astype(np.uint32)
            minima = np.empty((len(some), functions), "<i4")
            for j, factor in enumerate(factors):
                minima[:, j] = np.minimum.reduceat(low * factor, starts).view(np.int32)
            at = pa.array(some)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(first), pa.array(second),
                 pa.array(sizes, pa.int64()), pa.FixedSizeListArray.from_arrays(pa.array(minima.ravel()), functions).cast(pa.list_(pa.int32()))],
                names=["_k", "_h", "s1", "s2", "size", "minima"])

    return run


def _promising(threshold: float, functions: int):
    """(leaf, v): sets with a partner in their part of a leaf whose minima agree often enough."""
    least = functions * threshold - DOUBT * math.sqrt(functions * threshold * (1 - threshold))

    def run(batches):
        for rows in whole_groups(batches, "part", 4 << 20):
            bounds = group_bounds(rows.column("part").to_numpy())
            minima = rows.column("minima").combine_chunks().flatten().to_numpy().reshape(-1, functions)
            near = np.zeros(len(minima), bool)
            sizes = np.diff(bounds)
            for m in np.unique(sizes[sizes > 1]).tolist():
                own = bounds[:-1][sizes == m]
                for i in range(m if m <= 12 else 0):
                    for j in range(i + 1, m):
                        good = (minima[own + i] == minima[own + j]).sum(axis=1) >= least
                        near[own[good] + i] = near[own[good] + j] = True
                for a in own.tolist() if m > 12 else ():
                    block = minima[a: a + m]
                    for i in range(m - 1):
                        good = np.flatnonzero((block[i + 1:] == block[i]).sum(axis=1) >= least) + i + 1
                        if len(good):
                            near[a + i] = True
                            near[a + good] = True
            yield from rows.select(["leaf", "_k", "_h", "size"]).filter(pa.array(near)).combine_chunks().to_batches()

    return run


def shared_grams(sets: list[np.ndarray], split: int | None = None, step: int = 4096) -> np.ndarray:
    """The sizes of all pairwise intersections, by products of 0/1 matrices of shared n-grams.

    With ``split``, those of the sets before it with the sets from it on.
    """
    m = len(sets)
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    turn = np.argsort(every, kind="stable")
    every, owner = every[turn], owner[turn]
    bounds = group_bounds(every)
    repeated = np.repeat(np.diff(bounds) > 1, np.diff(bounds))
    column = np.cumsum(np.concatenate([[True], every[1:] != every[:-1]])[repeated]) - 1 if repeated.any() else np.empty(0, int)
    owner = owner[repeated]
    both = np.zeros((m, m) if split is None else (split, m - split))
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        i, j = np.searchsorted(column, [a, a + step])
        held = np.zeros((m, step), np.float32)
        held[owner[i:j], column[i:j] - a] = 1
        both += held @ held.T if split is None else held[:split] @ held[split:].T
    return both


def _counted(first: list[list[int]], second: list[list[int]], leaf: int) -> np.ndarray:
    """Which pairs of sets, given as the leaves of each, have no common leaf before this one: they count here."""
    before = [[x for x in own if x < leaf] for own in (*first, *second)]
    place = {x: i for i, x in enumerate({x for own in before for x in own})}
    held = np.zeros((len(before), max(len(place), 1)), np.float32)
    for i, own in enumerate(before):
        held[i, [place[x] for x in own]] = 1
    return held[: len(first)] @ held[len(first):].T == 0


def _linked(both: np.ndarray, first: np.ndarray, second: np.ndarray, threshold: float) -> np.ndarray:
    return both >= threshold * (first[:, None] + second[None, :] - both) - 1e-9


PIECES = (
    "leaf long, block int, blocks int, piece int, k array<long>, h array<long>, copies array<long>, "
    "leaves array<array<long>>, grams array<binary>, links array<long>, root_k array<long>, root_h array<long>")
_LONGS = pa.list_(pa.int64())


def _blocks(n: int, threshold: float):
    """Blocks of a leaf's sets, compared within themselves, in pieces of ``BLOCK`` sets.

    Each set has its links within the block and the least set that these reach. The n-grams
    go on only where a leaf has more blocks.
    """

    def block(rows: pa.Table) -> pa.RecordBatch:
        m, leaf = rows.num_rows, rows.column("leaf")[0].as_py()
        hashes, offsets = gram_hashes(rows.column("_text").to_pylist(), n)
        sets = [np.unique(hashes[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        size = np.array([len(s) for s in sets])
        ids = list(zip(rows.column("_k").to_pylist(), rows.column("_h").to_pylist()))
        copies, leaves = rows.column("copies").to_numpy(), rows.column("leaves").to_pylist()
        links, label = np.zeros(m, np.int64), np.arange(m)
        if m > 1:
            linked = _linked(shared_grams(sets), size, size, threshold)
            np.fill_diagonal(linked, False)
            if linked.any():
                links = (linked & _counted(leaves, leaves, leaf)) @ copies
            for r in np.flatnonzero(linked.any(axis=1)):
                joined = np.unique(np.append(label[linked[r]], label[r]))
                if len(joined) > 1:
                    label[np.isin(label, joined)] = joined[0]
        least: dict[int, tuple[int, int]] = {}
        for i, x in zip(label.tolist(), ids):
            least[i] = min(least.get(i, x), x)
        roots = [least[i] for i in label.tolist()]
        several = rows.column("blocks")[0].as_py() > 1
        cuts = [slice(i, i + BLOCK) for i in range(0, m, BLOCK)]
        lists = [[x[0] for x in ids], [x[1] for x in ids], copies.tolist()]
        ends = [links.tolist(), [x[0] for x in roots], [x[1] for x in roots]]
        k = len(cuts)
        return pa.RecordBatch.from_arrays(
            [pa.array([leaf] * k), *(pa.array([rows.column(c)[0].as_py()] * k, pa.int32()) for c in ("block", "blocks")),
             pa.array(range(k), pa.int32()), *(pa.array([x[c] for c in cuts], _LONGS) for x in lists),
             pa.array([leaves[c] for c in cuts], pa.list_(_LONGS)),
             pa.array([[g.tobytes() for g in sets[c]] if several else [] for c in cuts], pa.list_(pa.binary())),
             *(pa.array([x[c] for c in cuts], _LONGS) for x in ends)], names=[f.split()[0] for f in PIECES.split(", ")])

    def run(batches):
        for rows in whole_groups(batches, "part", 4 << 20):
            bounds = group_bounds(rows.column("part").to_numpy())
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                yield block(rows.slice(a, b - a))

    return run


class _Own:
    """The pieces of one block, which all other pieces of its leaf are compared with."""

    def __init__(self):
        self.k, self.h, self.leaves, self.sets, self.root = [], [], [], [], []
        self.size, self.links = np.empty(0, np.int64), np.empty(0, np.int64)
        self.edges: set[tuple[tuple[int, int], tuple[int, int]]] = set()

    def add(self, row: dict) -> None:
        self.k += row["k"]
        self.h += row["h"]
        self.leaves += row["leaves"]
        self.sets += [np.frombuffer(g, np.uint64) for g in row["grams"]]
        self.root += zip(row["root_k"], row["root_h"])
        self.size = np.array([len(s) for s in self.sets])
        self.links = np.zeros(len(self.sets), np.int64)

    def meet(self, row: dict, threshold: float) -> None:
        if not self.sets:
            return
        other = [np.frombuffer(g, np.uint64) for g in row["grams"]]
        both = shared_grams([*self.sets, *other], len(self.sets))
        linked = _linked(both, self.size, np.array([len(s) for s in other]), threshold)
        if not linked.any():
            return
        self.links += (linked & _counted(self.leaves, row["leaves"], row["leaf"])) @ np.array(row["copies"], np.int64)
        if row["to"] < row["block"]:  # the other block reports the same pairs
            roots = list(zip(row["root_k"], row["root_h"]))
            known = {x: i for i, x in enumerate(dict.fromkeys([*self.root, *roots]))}
            names = list(known)
            i, j = np.nonzero(linked)
            pairs = np.array([known[x] for x in self.root])[i] * len(names) + np.array([known[x] for x in roots])[j]
            self.edges.update((names[p // len(names)], names[p % len(names)]) for p in np.unique(pairs).tolist())

    def rows(self) -> list[tuple]:
        out = [(k, h, n, *r) for k, h, n, r in zip(self.k, self.h, self.links.tolist(), self.root) if n]
        return out + [(*a, 0, *b) for a, b in sorted(self.edges)]


def _across(threshold: float):
    """For each set of a block the links to other blocks, and what links of theirs join. Rows: a block's own pieces first."""

    def run(batches):
        own, part = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                if row["part"] != part:
                    if own is not None:
                        yield _links(own.rows())
                    own, part = _Own(), row["part"]
                if row["block"] == row["to"]:
                    own.add(row)
                else:
                    own.meet(row, threshold)
        if own is not None:
            yield _links(own.rows())

    return run


def _links(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["_k", "_h", "links", "root_k", "root_h"])


def _promising_across(threshold: float, functions: int):
    """(leaf, _k, _h, size) of sets of large leaves that have a promising partner. Rows: a block's own pieces first."""
    least = functions * threshold - DOUBT * math.sqrt(functions * threshold * (1 - threshold))

    def matrix(value: pa.Scalar) -> tuple[pa.StructArray, np.ndarray]:
        rows = value.values
        return rows, rows.field("minima").flatten().to_numpy().reshape(-1, functions)

    def passed(leaf, held) -> pa.RecordBatch:
        chosen = [rows.filter(pa.array(near)) for rows, _, near in held]
        n = sum(map(len, chosen))
        columns = [pa.concat_arrays([c.field(f) for c in chosen]) for f in ("_k", "_h", "size")]
        return pa.RecordBatch.from_arrays([pa.array([leaf] * n, pa.int64()), *columns], names=["leaf", "_k", "_h", "size"])

    def run(batches):
        held, part, leaf = [], None, None
        for batch in batches:
            for i in range(batch.num_rows):
                now = batch.column("part")[i].as_py()
                if now != part:
                    if held:
                        yield passed(leaf, held)
                    held, part, leaf = [], now, batch.column("leaf")[i].as_py()
                rows, minima = matrix(batch.column("rows")[i])
                mine = batch.column("block")[i].as_py() == batch.column("to")[i].as_py()
                if mine:
                    held.append((rows, minima, np.zeros(len(rows), bool)))
                for _, own, near in held:
                    for j in np.flatnonzero(~near):
                        equal = (minima == own[j]).sum(axis=1) >= least
                        # a set of the block itself meets itself too
                        near[j] = equal.sum() > (own is minima)
                if mine and len(held) > 1:
                    last, minima, near = held[-1]
                    for _, own, _ in held[:-1]:
                        for j in np.flatnonzero(~near):
                            near[j] = ((own == minima[j]).sum(axis=1) >= least).any()
        if held:
            yield passed(leaf, held)

    return run


def _streamed(pieces: DataFrame) -> DataFrame:
    """Each piece once for every block of its leaf; a block's own pieces come before the others of its part."""
    sent = pieces.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.withColumn("part", F.xxhash64("leaf", "to"))
    return sent.repartition("part").sortWithinPartitions("part", F.col("block") != F.col("to"), "block", "piece")


def _in_blocks(rows: DataFrame, blocks) -> DataFrame:
    """``blocks`` and ``block`` of each set of a leaf."""
    own = F.pmod(F.xxhash64("_k", "_h", F.lit(_SEED)), F.col("blocks")).cast("int")
    return rows.withColumn("blocks", blocks.cast("int")).withColumn("block", own)


def _sized(members, grams=None):
    """Blocks of a leaf: each has ``BLOCK`` sets, or the root of all if these are more, so that pairs of blocks stay as few as sets."""
    most = F.ceil(members / F.greatest(F.lit(BLOCK), F.ceil(F.sqrt(members))))
    return most if grams is None else F.greatest(most, F.ceil(grams / GRAMS))


def near_duplicate_classes(
    docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.99999,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row for each row of ``docs``: (_k, _h, doc_id, class_k, class_h, class_id, n_links).

    Words are runs of letters and digits in lower case, over whole texts; a text of
    fewer than ``n`` words has one n-gram of all of them. Two documents are linked if
    the Jaccard similarity of their n-gram sets is at least ``threshold``; a class is a
    connected component of links, ``class_id`` its least doc_id, and ``n_links`` the
    number of other rows a row is linked to, copies included. A text without words
    (null, empty) has no links and is a class of its own. Rows with equal ids and
    texts count as copies of each other. A pair at the threshold is missed with
    probability 1 - ``recall``, a more similar pair more rarely. Pairs that are met are
    compared exactly, but for those of which too few of all sampled minima agree:
    ``DOUBT`` standard deviations below the threshold, which adds less than 1e-8 to the loss.
    """
    runs = runs_needed(threshold, recall)
    functions = runs * LEVELS * 2
    keyed = docs.select(
        F.col(doc_id).cast("long").alias("_id"), *row_keys(doc_id, text), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    texts = keyed.select("_k", "_h", "_text")
    signed = staged(texts.mapInArrow(
        _signatures(n, functions), "_k long, _h long, s1 long, s2 long, size long, minima array<int>"), "signed")
    classes = staged(signed.groupBy("s1", "s2", "size").agg(
        F.count("*").alias("copies"), F.min(F.struct("_k", "_h")).alias("one")), "classes")
    ones = classes.select("copies", F.col("one._k").alias("_k"), F.col("one._h").alias("_h"))
    sets = staged(signed.join(ones, ["_k", "_h"]).dropDuplicates(["_k", "_h"]), "sets")

    def children(rows: DataFrame, level: int) -> DataFrame:
        """A row for each sampled function of the node: it leads to the child named by the minimum."""
        chance = int(second_sample(threshold) * (1 << 20))
        found = []
        for slot in (0, 1):
            value = F.col("minima")[(F.col("run") * LEVELS + level) * 2 + slot]
            child = F.xxhash64("node", F.lit(slot), value)
            drawn = F.pmod(F.xxhash64("node", F.lit(_SEED)), F.lit(1 << 20)) < chance
            found.append(child if slot == 0 else F.when(drawn, child))
        made = F.explode(F.filter(F.array(*found), lambda c: c.isNotNull()))
        return rows.select("_k", "_h", "size", "minima", "run", made.alias("node"))

    nodes = sets.select("_k", "_h", "size", "minima", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"))
    nodes = nodes.withColumn("node", F.xxhash64("run"))
    leaves = None
    for level in range(LEVELS):
        split = children(nodes, level)
        sizes = split.groupBy("node").agg(F.count("*").alias("members"), F.sum("size").alias("grams")).where("members > 1")
        split = staged(split.drop("minima").join(sizes, "node"), f"nodes{level}")
        small = split if level == LEVELS - 1 else split.where(F.col("members") <= SMALL)
        small = small.select("_k", "_h", "size", F.col("node").alias("leaf"), "members", "grams")
        leaves = small if leaves is None else leaves.unionByName(small)
        if level == LEVELS - 1:
            break
        large = split.where(F.col("members") > SMALL)
        nodes = large.select("_k", "_h", "run", "node").join(sets, ["_k", "_h"])

    # which sets have a promising partner in a leaf
    with_minima = staged(leaves.join(sets.select("_k", "_h", "minima"), ["_k", "_h"]), "minima")
    few = with_minima.where(F.col("members") <= BLOCK).select(F.col("leaf").alias("part"), "leaf", "_k", "_h", "size", "minima")
    found = few.repartition("part").sortWithinPartitions("part").mapInArrow(
        _promising(threshold, functions), "leaf long, _k long, _h long, size long")
    many = _in_blocks(with_minima.where(F.col("members") > BLOCK), _sized(F.col("members")))
    piece = F.pmod(F.xxhash64("_h", "_k"), F.ceil(F.sqrt("members") / BLOCK)).cast("int")
    pieces = many.groupBy("leaf", "block", "blocks", piece.alias("piece")).agg(
        F.collect_list(F.struct("_k", "_h", "size", "minima")).alias("rows"))
    crowded = _streamed(staged(pieces, "crowded")).select("part", "leaf", "block", "to", "rows").mapInArrow(
        _promising_across(threshold, functions), "leaf long, _k long, _h long, size long")
    kept = staged(found.unionByName(crowded).distinct(), "kept")
    # leaves with the same members once
    stats = kept.groupBy("leaf").agg(
        F.count("*").alias("members"), F.sum("size").alias("grams"),
        F.sum(F.xxhash64("_k", "_h").cast("decimal(38,0)")).alias("who"))
    chosen = stats.where("members > 1").groupBy("members", "grams", "who").agg(F.min("leaf").alias("leaf"))
    blocks = _sized(F.col("members"), F.col("grams")).alias("blocks")
    listed = (
        kept.join(chosen.select("leaf", blocks), "leaf").groupBy("_k", "_h")
        .agg(F.collect_list(F.struct("leaf", "blocks")).alias("own")).join(ones, ["_k", "_h"])
    )
    held = (
        texts.join(listed, ["_k", "_h"]).dropDuplicates(["_k", "_h"])
        .withColumn("leaves", F.col("own.leaf")).withColumn("one", F.explode("own"))
        .select("_k", "_h", "copies", "leaves", F.col("one.leaf").alias("leaf"), F.col("one.blocks").alias("blocks"), "_text")
    )
    parted = _in_blocks(held, F.col("blocks")).withColumn("part", F.xxhash64("leaf", "block"))
    own = staged(
        parted.select("part", "leaf", "_k", "_h", "copies", "leaves", "block", "blocks", "_text")
        .repartition("part").sortWithinPartitions("part").mapInArrow(_blocks(n, threshold), PIECES), "own")
    inner = own.select(F.inline(F.arrays_zip("k", "h", "links", "root_k", "root_h"))).toDF("_k", "_h", "links", "root_k", "root_h")
    sent = _streamed(own.where("blocks > 1")).select("part", "leaf", "block", "to", "k", "h", "copies", "leaves", "grams", "root_k", "root_h")
    outer = sent.mapInArrow(_across(threshold), "_k long, _h long, links long, root_k long, root_h long")
    compared = staged(inner.unionByName(outer), "compared")
    one = F.struct("_k", "_h")
    links = compared.groupBy(one.alias("one")).agg(F.sum("links").alias("links"))
    root = F.struct(F.col("root_k").alias("_k"), F.col("root_h").alias("_h"))
    labels = components(compared.select(one.alias("a"), root.alias("b")).where("a <> b"))
    summed = (
        classes.join(links, "one", "left").join(labels.withColumnRenamed("v", "one"), "one", "left")
        .select("s1", "s2", "size", F.coalesce("label", "one").alias("label"),
                (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    )
    members = (
        signed.select("_k", "_h", "s1", "s2", "size").dropDuplicates(["_k", "_h"])
        .join(summed, ["s1", "s2", "size"]).select("_k", "_h", "label", "links")
    )
    out = keyed.select("_id", "_k", "_h").join(members, ["_k", "_h"], "left")
    label = F.coalesce("label", F.struct("_k", "_h"))
    found = out.select(
        "_k", "_h", F.col("_id").alias("doc_id"), label.alias("label"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))
    return found.select(
        "_k", "_h", "doc_id", F.col("label._k").alias("class_k"), F.col("label._h").alias("class_h"),
        F.when(F.col("label._k") != -(2**63), F.col("label._k")).alias("class_id"), "n_links")

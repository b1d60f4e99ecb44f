"""Exact top-k search by inner product with two cover trees.

Queries go to all rows in blocks of bounded size. In each task the rows and the block
of queries are both indexed by a cover tree: a node's points lie within its radius of
its centre, and centres of one level lie further apart than the radius below. No
inner product of a pair of nodes can exceed

    <q, r> + |q| radius(R) + |r| radius(Q) + radius(Q) radius(R)

for their centres q and r, so a pair is passed over when this is less than the worst
k-th score among the queries of its group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordloom.llm.common import bounded

#: Rows of one tree, queries' bytes in a block, and points below which a node of rows or
#: of queries is not divided: a group of queries is held back by its worst score.
TREE, QUERIES, LEAF, GROUP = 8192, 24 << 20, 64, 16
#: Points that a child must have on average, or its parent stays undivided: among points
#: that all lie far apart, a centre covers nothing but itself and no bound would prune.
WORTH = 12


class Node:
    __slots__ = ("centre", "children", "norm", "points", "radius", "worst")

    def __init__(self, centre: np.ndarray, radius: float, points: np.ndarray):
        self.centre, self.radius, self.points = centre, radius, points
        self.norm = float(np.sqrt(centre @ centre))
        self.children: list[Node] = []
        self.worst = -np.inf


def distances(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    d = x - centre
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def build(x: np.ndarray, points: np.ndarray | None = None, first: int | None = None, leaf: int = LEAF) -> Node:
    """A cover tree of the rows of ``x``: children cover their points within half the radius.

    A node whose first centres cover too little is left whole.
    """
    points = np.arange(len(x)) if points is None else points
    first = int(points[0]) if first is None else first
    away = distances(x[points], x[first])
    node = Node(x[first], float(away.max()) * (1 + 1e-12), points)
    if len(points) <= leaf or node.radius == 0:
        return node
    half, left, centre = node.radius / 2, points, first
    covers: list[tuple[np.ndarray, int]] = []
    while len(left):
        near = distances(x[left], x[centre]) <= half
        covers.append((left[near], centre))
        left = left[~near]
        centre = int(left[0]) if len(left) else -1
        if len(covers) % 16 == 0 and len(points) - len(left) < WORTH * len(covers):
            return node
    node.children = [build(x, own, at, leaf) for own, at in covers]
    return node


class Search:
    """The best ``k`` rows for each query; equal scores go to the smaller id."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, k: int):
        self.x, self.ids, self.k = queries, query_ids, k
        self.tree = build(queries, leaf=GROUP)
        n = len(queries)
        self.worst = np.full(n, -np.inf)
        self.found = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))  # query, score, row id
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0
        self.visited = 0

    def compact(self) -> None:
        """Keep the best of what was gathered, and learn the k-th scores."""
        q, s, r = (np.concatenate([a, *(h[i] for h in self.held)]) for i, a in enumerate(self.found))
        self.held, self.size = [], 0
        turn = np.lexsort((r, -s, q))
        q, s, r = q[turn], s[turn], r[turn]
        start = np.concatenate([[True], q[1:] != q[:-1]]) if len(q) else np.empty(0, bool)
        rank = np.arange(len(q)) - np.maximum.accumulate(np.where(start, np.arange(len(q)), 0)) if len(q) else q
        last = rank == self.k - 1
        self.worst[q[last]] = s[last]
        keep = rank < self.k
        self.found = q[keep], s[keep], r[keep]
        self._lower(self.tree)

    def _lower(self, node: Node) -> None:
        node.worst = float(self.worst[node.points].min())
        for child in node.children:
            self._lower(child)

    def add(self, rows: np.ndarray, ids: np.ndarray) -> None:
        root = build(rows)
        stack = [(self._bound(self.tree, root), self.tree, root)]
        while stack:
            bound, a, b = stack.pop()
            if bound < a.worst:
                continue
            if not a.children and not b.children:
                self._leaves(a, b, rows, ids)
            elif not b.children or (a.children and a.radius > b.radius):
                stack += sorted(((self._bound(c, b), c, b) for c in a.children), key=lambda t: t[0])
            else:
                stack += sorted(((self._bound(a, c), a, c) for c in b.children), key=lambda t: t[0])
        self.compact()

    @staticmethod
    def _bound(a: Node, b: Node) -> float:
        bound = float(a.centre @ b.centre) + a.norm * b.radius + b.norm * a.radius + a.radius * b.radius
        return bound + 1e-9 * (1 + abs(bound))

    def _leaves(self, a: Node, b: Node, rows: np.ndarray, ids: np.ndarray) -> None:
        self.visited += len(a.points) * len(b.points)
        for part in range(0, len(b.points), 4096):
            own = b.points[part: part + 4096]
            for some in range(0, len(a.points), 1024):
                asked = a.points[some: some + 1024]
                scores = self.x[asked] @ rows[own].T
                theirs = np.flatnonzero(np.isin(ids[own], self.ids[asked]))
                scores[:, theirs] = np.where(self.ids[asked][:, None] == ids[own[theirs]][None, :], -np.inf, scores[:, theirs])
                least = self.worst[asked]
                if scores.shape[1] > self.k and not np.isfinite(least).all():
                    # a first meeting: only each query's best can count
                    least = np.maximum(least, np.partition(scores, -self.k, axis=1)[:, -self.k])
                i, j = np.nonzero(scores >= np.maximum(least, np.finfo(float).min)[:, None])
                if not len(i):
                    continue
                if len(i) > 8 * self.k * len(asked):  # very many ties
                    tied = self._smallest(i, scores[i, j], ids[own[j]])
                    i, j = i[tied], j[tied]
                self.held.append((asked[i], scores[i, j], ids[own[j]]))
                self.size += len(i)
                if self.size > 4 * self.k * len(self.ids) + 20_000:
                    self.compact()
        if not np.isfinite(a.worst):
            self.compact()

    def _smallest(self, i: np.ndarray, s: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Places of the k best of each query, ties by id."""
        turn = np.lexsort((r, -s, i))
        start = np.concatenate([[True], i[turn][1:] != i[turn][:-1]])
        rank = np.arange(len(turn)) - np.maximum.accumulate(np.where(start, np.arange(len(turn)), 0))
        return turn[rank < self.k]


def scaled(vectors: pa.Array, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their components times the factor, rounded down, one after another)."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = pc.list_value_length(vectors).fill_null(0).to_numpy()
    values = vectors.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy()
    whole = np.floor(values * factor)
    row = np.repeat(np.arange(len(lengths)), lengths)
    bad = np.zeros(len(lengths), bool)
    bad[row[~np.isfinite(values)]] = True
    valid = ~bad & (lengths > 0)
    return valid, whole[valid[row]]


def _by_width(batch_ids: np.ndarray, vectors: pa.Array, factor: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, ids, matrix) of the vectors that take part."""
    valid, whole = scaled(vectors, factor)
    lengths = pc.list_value_length(vectors).fill_null(0).to_numpy()[valid]
    ids = batch_ids[valid]
    first = np.cumsum(lengths) - lengths
    for width in np.unique(lengths).tolist():
        some = np.flatnonzero(lengths == width)
        yield width, ids[some], whole[first[some][:, None] + np.arange(width)[None, :]]


def _search(sent, k: int, factor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches: dict[int, Search] = {}
        for width, ids, x in sent.value:
            searches[width] = Search(x, ids, k)
        held: dict[int, list] = {}

        def flush(width: int) -> None:
            parts = held.pop(width)
            searches[width].add(np.concatenate([p[1] for p in parts]), np.concatenate([p[0] for p in parts]))

        for batch in batches:
            for at in range(0, batch.num_rows, TREE):
                part = batch.slice(at, TREE)
                for width, ids, x in _by_width(part.column(0).to_numpy(), part.column(1), factor):
                    if width in searches:
                        held.setdefault(width, []).append((ids, x))
                        if sum(len(p[0]) for p in held[width]) >= TREE:
                            flush(width)
        for width in list(held):
            flush(width)
        for s in searches.values():
            q, score, r = s.found
            yield pa.RecordBatch.from_arrays(
                [pa.array(s.ids[q]), pa.array(r), pa.array(score.astype(np.int64))], names=["query_id", "vec_id", "score"])

    return run


def _blocks(queries: DataFrame, factor: float) -> Iterator[list[tuple[int, np.ndarray, np.ndarray]]]:
    """The queries in blocks of bounded size, read one partition at a time."""

    def packed(rows: list) -> list[tuple[int, np.ndarray, np.ndarray]]:
        return list(_by_width(np.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.list_(pa.float64())), factor))

    held, size = [], 0
    for row in queries.toLocalIterator():
        own = 8 * len(row[1]) + 64
        if held and size + own > QUERIES:
            yield packed(held)
            held, size = [], 0
        held.append(row)
        size += own
    if held:
        yield packed(held)


def top_inner_products(
    vectors: DataFrame, is_query: Column, k: int = 20, factor: float = 64.0, vec_id: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` rows of the highest inner product.

    Components are taken times ``factor``, rounded down; scores are exact integers
    and ties go to the smaller id. A vector that is null or empty or holds null or a
    non-finite component takes no part, nor does a row without an id. Rows with the
    query's own id are no candidates of it; vectors of another length neither.
    Repeated rows are candidates each; of queries with one id the least vector asks.
    """
    rows = vectors.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull()).select(
        F.col(vec_id).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("_vector"), is_query.alias("_asks"))
    fit = F.forall("_vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    queries = rows.where("_asks").where(fit & (F.size("_vector") > 0)).groupBy("_id").agg(F.min("_vector").alias("_vector"))
    found = None
    for block in _blocks(queries, factor):
        sent = bounded(vectors.sparkSession, block, sum(x.nbytes + ids.nbytes for _, ids, x in block))
        some = rows.select("_id", "_vector").mapInArrow(_search(sent, k, factor), "query_id long, vec_id long, score long")
        found = some if found is None else found.unionByName(some)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Benchmark passages in documents, by the q-gram lemma.

An alignment of an item of L characters with at most k edits keeps L - q + 1 - k * q
of the item's q-grams, all on neighbouring diagonals. Shared q-grams are counted in
overlapping bands of diagonals; regions that reach the bound are kept and verified
by a banded alignment, which gives edits and span.

The items are a stated query set: they go to the documents in blocks of bounded
size, one after another in the same scan, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.llm.common import appended, bounded
from recordloom.llm.folding import as_text, fold

Q = 8
#: Characters of benchmark items in one block.
BLOCK = 2_000_000
#: Alignments done at once.
BATCH = 256
_SLOTS = 22
_FAR = 1 << 20


def codes(points: np.ndarray) -> np.ndarray:
    """A byte for each character: equal characters agree, others seldom do."""
    return ((points * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def qgrams(points: np.ndarray) -> np.ndarray:
    """The q-gram at each place, as one 64-bit number."""
    raw = np.ascontiguousarray(codes(points))
    n = len(raw) - Q + 1
    return np.ndarray((n,), "<u8", raw, strides=(1,)) if n > 0 else np.empty(0, "<u8")


def slots(grams: np.ndarray) -> np.ndarray:
    return (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOTS)


def budget(length: int, rate: float) -> int:
    """Edits allowed for an item: a share of its length, as long as the lemma's bound stays above 0."""
    return max(0, min(int(length * rate), (length - Q) // Q))


@dataclass
class Items:
    """One block of items, ready to be searched for."""

    ids: list
    texts: list[np.ndarray]
    rate: float
    edits: np.ndarray = field(init=False)

    def __post_init__(self):
        lengths = np.array([len(t) for t in self.texts], np.int64)
        self.lengths = lengths
        self.edits = np.array([budget(n, self.rate) for n in lengths.tolist()], np.int64)
        self.least = lengths - Q + 1 - self.edits * Q
        self.strings = [as_text(t) for t in self.texts]
        self.short = np.flatnonzero(lengths < Q).tolist()
        grams = [qgrams(t) for t in self.texts]
        sizes = np.array([len(g) for g in grams], np.int64)
        item = np.repeat(np.arange(len(grams)), sizes)
        place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        every = np.concatenate(grams) if grams else np.empty(0, "<u8")
        turn = np.argsort(every, kind="stable")
        self.item, self.place = item[turn], place[turn]
        self.grams, self.first, self.count = np.unique(every[turn], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << _SLOTS, bool)
        self.seen[slots(self.grams)] = True
        self.gap = int(2 * (lengths.max(initial=0) + 4 * (self.edits.max(initial=0) + 1)) + Q)

    def regions(self, points: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, row, first diagonal in the row) of the bands that share enough q-grams."""
        nothing = (np.empty(0, np.int64),) * 3
        grams = qgrams(points)
        at = np.flatnonzero(self.seen[slots(grams)])
        if not len(at) or not len(self.grams):
            return nothing
        index = np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)
        true = self.grams[index] == grams[at]
        at, index = at[true], index[true]
        row = np.searchsorted(rows, at, "right") - 1
        inside = at + Q <= rows[row + 1]
        at, index, row = at[inside], index[inside], row[inside]
        times = self.count[index]
        hit = np.repeat(self.first[index] - np.cumsum(times) + times, times) + np.arange(times.sum())
        at, row = np.repeat(at, times), np.repeat(row, times)
        item = self.item[hit]
        # rows lie apart, so that a band holds hits of one row only
        diagonal = at + row * self.gap - self.place[hit] + self.gap
        band = diagonal // (self.edits[item] + 1)
        keys = np.concatenate([item << 40 | band, item << 40 | (band - 1)])
        keys, one, n = np.unique(keys, return_index=True, return_counts=True)
        good = n >= self.least[keys >> 40]
        keys, one = keys[good], one[good] % len(at)
        item, band = keys >> 40, keys & ((1 << 40) - 1)
        row = row[one]
        return item, row, band * (self.edits[item] + 1) - self.gap - row * self.gap - rows[row]

    def align(self, points: np.ndarray, rows: np.ndarray, item: np.ndarray, row: np.ndarray, diagonal: np.ndarray):
        """(edits, start, end in the row) of the best alignment in each band."""
        k = self.edits[item]
        width = 4 * k + 3  # two bands of diagonals, and k on either side
        longest, widest = int(self.lengths[item].max()), int(width.max())
        first = diagonal - k
        columns = np.arange(longest + widest)
        where = first[:, None] + columns[None, :]
        size = (rows[row + 1] - rows[row])[:, None]
        valid = (where >= 0) & (where < size)
        region = np.where(valid, points[np.where(valid, where + rows[row][:, None], 0)], np.uint32(0xFFFFFFFF))
        texts = np.zeros((len(item), longest), np.uint32)
        for i, x in enumerate(item.tolist()):
            texts[i, : self.lengths[x]] = self.texts[x]
        band = np.arange(widest)
        outside = band[None, :] >= width[:, None]
        cost = np.where(outside, _FAR, 0)
        begin = np.broadcast_to(band, cost.shape).copy()
        best = np.full(len(item), _FAR)
        start, end = np.zeros(len(item), np.int64), np.zeros(len(item), np.int64)
        for i in range(longest):
            moved = cost + (region[:, i: i + widest] != texts[:, i: i + 1])
            above = np.full_like(cost, _FAR)
            above[:, :-1] = cost[:, 1:] + 1
            came = np.empty_like(begin)
            came[:, :-1], came[:, -1] = begin[:, 1:], 0
            better = above < moved
            cost, begin = np.where(better, above, moved), np.where(better, came, begin)
            lead = cost - band
            low = np.minimum.accumulate(lead, axis=1)
            source = np.maximum.accumulate(np.where(lead == low, band, 0), axis=1)
            cost = np.where(outside, _FAR, low + band)
            begin = np.take_along_axis(begin, source, 1)
            done = np.flatnonzero(self.lengths[item] == i + 1)
            if len(done):
                c = cost[done].argmin(axis=1)
                best[done] = cost[done, c]
                start[done] = first[done] + begin[done, c]
                end[done] = first[done] + i + 1 + c
        return best, start, end

    def find(self, texts: list[str]) -> list[list[dict]]:
        """For each text its matches: item_id, start, end (characters of the text), edits."""
        points, rows, place = fold(texts)
        found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        item, row, diagonal = self.regions(points, rows)
        left = []
        for i, (x, r, d) in enumerate(zip(item.tolist(), row.tolist(), diagonal.tolist())):
            k, n = int(self.edits[x]), int(self.lengths[x])
            a = max(int(rows[r]), int(rows[r]) + d)
            b = min(int(rows[r + 1]), int(rows[r]) + d + 2 * k + 2 + n)
            at = as_text(points[a:b]).find(self.strings[x])  # most copies are exact
            if at < 0:
                left.append(i)
            else:
                found.setdefault((r, x), []).append((0, a + at - int(rows[r]), a + at + n - int(rows[r])))
        left.sort(key=lambda i: int(self.lengths[item[i]]))
        for i in range(0, len(left), BATCH):
            some = np.array(left[i: i + BATCH])
            best, start, end = self.align(points, rows, item[some], row[some], diagonal[some])
            for j in np.flatnonzero(best <= self.edits[item[some]]).tolist():
                found.setdefault((int(row[some[j]]), int(item[some[j]])), []).append((int(best[j]), int(start[j]), int(end[j])))
        for x in self.short:
            for r in range(len(texts)):
                own = " " + as_text(points[rows[r]: rows[r + 1]])
                at = own.find(f" {self.strings[x]} ")
                while at >= 0:
                    found.setdefault((r, x), []).append((0, at, at + int(self.lengths[x])))
                    at = own.find(f" {self.strings[x]} ", at + 1)
        out: list[list[dict]] = [[] for _ in texts]
        for (r, x), spans in sorted(found.items()):
            kept: list[tuple[int, int, int]] = []
            for edits, a, b in sorted(spans):  # of overlapping spans the one with the fewest edits
                if all(b <= s or a >= e for _, s, e in kept):
                    kept.append((edits, a, b))
            base, last = int(rows[r]), int(rows[r + 1]) - 1
            for edits, a, b in sorted(kept, key=lambda s: s[1:]):
                out[r].append({
                    "item_id": self.ids[x], "start": int(place[min(base + max(a, 0), last)]),
                    "end": int(place[min(max(base + b - 1, base), last)]) + 1, "edits": edits})
        return out


def item_blocks(benchmark: DataFrame, item_id: str, text: str, size: int = BLOCK) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, read one partition at a time."""
    held, n = [], 0
    rows = benchmark.select(F.col(item_id).cast("long"), F.col(text).cast("string")).where(F.col(text).isNotNull())
    for x, t in rows.toLocalIterator():
        if held and n + len(t) > size:
            yield held
            held, n = [], 0
        held.append((x, t))
        n += len(t)
    if held:
        yield held


def _items(rows: list[tuple[int, str]], rate: float) -> Items:
    ids, texts = [], []
    for x, t in rows:
        points = fold([t])[0][:-1]
        if len(points):
            ids.append(x)
            texts.append(points)
    return Items(ids, texts, rate)


LEAKS = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()), T.StructField("edits", T.IntegerType())]))


def benchmark_leaks(
    docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, text: str = "text", item_id: str = "item_id",
    item_text: str = "text", leaks: str = "leaks", keep: list[str] | None = None,
) -> DataFrame:
    """Add ``leaks``: the places where a whole benchmark item occurs in a text, with few edits.

    Texts and items are compared as letters and digits in lower case, with one space
    between words. An item may have ``rate`` of its length in edits (less where the
    lemma would give no bound, none below ``Q`` characters: those must be whole
    words). ``start`` and ``end`` count characters of the text. Null or empty items
    match nothing, null or empty texts have no leaks; repeated items are reported
    each, repeated rows alike, overlapping places of one item once, by the fewest
    edits. A column named ``leaks`` is replaced.
    """
    rows = docs if keep is None else docs.select(*keep, text)
    out = rows.drop(leaks).withColumn(leaks, F.lit(None).cast(LEAKS))
    blocks = 0
    for block in item_blocks(benchmark, item_id, item_text):
        sent = bounded(docs.sparkSession, block, sum(4 * len(t) + 64 for _, t in block))

        def start(sent=sent):
            items = _items(sent.value, rate)
            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))
            return lambda texts: [pa.array(items.find([t or "" for t in texts.to_pylist()]), kind)]

        more = f"_leaks{blocks}"
        out = appended(out, text, [(more, LEAKS)], start)
        out = out.withColumn(leaks, F.concat(F.coalesce(leaks, F.array().cast(LEAKS)), more)).drop(more)
        blocks += 1
    out = out.withColumn(leaks, F.coalesce(leaks, F.array().cast(LEAKS)))
    return out if keep is None or text in keep else out.drop(text)

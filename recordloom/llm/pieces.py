"""Find the windows of a corpus that occur more than once, by minimiser.

A window is a fixed number of units (bytes or words) of one document. Neighbouring
windows with the same least k-gram travel together as one piece, under that
k-gram's hash. Equal windows have equal minimisers, so

* pieces whose minimiser is at one place of the corpus only hold no repeated window
  and are dropped (a piece of periodic text has its minimiser at several places),
* of equal pieces one is kept with its number of copies,
* only where a minimiser has several different pieces are their bytes fetched, and
  the pieces of a minimiser meet in one bucket, which an exact sort works on.

A minimiser with more than ``CROWDED`` different pieces does not go to one bucket:
its pieces are cut again by longer k-grams, in the end as long as the window, where
equal windows have equal pieces and counting them is all there is to do. Every
window is judged, whatever its minimiser.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import PORTION, cut_batches, portions, staged, text_buffers
from recordloom.llm.hashing import BASES, BYTE_VALUES, Prefix, slide_min, word_bounds, word_hashes

#: Different pieces of one minimiser that a bucket may hold; bounds its memory.
CROWDED = 2000
#: Bytes of pieces that a bucket sorts at once, whole minimisers at a time.
BUCKET = 1 << 20

_PIECE = "_k long, _h long, start long, n int, key long, piece long, places int"
_HELD = "_k long, _h long, start long, n int, key long, piece long, places int, copies long, content binary"
_SPAN = "_k long, _h long, a long, b long"


@dataclass(frozen=True)
class Unit:
    """``window`` units; ``grams``: k of the first cut and of those of crowded minimisers."""

    words: bool
    window: int
    grams: tuple[int, ...]


def units(data: np.ndarray, offsets: np.ndarray, unit: Unit):
    """Values to hash, row offsets in units, and each unit's first and end byte (words only)."""
    if not unit.words:
        return data, offsets, None, None
    starts, ends, rows = word_bounds(data, offsets)
    return word_hashes(data, starts, ends), rows, starts, ends


def places(h: np.ndarray, least: np.ndarray, first: np.ndarray, last: np.ndarray, w: int) -> np.ndarray:
    """1 where a piece's minimiser is at one place of it, else 2."""
    # a gram is a minimiser if the largest of the minima around it is its own value
    padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    at = np.flatnonzero(h == ~slide_min(~padded, w))
    kinds, kind = np.unique(h[at], return_inverse=True)
    by = np.sort(kind * (len(h) + 1) + at)
    own = np.searchsorted(kinds, least[first]) * (len(h) + 1)
    return np.minimum(np.searchsorted(by, own + last + w - 1) - np.searchsorted(by, own + first), 2)


def runs(values: np.ndarray, offsets: np.ndarray, window: int, k: int):
    """(row, start in the row, windows, minimiser, hash of the piece, places) of all pieces."""
    long = np.flatnonzero(np.diff(offsets) >= window)
    found = []
    if not len(long):
        return tuple(np.empty(0, np.int64) for _ in range(6))
    for a, b in portions(offsets, PORTION):
        step = PORTION if offsets[b] - offsets[a] > 2 * PORTION else int(offsets[b] - offsets[a])
        for s in range(int(offsets[a]), int(offsets[b]), max(step, 1)):
            e = min(s + step + window - 1, int(offsets[b]))
            own = np.clip(offsets[a: b + 1], s, e) - s
            if e - s < window:
                continue
            v = values[s:e]
            v = BYTE_VALUES[v] if v.dtype == np.uint8 else v
            grams = Prefix(v, BASES[0]).all(k)
            least = slide_min(grams, window - k + 1)
            n = len(least)
            inside = np.zeros(n + 1, np.int8)
            full = np.flatnonzero(np.diff(own) >= window)
            np.add.at(inside, own[full], 1)
            np.add.at(inside, np.minimum(own[full + 1] - window + 1, n), -1)
            valid = np.cumsum(inside[:n]) > 0
            new = valid.copy()
            if k < window:
                new[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
            first = np.flatnonzero(new)
            if not len(first):
                continue
            # a run ends where the next begins or the row has no more windows; very long runs are cut
            row_end = own[np.searchsorted(own, first, "right")] - window + 1
            last = np.minimum(np.append(first[1:], n), row_end)
            parts = -(-(last - first) // (2 * window))
            if parts.max() > 1:
                turn = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                start = np.repeat(first, parts) + turn * 2 * window
                last = np.minimum(start + 2 * window, np.repeat(last, parts))
                first = start
            row = np.searchsorted(own, first, "right") - 1
            piece = Prefix(v, BASES[1]).at(first, last + window - 1)
            found.append((
                row + a, first + s - offsets[row + a], last - first, least[first].view(np.int64), piece.view(np.int64),
                places(grams, least, first, last, window - k + 1) if k < window else np.ones(len(first), np.int64)))
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(6))
    return tuple(np.concatenate([x[i] for x in found]) for i in range(6))


def _cut(unit: Unit) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for batch in cut_batches(batches, "_text"):
            data, offsets = text_buffers(batch.column(2))
            values, rows, _, _ = units(data, offsets, unit)
            row, start, n, key, piece, place = runs(values, rows, unit.window, unit.grams[0])
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(start, pa.int64()),
                 pa.array(n, pa.int32()), pa.array(key, pa.int64()), pa.array(piece, pa.int64()), pa.array(place, pa.int32())],
                names=["_k", "_h", "start", "n", "key", "piece", "places"])

    return run


def _held(rows: list[tuple]) -> pa.RecordBatch:
    long, short = pa.int64(), pa.int32()
    kinds = [long, long, long, short, long, long, short, long, pa.binary()]
    names = ["_k", "_h", "start", "n", "key", "piece", "places", "copies", "content"]
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def _fetch(unit: Unit) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The bytes of the wanted pieces of each document."""

    def run(batches):
        for batch in cut_batches(batches, "_text"):
            data, offsets = text_buffers(batch.column(2))
            _, rows, starts, ends = units(data, offsets, unit) if unit.words else (None, offsets, None, None)
            out, held = [], data.tobytes()
            wanted = batch.column(3).to_pylist()
            for i, (k, h) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                for w in wanted[i]:
                    a = int(rows[i]) + w["start"]
                    b = a + w["n"] + unit.window - 1
                    content = held[starts[a]: ends[b - 1]] if unit.words else held[a:b]
                    out.append((k, h, w["start"], w["n"], w["key"], w["piece"], w["places"], w["copies"], content))
            if out:
                yield _held(out)

    return run


def _cut_again(unit: Unit, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pieces of crowded minimisers cut by longer k-grams; the last cut needs no bytes."""

    def run(batches):
        for batch in cut_batches(batches, "content", BUCKET):
            column = batch.column(batch.schema.get_field_index("content"))
            data, offsets = text_buffers(column)
            values, rows, starts, ends = units(data, offsets, unit)
            held = data.tobytes()
            ids, hs, at, copies = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("_k", "_h", "start", "copies"))
            out = []
            for row, start, n, key, piece, place in zip(*(x.tolist() for x in runs(values, rows, unit.window, k))):
                a = int(rows[row]) + start
                b = a + n + unit.window - 1
                content = b"" if k == unit.window else held[starts[a]: ends[b - 1]] if unit.words else held[a:b]
                out.append((int(ids[row]), int(hs[row]), int(at[row]) + start, n, key, piece, place, int(copies[row]), content))
            if out:
                yield _held(out)

    return run


def _bucket(
    unit: Unit, repeated: Callable[[list[bytes], int], list[np.ndarray]],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sort the windows of whole minimisers; spans of repeated ones in pieces that occur once."""

    def work(rows: list[tuple]) -> pa.RecordBatch:
        out = []
        for (k, h, start, copies, _), mask in zip(rows, repeated([r[4] for r in rows], unit.window)):
            if copies > 1 or not mask.any():
                continue  # all of a piece with copies is repeated already
            edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
            out += [(k, h, start + a, start + b + unit.window - 1) for a, b in edges.reshape(-1, 2).tolist()]
        columns = list(zip(*out)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["_k", "_h", "a", "b"])

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("_k", "_h", "start", "copies", "content", "key")]
            for *row, key in zip(*columns):
                if key != last and size >= BUCKET:
                    yield work(held)
                    held, size = [], 0
                last = key
                held.append(tuple(row))
                size += len(row[4])
        if held:
            yield work(held)

    return run


def covered(docs: DataFrame, unit: Unit, repeated: Callable[[list[bytes], int], list[np.ndarray]]) -> DataFrame:
    """(_k, _h, a, b): stretches of units that repeated windows cover, overlapping or not.

    ``docs`` has _k, _h and _text. Rows with equal keys count as copies of each
    other. ``repeated`` sorts the windows of a list of pieces and marks those that
    occur more than once among them.
    """
    width = unit.window - 1
    pieces = staged(docs.mapInArrow(_cut(unit), _PIECE), "pieces")
    often = pieces.groupBy("key").agg(F.sum("places").alias("_often")).where("_often > 1").select("key")
    shared = staged(pieces.join(often, "key"), "shared")
    found = []

    def settle(rows: DataFrame, copies, name: str) -> tuple[DataFrame, DataFrame]:
        """Of equal pieces one; the spans of those with copies; and the rest by minimiser."""
        kinds = staged(
            rows.groupBy("key", "piece", "n", "places")
            .agg(copies.alias("_all"), F.min(F.struct("_k", "_h", "start")).alias("_one")),
            name)
        many = kinds.where("_all > 1").select("key", "piece")
        found.append(rows.join(many, ["key", "piece"], "left_semi").select(
            "_k", "_h", F.col("start").alias("a"), (F.col("start") + F.col("n") + width).alias("b")))
        several = (
            kinds.groupBy("key").agg(F.count("*").alias("different"), F.max("places").alias("_most"))
            .where("different > 1 or _most > 1").drop("_most")
        )
        return kinds, several

    kinds, several = settle(shared, F.count("*"), "kinds")
    wanted = (
        kinds.join(several, "key")
        .groupBy(F.col("_one._k").alias("_k"), F.col("_one._h").alias("_h"))
        .agg(F.collect_list(F.struct(
            F.col("_one.start").alias("start"), "n", "key", "piece", "places", F.col("_all").alias("copies"))).alias("_wanted"))
    )
    texts = docs.join(wanted, ["_k", "_h"]).select("_k", "_h", "_text", "_wanted").dropDuplicates(["_k", "_h"])
    held = staged(texts.mapInArrow(_fetch(unit), _HELD), "contents").join(several, "key")
    for i, k in enumerate(unit.grams[1:]):
        found.append(
            held.where(F.col("different") <= CROWDED).repartition("key").sortWithinPartitions("key")
            .mapInArrow(_bucket(unit, repeated), _SPAN))
        crowded = held.where(F.col("different") > CROWDED)
        if crowded.isEmpty():
            break
        again = staged(crowded.mapInArrow(_cut_again(unit, k), _HELD), f"again{i}")
        kinds, several = settle(again, F.sum("copies"), f"kinds{i}")
        one = kinds.select("key", "piece", "_all", F.col("_one._k").alias("_k"), F.col("_one._h").alias("_h"), F.col("_one.start").alias("start"))
        held = (
            again.drop("copies").join(one, ["key", "piece", "_k", "_h", "start"]).join(several, "key")
            .withColumnRenamed("_all", "copies")
        )
    spans = found[0]
    for more in found[1:]:
        spans = spans.unionByName(more)
    return spans

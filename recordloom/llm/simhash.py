"""Near duplicates by SimHash: exact comparison of fingerprints in tiles.

Different fingerprints are packed into tiles by the population counts of their four
quarters. Two fingerprints that differ in ``radius`` bits have counts whose distance
(the sum over the quarters) is at most ``radius``, so other pairs of tiles are skipped
unseen. The tiles that are left are compared whole, by exclusive or and bit counts.
A pair of tiles reports a shallow forest that spans its links, never the links
themselves, so a group of n near fingerprints costs in proportion to n in rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.llm.common import appended, as_row, staged, text_buffers
from recordloom.llm.components import components
from recordloom.llm.spread import spread_join
from recordloom.llm.stretches import word_stretches

SEED = 42
SHINGLE = 3
RADIUS = 2
#: Fingerprints of a tile, on average; the rows of one side that are compared at once.
TILE, STRIP = 1024, 128
QUARTERS, QUARTER_BITS = 4, 16
#: Children of a node in the forests that are reported.
FAN = 16
#: Shingles whose bits are counted at once.
PORTION = 1 << 16

_LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bit by bit the majority over the hashes of a text's shingles, repeats included.

    A-Z read as a-z, words end at space and tab to carriage return. Fewer words than a
    shingle has are one shingle; no words give zero. A bit that exactly half of the
    hashes set is not set. Words are read in stretches that overlap by a shingle less one.
    """
    sums, count, before = np.zeros(64, np.int64), 0, []
    for words in word_stretches(text, _LOWER):
        words = before + words
        before = words[max(len(words) - shingle + 1, 0):]
        if len(words) >= shingle:
            count += len(words) - shingle + 1
            sums += _set_bits(words, shingle)
    if not count and before:
        count, sums = 1, _set_bits(before, len(before))
    return int.from_bytes(np.packbits(2 * sums > count).tobytes(), "big")


def _set_bits(words: list[bytes], shingle: int) -> np.ndarray:
    """How many hashes of the shingles set each bit, the highest first."""
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts, stops = (ends - [len(w) for w in words])[: len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist()
    digest, sums = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, len(starts), PORTION):
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[i: i + PORTION], stops[i: i + PORTION])]
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8)).reshape(-1, 64)
        sums += bits.sum(axis=0, dtype=np.int64)
    return sums


def _fingerprints():
    def work(texts: pa.Array) -> list[pa.Array]:
        data, offsets = text_buffers(texts)
        held = data.tobytes()
        found = [fingerprint(held[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        return [pa.array(np.array(found, np.uint64).view(np.int64))]

    return work


def near_fingerprints(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS,
) -> DataFrame:
    """The columns of ``docs`` but its text, ``fingerprint`` (16 hexadecimal digits) and ``component_id``.

    Documents whose fingerprints differ in at most ``radius`` bits are linked;
    ``component_id`` is the least id that can be reached over links, a document's own
    included. Null and wordless texts have fingerprint zero and are linked as any other.
    Null ids are never a component's id; a component without any other has a null one.
    Equal rows are rows of their own. No rows give no rows. Columns of ``docs`` named as
    a new one are replaced.
    """
    kept = [c for c in docs.columns if c not in (text, "fingerprint", "component_id")]
    packed = docs.select(as_row(kept), F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_said"))
    rows = staged(appended(packed, "_said", [("_f", T.LongType())], _fingerprints, keep=["_row", "_id"]), "prints")
    found = rows.groupBy("_f").agg(F.min("_id").alias("_least"))
    prints = staged(found, "different")
    labels = components(links(prints.select(F.col("_f").alias("f")), radius))
    named = staged(prints.join(labels, F.col("_f") == F.col("v"), "left").select(
        "_f", "_least", F.coalesce("label", "_f").alias("_label")), "labelled")
    least = named.groupBy("_label").agg(F.min("_least").alias("component_id"))
    known = spread_join(named, "_label", least).select("_f", "component_id")
    digits = F.lower(F.lpad(F.hex("_f"), 16, "0")).alias("fingerprint")
    return spread_join(rows, "_f", known).select(*(F.col(f"_row.`{c}`") for c in kept), digits, "component_id")


def quarter_counts(f: Column) -> list[Column]:
    """Set bits in each quarter of a 64-bit number."""
    mask = F.lit((1 << QUARTER_BITS) - 1).cast("long")
    return [F.bit_count(F.shiftrightunsigned(f, QUARTER_BITS * i).bitwiseAND(mask)).cast("int") for i in range(QUARTERS)]


def _packed_counts(counts: list[Column]) -> Column:
    key = F.lit(0)
    for c in counts:
        key = key * 32 + c
    return key.cast("int")


def neighbours(radius: int) -> list[tuple[int, ...]]:
    """Differences of quarter counts that ``radius`` bits can make, one of each opposite pair."""
    all_of = product(range(-radius, radius + 1), repeat=QUARTERS)
    return [d for d in all_of if sum(map(abs, d)) <= radius and d >= (0,) * QUARTERS]


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges ``(a, b)`` that link the different fingerprints ``f`` as all pairs within ``radius`` would.

    A tile is one row that holds its fingerprints as bytes, so the exchanges carry tiles.
    There are at most 17 ** 4 counts of quarters; counts that very many fingerprints share
    have several tiles, cut by a hash.
    """
    keyed = prints.select("f", _packed_counts(quarter_counts(F.col("f"))).alias("counts"))
    sizes = keyed.groupBy("counts").agg(F.ceil(F.count("*") / tile).cast("long").alias("parts"))
    # 17 ** 4 rows at most, whatever the data
    cut = keyed.join(F.broadcast(sizes), "counts").withColumn("part", F.pmod(F.xxhash64("f"), "parts"))
    tiles = staged(cut.groupBy("counts", "part").agg(F.sort_array(F.collect_list("f")).alias("fs")), "tiles")
    known = F.broadcast(sizes.select(F.col("counts").alias("other"), F.col("parts").alias("other_parts")))
    steps = F.array(*[F.lit(sum(x * 32 ** (QUARTERS - 1 - i) for i, x in enumerate(d))) for d in neighbours(radius)])
    # a tile meets those of its own counts from its own number on, and all of a later neighbour's
    near = tiles.select("counts", "part", F.explode(steps).alias("step"))
    near = near.withColumn("other", F.col("counts") + F.col("step")).join(known, "other")
    first = F.when(F.col("step") == 0, F.col("part")).otherwise(F.lit(0).cast("long"))
    pairs = near.select("counts", "part", "other", F.explode(F.sequence(first, F.col("other_parts") - 1)).alias("other_part"))
    right = tiles.select(F.col("counts").alias("other"), F.col("part").alias("other_part"), F.col("fs").alias("gs"))
    met = pairs.join(tiles, ["counts", "part"]).join(right, ["other", "other_part"])
    same = (F.col("counts") == F.col("other")) & (F.col("part") == F.col("other_part"))
    return met.select("fs", F.when(~same, F.col("gs")).alias("gs")).mapInArrow(_compare(radius), "a long, b long")


def _compare(radius: int):
    """Of each pair of tiles, or of one tile with itself (null), the forest of its links."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column("fs"), batch.column("gs")):
                one = left.values.to_numpy().view(np.uint64)
                other = right.values.to_numpy().view(np.uint64) if right.is_valid else None
                a, b = forest(one, other, radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return run


def forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what links between two tiles (or within one) join; fewer than there are fingerprints."""
    every = left if right is None else np.concatenate([left, right])
    others = every if right is None else right
    shift = 0 if right is None else len(left)
    label = np.arange(len(every))
    for s in range(0, len(left), STRIP):
        near = np.bitwise_count(left[s: s + STRIP, None] ^ others[None, :]) <= radius
        if right is None:
            near[np.arange(near.shape[0]), np.arange(s, s + near.shape[0])] = False
        for r in np.flatnonzero(near.any(axis=1)):
            joined = np.unique(np.append(label[np.flatnonzero(near[r]) + shift], label[s + r]))
            if len(joined) > 1:
                label[np.isin(label, joined)] = joined[0]
    order = np.argsort(label, kind="stable")
    starts = np.concatenate([[0], np.flatnonzero(np.diff(label[order])) + 1])
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(order)]])))
    child = np.flatnonzero(place > 0)
    parent = child - place[child] + (place[child] - 1) // FAN
    return every[order[child]], every[order[parent]]

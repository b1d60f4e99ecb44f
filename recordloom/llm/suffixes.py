"""Exact substring deduplication with a two-stage suffix sort.

Equal long strings meet in one bucket (see ``pieces``). A bucket sorts the suffixes
that begin a window: only those smaller than their successor are sorted directly;
the order of the others follows from scanning the buckets of first bytes from the
smallest on, since a suffix larger than its successor comes in the order of that
successor. Common prefixes of neighbours in the order then tell which strings of
the given length start at more than one place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.llm.common import as_row, cut_batches, row_keys, text_buffers
from recordloom.llm.pieces import Unit, covered

#: Pairs of neighbours whose prefixes are compared at once.
_PAIRS = 1 << 14


def suffix_order(contents: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in order, the joined bytes with an end mark, which places begin a window).

    Ordered are all places that begin a window and those up to the next suffix
    smaller than its successor. Order counts up to ``window`` bytes; a piece's end
    is smaller than any byte.
    """
    lengths = np.array([len(c) for c in contents], np.int64)
    data = np.zeros(int(lengths.sum()) + len(contents), np.int16)
    ends = np.cumsum(lengths + 1) - 1  # of the end marks, which are 0; bytes are 1 more
    starts = ends - lengths
    raw = b"".join(c + b"\0" for c in contents)
    data[:] = np.frombuffer(raw, np.uint8)
    data += 1
    data[ends] = 0
    n = len(data)
    # smaller: the suffix is smaller than its successor; end marks count as such
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(data[1:] - data[:-1])
    step[ends] = 1
    decided = np.where(step != 0, np.arange(n), n)
    following = np.minimum.accumulate(decided[::-1])[::-1]
    smaller = step[following] > 0
    opening = np.zeros(n + 1, np.int64)
    np.add.at(opening, starts, 1)
    np.add.at(opening, np.maximum(starts, ends - window + 1), -1)
    window_at = np.cumsum(opening[:n]) > 0
    # up to the first smaller suffix at or after each place
    next_smaller = np.minimum.accumulate(np.where(smaller, np.arange(n), n)[::-1])[::-1]
    reach = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(window_at)
    np.add.at(reach, at, 1)
    np.add.at(reach, next_smaller[at] + 1, -1)
    needed = np.cumsum(reach[:n]) > 0
    # first stage: sort the smaller ones by their bytes
    direct = np.flatnonzero(needed & smaller)
    piece_end = ends[np.searchsorted(ends, direct)]
    spans = list(zip(direct.tolist(), np.minimum(direct + window, piece_end).tolist()))
    spans.sort(key=lambda s: raw[s[0]: s[1]])
    direct = np.array([s[0] for s in spans], np.int64)
    # second stage: scan the buckets of first bytes upwards and place predecessors
    larger = needed & ~smaller
    by_byte = data[direct]
    direct = direct[np.argsort(by_byte, kind="stable")]
    cuts = np.searchsorted(np.sort(by_byte), np.arange(258))
    waiting: list[list[np.ndarray]] = [[] for _ in range(258)]
    ordered = []
    for byte in range(257):
        bucket = [*waiting[byte]]
        wave = np.concatenate(bucket) if bucket else np.empty(0, np.int64)
        while len(wave):  # predecessors with the same byte follow in the order of this wave
            wave = wave[wave > 0] - 1
            wave = wave[larger[wave] & (data[wave] == byte)]
            bucket.append(wave)
        bucket.append(direct[cuts[byte]: cuts[byte + 1]])
        done = np.concatenate(bucket)
        if not len(done):
            continue
        ordered.append(done)
        before = done[done > 0] - 1
        before = before[larger[before] & (data[before] > byte)]
        kinds = data[before]
        turn = np.argsort(kinds, kind="stable")
        before, kinds = before[turn], kinds[turn]
        for group in np.split(before, np.flatnonzero(np.diff(kinds)) + 1):
            if len(group):
                waiting[int(data[group[0]])].append(group)
    return (np.concatenate(ordered) if ordered else np.empty(0, np.int64)), data, window_at


def common_prefixes(order: np.ndarray, data: np.ndarray, most: int) -> np.ndarray:
    """For each neighbour pair in ``order``, the length of the common prefix, up to ``most``."""
    raw = np.concatenate([data, np.zeros(most, data.dtype)])
    rows = np.lib.stride_tricks.sliding_window_view(raw, most)
    out = np.empty(max(len(order) - 1, 0), np.int64)
    for i in range(0, len(out), _PAIRS):
        a, b = order[i: i + _PAIRS], order[i + 1: i + 1 + _PAIRS]
        a = a[: len(b)]
        same = np.ones(len(a), bool)
        length = np.zeros(len(a), np.int64)
        for s in range(0, most, 64):  # most neighbours differ early; the rest go on
            live = np.flatnonzero(same)
            if not len(live):
                break
            differ = rows[a[live], s: s + 64] != rows[b[live], s: s + 64]
            ended = differ.any(axis=1)
            length[live] += np.where(ended, differ.argmax(axis=1), differ.shape[1])
            same[live[ended]] = False
        out[i: i + len(a)] = length
    return out


def repeated_strings(contents: list[bytes], window: int) -> list[np.ndarray]:
    """For each piece and window of it: whether that string starts at another place too."""
    order, data, window_at = suffix_order(contents, window)
    order = order[window_at[order]]
    same = common_prefixes(order, data, window) >= window
    mark = np.zeros(len(data), bool)
    mark[order[:-1][same]] = True
    mark[order[1:][same]] = True
    out, at = [], 0
    for c in contents:
        out.append(mark[at: at + max(len(c) - window + 1, 0)])
        at += len(c) + 1
    return out


def _trim(batches):
    """Cut the spans out of each text."""
    for batch in cut_batches(batches, "_text"):
        column = batch.schema.get_field_index
        data, offsets = text_buffers(batch.column(column("_text")))
        texts, readable, sizes, removed, runs = [], [], [], [], []
        for i, spans in enumerate(batch.column(column("_spans")).to_pylist()):
            own = data[offsets[i]: offsets[i + 1]]
            gone = count = 0
            split = np.empty(0, np.uint8)
            if spans:
                edge = np.zeros(len(own) + 1, np.int32)
                at = np.array([(s["a"], s["b"]) for s in spans], np.int64)
                np.add.at(edge, at[:, 0], 1)
                np.add.at(edge, at[:, 1], -1)
                out = np.cumsum(edge[:-1]) > 0
                gone = int(out.sum())
                count = int((out & ~np.concatenate([[False], out[:-1]])).sum())
                # a letter that a cut takes in part is left out of the readable text
                lead = np.maximum.accumulate(np.where(own & 0xC0 != 0x80, np.arange(len(own)), 0))
                broken = np.zeros(len(own), bool)
                broken[lead[out]] = True
                split = own[~out & ~broken[lead]]
                own = own[~out]
            texts.append(own.tobytes())
            readable.append(split.tobytes() if spans else texts[-1])
            sizes.append(int(offsets[i + 1] - offsets[i]))
            removed.append(gone)
            runs.append(count)
        yield pa.RecordBatch.from_arrays(
            [batch.column(column("_row")), pa.array(texts, pa.binary()),
             pa.array(readable, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int64()),
             pa.array(removed, pa.int64()), pa.array(runs, pa.int64())],
            names=["_row", "kept_bytes", "kept_text", "n_bytes", "n_removed", "n_spans"])


def remove_repeated_strings(docs: DataFrame, length: int = 400, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Remove every byte that a ``length``-byte string covers which also starts elsewhere.

    Texts are judged as UTF-8 bytes, whole, on the input; matches do not cross rows.
    Adds ``kept_bytes`` (binary), ``kept_text`` (the same without letters that a cut
    leaves in part), ``n_bytes``, ``n_removed`` and ``n_spans`` (maximal
    removed runs) to all columns; columns of these names are replaced. A null or
    short text loses nothing. Rows repeated with the same id and text, also rows
    without an id, are copies of each other and lose everything a window covers.
    """
    made = ("kept_bytes", "kept_text", "n_bytes", "n_removed", "n_spans")
    kept = [c for c in docs.columns if c not in made]
    keyed = docs.select(as_row(kept), *row_keys(doc_id, text), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))
    unit = Unit(words=False, window=length, grams=_grams(length))
    spans = covered(keyed.select("_k", "_h", "_text"), unit, repeated_strings)
    per_row = spans.groupBy("_k", "_h").agg(F.collect_set(F.struct("a", "b")).alias("_spans"))
    rows = keyed.join(per_row, ["_k", "_h"], "left").select("_row", "_text", "_spans")
    schema = T.StructType([
        rows.schema["_row"], T.StructField("kept_bytes", T.BinaryType()),
        T.StructField("kept_text", T.StringType()), *(T.StructField(c, T.LongType()) for c in made[2:])])
    return rows.mapInArrow(_trim, schema).select(*(F.col(f"_row.`{c}`") for c in kept), *made)


def _grams(length: int) -> tuple[int, ...]:
    """An eighth of the window at first, then nearer and nearer to all of it."""
    return tuple(dict.fromkeys(max(1, k) for k in (length // 8, length * 5 // 8, length - length // 25, length)))

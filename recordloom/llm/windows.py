"""Word-window deduplication: super-k-mers in buckets, windows counted by sorting.

Consecutive windows that share a minimiser travel as one packed string to its
bucket (see ``pieces``), where sorting the windows brings equal ones together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.llm.common import as_row, cut_batches, row_keys, text_buffers
from recordloom.llm.hashing import ranges, word_bounds
from recordloom.llm.pieces import Unit, covered


def packed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by one space, and where each then starts and ends."""
    lengths = ends - starts
    out = np.full(int(lengths.sum()) + len(starts), 0x20, np.uint8)
    at = np.cumsum(lengths + 1) - lengths - 1
    out[ranges(at, lengths)] = data[ranges(starts, lengths)]
    return out.tobytes(), at, at + lengths


def repeated_windows(contents: list[bytes], window: int) -> list[np.ndarray]:
    """For each piece and window of it: whether that word sequence starts at another place too."""
    data = np.frombuffer(b"".join(contents), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(c) for c in contents])]).astype(np.int64)
    starts, ends, rows = word_bounds(data, offsets)
    text, at, end = packed(data, starts, ends)
    first = np.concatenate([np.arange(a, max(a, b - window + 1)) for a, b in zip(rows[:-1], rows[1:])] or [[]]).astype(np.int64)
    spans = list(zip(at[first].tolist(), end[first + window - 1].tolist(), first.tolist()))
    strings = sorted([(text[a:b], i) for a, b, i in spans])
    mark = np.zeros(len(starts), bool)
    for (s, i), (t, j) in zip(strings, strings[1:]):
        if s == t:
            mark[i] = mark[j] = True
    return [mark[a: max(a, b - window + 1)] for a, b in zip(rows[:-1], rows[1:])]


def _trim(batches):
    """Cut the spans of words out of each text."""
    for batch in cut_batches(batches, "_text"):
        column = batch.schema.get_field_index
        data, offsets = text_buffers(batch.column(column("_text")))
        starts, ends, rows = word_bounds(data, offsets)
        texts, sizes, removed = [], [], []
        for i, spans in enumerate(batch.column(column("_spans")).to_pylist()):
            s, e = starts[rows[i]: rows[i + 1]], ends[rows[i]: rows[i + 1]]
            sizes.append(len(s))
            if spans:
                edge = np.zeros(len(s) + 1, np.int32)
                at = np.array([(x["a"], x["b"]) for x in spans], np.int64)
                np.add.at(edge, at[:, 0], 1)
                np.add.at(edge, at[:, 1], -1)
                stay = np.cumsum(edge[:-1]) == 0
                s, e = s[stay], e[stay]
            removed.append(sizes[-1] - len(s))
            texts.append(packed(data, s, e)[0][:-1])
        yield pa.RecordBatch.from_arrays(
            [batch.column(column("_row")), pa.array(texts, pa.binary()).cast(pa.string()),
             pa.array(sizes, pa.int64()), pa.array(removed, pa.int64())],
            names=["_row", "kept_words", "n_words", "n_removed"])


def remove_repeated_windows(docs: DataFrame, window: int = 35, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Remove every word that a window of ``window`` words covers which also starts elsewhere.

    Words are runs of anything but space and tab to carriage return, unchanged;
    windows do not cross rows and are judged on the input. Adds ``kept_words`` (the
    remaining words joined by one space), ``n_words`` and ``n_removed`` to all
    columns; columns of these names are replaced. A null text has no words, a short
    one loses none. Rows repeated with the same id and text, also rows without an
    id, are copies of each other and lose everything a window covers.
    """
    made = ("kept_words", "n_words", "n_removed")
    kept = [c for c in docs.columns if c not in made]
    keyed = docs.select(as_row(kept), *row_keys(doc_id, text), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text"))
    unit = Unit(words=True, window=window, grams=_grams(window))
    spans = covered(keyed.select("_k", "_h", "_text"), unit, repeated_windows)
    per_row = spans.groupBy("_k", "_h").agg(F.collect_set(F.struct("a", "b")).alias("_spans"))
    rows = keyed.join(per_row, ["_k", "_h"], "left").select("_row", "_text", "_spans")
    schema = T.StructType([
        rows.schema["_row"], T.StructField("kept_words", T.StringType()),
        *(T.StructField(c, T.LongType()) for c in made[1:])])
    return rows.mapInArrow(_trim, schema).select(*(F.col(f"_row.`{c}`") for c in kept), *made)


def _grams(window: int) -> tuple[int, ...]:
    """A fifth of the window at first, then nearer and nearer to all of it."""
    return tuple(dict.fromkeys(max(1, k) for k in (window // 5, window * 5 // 7, window - window // 12, window)))

"""Texts as folded code points: lower case, letters and digits only, one space between words."""

from __future__ import annotations

import functools
import sys

import numpy as np

SPACE = 0x20


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its lower-case one (0: not a letter or digit)."""
    low = np.zeros(sys.maxunicode + 1, np.uint32)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalnum():
            small = c.lower()
            low[i] = ord(small) if len(small) == 1 else i
    return low, low != 0


def fold(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all texts, row offsets, place of each in its own text).

    Each word is followed by one space; a text starts with a word.
    """
    low, _ = tables()
    sizes = np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    points = low[raw]
    word = points != 0
    # a separator stays if a word ends before it in the same text; a text that ends in a word gets a space
    last = offsets[1:][sizes > 0] - 1
    open_end = last[word[last]]
    first_gap = np.zeros(len(raw), bool)
    first_gap[1:] = word[:-1] & ~word[1:]
    starts = offsets[:-1][sizes > 0]
    first_gap[starts] = False
    keep = np.flatnonzero(word | first_gap)
    rows = np.searchsorted(keep, offsets)
    out = np.where(word[keep], points[keep], SPACE).astype(np.uint32)
    place = keep - np.repeat(offsets[:-1], np.diff(rows))
    if len(open_end):
        at = np.searchsorted(keep, open_end) + 1
        out = np.insert(out, at, SPACE)
        place = np.insert(place, at, place[at - 1] + 1)
        rows = rows + np.searchsorted(np.searchsorted(keep, open_end) + 1, rows, "right")
    return out, rows, place


def as_text(points: np.ndarray) -> str:
    return points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")

"""Vectorised hashes of byte and word sequences.

A sequence hashes to the sum of its units' random values times powers of an odd
number modulo 2**64; prefix sums give the hash of any stretch, and the inverse
power makes it independent of the place.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Odd multipliers and the seed of the byte values; any others do as well.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
SEED = 20260801

BYTE_VALUES = np.random.default_rng(SEED).integers(0, 2**64, 256, dtype=np.uint64)
#: Separators of words: space, and tab to carriage return.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of ``base`` and of its inverse."""
    held = _POWERS.get(base)
    if held is None or len(held[0]) <= n:
        size = 1 << max(12, int(n).bit_length())
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        held = _POWERS[base] = (made[0], made[1])
    return held


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a hash over all 64 bits."""
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h ^= h >> U(29)
    h *= U(0xA24BAED4963EE407)
    h ^= h >> U(32)
    return h


class Prefix:
    """Hashes of stretches of ``values``."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        up, self.down = powers(base, n)
        self.sums = np.empty(n + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(values * up[:n], out=self.sums[1:])

    def all(self, k: int) -> np.ndarray:
        """Of every stretch of ``k`` units."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n] + U(k))

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def slide_min(h: np.ndarray, w: int) -> np.ndarray:
    """The least of every ``w`` neighbours, in two running minima."""
    n = len(h) - w + 1
    if w == 1:
        return h
    whole = -(-len(h) // w) * w
    x = np.full(whole, ~U(0), np.uint64)
    x[: len(h)] = h
    x = x.reshape(-1, w)
    left = np.minimum.accumulate(x, axis=1).ravel()
    right = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1: w - 1 + n])


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data``, and for each row the number of words before it."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SEPARATOR[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """A hash of each word; ``data`` is read in stretches of whole words."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + step, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        out[i:j] = Prefix(BYTE_VALUES[data[a:b]], BASES[0]).at(starts[i:j] - a, ends[i:j] - a)
        i = j
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of start, start + 1, ... for each range."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - first, lengths)

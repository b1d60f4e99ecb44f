"""Plain versions of the operators, to compare with."""

import hashlib
import re
from collections import Counter


def strings(rows, length):
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256), windows of bytes counted in a dictionary."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[k: k + length] for _, b in texts for k in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if count[b[k: k + length]] > 1:
                gone[k: k + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def windows(rows, length):
    texts = [(i, re.findall("[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    count = Counter(tuple(w[k: k + length]) for _, w in texts for k in range(len(w) - length + 1))
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if count[tuple(w[k: k + length])] > 1:
                gone[k: k + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def grams(text, n=5):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return frozenset(tuple(words[i: i + n]) for i in range(max(len(words) - n + 1, 1))) if words else frozenset()


def classes(rows, n=5, threshold=0.8):
    """(doc_id, class_id, n_links): all pairs compared."""
    sets = [grams(t, n) for _, t in rows]
    where = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for i, s in enumerate(sets):
        near = Counter(j for g in s for j in where[g] if j > i)
        for j, both in near.items():
            if both >= threshold * (len(s) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), d), d)
    return sorted((d, least[top(i)], links[i]) for i, (d, _) in enumerate(rows))

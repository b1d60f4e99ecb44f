"""op12 against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from recordloom.llm import simhash
from recordloom.llm.simhash import fingerprint, forest, links, near_fingerprints, neighbours

SMALL = "/root/testdata/sf0.01"


def plain_print(text):
    words = re.findall("[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i: i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reached(prints, radius=2):
    """For each print the number of its component, by all pairs."""
    different = sorted(set(prints))
    held = np.array(different, np.uint64)
    root = list(range(len(held)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(held)):
        for j in np.flatnonzero(np.bitwise_count(held[i + 1:] ^ held[i]) <= radius) + i + 1:
            root[top(i)] = top(j)
    where = {f: top(i) for i, f in enumerate(different)}
    return [where[f] for f in prints]


def plain(rows):
    prints = [plain_print(t) for _, t in rows]
    roots, least = reached(prints), {}
    for (i, _), r in zip(rows, roots):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted(((i, f"{f:016x}", least.get(r)) for (i, _), f, r in zip(rows, prints, roots)), key=str)


def found(df):
    return sorted((tuple(r) for r in near_fingerprints(df).select("doc_id", "fingerprint", "component_id").collect()), key=str)


def odd_rows():
    rng = random.Random(3)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "One  two\tthree"), (8, "one two three four"),
            (9, "É a b"), (10, "é a b"), (11, "x x x x x"), (None, "one"), (None, "no id at all"), (4, "one"), (4, "one")]
    base = [f"w{rng.randrange(400)}" for _ in range(300)]
    for i in range(80):
        words = list(base)
        words[rng.randrange(300)] = f"v{i}"
        rows.append((100 + i, " ".join(words)))
    rows += [(300 + i, " ".join(base)) for i in range(30)]
    return rows + [(400, "word " * 300_000), (401, "Word " * 300_000 + "end"), (402, "x" * 3_000_000)]


def test_odd_rows(spark):
    rows = odd_rows()
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)


def test_the_tables(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert found(df) == plain([tuple(r) for r in df.select("doc_id", "text").collect()])


def test_clashing_names_and_empty_table(spark):
    rows = odd_rows()[:15]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {c: F.lit(7) for c in ("f", "_f", "counts", "part", "label", "fingerprint", "component_id")})
    assert found(df) == plain(rows)
    assert {"f", "counts", "label"} < set(near_fingerprints(df).columns)
    assert found(df.limit(0)) == []


def test_stretches_change_nothing(monkeypatch):
    text = " ".join(f"w{i % 37}" for i in range(500))
    whole = fingerprint(text.encode())
    assert whole == plain_print(text)
    monkeypatch.setattr(simhash, "PORTION", 7)
    for size in (5, 64, 1000):
        monkeypatch.setattr(simhash, "word_stretches", lambda t, table, n=size: __import__(
            "recordloom.llm.stretches", fromlist=["x"]).word_stretches(t, table, n))
        assert fingerprint(text.encode()) == whole
        assert fingerprint(b"a  b") == plain_print("a b")


@pytest.mark.parametrize("tile", [1024, 20])
def test_tiles_lose_no_link(spark, tile):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**64, 120, dtype=np.uint64)
    near = [base]
    for _ in range(6):
        flips = [np.uint64(1) << rng.integers(0, 64, len(near[-1]), dtype=np.uint64) for _ in range(rng.integers(1, 4))]
        near.append(near[-1] ^ np.bitwise_or.reduce(flips))
    # and one crowd in which every print links to very many
    crowd = np.array([(1 << a) | (1 << b) for a in range(30) for b in range(a)], np.uint64)
    prints = np.unique(np.concatenate([*near, crowd, np.array([0, 2**64 - 1], np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "f long")
    edges = [(int(np.int64(r.a).view(np.uint64)), int(np.int64(r.b).view(np.uint64))) for r in links(df, tile=tile).collect()]
    assert all((a ^ b).bit_count() >= 1 for a, b in edges)
    want = reached([int(p) for p in prints])
    root = {int(p): int(p) for p in prints}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[top(a)] = top(b)
    got = [top(int(p)) for p in prints]
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_a_crowd_makes_rows_in_proportion():
    held = np.array([(1 << a) | (1 << b) for a in range(64) for b in range(a)], np.uint64)
    for n in (500, 1000, 2000):
        a, _ = forest(held[:n], None, 2)
        assert len(a) == n - 1
        degrees = np.unique(np.concatenate(forest(held[:n], None, 2)), return_counts=True)[1]
        assert degrees.max() <= simhash.FAN + 1


def test_no_neighbour_is_left_out():
    rng = random.Random(1)
    steps = set(neighbours(2))
    for _ in range(2000):
        a = rng.getrandbits(64)
        b = a ^ (1 << rng.randrange(64)) ^ (rng.choice([0, 1]) << rng.randrange(64))
        d = tuple((b >> 16 * i & 65535).bit_count() - (a >> 16 * i & 65535).bit_count() for i in range(4))
        assert d in steps or tuple(-x for x in d) in steps

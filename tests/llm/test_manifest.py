"""op13 against trees of lists."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from recordloom.llm.manifest import Versions, dataset_manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if c is None else f"{len(str(c).encode())}:{c}" for c in row))


def climb(nodes):
    """Levels of a tree, the leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i: i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def way(levels, place):
    out = []
    for nodes in levels[:-1]:
        first = place // 3 * 3
        out.append(("".join(nodes[first:place]), "".join(nodes[place + 1: first + 3])))
        place //= 3
    return out


def plain(rows):
    groups = {}
    for row in rows:
        doc_id, source, lang, n_chars, text = row
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        other = (*row[:4], None if text is None else text.replace("\n", "")) if hit else row
        groups.setdefault(source, []).append((doc_id, leaf(row), leaf(other)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[s] = climb([r[1] for r in groups[s]])
    top = climb([trees[s][-1][0] for s in order])
    out = []
    for g, s in enumerate(order):
        for place, (doc_id, digest, other) in enumerate(groups[s]):
            steps, x = way(trees[s], place) + way(top, g), other
            for left, right in steps:
                x = h(left + x + right)
            out.append((doc_id, digest, trees[s][-1][0], top[-1][0], h("".join(a + b for a, b in steps)), x, x == top[-1][0]))
    return sorted(out, key=str)


def tampered():
    hit = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return {"text": F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}


NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def found(df, **more):
    return sorted((tuple(r) for r in dataset_manifest(df, tampered=tampered(), **more).select(*NAMES).collect()), key=str)


def rows(n=400):
    rng = random.Random(2)
    made = [
        (i, rng.choice(["hot", "hot", "hot", "a", "b", "é", None, ""]), rng.choice(["en", None]), rng.choice([i * 7, None]),
         rng.choice([None, "", "one\ntwo", f"line {i}\n", "plain é"])) for i in range(n)]
    made += [(None, "a", None, None, None), (None, "a", "x", None, "a\n"), (3, "lone", None, 1, "x\ny" * 400_000)]
    return made + [(7, "hot", "en", 5, "same\n")] * 60 + [(7, "hot", "en", 6, "same\n")] * 3


@pytest.mark.parametrize("height", [7, 2, 1])
def test_against_lists(spark, height):
    made = rows()
    assert found(spark.createDataFrame(made, SCHEMA), height=height) == plain(made)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28])
def test_small_trees(spark, n):
    made = [(i, "s", None, i, "x\ny") for i in range(n)]
    assert found(spark.createDataFrame(made, SCHEMA), height=2) == plain(made)


def test_many_sources(spark):
    made = [(i, f"s{i}", None, i, "x\ny") for i in range(40)]
    assert found(spark.createDataFrame(made, SCHEMA), height=1) == plain(made)


def test_one_source_without_a_name(spark):
    made = [(i, None, None, i, "x\ny") for i in range(5)]
    assert found(spark.createDataFrame(made, SCHEMA)) == plain(made)


def test_empty_table_and_clashing_names(spark):
    made = rows(30)
    df = spark.createDataFrame(made, SCHEMA).withColumns({c: F.lit(1) for c in ("tree", "pos", "leaf", "root", "n", "part", "total")})
    assert found(df) == plain(made)
    assert found(df.limit(0)) == []


def test_a_version_shares_what_it_does_not_touch():
    leaves = [h(str(i)) for i in range(9**2)]
    tree = Versions(leaves, 4)
    before = len(tree.digests)
    version = tree.replaced(40, h("other"))
    assert len(tree.digests) - before == 5
    assert tree.digests[version] == climb([*leaves[:40], h("other"), *leaves[41:]])[-1][0]
    assert tree.digests[tree.root] == climb(leaves)[-1][0]

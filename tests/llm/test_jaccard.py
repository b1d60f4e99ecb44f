"""op2 against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

import brute
from recordloom.llm import jaccard
from recordloom.llm.components import components
from recordloom.llm.jaccard import met, near_duplicate_classes, runs_needed

SMALL = "/root/testdata/sf0.001"


def edited(words, rng, share):
    return " ".join(rng.choice("pqrst") * 3 if rng.random() < share else w for w in words)


def odd_rows():
    rng = random.Random(11)
    rows = [(1, None), (2, ""), (3, "..."), (4, "one two"), (5, "One, two!"), (6, "one two three"), (7, "one two three four five six")]
    base = [f"w{rng.randrange(500)}" for _ in range(200)]
    rows += [(100 + i, edited(base, rng, 0.012)) for i in range(70)]
    rows += [(200 + i, " ".join(base)) for i in range(5)]
    for k in range(12):
        own = [f"v{rng.randrange(300)}" for _ in range(60 + k * 10)]
        rows += [(300 + 10 * k + i, edited(own, rng, 0.02 * i)) for i in range(4)]
    return rows


def found(df, **more):
    out = near_duplicate_classes(df, **more).select("doc_id", "class_id", "n_links").collect()
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("small,block", [(48, 128), (4, 9)])
def test_odd_rows(spark, monkeypatch, small, block):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = odd_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df) == sorted(brute.classes(rows), key=str)


def test_the_tables(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    assert found(df) == sorted(brute.classes(rows), key=str)


def test_rows_without_id_repeated_rows_and_clashing_names(spark):
    rows = [(None, "a b c d e f g"), (None, "a b c d e f g"), (1, "x y z u v w q"), (1, "x y z u v w q"), (2, "x y z u v w q")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("node", "leaf", "size", "label")})
    assert found(df) == sorted([(None, None, 1), (None, None, 1), (1, 1, 2), (1, 1, 2), (2, 1, 2)], key=str)
    assert found(df.limit(0)) == []


def test_a_group_of_near_copies_makes_rows_in_proportion(spark, monkeypatch):
    """One group of n different near copies: rows of the comparison grow as n, classes and links stay exact."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    made, real = {}, jaccard.staged

    def counted(df, name):
        out = real(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard, "staged", counted)
    rng, base = random.Random(2), [f"w{i}" for i in range(120)]
    per_set = []
    for n in (250, 500, 1000):
        rows = []
        for i in range(n):
            words = list(base)
            words[rng.randrange(120)] = f"v{i}"
            rows.append((i, " ".join(words)))
        made.clear()
        got = found(spark.createDataFrame(rows, "doc_id long, text string"))
        if n == 250:
            assert got == sorted(brute.classes(rows), key=str)
        assert {c for _, c, _ in got} == {0} and {k for _, _, k in got} == {n - 1}
        per_set.append(made["compared"] / n)
    assert max(per_set) < 2 * min(per_set)


def test_very_long_texts_and_a_hot_source_of_repeats(spark):
    long = " ".join(f"w{i % 5001}" for i in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, "x" * 2_000_000), (4, "x" * 2_000_000)] + [(10 + i, "same words in all of these") for i in range(300)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == sorted(brute.classes(rows), key=str)


def test_recall():
    assert 0.6 < met(0.8) < 0.7
    assert (1 - met(0.8)) ** runs_needed(0.8, 0.99999) <= 1e-5


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.v: r.label for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}

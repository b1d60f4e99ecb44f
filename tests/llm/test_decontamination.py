"""op1 against a plain search for the best alignment."""

import random
import re

import pytest
from pyspark.sql import functions as F

from recordloom.llm import decontamination
from recordloom.llm.decontamination import benchmark_leaks, budget

TABLES = "/root/testdata/sf0.001"


def plain(text):
    return " ".join(re.findall(r"[^\W_]+", (text or "").lower()))


def distance(item, text):
    """The fewest edits between the item and any part of the text."""
    row = [0] * (len(text) + 1)
    for a in item:
        new = [row[0] + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def edited(text, edits, rng):
    out = list(text)
    for _ in range(edits):
        i = rng.randrange(len(out))
        out[i: i + 1] = rng.choice([[], [rng.choice("abcdefgh")], [out[i], rng.choice("xyz")]])
    return "".join(out)


def tables(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 7)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([4, 9, 20, 40, 60])] + [(50, "kurz"), (51, None), (52, "!!"), (53, "")]
    docs = [(None, None), (1, ""), (2, "no match at all")]
    for k in range(60):
        item = items[k % 5][1]
        n = budget(len(item), 0.1)
        docs.append((10 + k, " ".join(word() for _ in range(30)) + " " + edited(item, rng.randrange(0, 2 * n + 2), rng) + ". " + word()))
    docs += [(100, items[3][1].upper() + "! und Kurz, " + items[3][1]), (100, items[2][1]), (101, items[2][1]), (102, "kurzum")]
    return docs, items


@pytest.mark.parametrize("block", [2_000_000, 150])
def test_against_all_alignments(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination.item_blocks, "__defaults__", (block,))
    docs, items = tables(spark)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"start": F.lit(1), "leaks": F.lit("x"), "item_id": F.lit(0)})
    out = benchmark_leaks(df, spark.createDataFrame(items, "item_id long, text string"))
    assert out.columns == ["doc_id", "text", "start", "item_id", "leaks"]
    rows = out.collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = {}
        for i, t in items:
            p, d = plain(t), plain(r.text)
            if len(p) >= 8:
                if (n := distance(p, d)) <= budget(len(p), 0.1):
                    want[i] = n
            elif p and f" {p} " in f" {d} ":
                want[i] = 0
        got = {}
        for x in r.leaks:
            got[x.item_id] = min(got.get(x.item_id, 99), x.edits)
            assert distance(plain(dict(items)[x.item_id]), plain(r.text[x.start: x.end])) <= x.edits + 1
        assert got == want
    twice = [x for r in rows if r.doc_id == 100 for x in r.leaks if x.item_id == 3]
    assert len(twice) == 2


def test_the_tables(spark):
    docs, items = (spark.read.parquet(f"{TABLES}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, x.item_id) for r in benchmark_leaks(docs, items, keep=["doc_id"]).collect() for x in r.leaks}
    texts, passages = ([tuple(r) for r in df.select(df.columns[0], "text").collect()] for df in (docs, items))
    exact = {(d, i) for d, t in texts for i, p in passages if f" {plain(p)} " in f" {plain(t)} "}
    assert exact and exact <= got and len(got) <= len(exact) + 5


def test_empty(spark):
    docs, items = tables(spark)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert all(r.leaks == [] for r in benchmark_leaks(df, bench.limit(0)).collect())
    assert benchmark_leaks(df.limit(0), bench).collect() == []

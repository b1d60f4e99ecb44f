"""op9 against all inner products."""

import numpy as np
from pyspark.sql import functions as F

from recordloom.llm import covertree
from recordloom.llm.covertree import Search, build, top_inner_products

SMALL = "/root/testdata/sf0.01"


def brute(rows, k=20):
    held = [(i, np.floor(np.array(v, float) * 64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in held:
        if q % 20 == 0:
            scores = sorted((-int(a @ b), i) for i, b in held if i != q and len(b) == len(a))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in top_inner_products(df, F.col("vec_id") % 20 == 0).collect())


def test_the_tables(spark, monkeypatch):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding")
    want = brute([tuple(r) for r in df.collect()])
    assert found(df) == want
    monkeypatch.setattr(covertree, "QUERIES", 4000)  # several blocks of queries
    assert found(df.repartition(7)) == want


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    same = [float(x) for x in rng.normal(size=5)]
    rows = [(i, same) for i in range(60)] + [(i, [float(x) for x in rng.normal(size=5)]) for i in range(60, 200)]
    rows += [(200, None), (220, [None, 1.0]), (240, [float("nan"), 1.0]), (260, [float("inf")] * 5), (280, []), (None, same), (300, [0.0] * 5), (320, [1.0, 2.0]), (321, [3.0, -2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"score": F.lit("x"), "rank": F.lit(1), "query_id": F.lit(2)})
    assert found(df) == brute(rows)
    assert found(df.limit(0)) == []
    twice = top_inner_products(df.union(df), F.col("vec_id") == 300).collect()
    assert len(twice) == 20 and all(r.score == 0 for r in twice) and [r.vec_id for r in sorted(twice)] == sorted([*range(10)] * 2)


def test_trees_cover_and_prune():
    rng = np.random.default_rng(3)
    x = np.floor(np.concatenate([rng.normal(c, 0.05, (300, 8)) for c in rng.normal(size=(12, 8))]) * 64)

    def check(node):
        away = np.sqrt(((x[node.points] - node.centre) ** 2).sum(axis=1))
        assert away.max() <= node.radius
        if node.children:
            assert sorted(p for c in node.children for p in c.points.tolist()) == sorted(node.points.tolist())
            centres = np.array([c.centre for c in node.children])
            apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2))[~np.eye(len(centres), dtype=bool)]
            assert (apart > node.radius / 2).all()
            [check(c) for c in node.children]

    check(build(x))
    ids = np.arange(len(x))
    s = Search(x[::20], ids[::20], 20)
    s.add(x, ids)
    assert s.visited < 0.5 * len(x) * len(x[::20])

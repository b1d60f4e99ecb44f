"""op7 against its SQL and by hand."""

import math
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from recordloom.llm.licenses import TEMPLATES, scan_licenses
from recordloom.llm.queries import QUERIES, SQL

TABLES = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings"):
        duck.execute(f"create view {t} as select * from '{TABLES}/{t}.parquet'")
    cursor = duck.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    want = sorted(map(str, cursor.fetchall()))
    df = QUERIES[name](spark, TABLES)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(str(tuple(r)) for r in df.select(columns).collect()) == want


def test_plan_has_no_python(spark):
    plan = QUERIES["op7_license_scan"](spark, TABLES)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))


def test_inheritance_and_odd_rows(spark):
    mit, apache = "Released under the MIT License.", "licensed under the APACHE license version 2.0"
    rows = [
        ("a/LICENSE", mit), ("a/x", "nothing"), ("a/b/c/y", None), ("a/b/COPYING", f"some\n{apache}\nmore"), ("a/b/z", ""),
        ("a/b/own", "SPDX-License-Identifier: GPL-3.0"), ("ab/q", "text"), ("top", "text"), (None, mit), (None, None), ("a/x", "nothing"),
        ("a/license.txt", "This license is unlike any other that anybody has ever seen before."), ("e/" * 200 + "deep", "w " * 100_000 + mit),
    ]
    df = spark.createDataFrame(rows, "path string, text string").withColumns({c: F.lit("x") for c in ("line", "license", "term", "cosine")})
    got = {(r.path, r.license, r.origin, r.inherited_from) for r in scan_licenses(df).collect()}
    assert scan_licenses(df).count() == len(rows)
    assert got == {
        ("a/LICENSE", "MIT", "own", None), ("a/x", "MIT", "inherited", "a"), ("a/b/c/y", "Apache-2.0", "inherited", "a/b"),
        ("a/b/COPYING", "Apache-2.0", "own", None), ("a/b/z", "Apache-2.0", "inherited", "a/b"), ("a/b/own", "GPL-3.0", "own", None),
        ("ab/q", None, None, None), ("top", None, None, None), (None, "MIT", "own", None), (None, None, None, None),
        ("a/license.txt", "MIT", "inherited", "a"), ("e/" * 200 + "deep", None, None, None)}
    assert scan_licenses(df.limit(0)).collect() == []


def test_every_term_has_its_own_frequency(spark):
    """Cosines by hand, with the document frequency of every word, not only of the templates'."""
    said = "This project is released under the MIT License."
    texts = [said, "this project is released", "project of the day", None, *["project is this"] * 3000]
    df = spark.createDataFrame([(f"d{i}/f", t) for i, t in enumerate(texts)], "path string, text string")

    def split(t):
        return [w for w in re.split("[^a-z0-9]+", (t or "").lower()) if w]

    files = Counter(w for t in texts for w in set(split(t)))

    def weights(t):
        return {w: n * (math.log((1 + len(texts)) / (1 + files[w])) + 1) for w, n in Counter(split(t)).items()}

    def cosine(a, b):
        return sum(w * b.get(k, 0) for k, w in a.items()) / math.hypot(*a.values()) / math.hypot(*b.values())

    want = max((round(cosine(weights(said), weights(body)), 6), name) for name, body in TEMPLATES)
    got = scan_licenses(df).where("own_license is not null").collect()
    assert [(r.path, r.cosine, r.own_license) for r in got] == [("d0/f", pytest.approx(want[0], abs=2e-6), want[1])]

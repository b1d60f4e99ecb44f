"""Every bound query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    found = duckdb.connect()
    for name in TABLES:
        found.execute(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    return found


def as_set(rows):
    return sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_agrees(spark, duck, name):
    df = entry.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = [tuple(dict(zip(names, r))[c] for c in columns) for r in cursor.fetchall()]
    assert as_set(got) == as_set(want)


def test_entry(spark):
    assert {r.status for r in entry.entry(spark).collect()} == {"Ready", "Incomplete", "Duplicate", "Conflict"}

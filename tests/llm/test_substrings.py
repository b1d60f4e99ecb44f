"""op3 and op8 against dictionaries of all windows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from recordloom.llm import pieces
from recordloom.llm.suffixes import remove_repeated_strings, repeated_strings, suffix_order
from recordloom.llm.windows import remove_repeated_windows, repeated_windows

SMALL = "/root/testdata/sf0.001"


def odd_rows():
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdé ") for _ in range(900))
    rows = [(None, None), (1, None), (2, ""), (3, "short"), (4, "a" * 401), (5, "a" * 400), (6, "ab" * 300), (7, "xyz" * 500)]
    rows += [(8, passage), (8, passage), (9, passage[:399]), (10, passage[200:650]), (None, passage[100:800])]
    rows += [(20 + i, f"{i} " + "".join(rng.choice("ab ") for _ in range(60)) + passage[i * 3: 500 + i * 5] + str(i) * 9) for i in range(25)]
    rows += [(60, " ".join(rng.choice(["u", "v", "w"]) for _ in range(3000)))]
    rows += [(70 + i, " ".join(f"w{(k * k) % 97}" for k in range(i, 90 + 2 * i))) for i in range(8)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def strings(df, length):
    out = remove_repeated_strings(df, length)
    rows = out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256)).collect()
    return sorted(map(tuple, rows), key=str)


def windows(df, length):
    out = remove_repeated_windows(df, length)
    rows = out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_words").cast("binary"), 256)).collect()
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("length", [400, 50])
@pytest.mark.parametrize("crowded", [2000, 2])
def test_strings(spark, monkeypatch, length, crowded):
    monkeypatch.setattr(pieces, "CROWDED", crowded)
    rows = odd_rows()
    assert strings(frame(spark, rows), length) == sorted(brute.strings(rows, length), key=str)


@pytest.mark.parametrize("length", [35, 12])
@pytest.mark.parametrize("crowded", [2000, 2])
def test_windows(spark, monkeypatch, length, crowded):
    monkeypatch.setattr(pieces, "CROWDED", crowded)
    rows = odd_rows()
    assert windows(frame(spark, rows), length) == sorted(brute.windows(rows, length), key=str)


def test_long_rows_are_cut(spark, monkeypatch):
    for module in (pieces,):
        monkeypatch.setattr(module, "PORTION", 300)
    rows = odd_rows()
    values = [np.frombuffer((t or "").encode(), np.uint8) for _, t in rows]
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])])
    row, start, n, *_ = pieces.runs(np.concatenate(values), offsets, 50, 6)
    got = sorted((r, s + k) for r, s, m in zip(row.tolist(), start.tolist(), n.tolist()) for k in range(m))
    assert got == [(r, k) for r, v in enumerate(values) for k in range(len(v) - 49)]


def test_the_tables(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    assert strings(df, 400) == sorted(brute.strings(rows, 400), key=str)
    assert windows(df, 35) == sorted(brute.windows(rows, 35), key=str)


def test_empty_table_and_clashing_names(spark):
    df = frame(spark, []).withColumns({"n_bytes": F.lit("x"), "start": F.lit(1), "key": F.lit(2), "n": F.lit(3)})
    assert strings(df, 400) == [] and windows(df, 35) == []
    df = frame(spark, odd_rows()).withColumns({c: F.lit(7) for c in ("n_bytes", "start", "key", "n", "a", "copies", "kept_words")})
    assert strings(df, 50) == sorted(brute.strings(odd_rows(), 50), key=str)
    out = remove_repeated_windows(df, 12)
    assert out.columns[:2] == ["doc_id", "text"] and out.columns.count("kept_words") == 1


def test_suffixes_are_in_order():
    rng = random.Random(2)
    for size in (1, 3, 9):
        contents = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(size, 60))) for _ in range(20)]
        order, data, at = suffix_order(contents, size)
        joined = [(c[i: i + size]) for c in contents for i in range(len(c) + 1)]
        strings_ = [joined[i] for i in order.tolist() if at[i]]
        assert strings_ == sorted(strings_) and len(strings_) == sum(max(len(c) - size + 1, 0) for c in contents)
        count = {s: strings_.count(s) for s in set(strings_)}
        got = repeated_strings(contents, size)
        assert [m.tolist() for m in got] == [[count[c[i: i + size]] > 1 for i in range(len(c) - size + 1)] for c in contents]
        words = [" ".join("ab"[b % 2] for b in c).encode() for c in contents]
        assert len(repeated_windows(words, size)) == len(words)

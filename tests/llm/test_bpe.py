"""op6 against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import struct

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from recordloom.llm.bpe import encode_decode
from recordloom.llm.queries import op6_bpe_round_trip, vocabulary

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary("word_bpe_49k.json"))


def odd_texts():
    rng = random.Random(4)
    return [
        None, "", " ", "\n\t", "Hello, WORLD!", "don't we'll I'm", "a" * 30_000, "ab" * 20_000, "x" * 200 + " y", "É é ß İ ı Ω ώ 日本語 한국어",
        "<|startoftext|> and <|endoftext|>", "<|endoftext|", "1234 5.6 7,8", "\u00a0\u2003wide\u3000space", "😀👍🏽 e\u0301", "\x00\x01", "_under_score__",
        *("".join(rng.choice("ab C'\n.,!?é日1 ") for _ in range(rng.randrange(80))) for _ in range(300)),
    ]


def wanted(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_odd_texts(spark, library):
    texts = odd_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in encode_decode(df, vocabulary("word_bpe_49k.json")).collect():
        ids, decoded = wanted(library, texts[r.doc_id])
        got = list(struct.unpack(f"<{len(r.token_ids) // 4}I", bytes(r.token_ids)))
        assert (got, r.n_tokens, r.decoded) == (ids, len(ids), decoded), texts[r.doc_id]


def test_the_query(spark, library):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op6_bpe_round_trip(spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids, decoded = wanted(library, r.text)
        sha = hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[r.doc_id] == (len(ids), sha, hashlib.sha256(decoded.encode()).hexdigest())


def test_repeated_rows_clashing_names_and_an_empty_table(spark, library):
    rows = [(None, "one two"), (1, "one two"), (1, "one two"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(5) for c in ("n_tokens", "token_ids", "_row", "ids")})
    out = encode_decode(df, vocabulary("word_bpe_49k.json"))
    assert sorted((r.doc_id or 0, r.n_tokens, r._row, r.ids) for r in out.collect()) == [
        (i or 0, len(wanted(library, t)[0]), 5, 5) for i, t in sorted(rows, key=lambda x: x[0] or 0)]
    assert encode_decode(df.limit(0), vocabulary("word_bpe_49k.json")).count() == 0

"""The pipeline against plain versions of its stages."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from recordloom.llm.bpe import WordBpe
from recordloom.llm.queries import vocabulary

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out.append(docs)
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SMALL).write.parquet(path)
        docs = spark.read.parquet(path)
    return [*out, docs]


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text").orderBy("doc_id").collect()]


def test_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[:-1])
    assert len(corpus_pipeline.STAGES) == 5


def test_one_of_each_class_stays(stages):
    before = rows(stages[1])
    firsts = {c for _, c, _ in brute.classes(before)}
    assert rows(stages[2]) == [r for r in before if r[0] in firsts]


def test_repeated_strings_go(stages):
    want = [(i, sha) for i, *_, sha in brute.strings(rows(stages[2]), corpus_pipeline.REPEATED)]
    got = rows(stages[3])
    assert [i for i, _ in got] == [i for i, _ in want]
    same = [hashlib.sha256((t or "").encode()).hexdigest() == sha for (_, t), (_, sha) in zip(got, want)]
    assert sum(same) >= len(same) - 3  # the others end within a letter


def test_passages_of_a_few_words_over_fifty_go(spark):
    """Short words included: 51 to 60 words that two documents share, in the midst of text of their own."""
    rng = random.Random(8)

    def words(n, least, most):
        return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(least, most))) for _ in range(n))

    rows, passages = [], []
    for i in range(30):
        shared = words(51 + i % 10, 2 + i % 3, 8)
        passages.append(shared)
        rows += [(2 * i + k, f"{words(80, 3, 9)} {shared} {words(80, 3, 9)}") for k in (0, 1)]
    rows += [(100 + i, words(200, 3, 9)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    left = {r.doc_id: r.text for r in corpus_pipeline.cut_repeated_strings(spark, docs, SMALL).collect()}
    assert not any(p in left[2 * i + k] for i, p in enumerate(passages) for k in (0, 1))
    assert all(len(left[2 * i + k]) < len(dict(rows)[2 * i + k]) - 0.9 * len(p) for i, p in enumerate(passages) for k in (0, 1))
    assert all(left[100 + i] == dict(rows)[100 + i] for i in range(20))


def test_contaminated_documents_go(spark, stages):
    plain = lambda t: f" {' '.join(re.findall('[^\\W_]+', (t or '').lower()))} "
    items = [plain(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    before, after = rows(stages[3]), {i for i, _ in rows(stages[4])}
    leaky = {i for i, t in before if any(p in plain(t) for p in items)}
    assert leaky and not leaky & after and len(after) >= len(before) - len(leaky) - 3


def test_tokens(stages):
    with open(vocabulary("word_bpe_49k.json"), "rb") as file:
        codec = WordBpe(file.read())
    for r in stages[5].collect():
        assert (bytes(r.token_ids), r.decoded) == codec.encode(r.text or "")
    assert stages[5].count() == stages[4].count()


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, SMALL).select("doc_id", F.sha2("decoded", 256)).collect()
    assert sorted(got) == sorted(stages[5].select("doc_id", F.sha2("decoded", 256)).collect())


def test_odd_documents(spark, tmp_path):
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    docs = spark.createDataFrame(
        [(None, None, "x"), (1, "", "y"), (1, "", "y"), (2, "a b c d e f g", None), (2, "a b c d e f g", None), (3, "é" * 900, "z")],
        "doc_id long, text string, _k string").withColumns({"n_chars": F.lit(1).cast("long"), "leaks": F.lit(2)})
    for frame, left in ((docs, 4), (docs.limit(0), 0)):
        for _, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, str(tmp_path))
        assert frame.count() == left

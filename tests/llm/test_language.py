"""op10: rows that nothing was learned from, and the sizes against plain compression."""

import zlib

import numpy as np
import zstandard
from pyspark.sql import functions as F

from recordloom.llm.language import LEVEL, PIECE, Classifier, dictionaries, identify_language

TABLES = "/root/testdata/sf0.1"


def test_held_out_rows(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    out = identify_language(docs, keep=["doc_id", "lang"]).collect()
    assert len(out) == docs.count()
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    right = np.array([r.lang == r.lang_pred for r in held])
    sure = np.array([not r.doubtful for r in held])
    assert right.mean() >= 0.97 and right[sure].mean() >= right.mean()
    assert {r.lang_pred for r in out} == {"en", "de", "fr", "es"} and all(0 <= r.score <= 1 for r in out)


def test_sizes():
    contents = {"a": b"the quick brown fox " * 9, "b": b"der schnelle braune fuchs " * 9}
    own = Classifier(contents)
    text = "The brown fox sees the quick fox. " * 90
    want = []
    for content in contents.values():
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        tool = zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)
        data = text.lower().encode()
        want.append(sum(len(tool.compress(data[i: i + PIECE])) for i in range(0, len(data), PIECE)))
    assert own.sizes(text).tolist() == want and own.classify(text)[0] == "a"


def test_odd_rows(spark):
    rows = [(i, f"the quick brown fox number {i}", "en") for i in range(20)] + [(50 + i, f"der schnelle braune fuchs {i}", "de") for i in range(20)]
    odd = [(100, None, "en"), (101, "", None), (102, "123 !!", "en"), (None, "the brown fox", None), (103, "x" * 400_000, None), (1, "the quick", "en"), (1, "the quick", "en")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumns({"score": F.lit("s"), "_text": F.lit(1)})
    out = identify_language(df)
    assert out.columns == ["doc_id", "text", "lang", "_text", "lang_pred", "score", "margin", "doubtful"]
    got = out.collect()
    assert {(r.doc_id, r.lang_pred, r.score) for r in got if r.doc_id in (100, 101, 102)} == {(i, "und", 0.0) for i in (100, 101, 102)}
    assert all(r.lang_pred == r.lang for r in got if r.doc_id is not None and r.doc_id < 100)
    assert {r.lang_pred for r in identify_language(df, df.limit(0)).collect()} == {"und"}
    assert identify_language(df.limit(0)).collect() == []
    assert dictionaries(df) == dictionaries(df.repartition(5))


def test_texts_that_open_alike(spark):
    """A common opening longer than what a text gives to a dictionary does not hide the language."""
    notice = "This notice stands before every text of this source and says nothing of its language. " * 8
    said = {"de": "der schnelle braune fuchs springt über den faulen hund ", "fr": "le renard brun saute par dessus le chien paresseux "}
    rows = [(i, notice + text * 40, lang) for k, (lang, text) in enumerate(said.items()) for i in range(100 * k, 100 * k + 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    short = spark.createDataFrame([(-1, said["de"], None), (-2, said["fr"], None)], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in identify_language(short, df).collect()} == {-1: "de", -2: "fr"}
    held = dictionaries(df)
    assert all(said[x].encode()[:20] in held[x] for x in said)


def test_whole_texts_of_a_bounded_sample(spark):
    rows = [(i, f"{lang} " + f"word{i} of {lang} " * size, lang) for lang, size in (("aa", 700), ("bb", 3)) for i in range(60)]
    rows += [(500 + i, f"bb {i} " + "long tale " * 900, "bb") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts = {t.lower() for _, t, _ in rows}
    held = dictionaries(df, characters=30_000)
    for content in held.values():
        assert set(content.decode().split("\n")) <= texts
    # long texts are taken whole where there are no others, up to the one that passes the bound
    assert 30_000 <= len(held["aa"]) < 30_000 + 2 * len(rows[0][1])
    assert "long tale" in held["bb"].decode() and held["bb"].decode().index("long tale") > 1_000
    assert len(dictionaries(df, characters=1_000)["bb"].decode().split("\n")) < 40
    assert len(dictionaries(df, sampled=4)["aa"].decode().split("\n")) == 4


def test_a_tie_goes_to_the_first_language_and_many_languages_share(spark):
    rows = [(i, "the same words", lang) for lang in ("zz", "mm") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.lang_pred for r in identify_language(df).collect()} == {"mm"}
    many = spark.createDataFrame([(i, f"text number {i} of its own language", f"l{i}") for i in range(300)], "doc_id long, text string, lang string")
    assert len(dictionaries(many)) > 200

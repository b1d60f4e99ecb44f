"""op5: the decoder against all spellings, the scores on rows that nothing was learned from."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.llm import charmodel
from recordloom.llm.charmodel import CODE, DISGUISED, DROPPED, GAP, LOOKALIKES, SYMBOLS, CharModel, codes, count_trigrams
from recordloom.llm.toxicity import lower_share, toxicity_scores

TABLES = "/root/testdata/sf0.1"


def symbols(text):
    return codes()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]


@pytest.fixture(scope="module")
def model():
    s = symbols("  " + "  ".join(["the stupid idiot and the clown said it", "it is in the tin"] * 20) + "  ")
    return CharModel(np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3))


def best(model, word):
    """The best of all spellings of a word without repetitions."""
    found = []
    for letters in itertools.product(*[[c, *LOOKALIKES.get(c, "")] for c in word]):
        cost = sum(DISGUISED for a, b in zip(word, letters) if a != b)
        s = [GAP, GAP, *(CODE.get(x, 1) for x in letters), GAP]
        cost += sum(model.log[(s[i] * SYMBOLS + s[i + 1]) * SYMBOLS + s[i + 2]] for i in range(len(s) - 2))
        found.append((cost, "".join(letters)))
    return max(found)[1]


@pytest.mark.parametrize("word", ["1d10t", "$tup1d", "cl0wn", "t1n", "a1b", "x9y8z7"])
def test_decoder_finds_the_best_spelling(model, word):
    assert model.restore(word) == best(model, word)


def test_spans(model):
    assert model.plain("the 1d10t, i d i o t! c-l-o-w-n. cloooown THE!! a$$ 10.0.0.1") == "the idiot, idiot! clown. clown THE!! a$$ 10.0.0.1"
    assert model.plain("") == ""
    long = "a" * 200_000
    assert set(model.plain(long)) == {"a"}
    assert DROPPED < 0


def test_counts_cover_all_texts(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "")], "doc_id long, text string").repartition(3)
    got = {r.gram: r.n for r in count_trigrams(df).collect()}
    a, b = CODE["a"], CODE["b"]
    assert got[(GAP * SYMBOLS + a) * SYMBOLS + b] == 1 and got[(a * SYMBOLS + b) * SYMBOLS + GAP] == 1


def test_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{TABLES}/{t}.parquet") for t in ("documents", "labels"))
    scores = {r.doc_id: r.score for r in toxicity_scores(docs, labels, keep=["doc_id"]).collect()}
    assert len(scores) == docs.count()
    rows = [(scores[r.doc_id], r.toxic) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    caught = [s >= 0.5 for s, y in rows if y]
    clean = [s >= 0.5 for s, y in rows if not y]
    assert sum(caught) >= 0.88 * len(caught) and sum(clean) <= 0.01 * len(clean)


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(None, None), (1, ""), (2, "you 1d10t"), (2, "you 1d10t"), (3, "x" * 300_000)], "doc_id long, text string"
    ).withColumn("score", F.lit("mine"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = toxicity_scores(docs, none)
    assert out.columns == ["doc_id", "text", "score"] and {round(r.score, 6) for r in out.collect()} == {0.05}
    some = spark.createDataFrame([(2, 1, 1), (2, 1, None), (None, 0, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in toxicity_scores(docs, some).collect())
    assert toxicity_scores(docs.limit(0), some).count() == 0


def test_lower_share():
    assert lower_share(np.array([3, 0]), np.array([0, 3]))[0] == pytest.approx(0.75)
    assert lower_share(np.array([0]), np.array([3]))[0] == pytest.approx(0)


def test_planted_disguises(spark):
    """Each kind of disguise alone, end to end, next to plain words of the same shape."""
    plain = "the man said it is in the tin and the letter is on the table"
    rows = [(i, f"{plain} {['stupid', 'good', 'idiot', 'book'][i % 4]} number") for i in range(400)]
    planted = ["idio7", "iidiioott", "idioott", "id.iot", "stu pid", "id iot", "stu-pid", "i d i o t", "1d10t"]
    clean = ["boo7", "good", "is in", "a b c", "the.man", "it!"]
    tests = [(1000 + i, f"{plain} {x} number") for i, x in enumerate(planted + clean)]
    docs = spark.createDataFrame(rows + tests, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 1 - i % 2) for i, _ in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in toxicity_scores(docs, labels, keep=["doc_id"]).collect()}
    scores = [round(got[i], 2) for i, _ in tests]
    assert [x for x, z in zip(planted, scores) if z < 0.5] == []
    assert [x for x, z in zip(clean, scores[len(planted):]) if z >= 0.5] == []


def read_alone(model, text):
    """Every word by the search itself, one text at a time, instead of by tables."""
    plain = model.plain(text).lower()
    found = set(charmodel.WORD.findall(plain))
    more = {model.restore(w) for w in found if re.search(r"([^\W\d_])\1", w)}
    for kind in (charmodel.SHORT, charmodel.FINAL):
        more |= {w for m in kind.finditer(plain) for w in charmodel.WORD.findall(model.restore(m[0]))}
    return found | more


def test_tables_read_as_the_search_does(model, monkeypatch):
    rng = random.Random(5)
    words = ["the", "stupid", "idiot", "clown", "said", "tin", "aa", "bb", "a", "iit", "stuupiid", "ass", "cloown", "é", "日本"]

    def text():
        made = []
        for _ in range(rng.randrange(12)):
            w = rng.choice(words)
            kind = rng.random()
            if kind < 0.3:
                w += rng.choice("01257!$@(|+€") * rng.choice([1, 1, 2])
            elif kind < 0.45:
                w = rng.choice([" ", "-", ". "]).join(w[:3])
            elif kind < 0.6:
                i = rng.randrange(len(w))
                w = w[:i] + w[i] * rng.choice([1, 2]) + w[i:]
            made.append(w)
        return rng.choice([" ", ", ", "\n", "\t"]).join(made)

    texts = ["", "\n", *(text() for _ in range(400))]
    alone = [read_alone(model, t) for t in texts]
    for stretch in (1 << 20, 60):
        monkeypatch.setattr(charmodel, "STRETCH", stretch)
        together = model.readings(texts)
        assert all(a <= b for a, b in zip(alone, together))
        # what comes besides are words joined over fillers
        joined = ["".join(c for c in t.lower() if c not in charmodel.FILLERS) for t in map(model.plain, texts)]
        assert all(w in j for a, b, j in zip(alone, together, joined) for w in b - a)
    assert "stupid" in model.readings(["he is stu pid"])[0]

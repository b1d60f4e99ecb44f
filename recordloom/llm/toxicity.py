"""Toxicity by a noisy channel: disguised words are restored, then the words are scored.

A character model counted over all texts (see ``charmodel``) restores leetspeak,
spaced and repeated letters. Evidence is whole words and word beginnings, and how
many different words share a beginning; a logistic model of them is learned from a
bounded sample of labelled rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.llm.charmodel import LONGEST, SYMBOLS, CharModel, count_trigrams
from recordloom.llm.common import appended, bounded, cut_batches, staged

#: Labelled rows that the weights are learned from, chosen by a hash of the id.
LABELLED = 20_000
#: Labelled toxic texts that a word or beginning must occur in, and the least toxic
#: share, one standard error lower than seen, among all labelled texts that have it.
SUPPORT, SHARE = 3, 0.2
#: A word or beginning speaks anew when a text has so many different words with it.
STEPS = (1, 2, 3, 5)
#: Steps and regularisation of the logistic fit.
ROUNDS, RIDGE = 300, 0.03
#: Lengths of word beginnings.
BEGINNINGS = (4, 5, 6, 7)
#: Words whose score a task remembers.
_REMEMBERED = 200_000


def features(word: str) -> list[str]:
    """The whole word, and its beginnings (marked)."""
    return [word, *(word[:k] + "-" for k in BEGINNINGS if len(word) >= k)]


def lower_share(toxic: np.ndarray, clean: np.ndarray, z: float = 1.0) -> np.ndarray:
    """The lower end of the Wilson interval of the toxic share."""
    n = np.maximum(toxic + clean, 1)
    p = toxic / n
    return (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def sampled_labels(labels: DataFrame, held_out, most: int = LABELLED, doc_id: str = "doc_id") -> DataFrame:
    """(_id, toxic) of at most ``most`` labelled rows that are not held out."""
    rows = labels.select(F.col(doc_id).cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
    rows = rows.where(F.col("_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("_id")))
    return rows.groupBy("_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("_id"), "_id").limit(most)


def held_out(doc_id):
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Scorer:
    """Scores texts, restored first, by the words that speak for or against toxicity."""

    def __init__(self, model: CharModel, weights: dict[str, tuple[float, ...]], base: float):
        self.model, self.weights, self.base = model, weights, base
        self.known: dict[str, tuple[str, ...]] = {}

    def evidence(self, texts: list[str]) -> list[Counter]:
        """Of each text the known words and beginnings, with the number of different words that have them."""
        known, out = self.known, []
        for words in self.model.readings(texts):
            found = []
            for w in words:
                own = known.get(w)
                if own is None:
                    if len(known) >= _REMEMBERED:
                        known.clear()
                    own = tuple([f for f in features(w) if f in self.weights])
                    if len(w) <= LONGEST:
                        known[w] = own
                if own:
                    found += own
            out.append(Counter(found))
        return out

    def scores(self, texts: list[str]) -> list[float]:
        out = []
        for found in self.evidence(texts):
            z = self.base
            for f, n in found.items():
                z += sum([w for w, k in zip(self.weights[f], STEPS) if n >= k])
            out.append(float(1 / (1 + np.exp(-z))))
        return out


def fit(rows: np.ndarray, columns: np.ndarray, labels: np.ndarray, width: int) -> tuple[np.ndarray, float]:
    """Logistic regression on 0/1 features, given as (row, column) pairs, by Adam steps."""
    n = len(labels)
    share = (labels.sum() + 0.5) / (n + 10)  # without labels: one in twenty
    w = np.zeros(width + 1)
    w[-1] = np.log(share / (1 - share))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, ROUNDS + 1):
        error = 1 / (1 + np.exp(-(np.bincount(rows, w[columns], n) + w[-1]))) - labels
        slope = np.append(np.bincount(columns, error[rows], width) + RIDGE * w[:-1], error.sum())
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope * slope
        w -= 0.05 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
    return w[:-1], float(w[-1])


def _count(model, only):
    """(feature, n): in how many of the texts it occurs; only those of a given set, if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, count = CharModel(model.value), Counter()
        wanted = only.value if only is not None else None
        for batch in cut_batches(batches, "_text"):
            for words in own.readings([t or "" for t in batch.column(0).to_pylist()]):
                found = {f for w in words for f in features(w)}
                count.update(found if wanted is None else found & wanted)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["feature", "n"])

    return run


def _evidence(model, only):
    """(toxic, features, counts) of each labelled text, for the chosen features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(CharModel(model.value), dict.fromkeys(only.value, ()), 0.0)
        for batch in cut_batches(batches, "_text"):
            found = scorer.evidence([t or "" for t in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([list(c) for c in found], pa.list_(pa.string())),
                 pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))], names=["toxic", "features", "counts"])

    return run


def _totals(texts: DataFrame, model, only=None) -> DataFrame:
    counted = texts.mapInArrow(_count(model, only), "feature string, n long")
    return counted.groupBy("feature").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, labels: DataFrame, most: int = LABELLED, doc_id: str = "doc_id", text: str = "text"):
    """(character counts, weights, intercept) of a toxicity model.

    The character counts cover all texts. Features are words and beginnings that
    enough toxic texts of the labelled sample have. What is brought to the driver is
    bounded: the grams by the alphabet, the rest by the sample.
    """
    spark = docs.sparkSession
    counts = np.zeros(SYMBOLS**3, np.int64)
    grams = count_trigrams(docs, text).toArrow()
    counts[grams.column("gram").to_numpy()] = grams.column("n").to_numpy()
    model = bounded(spark, counts, counts.nbytes)
    sample = F.broadcast(sampled_labels(labels, held_out, most, doc_id))
    labelled = staged(
        docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("string").alias("_text"))
        .join(sample, "_id").select("_text", "toxic"), "labelled")
    toxic, clean = (labelled.where(F.col("toxic") == x).select("_text") for x in (1, 0))
    seen = _totals(toxic, model).where(F.col("n") >= SUPPORT).toArrow()
    names = seen.column("feature").to_pylist()
    some = bounded(spark, set(names), sum(map(len, names)) + 80 * len(names))
    rest = _totals(clean, model, some).toArrow()
    other = dict(zip(rest.column("feature").to_pylist(), rest.column("n").to_pylist()))
    share = lower_share(seen.column("n").to_numpy(), np.array([other.get(f, 0) for f in names], float))
    names = sorted(f for f, s in zip(names, share) if s >= SHARE)
    chosen = bounded(spark, names, sum(map(len, names)) + 80 * len(names))
    found = labelled.select("_text", "toxic").mapInArrow(
        _evidence(model, chosen), "toxic int, features array<string>, counts array<int>").toArrow()
    place = {f: i for i, f in enumerate(names)}
    rows, columns = [], []
    for row, (own, n) in enumerate(zip(found.column("features").to_pylist(), found.column("counts").to_pylist())):
        for f, k in zip(own, n):
            steps = [place[f] * len(STEPS) + i for i, least in enumerate(STEPS) if k >= least]
            rows += [row] * len(steps)
            columns += steps
    w, base = fit(
        np.array(rows, np.int64), np.array(columns, np.int64), found.column("toxic").to_numpy().astype(float), len(names) * len(STEPS))
    return counts, {f: tuple(w[i * len(STEPS): (i + 1) * len(STEPS)].tolist()) for f, i in place.items()}, base


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, most: int = LABELLED, doc_id: str = "doc_id", text: str = "text",
    score: str = "score", keep: list[str] | None = None,
) -> DataFrame:
    """Add ``score`` (0 to 1) to every row, from its whole text; ``score`` of the input is replaced.

    Learned from at most ``most`` labelled rows that are not held out; ids and labels
    are no inputs of a score, repeated rows score alike. An empty or null text, and
    any text if there are no labels, has the score of no evidence (one in twenty
    without labels).
    Labels that are null or have no id are passed over; of several labels of one id
    the highest counts.
    """
    counts, weights, base = learn(docs, labels, most, doc_id, text)
    spark = docs.sparkSession
    sent = bounded(spark, (counts, weights, base), counts.nbytes + sum(300 + len(f) for f in weights))

    def start():
        held, own, low = sent.value
        scorer = Scorer(CharModel(held), own, low)
        return lambda texts: [pa.array(scorer.scores([t or "" for t in texts.to_pylist()]), pa.float64())]

    return appended(docs, text, [(score, T.DoubleType())], start, keep)

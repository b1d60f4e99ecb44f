"""Language identification by compression.

Each language has a raw-content zstandard dictionary of its own texts. A text is
compressed in pieces with every dictionary; the language whose dictionary makes it
smallest wins, and the prediction is doubtful where the runner-up is close.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.llm.common import appended, bounded, check_bound, staged

#: Labelled rows per language, and characters that they may hold together: the row that
#: passes this bound is the last, and is whole too.
SAMPLED, CHARACTERS = 800, 400_000
#: Rows of at most so many characters are taken first: many texts speak for a language
#: better than one long one.
SHORT = 2048
#: Characters of all dictionaries together; many languages get smaller samples.
ALL_CHARACTERS = 12_000_000
#: Parts of a language in which rows are ranked before they meet.
PARTS = 64
#: Bytes that are compressed at once: a piece is small, so that the dictionary counts.
PIECE = 1024
LEVEL = 5
#: The share of the size by which the runner-up must be larger.
MARGIN = 0.01
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def dictionaries(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sampled: int = SAMPLED,
    characters: int = CHARACTERS,
) -> dict[str, bytes]:
    """Raw content for each language: whole texts of at most ``sampled`` rows that are not held out.

    Rows without text or language are passed over. Rows are taken in the order of a hash of id
    and text, short ones first, until they hold ``characters`` together; repeated rows enter
    once, and the partitioning makes no difference. A language with very many rows is ranked in parts first.
    """
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), F.col(lang).alias("_lang")).where(
        F.col("_lang").isNotNull() & F.coalesce(F.col("_text"), F.lit("")).rlike(r"\p{L}") & ~held_out(F.col("_id")))
    key = F.xxhash64(F.col("_id").cast("string"), "_text")
    size = F.length("_text")
    # ranked without their texts, which only the chosen rows bring
    narrow = rows.select("_lang", (size > SHORT).alias("_long"), key.alias("_order"), size.alias("_size")).distinct()
    order = ["_long", "_order"]
    parted = narrow.withColumn("_part", F.pmod("_order", F.lit(PARTS)))
    inside = W.partitionBy("_lang", "_part").orderBy(*order)
    whole = W.partitionBy("_lang").orderBy(*order)
    some = parted.withColumn("_turn", F.row_number().over(inside)).where(F.col("_turn") <= sampled)
    some = some.withColumn("_turn", F.row_number().over(whole)).where(F.col("_turn") <= sampled)
    languages = F.greatest(F.lit(1), narrow.agg(F.countDistinct("_lang")).scalar())
    bound = F.least(F.lit(characters), F.floor(F.lit(ALL_CHARACTERS) / languages))
    before = F.sum("_size").over(whole.rowsBetween(W.unboundedPreceding, -1))
    chosen = some.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < bound)
    chosen = staged(chosen.select("_lang", "_order", "_turn"), "chosen")
    taken = rows.withColumn("_order", key).join(chosen, ["_lang", "_order"])
    taken = taken.groupBy("_lang", "_turn").agg(F.lower(F.max("_text")).alias("_text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_turn", "_text"))), lambda x: x["_text"]), "\n")
    contents = staged(taken.groupBy("_lang").agg(joined.alias("content")), "languages")
    # measured before anything comes to the driver
    check_bound(contents.agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0))).first()[0])
    return {r._lang: r.content.encode() for r in contents.collect()}


class Classifier:
    """Compressed sizes of texts under each language's dictionary."""

    def __init__(self, contents: dict[str, bytes]):
        self.languages = sorted(contents)
        self.compressors = []
        for name in self.languages:
            held = zstandard.ZstdCompressionDict(contents[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(
                level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: str) -> np.ndarray:
        data = text.lower().encode("utf-8", "replace")  # dictionaries are in lower case
        parts = [data[i: i + PIECE] for i in range(0, len(data), PIECE)]
        return np.array([sum([len(c.compress(p)) for p in parts]) for c in self.compressors])

    def classify(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin): the score is the winner's share by size, from 1 / languages up to 1."""
        if not text or not self.languages or not any(c.isalpha() for c in text):
            return UNKNOWN, 0.0, 0.0
        sizes = self.sizes(text)
        best = int(sizes.argmin())
        if len(sizes) == 1:
            return self.languages[0], 1.0, 1.0
        runner_up = np.delete(sizes, best).min()
        margin = float(runner_up - sizes[best]) / float(sizes[best])
        weights = np.exp(-(sizes - sizes[best]) / max(1.0, 0.02 * sizes[best]))
        return self.languages[best], float(1 / weights.sum()), margin


def identify_language(
    docs: DataFrame, learned: DataFrame | None = None, margin: float = MARGIN, doc_id: str = "doc_id", text: str = "text",
    lang: str = "lang", keep: list[str] | None = None, sampled: int = SAMPLED,
) -> DataFrame:
    """Add ``lang_pred``, ``score`` (0 to 1), ``margin`` and ``doubtful`` to every row.

    Languages are learned from ``learned`` (``docs`` by default), see
    ``dictionaries``; a prediction depends on the whole text alone. ``lang_pred`` is
    "und" with score 0 where the text is null or has no letter, or nothing could be
    learned; equal sizes go to the first language by name. ``doubtful`` tells that
    the runner-up needs less than ``margin`` more: a caller that rejects narrow
    decisions drops these. Columns of these names are replaced.
    """
    contents = dictionaries(docs if learned is None else learned, doc_id, text, lang, sampled)
    sent = bounded(docs.sparkSession, contents, sum(map(len, contents.values())))

    def start():
        own = Classifier(sent.value)

        def work(texts: pa.Array) -> list[pa.Array]:
            made = [own.classify(t) for t in texts.to_pylist()]
            return [
                pa.array([x[0] for x in made], pa.string()), pa.array([x[1] for x in made], pa.float64()),
                pa.array([x[2] for x in made], pa.float64()), pa.array([x[2] < margin for x in made], pa.bool_())]

        return work

    fields = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("margin", T.DoubleType()), ("doubtful", T.BooleanType())]
    return appended(docs, text, fields, start, keep)

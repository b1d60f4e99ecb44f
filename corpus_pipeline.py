"""A document pipeline of five stages, each writing what it keeps for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordloom.llm.bpe import encode_decode
from recordloom.llm.common import as_row, row_keys, scratch
from recordloom.llm.decontamination import benchmark_leaks
from recordloom.llm.jaccard import near_duplicate_classes
from recordloom.llm.queries import vocabulary
from recordloom.llm.suffixes import remove_repeated_strings
from recordloom.llm.toxicity import toxicity_scores


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of less than one half."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity_scores(docs, labels, score="_toxicity")
    return scored.where("_toxicity < 0.5").drop("_toxicity")


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least id; of repeated rows one."""
    classes = near_duplicate_classes(docs)
    first = classes.where("_k = class_k and _h = class_h").select("_k", "_h").distinct()
    keys = row_keys("doc_id", "text")
    repeated = W.partitionBy("_k", "_h").orderBy("_k")
    kept = docs.select(as_row(docs.columns), *keys).join(first, ["_k", "_h"], "left_semi")
    return kept.withColumn("_turn", F.row_number().over(repeated)).where("_turn = 1").select("_row.*")


#: Bytes of a repeated string: less than fifty words have, also where these are short.
REPEATED = 200


def cut_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of ``REPEATED`` bytes that occur elsewhere too; a text of them alone stays, empty."""
    cut = remove_repeated_strings(docs, REPEATED)
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text"))
    return cut.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return benchmark_leaks(docs, items, leaks="_leaks").where(F.size("_leaks") == 0).drop("_leaks")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of every document that is left, and the text that they decode to."""
    return encode_decode(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_near_duplicates),
    ("suffix_array_dedup", cut_repeated_strings),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe_round_trip", encode),
]

#: SQL can express neither language models nor tokenizers; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = scratch(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs

"""From raw documents to tokens: good texts, one of each near-duplicate group, without repeats or test items, encoded.

Every stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; each result is written as
Parquet before the next stage reads it. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firegrid.llm import decontamination, ngram_join, quality_classifier, sentencepiece_bpe, suffix_dedup
from firegrid.llm.common import remainder, stored


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier scores below 0.7; it learns from labels outside the held-out quarter."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder(4) != 2)
    return quality_classifier.keep_good(docs, labels)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each component at five-word shingles and a similarity of 0.8."""
    return ngram_join.keep_one(docs, n=5, pct=80)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out strings of 50 bytes and more that a document with a smaller doc_id has; n_chars follows."""
    return suffix_dedup.strip_repeats(docs, 50).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of benchmark."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, checked by decoding them."""
    return sentencepiece_bpe.encode(docs).select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("quality_classifier", good_quality),
    ("ngram_jaccard_join", one_of_each),
    ("suffix_array_dedup", without_repeats),
    ("benchmark_decontamination", without_test_items),
    ("sentencepiece", encoded),
]

#: SQL can't express a trained network; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

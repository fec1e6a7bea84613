"""The registered query of each training-data operator: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, language_id, ngram_join, quality_classifier, quality_rules, sentencepiece_bpe, sharding, suffix_dedup, toxicity, warc
from .common import remainder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held(scored: DataFrame, modulus: int, out: int) -> DataFrame:
    return scored.withColumn("held_out", remainder(modulus) == out)


def op1_quality_classifier(spark, sf_dir):
    labels = _table(spark, sf_dir, "labels").where(remainder(4) != 2)
    return _held(quality_classifier.quality_classifier(_table(spark, sf_dir, "documents"), labels), 4, 2)


def op2_ngram_join(spark, sf_dir):
    return ngram_join.ngram_join(_table(spark, sf_dir, "documents"), n=3, pct=90)


def op3_decontamination(spark, sf_dir):
    return decontamination.find_contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_sentencepiece(spark, sf_dir):
    encoded = sentencepiece_bpe.encode(_table(spark, sf_dir, "documents"))
    return encoded.select(
        "doc_id",
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"),
        F.xxhash64("ids").alias("ids_hash"),
        F.sha2(F.coalesce("decoded", F.lit("")), 256).alias("decoded_sha256"),
        "round_trip",
    )


def op5_toxicity(spark, sf_dir):
    labels = _table(spark, sf_dir, "labels").where(remainder(5) != 0)
    return _held(toxicity.toxicity(_table(spark, sf_dir, "documents"), labels), 5, 0)


def op6_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"))


def op7_warc(spark, sf_dir):
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op8_sharding(spark, sf_dir):
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op9_language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return _held(language_id.language_id(docs, docs.where(remainder(4) != 2)), 4, 2).select("doc_id", "held_out", "lang_pred", "score")


def op10_suffix_dedup(spark, sf_dir):
    return suffix_dedup.suffix_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_ngram_join, op3_decontamination, op4_sentencepiece, op5_toxicity, op6_quality_rules, op7_warc, op8_sharding, op9_language_id, op10_suffix_dedup)}

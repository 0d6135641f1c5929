"""The corpus operators as queries over the given tables: name -> function of (spark, sf_dir), and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from karstflow.llm import decontaminate, language_id, line_dedup, near_dup, packing, quality_classifier, quality_rules, sharding, suffix_dedup, token_counts
from karstflow.llm.oracles import ORACLES


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _sha256(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(_documents(spark, sf_dir))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    done = line_dedup.dedup_lines(docs, min_chars=20, min_docs=3, keep="last")
    return done.select("doc_id", "n_lines", "n_dropped", _sha256(F.col("text")).alias("kept_sha256"))


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: What op3 redacts.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after e-mail addresses are replaced, the second ones by edits."""
    ranks = _tokenizer("byte_bpe_50k.tiktoken")
    state = token_counts.count_tokens(_documents(spark, sf_dir), ranks)
    edited = token_counts.apply_edits(state, token_counts.redactions(F.col("text"), EMAIL, "[EMAIL]"), ranks)
    return edited.select("doc_id", "n_tokens_before", "n_tokens", "n_encoded", F.size("leaf_tokens").alias("n_leaves"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.dedup_substrings(_documents(spark, sf_dir), min_bytes=400)
    return done.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def _remainder(of: Column, by: int) -> Column:
    return F.coalesce(F.crc32(of.cast("string").cast("binary")) % by, F.lit(-1))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held = _remainder(F.col("doc_id"), 4) == 2
    model = language_id.train(docs.where(~held))
    return language_id.predict(docs, model, {"doc_id": F.col("doc_id"), "held_out": held})


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), _tokenizer("word_bpe_49k.json"), end_id=1, length=2048)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = _remainder(F.col("doc_id"), 3) == 1
    model = quality_classifier.train(docs, labels.where(~held))
    return quality_classifier.predict(docs, model, {"doc_id": F.col("doc_id"), "held_out": held})


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    done = decontaminate.contamination(_documents(spark, sf_dir), items, window=10)
    return done.select("doc_id", "n_words", "n_hit", "n_items", _sha256(F.array_join("items", ",")).alias("items_sha256"), "contaminated")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_documents(spark, sf_dir), shingle=3, num=85, den=100)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_documents(spark, sf_dir), shards=16)


__all__ = ["ORACLES", "QUERIES"]

QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_line_dedup,
        op3_token_counts,
        op4_suffix_dedup,
        op5_language_id,
        op6_packing,
        op7_quality_classifier,
        op8_decontamination,
        op9_near_duplicates,
        op10_sharding,
    )
}

"""Queries of the training-data operators over their whole tables, and their DuckDB equivalents where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_tree, common, embedding_dedup, mixing, pii, quality_model, quality_rules, simhash, token_count, toxicity, url_filter


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    common.bounded_batches(spark)
    return common.read_table(spark, sf_dir, name)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_tree.encode_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_embeddings(read_table(spark, sf_dir, "embeddings"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.ledger(read_table(spark, sf_dir, "documents"))
    measured = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "failures")
    return book.select(*measured, (~quality_rules.apply_policy(book, "base")).alias("base_failed"), quality_rules.apply_policy(book, "v1").alias("kept"))


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(read_table(spark, sf_dir, "documents"), pii.session_key(spark))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_url_filters, op2_toxicity, op3_bpe_round_trip, op4_source_mixing, op5_token_counts, op6_embedding_near_dedup, op7_simhash_near_dedup, op8_quality_rules, op9_pii_surrogates, op10_quality_classifier)}


def oracle_sql() -> dict[str, str]:
    return {"op4_source_mixing": mixing.ORACLE_SQL, "op8_quality_rules": quality_rules.ORACLE_SQL}

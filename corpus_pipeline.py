"""A corpus pipeline: toxicity, near duplicates, PII, mixing, tokens. Each stage is written and read again as Parquet.

All stages but the last return the columns of the documents they're given, whatever else these hold; null ids and texts, empty
and very long texts, repeated rows and empty tables go through all of them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vmlens.llm import bpe_tree, mixing, pii, simhash, toxicity
from vmlens.llm.common import bounded_batches, new_folder, read_table, remove_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the cut. Null and empty texts score as the model's base rate; null ids are kept alike."""
    bounded_batches(spark)
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score_column(F.col("text"), model) < toxicity.CUT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component the document with the smallest id stays; of rows that repeat an id or have none, one as well. Blank and null texts are one component."""
    bounded_batches(spark)
    return simhash.keep_one(docs).select(*docs.columns)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates under the session's key; n_chars follows. Null texts stay null; other columns aren't read."""
    bounded_batches(spark)
    out = pii.replace_texts(docs, pii.session_key(spark))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: whole rows, 0 to 2 times. A null source is one of its own; texts without words take no share."""
    return mixing.take(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids and their number: none for null and empty texts."""
    bounded_batches(spark)
    coded = bpe_tree.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_duplicates), ("pii", replace_private), ("mixing", mix_sources), ("bpe", encode)]

#: No SQL has SimHash's XXH64 or the byte pair merges; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of `sf_dir`.

    Every stage's table is in the shared folder, is removed when the next one is written, and the last one when the driver ends.
    """
    return run_stages(spark, read_table(spark, sf_dir, "documents"), sf_dir)


def run_stages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All stages over `docs`, which has doc_id, text and source at least."""
    folder = new_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:
            remove_folder(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs

"""Helpers shared by the training-data operators: tables, skew-safe joins, connected components."""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import durable, new_folder, remove_folder, stored  # noqa: F401 - part of these helpers

#: The characters that separate words (fixed by the query contracts): space and U+0009 to U+000D.
SPACE = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of an Arrow batch: Python workers hold a batch several times over.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
#: Rows of texts that are worked on at a time, where results are about as large as texts.
BATCH_ROWS = 400
#: Bytes up to which a table in fewer files than there are cores is dealt out to all of them.
SMALL_TABLE = 64 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table. A small one in few files, each maybe a single row group, is dealt to all cores: a shuffle of at most SMALL_TABLE bytes."""
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return table.repartition(cores) if size <= SMALL_TABLE and len(table.inputFiles()) < cores else table


def bounded_batches(spark: SparkSession) -> None:
    """For the entry points, queries and stages: a session that doesn't say how large Arrow batches are gets BATCH_BYTES.

    It's always the same value, so frames that are built one after the other don't get in each other's way. Operators leave
    settings alone."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def slices(batches, rows: int = BATCH_ROWS):
    """pandas batches cut into pieces of at most so many rows: what is made from a piece of texts is handed on before the next."""
    for pdf in batches:
        for at in range(0, len(pdf), rows):
            yield pdf.iloc[at : at + rows].reset_index(drop=True)


def process_cache() -> dict:
    """A dict that lives as long as the Python process (tokenizers are loaded once per worker, not once per task)."""
    name = "_vmlens_process_cache"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
    return sys.modules[name].__dict__


def words_of(text: Column) -> Column:
    """Array of words; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def skew_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that adaptive execution can split when one key holds much of `left`.

    An aggregate below a join keeps its own partitioning, and then a hot partition can't be split. The extra key (a
    hash of the others) gives both sides an exchange of their own.
    """
    key = "__join_hash"
    extra = F.xxhash64(*on)
    return left.withColumn(key, extra).join(right.withColumn(key, extra), [*on, key], how).drop(key)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of (a, b) bigint edges: one row (node, root) for every node of an edge, root the smallest.

    Alternating large-star and small-star rounds: every round is aggregations with map-side combine and joins that
    can be split, and its result is durable. Nothing is collected but a count and a checksum.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, seen = durable(edges), None
    for _ in range(max_rounds):
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen or not mark[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b")).groupBy("node").agg(F.min("root").alias("root"))
        seen = tuple(mark)
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = skew_join(both, least, ["a"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        # every edge (a, b) gives (b, m); the first of them is (a, m), which the aggregate has already
        small = skew_join(large, least, ["a"]).where("b <> m").select("b", "m")
        edges = durable(least.union(small.toDF("a", "m")).distinct().toDF("a", "b"))
    raise RuntimeError(f"components did not converge in {max_rounds} rounds")


def merge_labels(u, v, n: int):
    """numpy: label of each of n nodes, the smallest index that pairs (u[i], v[i]) join it to."""
    import numpy as np

    label = np.arange(n)
    while len(u):
        least = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, least)
        np.minimum.at(new, v, least)
        np.minimum.at(new, label[u], least)
        np.minimum.at(new, label[v], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label

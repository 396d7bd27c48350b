"""Precopy migrations: metrics of the iterations, when they converge, and the final delta."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import bandwidth

DOWNTIME_MS, TIMEOUT_S = 300, 3600


def iteration_metrics(df: DataFrame, by: Sequence[str], order: str, num_bytes: str, transfer_s: str) -> DataFrame:
    """With bandwidth, est_downtime_s (by the bandwidth before; 0 for no bytes, null for the first) and total_bytes."""
    w = Window.partitionBy(*by).orderBy(order)
    out = df.withColumn("bandwidth", bandwidth(F.col(num_bytes), F.col(transfer_s)))
    before = F.lag("bandwidth").over(w)
    estimate = F.when(F.col(num_bytes) == 0, F.lit(0.0)).when(before > 0, F.col(num_bytes) / before)
    return out.withColumn("est_downtime_s", estimate).withColumn("total_bytes", F.sum(num_bytes).over(w))


def decisions(metrics: DataFrame, num_bytes: str, elapsed_s: str, downtime_ms: int = DOWNTIME_MS, timeout_s: int = TIMEOUT_S, on_timeout: str = "cancel") -> DataFrame:
    """With `decision`: done, fits, timeout (go on to the end, or error where timeouts cancel) or continue, in that order."""
    late = F.lit("error" if on_timeout == "cancel" else "timeout")
    decision = F.when(F.col(num_bytes) == 0, "done").when(F.col("est_downtime_s") * 1000 <= downtime_ms, "fits").when(F.col(elapsed_s) >= timeout_s, late).otherwise("continue")
    return metrics.withColumn("decision", decision)


def convergence(decided: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """by, iteration and decision of the first iteration that doesn't go on."""
    stop = decided.where("decision <> 'continue'")
    return stop.groupBy(*by).agg(F.min(F.struct(order, "decision")).alias("s")).select(*by, F.col(f"s.{order}").alias("iteration"), F.col("s.decision").alias("decision"))


def final_delta(dirty: DataFrame, remaining: DataFrame) -> DataFrame:
    """The bag of both: duplicates stay."""
    return dirty.unionByName(remaining)


def average_bandwidth(df: DataFrame, by: Sequence[str], num_bytes: str, elapsed_s: str) -> DataFrame:
    """Total bytes over the time since the begin at the moment of asking (not up to the last iteration)."""
    return df.groupBy(*by).agg(F.sum(num_bytes).alias("total_bytes"), F.max(elapsed_s).alias("elapsed_s")).withColumn("average", bandwidth(F.col("total_bytes"), F.col("elapsed_s")))

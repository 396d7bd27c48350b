"""Trees of devices and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import durable

#: Levels between checkpoints.
LEVELS = 4


def breadth_first(nodes: DataFrame, edges: DataFrame, max_depth: int | None = None, reverse: bool = False) -> DataFrame:
    """Nodes that their roots reach, in breadth-first order: id, depth, path.

    nodes: id, parent; edges: parent, ord, child. Roots have no parent and come by id; children come in list order; edges to
    no node are skipped. One join a level, and no row is collected. It goes on until a level is empty, or to a depth that is
    asked for; every few levels are checkpointed, and a cycle among them raises."""
    known = nodes.select("id")
    step = edges.join(known.withColumnRenamed("id", "child"), "child", "left_semi").select(F.col("parent").alias("id"), "ord", "child")
    level = nodes.where("parent IS NULL").select("id", F.lit(0).alias("depth"), F.array(F.col("id").cast("string")).alias("path"), F.array().cast("array<bigint>").alias("ords"), F.col("id").alias("root"))
    out, block, depth = None, level, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        level = level.join(step, "id").select(F.col("child").alias("id"), F.lit(depth).alias("depth"), F.concat("path", F.array(F.col("child").cast("string"))).alias("path"), F.concat("ords", F.array(F.col("ord").cast("bigint"))).alias("ords"), "root")
        block = block.unionByName(level)
        if depth % LEVELS == 0:
            block = durable(block)
            out = block if out is None else out.unionByName(block)
            level = block.where(F.col("depth") == depth)
            if not block.where(F.size(F.array_distinct("path")) < F.size("path")).isEmpty():
                raise ValueError("the nodes have a cycle")
            block = level.limit(0)
            if level.isEmpty():
                break
    out = block if out is None else out.unionByName(block)
    order = ["depth", "root", "ords"]
    out = out.orderBy(*(F.col(c).desc() if reverse else F.col(c) for c in order))
    return out.select("id", "depth", "path")


def snapshot_state(snapshots: DataFrame, path: list[str], schema: str) -> DataFrame:
    """The state of the snapshot at a path: snapshots have path (array of ids) and data (JSON text)."""
    return snapshots.where(F.col("path") == F.array(*map(F.lit, path))).select("path", F.from_json("data", schema).alias("state"))


def backing_chain(images: DataFrame, limit: int = 10) -> DataFrame:
    """Every image with the files behind it, nearest first: image, chain, too_deep. images: image, backing (null: none)."""
    chain = images.select("image", F.array().cast("array<string>").alias("chain"), F.col("backing").alias("next"))
    behind = images.select(F.col("image").alias("next"), F.col("backing").alias("after"))
    for _ in range(limit):
        chain = chain.join(behind, "next", "left").select("image", F.when(F.col("next").isNotNull(), F.concat("chain", F.array("next"))).otherwise(F.col("chain")).alias("chain"), F.col("after").alias("next"))
    return chain.select("image", "chain", F.col("next").isNotNull().alias("too_deep"))

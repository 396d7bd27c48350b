"""Embedding near-duplicates by PCA-ordered tiled comparison, exact for a cosine threshold.

Equal vectors are one class. Classes are ordered along the first principal component and cut into blocks; a row goes to
the tiles of those blocks whose bounding boxes (in the leading components) it can reach. There are as few blocks as give
all cores some tiles, and a block has a bounded size, so rows are sent no more often than that takes. A tile is compared
in pieces, and pieces whose boxes are too far apart are left out. In the others the products of the leading dimensions
come first; with the residual products bounded by the norms of the suffixes, a pair is dropped as soon as its cosine
cannot reach the threshold, and what is left is checked in double precision on the given vectors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, durable, merge_labels, skew_join, slices

THRESHOLD = 0.9
#: Rows of a piece; a block is compared piece by piece and has at least as many rows.
PIECE = 2048
#: Components that the vectors of a block have at most, about: bounds a task's memory.
BLOCK_VALUES = 2_000_000
#: Tiles for each core or shuffle partition, whichever are more, about. More blocks send every row to more tiles.
TILES_PER_CORE = 4
#: The basis is fitted to a bounded sample: it orders the work and has no part in the result.
SAMPLE_VALUES, SAMPLE_ROWS = 4_000_000, 20_000
BOX_DIMS = 8
#: Room for single precision in the bounds.
SLACK = 1e-4
PAIRS = 200_000
#: Rows dealt to tiles at a time.
DEAL_ROWS = 4096


def usable(column: str) -> Column:
    """True for vectors that can link: all components finite, not all zero."""
    v = F.col(column)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    scale = np.abs(rows).max(axis=1, keepdims=True)
    rows = rows / np.where(scale > 0, scale, 1)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def stack(vectors, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows padded with zeros to `dim`, and the vectors' own lengths."""
    lengths = np.array([len(x) for x in vectors], dtype=np.int32)
    out = np.zeros((len(lengths), dim))
    for k in np.unique(lengths):
        at = np.flatnonzero(lengths == k)
        out[at, :k] = np.stack([np.asarray(vectors[i], dtype=np.float64) for i in at])
    return out, lengths


def tile_links(a: np.ndarray, b: np.ndarray, basis: np.ndarray, threshold: float = THRESHOLD):
    """(i, j) with cosine of unit rows a[i], b[j] at least the threshold."""
    dim = a.shape[1]
    stages = sorted({min(dim, max(1, round(dim * x))) for x in (0.375, 0.625, 1)})
    ra, rb = (a @ basis).astype(np.float32), (b @ basis).astype(np.float32)
    suffix = lambda r, k: np.sqrt((r[:, k:].astype(np.float64) ** 2).sum(axis=1)).astype(np.float32)
    k = stages[0]
    # the product of suffix norms is one more dimension
    bound = np.concatenate([ra[:, :k], suffix(ra, k)[:, None]], axis=1) @ np.concatenate([rb[:, :k], suffix(rb, k)[:, None]], axis=1).T
    i, j = np.nonzero(bound >= threshold - SLACK)
    keep_i, keep_j = [], []
    for at in range(0, len(i), PAIRS):
        p, q = i[at : at + PAIRS], j[at : at + PAIRS]
        done, total = 0, np.zeros(len(p), dtype=np.float32)
        for k in stages[:-1]:
            total = total + np.einsum("ij,ij->i", ra[p, done:k], rb[q, done:k])
            alive = total + suffix(ra, k)[p] * suffix(rb, k)[q] >= threshold - SLACK
            p, q, total, done = p[alive], q[alive], total[alive], k
        exact = np.einsum("ij,ij->i", a[p], b[q]) >= threshold
        keep_i.append(p[exact])
        keep_j.append(q[exact])
    empty = [np.empty(0, dtype=np.int64)]
    return np.concatenate(keep_i or empty), np.concatenate(keep_j or empty)


def pieces(rows: np.ndarray, basis: np.ndarray, piece: int = PIECE) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions, low, high) of pieces along the first principal component; low and high are corners of their boxes."""
    lead = rows @ basis[:, :BOX_DIMS]
    order = np.argsort(lead[:, 0], kind="stable")
    return [(at, lead[at].min(axis=0), lead[at].max(axis=0)) for at in (order[i : i + piece] for i in range(0, len(order), piece))]


def apart(low: np.ndarray, high: np.ndarray, low2: np.ndarray, high2: np.ndarray) -> np.ndarray:
    """Least squared distance of boxes (or of points, where low is high) along the last axis."""
    gap = np.maximum(0, np.maximum(low - high2, low2 - high))
    return (gap * gap).sum(axis=-1)


def reach(threshold: float) -> float:
    """Largest squared distance of unit vectors that link, with room for rounding."""
    return 2 - 2 * threshold + SLACK


def block_links(x: np.ndarray, y: np.ndarray | None, lengths: np.ndarray, weights: np.ndarray, basis: np.ndarray, threshold: float = THRESHOLD, piece: int = PIECE):
    """(links, label) of the rows of x and y, or of x alone if y is None: linked weight, and index of the smallest row joined to.

    Rows of different `lengths` don't link. Links are counted piece by piece, so memory is bounded whatever links.
    """
    n, shift = len(lengths), 0 if y is None else len(x)
    links, label, own = np.zeros(n), np.arange(n), np.arange(n)
    left = pieces(x, basis, piece)
    right = left if y is None else pieces(y, basis, piece)
    other = x if y is None else y
    for s, (a, *box) in enumerate(left):
        for t, (b, *box2) in enumerate(right):
            if (y is None and t < s) or apart(*box, *box2) > reach(threshold):
                continue
            p, q = tile_links(x[a], other[b], basis, threshold)
            p, q = a[p], b[q] + shift
            fits = lengths[p] == lengths[q]
            if y is None and s == t:
                fits &= p < q
            p, q = p[fits], q[fits]
            if len(p):
                links += np.bincount(p, weights=weights[q], minlength=n) + np.bincount(q, weights=weights[p], minlength=n)
                # labels so far stand for their links
                label = merge_labels(np.concatenate([p, own]), np.concatenate([q, label]), n)
    return links, label


def link_embeddings(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", threshold: float = THRESHOLD, block: int | None = None, piece: int = PIECE) -> DataFrame:
    """One row per row of `vectors`: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do vectors of
    different length. Repeated rows and equal vectors are linked to one another and counted one by one. component_id is the
    smallest id reachable (ids that are null don't count; null if all are); kept is id = component_id, two nulls being
    equal. The threshold must be above 0. Columns of other names aren't read; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    source = vectors.select(F.col(id_column).alias("vec_id"), F.col(vector_column).alias("v")).withColumn("ok", usable("v"))
    classes = source.where("ok").groupBy("v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = durable(classes.withColumn("cid", F.monotonically_increasing_id()))
    total, dim = classes.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not total:
        return source.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if block is None:
        cores = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        blocks = int(np.ceil(np.sqrt(2 * TILES_PER_CORE * cores)))
        block = max(PIECE, min(-(-total // blocks), BLOCK_VALUES // dim))
    rows = min(SAMPLE_ROWS, max(2, SAMPLE_VALUES // dim))
    sample = unit(stack([r["v"] for r in classes.orderBy(F.xxhash64("cid")).select("v").limit(rows).collect()], dim)[0])
    values, basis = np.linalg.eigh(sample.T @ sample)
    basis = np.ascontiguousarray(basis[:, ::-1])
    lead = min(BOX_DIMS, dim)
    bins = max(1, min(-(-total // block), len(sample) // 8))
    cuts = np.quantile(sample @ basis[:, 0], np.linspace(0, 1, bins + 1)[1:-1])

    def place(batches):
        for pdf in batches:
            r = unit(stack(pdf["v"].tolist(), dim)[0]) @ basis[:, :lead]
            yield pd.DataFrame({"cid": pdf["cid"], "n": pdf["n"], "v": pdf["v"], "bin": np.searchsorted(cuts, r[:, 0], side="right").astype(np.int32), "r": list(r)})

    kind = classes.schema["v"].dataType.simpleString()
    placed = durable(classes.select("cid", "n", "v").mapInPandas(place, f"cid long, n long, v {kind}, bin int, r array<double>"))
    ends = [f(F.get("r", F.lit(k))).alias(f"{name}{k}") for k in range(lead) for name, f in (("lo", F.min), ("hi", F.max))]
    # a row for each bin, of which there are at most SAMPLE_ROWS / 8
    boxes = {x["bin"]: x for x in placed.groupBy("bin").agg(F.count(F.lit(1)).alias("rows"), *ends).collect()}
    names = sorted(boxes)
    low = np.array([[boxes[x][f"lo{k}"] for k in range(lead)] for x in names])
    high = np.array([[boxes[x][f"hi{k}"] for k in range(lead)] for x in names])
    parts = np.array([-(-boxes[x]["rows"] // block) for x in names], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(parts)])
    position = {x: k for k, x in enumerate(names)}
    limit = reach(threshold)

    def deal(batches):
        for pdf in slices(batches, DEAL_ROWS):
            r = np.stack(pdf["r"].to_numpy())
            own = pdf["bin"].map(position).to_numpy()
            home = first[own] + (pdf["cid"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts[own]
            for k in range(len(names)):
                near = np.flatnonzero(apart(r, r, low[k], high[k]) <= limit)
                for b in range(first[k], first[k + 1]):
                    if len(near):
                        h = home[near]
                        yield pd.DataFrame({"i": np.minimum(h, b), "j": np.maximum(h, b), "home": h, "cid": pdf["cid"].to_numpy()[near], "n": pdf["n"].to_numpy()[near], "v": pdf["v"].iloc[near].to_numpy()})

    def compare(key, pdf):
        i, j = key
        a = pdf[pdf["home"] == i]
        b = a if i == j else pdf[pdf["home"] == j]
        if not len(a) or not len(b):
            return pd.DataFrame({"cid": [], "links": [], "root": []})
        both = a if i == j else pd.concat([a, b])
        x, lengths = stack(both["v"].tolist(), dim)
        x, cid = unit(x), both["cid"].to_numpy()
        links, label = block_links(x[: len(a)], None if i == j else x[len(a) :], lengths, both["n"].to_numpy(), basis, threshold, piece)
        least = np.full(len(cid), np.iinfo(np.int64).max)
        np.minimum.at(least, label, cid)
        some = links > 0
        return pd.DataFrame({"cid": cid[some], "links": links[some].astype(np.int64), "root": least[label][some]})

    dealt = placed.mapInPandas(deal, f"i long, j long, home long, cid long, n long, v {kind}")
    found = durable(dealt.groupBy("i", "j").applyInPandas(compare, "cid long, links long, root long"))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cid")
    linked = skew_join(skew_join(classes, links, ["cid"], "left"), roots, ["cid"], "left").withColumn("root", F.coalesce("root", "cid"))
    linked = durable(linked.select("v", "least", "n", "links", "root"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = skew_join(linked, least, ["root"]).select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id", F.lit(True).alias("found"))
    out = skew_join(source.withColumn("v", F.when(F.col("ok"), F.col("v"))), linked, ["v"], "left")
    component = F.when(F.col("found"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))

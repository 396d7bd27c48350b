"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints within `radius` bits agree on all but `radius` of `blocks` bit groups. One table for each choice of
blocks - radius groups deals the distinct fingerprints into buckets by those bits, so that every link shows in some
bucket, whatever its size. A bucket is compared in tiles of bounded size: fingerprints stand as 64-bit words of bit
planes, one probe's distances to 64 of them are counted at once by carry-save bitwise counters, and words whose
distances all exceed the radius are abandoned. Tiles return a spanning forest of their links.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, durable, merge_labels, skew_join

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Fingerprints of a bucket that a tile has at most, about, on either side.
TILE = 1024
#: Mean bucket size beyond which one more bit group is used.
BUCKET = 2048
#: Ids up to which the rows that go are sent to every task; beyond, the rows that stay are joined.
BROADCAST_IDS = 500_000
#: Words of 64 fingerprints compared at a time, and those whose tiles are taken together.
STEP, WORK = 8192, 1 << 20


def text_fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Signed 64-bit fingerprint of the whole text; 0 for null, empty and blank texts."""
    import re

    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode("utf-8", "replace").lower())
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(itertools.accumulate(len(x) + 1 for x in words))
    starts = [0, *ends]
    spans = zip(starts, ends[shingle - 1 :], strict=False) if len(words) >= shingle else [(0, len(line) + 1)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a : b - 1], seed) for a, b in spans], dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 65536):
        counts += np.unpackbits(h[i : i + 65536].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(h), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint_column(text: Column, shingle: int = SHINGLE, seed: int = SEED) -> Column:
    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series([text_fingerprint(x, shingle, seed) for x in texts], dtype="int64")

    return fingerprint(text)


def bit_masks(blocks: int, radius: int = RADIUS) -> list[int]:
    """Signed masks, one for each choice of blocks - radius of the bit groups."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    groups = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(edges)]
    masks = [sum(x) for x in itertools.combinations(groups, blocks - radius)]
    return [x - (1 << 64) if x >> 63 else x for x in masks]


def block_count(n: int, radius: int = RADIUS, bucket: int = BUCKET) -> int:
    """The fewest bit groups whose tables have small buckets on average for n distinct fingerprints."""
    for blocks in range(radius + 1, radius + 5):
        if n <= bucket << (64 * (blocks - radius) // blocks):
            return blocks
    return radius + 5


def planes_of(fps: np.ndarray) -> np.ndarray:
    """64 bit planes of fingerprints, lane j of word w for fingerprint 64 w + j: shape (64, words)."""
    words = -(-len(fps) // 64)
    padded = np.zeros(words * 64, dtype="<u8")
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8), bitorder="little").reshape(words, 64, 64)
    return np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")).view("<u8")[:, :, 0]


def sliced_links(probes: np.ndarray, probe: np.ndarray, planes: np.ndarray, word: np.ndarray, lanes: np.ndarray, radius: int = RADIUS):
    """(row, lane) of links among rows that compare probes[probe[i]] with the 64 lanes of word[i]; lanes: those in use.

    Counters have 3 bits and an overflow bit, enough for a radius below 8.
    """
    rows = np.arange(len(probe))
    one = np.zeros(len(probe), dtype="<u8")
    c0, c1, c2, over = one.copy(), one.copy(), one.copy(), ~lanes
    full = ~np.uint64(0)
    for plane in range(64):
        bit = (probes[probe[rows]] >> np.uint64(plane)) & np.uint64(1)
        x = planes[plane, word[rows]] ^ (np.uint64(0) - bit)
        carry = c0 & x
        c0 ^= x
        x = c1 & carry
        c1 ^= carry
        over |= c2 & x
        c2 ^= x
        if plane % 8 == 7:
            alive = (over | _above(c0, c1, c2, radius)) != full
            if not alive.all():
                rows, c0, c1, c2, over = rows[alive], c0[alive], c1[alive], c2[alive], over[alive]
                if not len(rows):
                    break
    near = ~(over | _above(c0, c1, c2, radius))
    bits = np.unpackbits(np.ascontiguousarray(near).view(np.uint8), bitorder="little").reshape(-1, 64)
    i, lane = np.nonzero(bits)
    return rows[i], lane


def _above(c0, c1, c2, radius: int):
    """Lanes whose 3-bit count exceeds the radius."""
    above, equal = np.zeros_like(c0), ~np.zeros_like(c0)
    for c, k in ((c2, 2), (c1, 1), (c0, 0)):
        if radius >> k & 1:
            equal = equal & c
        else:
            above, equal = above | (equal & c), equal & ~c
    return above


def forest_of_tiles(tiles: list[tuple[np.ndarray, np.ndarray]], radius: int = RADIUS) -> np.ndarray:
    """Edges (node, smallest node it's joined to) over the links between the two sides of tiles, or within one if the second is empty."""
    nodes, at = np.unique(np.concatenate([x for pair in tiles for x in pair]), return_inverse=True)
    left, right, ids, probe, word, lanes, n_words, k = [], [], [], [], [], [], 0, 0
    for a, b in tiles:
        ia, ib = at[k : k + len(a)], at[k + len(a) : k + len(a) + len(b)]
        k += len(a) + len(b)
        base, other = (b, ib) if len(b) else (a, ia)
        n = -(-len(base) // 64)
        ids.append(np.pad(other, (0, 64 * n - len(base))))
        use = np.full(n, ~np.uint64(0))
        if len(base) % 64:
            use[-1] = np.uint64((1 << len(base) % 64) - 1)
        left.append(a)
        right.append(planes_of(base))
        probe.append(np.repeat(ia, n))
        word.append(np.tile(np.arange(n_words, n_words + n), len(a)))
        lanes.append(np.tile(use, len(a)))
        n_words += n
    probe, word, lanes, ids, planes = np.concatenate(probe), np.concatenate(word), np.concatenate(lanes), np.concatenate(ids), np.concatenate(right, axis=1)
    label = np.arange(len(nodes))
    for i in range(0, len(probe), STEP):
        p, w = probe[i : i + STEP], word[i : i + STEP]
        row, lane = sliced_links(nodes, p, planes, w, lanes[i : i + STEP], radius)
        u, v = p[row], ids[64 * w[row] + lane]
        if len(u):
            # labels so far stand for their links
            label = merge_labels(np.concatenate([u, np.arange(len(nodes))]), np.concatenate([v, label]), len(nodes))
    joined = label != np.arange(len(nodes))
    signed = nodes.astype("<u8").view("<i8")
    return np.stack([signed[joined], signed[label[joined]]], axis=1)


def link_forest(distinct: DataFrame, column: str = "fp", radius: int = RADIUS, blocks: int | None = None, tile: int = TILE) -> DataFrame:
    """(a, b) edges that join just those of the distinct fingerprints that links join."""
    masks = bit_masks(blocks or block_count(distinct.count(), radius), radius)
    tables = F.explode(F.array(*(F.struct(F.lit(i).alias("t"), F.col(column).bitwiseAND(F.lit(x)).alias("bits")) for i, x in enumerate(masks))))
    keyed = distinct.select(F.col(column).alias("fp"), tables.alias("k")).select("fp", "k.t", "k.bits")
    sizes = keyed.groupBy("t", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = skew_join(keyed, sizes.select("t", "bits", F.ceil(F.col("n") / tile).cast("int").alias("parts")), ["t", "bits"])
    rows = rows.withColumn("part", F.pmod(F.xxhash64("fp"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    first = F.col("part") <= F.col("other")
    tiles = rows.groupBy("t", "bits", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")).agg(
        F.collect_list(F.when(first, F.col("fp"))).alias("a"), F.collect_list(F.when(~first, F.col("fp"))).alias("b")
    )

    def compare(batches):
        pairs, work = [], 0
        for pdf in batches:
            for a, b, i, j in zip(pdf["a"], pdf["b"], pdf["i"], pdf["j"]):
                if (len(a) and len(b)) or (i == j and len(a) > 1):
                    pairs.append((np.asarray(a, dtype="<i8").view("<u8"), np.asarray(b, dtype="<i8").view("<u8")))
                    work += len(a) * (-(-(len(b) or len(a)) // 64))
                if work >= WORK:
                    yield edges_of(pairs)
                    pairs, work = [], 0
        if pairs:
            yield edges_of(pairs)

    def edges_of(pairs):
        edges = forest_of_tiles(pairs, radius)
        return pd.DataFrame({"a": edges[:, 0], "b": edges[:, 1]})

    return tiles.select("a", "b", "i", "j").mapInPandas(compare, "a long, b long")


def classed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED, blocks: int | None = None, tile: int = TILE) -> DataFrame:
    """(doc_id, fp, root, component_id): the fingerprint, the smallest fingerprint of its component, and near_duplicates' id."""
    prints = durable(docs.select(F.col(id_column).alias("doc_id"), fingerprint_column(F.col(text_column), shingle, seed).alias("fp")))
    distinct = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(link_forest(distinct, "fp", radius, blocks, tile)).withColumnRenamed("node", "fp")
    classes = durable(skew_join(distinct, roots, ["fp"], "left").withColumn("root", F.coalesce("root", "fp")))
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = skew_join(classes.select("fp", "root"), least, ["root"]).select("fp", "root", "component_id")
    return skew_join(prints, named, ["fp"])


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint (16 hex digits), component_id. Options: those of classed().

    A component is all documents that links of at most `radius` bits reach; its id is the smallest doc_id in it, null if
    all are null. Null, empty and blank texts have fingerprint zero and link like any other. Repeated rows and ties share a
    fingerprint. Columns of other names aren't read; an empty table gives an empty result.
    """
    return classed(docs, **options).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """Of every component one row: that of the smallest id. Of rows that repeat an id, or have none, one stays as well.

    All columns of `docs` stay, whatever their names. Texts aren't copied: ids say which rows go, and only rows whose id
    isn't unique have their fingerprint computed again.
    """
    marked = durable(classed(docs, id_column, text_column, **options))
    unsure = durable(marked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").select("doc_id"))
    some = unsure.limit(1).count() > 0
    gone = marked.where("NOT (doc_id <=> component_id)").select("doc_id")
    gone = durable(gone.union(unsure).distinct() if some else gone)
    if gone.count() <= BROADCAST_IDS:
        sure = docs.join(F.broadcast(gone.where("doc_id IS NOT NULL").select(F.col("doc_id").alias(id_column))), id_column, "left_anti").where(F.col(id_column).isNotNull())
    else:
        stay = marked.where("doc_id <=> component_id").join(unsure, "doc_id", "left_anti").select(F.col("doc_id").alias(id_column))
        sure = docs.join(stay, id_column, "left_semi")
    sure = sure.select(*docs.columns)
    if not some:
        return sure
    first = marked.where("doc_id <=> component_id").select(F.struct("doc_id", "fp").alias("k"), "root").distinct()
    again = docs.select(F.struct("*").alias("row"), F.struct(F.col(id_column).alias("doc_id"), fingerprint_column(F.col(text_column), options.get("shingle", SHINGLE), options.get("seed", SEED)).alias("fp")).alias("k"))
    unique_key = unsure.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("i"))
    again = skew_join(again.withColumn("i", F.coalesce(F.col("k.doc_id").cast("string"), F.lit(""))), unique_key, ["i"])
    key = lambda df: df.withColumn("j", F.to_json("k"))
    one = skew_join(key(again).select("row", "j"), key(first).select("j", "root"), ["j"]).groupBy("root").agg(F.first("row").alias("row")).select("row.*")
    return sure.unionByName(one)

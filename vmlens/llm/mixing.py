"""Mixing sources to target weights by hash-threshold histograms. DataFrame operations only.

Every document has a hash. What a source's target asks beyond whole epochs is met by the documents whose hash is at most
a threshold. The threshold is found without sorting: sum words by source and the leading bits of the hash, find the
bucket in which the budget is passed, and make the histogram anew, finer, for that bucket alone; the last histogram has
single hashes. Thresholds nest: a larger budget keeps every document that a smaller one took.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, durable, skew_join

#: Bits of the hash, and of each histogram but the last.
HASH_BITS, LEVEL_BITS, LEVELS = 60, 12, 2
#: Bytes up to which the table of sources is broadcast; beyond, it's joined by a shuffle.
BROADCAST_BYTES = 4 << 20


def document_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of MD5 of the id, or of the text where the id is null."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.concat(F.lit("t"), text), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(key, source, source_size, target) from sized documents.

    Sources in code point order, null last, have the weights in turn; the excess of a source over `cap` times its size
    is shared anew by weight until none is above, which is one water level: target = least(cap * size, weight * level).
    The windows run over the table of sources, which has a row for each source.
    """
    per = sizes.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1)).cast("double"))
    per = per.withColumn("most", F.col("source_size") * F.lit(cap))
    rising = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    per = per.withColumn("below", F.coalesce(F.sum("most").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    per = per.withColumn("rest", F.sum("w").over(rising.rowsBetween(0, Window.unboundedFollowing)))
    per = per.withColumn("level", (F.sum("source_size").over(whole) * F.lit(share) - F.col("below")) / F.col("rest"))
    per = per.withColumn("level", F.max("level").over(whole))
    return per.select("key", "source", "source_size", F.least("most", F.col("w") * F.col("level")).alias("target"))


def source_key(source: Column) -> Column:
    """A source as a join key that is never null."""
    source = source.cast("string")
    return F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source))


def sized(docs: DataFrame, id_column: str, text_column: str, source_column: str) -> DataFrame:
    """(doc_id, source, key, size, h), computed once."""
    text = F.col(text_column)
    return durable(
        docs.select(
            F.col(id_column).alias("doc_id"),
            F.col(source_column).cast("string").alias("source"),
            source_key(F.col(source_column)).alias("key"),
            F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            document_hash(F.col(id_column), text).alias("h"),
        )
    )


def join_sources(rows: DataFrame, by_source: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    return rows.join(F.broadcast(by_source), "key", how) if few else skew_join(rows, by_source, ["key"], how)


def plan(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> tuple[DataFrame, bool]:
    """(key, source_size, target, whole, limit): every source's whole epochs, and the last hash with one more; and whether they're few."""
    targets = source_targets(sizes, weights, share, cap)
    whole = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))).cast("long")
    targets = durable(targets.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")))
    few = (targets.agg(F.sum(F.octet_length("key") + 64)).first()[0] or 0) <= BROADCAST_BYTES
    slim, shift = sizes.select("key", "size", "h"), HASH_BITS
    state = targets.select("key", "budget", F.lit(0.0).alias("used"), F.lit(0).cast("long").alias("prefix"))
    by_key = Window.partitionBy("key")
    for level in range(LEVELS + 1):
        old, shift = shift, shift - LEVEL_BITS if level < LEVELS else 0
        inside = join_sources(slim, state, few).where(F.shiftright("h", old) == F.col("prefix"))
        histogram = inside.groupBy("key", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.first("budget").alias("budget"), F.first("used").alias("used"))
        histogram = histogram.withColumn("after", F.col("used") + F.sum("words").over(by_key.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
        histogram = histogram.withColumn("before", F.col("after") - F.col("words"))
        passed = F.col("after") > F.col("budget")
        if level < LEVELS:
            # the first bucket that passes the budget; a source that never does keeps its last one
            pick = F.min_by(F.struct("bucket", "before"), F.when(passed, F.col("bucket")))
            last = F.max_by(F.struct("bucket", "before"), F.col("bucket"))
            state = durable(histogram.groupBy("key").agg(F.first("budget").alias("budget"), F.coalesce(pick, last).alias("at")).select("key", "budget", F.col("at.before").alias("used"), F.col("at.bucket").alias("prefix")))
        else:
            # whole hashes while they fit, and the next one where that comes nearer
            near = ~passed | ((F.col("before") <= F.col("budget")) & (F.col("after") - F.col("budget") < F.col("budget") - F.col("before")))
            limits = histogram.groupBy("key").agg(F.max(F.when(near, F.col("bucket"))).alias("limit"), F.min("bucket").alias("least"))
    # below the first hash of the last bucket all are taken, even where nothing in that bucket is
    limits = limits.select("key", F.coalesce("limit", F.col("least") - 1).alias("limit"))
    return durable(targets.join(limits, "key", "left").select("key", "source_size", "target", "whole", F.when(F.col("budget") > 0, F.col("limit")).alias("limit"))), few


def epochs(h: Column) -> Column:
    """How often the mix takes a document of a joined plan."""
    return (F.col("whole") + F.when(h <= F.col("limit"), 1).otherwise(0)).cast("long")


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """One row per row of `docs`: doc_id, size, source_size, target, epochs and taken (size times epochs).

    Size is the number of words; null and blank texts have 0, and take whatever epochs come out, 0 words. Null is a source
    of its own. Every document has the whole epochs of target / source_size; those up to the threshold have one more.
    Rows with the same id (or, where it's null, text) have one hash and are taken together; a source misses its target by
    at most half of such a group. Columns of other names aren't read; an empty table gives an empty result.
    """
    sizes = sized(docs, id_column, text_column, source_column)
    sources, few = plan(sizes, weights, share, cap)
    out = join_sources(sizes, sources, few).withColumn("epochs", epochs(F.col("h")))
    return out.select("doc_id", "size", "source_size", "target", "epochs", (F.col("size") * F.col("epochs")).cast("long").alias("taken"))


def take(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it, as mix() says. Other columns, whatever their names, stay."""
    sources, few = plan(sized(docs, id_column, text_column, source_column), weights, share, cap)
    keyed = docs.select(F.struct("*").alias("row"), source_key(F.col(source_column)).alias("key"), document_hash(F.col(id_column), F.col(text_column)).alias("h"))
    taken = join_sources(keyed, sources, few).withColumn("epochs", epochs(F.col("h"))).where("epochs > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("epochs").cast("int"))).alias("copy")).select("row.*")


#: The same by DuckDB: the threshold is found by sorting the hashes of each source.
ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 't' || text, '')), 1, 15)) AS BIGINT) AS h
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w, source_size * CAST(2 AS DOUBLE) AS most FROM per),
stacked AS (
  SELECT *, coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
    sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
    sum(source_size) OVER () * CAST(1.5 AS DOUBLE) AS whole_words FROM weighed),
levels AS (SELECT *, max((whole_words - below) / rest) OVER () AS level FROM stacked),
targets AS (SELECT source, source_size, least(most, w * level) AS target FROM levels),
budgets AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM targets),
hashes AS (SELECT source, h, sum(size) AS words FROM sized GROUP BY source, h),
running AS (SELECT source, h, words, sum(words) OVER (PARTITION BY source ORDER BY h) AS after FROM hashes),
limits AS (
  SELECT r.source, max(CASE WHEN after <= target - epochs * source_size
      OR (after - words <= target - epochs * source_size AND after - (target - epochs * source_size) < (target - epochs * source_size) - (after - words))
    THEN h END) AS limit_h
  FROM running r JOIN budgets b ON r.source IS NOT DISTINCT FROM b.source GROUP BY r.source)
SELECT s.doc_id, s.size, b.source_size, b.target,
  CAST(s.size * (b.epochs + CASE WHEN b.target - b.epochs * b.source_size > 0 AND s.h <= l.limit_h THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source LEFT JOIN limits l ON s.source IS NOT DISTINCT FROM l.source
"""

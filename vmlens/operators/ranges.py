"""Half-open integer ranges: islands, chunks, overlap and as-of lookup, complement, address translation.

Windows are always partitioned by the given keys. Lookups deal ranges into bins of a fixed width, so that a hot key is
spread and no window has to hold a whole address space.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import bit_positions, int_div
from .prefix import before_each, has_hot_key


#: Positions, and bytes of addresses, of a bin in which neighbours are looked for first.
BIN_POSITIONS, BIN_BYTES = 1 << 16, 1 << 24


def _joined(df: DataFrame, by: Sequence[str], start: str, end: str, tag: str, width: int) -> DataFrame:
    """by, start, end, tag: ranges that don't overlap, joined where one ends where the next begins and both have the same tag.

    A key is cut into bins of `width`. Only the first and last run of a bin can go on in another one, so just these, at
    most two a bin, go to one window per key."""

    def merged(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(start)
        goes_on = (F.lag(end).over(w) == F.col(start)) & F.lag(tag).over(w).eqNullSafe(F.col(tag))
        marked = rows.withColumn("__new", F.when(goes_on, 0).otherwise(1)).withColumn("__run", F.sum("__new").over(w))
        return marked.groupBy(*keys, "__run").agg(F.min(start).alias(start), F.max(end).alias(end), F.first(tag).alias(tag))

    binned = [*by, "__bin"]
    runs = merged(df.select(*by, start, end, tag, F.floor(F.col(start) / width).alias("__bin")), binned)
    edge = (F.col("__run") == 1) | (F.col("__run") == F.max("__run").over(Window.partitionBy(*binned)))
    runs = runs.withColumn("__edge", edge)
    columns = [*by, start, end, tag]
    return runs.where("NOT __edge").select(*columns).unionByName(merged(runs.where("__edge"), by).select(*columns))


def islands(df: DataFrame, by: Sequence[str], position: str, width: int = BIN_POSITIONS) -> DataFrame:
    """Runs of consecutive integers: by, first, n. Repeated positions count once."""
    ones = df.select(*by, F.col(position).alias("first"), (F.col(position) + 1).alias("__end"), F.lit(0).alias("__tag")).where(F.col(position).isNotNull()).distinct()
    return _joined(ones, by, "first", "__end", "__tag", width).select(*by, "first", (F.col("__end") - F.col("first")).alias("n"))


def bitmap_ranges(df: DataFrame, by: Sequence[str], words: str, start: str, page_size: str) -> DataFrame:
    """Dirty bitmap words (array<bigint>, bit i of word k is page 64 k + i) to ranges: by, gpa, length."""
    pages = df.select(*by, start, page_size, F.posexplode(words).alias("__k", "__w")).select(*by, start, page_size, F.explode(F.transform(bit_positions(F.col("__w")), lambda i: F.col("__k").cast("bigint") * 64 + i)).alias("__page"))
    runs = islands(pages, [*by, start, page_size], "__page")
    return runs.select(*by, (F.col(start) + F.col("first") * F.col(page_size)).alias("gpa"), (F.col("n") * F.col(page_size)).alias("length"))


def flags_to_words(df: DataFrame, by: Sequence[str], index: str) -> DataFrame:
    """Set flags, given by their index, to 64-bit words: by, word, bits."""
    return df.groupBy(*by, int_div(F.col(index), F.lit(64)).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST({index} % 64 AS INT))")).alias("bits"))


def bitmap_union(left: DataFrame, right: DataFrame, by: Sequence[str], word: str = "word", bits: str = "bits") -> DataFrame:
    """Word-wise OR of two dirty logs; words that only one of them has are dropped, as a zip of both does."""
    return left.select(*by, word, F.col(bits).alias("__l")).join(right.select(*by, word, F.col(bits).alias("__r")), [*by, word]).select(*by, word, F.col("__l").bitwiseOR(F.col("__r")).alias(bits))


def merge_adjacent(df: DataFrame, by: Sequence[str], start: str, length: str) -> DataFrame:
    """Ranges in start order, joined where one ends just where the next begins."""
    hot = has_hot_key(df, by)
    rows = before_each(df.select(*by, start, length), by, [start, length], {"__end": ("last", F.col(start) + F.col(length))}, hot=hot)
    marked = rows.withColumn("__new", F.when(F.col("__end") == F.col(start), 0).otherwise(1))
    marked = before_each(marked, by, [start, length], {"__run": ("sum", F.col("__new"))}, inclusive=True, hot=hot)
    return marked.groupBy(*by, "__run").agg(F.min(start).alias(start), F.sum(length).alias(length)).drop("__run")


def clamp_start(df: DataFrame, start: str, length: str, low: int) -> DataFrame:
    """Ranges cut at `low`: what lies before it is dropped."""
    end = F.col(start) + F.col(length)
    cut = df.where(end > low).withColumn("__end", end)
    return cut.withColumn(start, F.greatest(F.col(start), F.lit(low))).withColumn(length, F.col("__end") - F.col(start)).drop("__end")


def runs(df: DataFrame, by: Sequence[str], order: Sequence[str], keys: Sequence[str], length: str | None = None) -> DataFrame:
    """Run-length groups of equal neighbouring keys: by, run (from 1), keys, n and, given a length column, its sum."""
    hot = has_hot_key(df, by)
    own = F.struct(*(F.col(k) for k in keys))
    rows = before_each(df, by, list(order), {"__before": ("last", own)}, hot=hot)
    same = F.col("__before").isNotNull()
    for k in keys:
        same = same & F.col("__before")[k].eqNullSafe(F.col(k))
    marked = before_each(rows.withColumn("__changed", F.when(same, 0).otherwise(1)), by, list(order), {"run": ("sum", F.col("__changed"))}, inclusive=True, hot=hot)
    aggs = [F.count(F.lit(1)).alias("n"), *([F.sum(length).alias(length)] if length else [])]
    return marked.groupBy(*by, "run", *keys).agg(*aggs)


def running_offset(df: DataFrame, by: Sequence[str], order: Sequence[str], size: str, name: str = "offset") -> DataFrame:
    """Sum of the sizes before each row."""
    return before_each(df, by, list(order), {name: ("sum", F.col(size))}).withColumn(name, F.coalesce(name, F.lit(0)))


def chunks(df: DataFrame, by: Sequence[str], order: Sequence[str], gpa: str, length: str, size: int) -> DataFrame:
    """Pieces of at most `size` units a chunk, filled from the last range to the first; a cut range gives its high part first.

    by, chunk, gpa, length. Size 0 gives nothing, and ranges of length 0 give no piece. `order` must be total.
    """
    if size <= 0:
        return df.select(*by, F.lit(0).cast("bigint").alias("chunk"), F.col(gpa).alias("gpa"), F.col(length).alias("length")).limit(0)
    line = before_each(df.where(F.col(length) > 0), by, [F.col(c).desc() for c in order], {"__a": ("sum", F.col(length))})
    line = line.withColumn("__a", F.coalesce("__a", F.lit(0)).cast("bigint")).withColumn("__b", F.col("__a") + F.col(length))
    cut = line.withColumn("chunk", F.explode(F.sequence(int_div(F.col("__a"), F.lit(size)), int_div(F.col("__b") - 1, F.lit(size)))))
    lo, hi = F.greatest("__a", F.col("chunk") * size), F.least("__b", (F.col("chunk") + 1) * size)
    return cut.select(*by, "chunk", (F.col(gpa) + F.col(length) - (hi - F.col("__a"))).alias("gpa"), (hi - lo).alias("length"))


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.sequence(F.floor(start / width).cast("bigint"), F.floor((end - 1) / width).cast("bigint"))


def overlaps(left: DataFrame, right: DataFrame, by: Sequence[str], start: str, length: str, width: int) -> DataFrame:
    """Pairs of rows whose ranges overlap, each once: by, then every column of either side with l_ or r_.

    Both sides are dealt to the bins they touch; a pair is kept in the bin where the later of its starts lies, so nothing
    has to be made distinct. `width` should be about the usual length: ranges many bins long are copied to each.
    """

    def side(df: DataFrame, mark: str) -> DataFrame:
        rest = [F.col(c).alias(f"{mark}_{c}") for c in df.columns if c not in by]
        return df.where(F.col(length) > 0).select(*by, *rest, F.explode(_bins(F.col(start), F.col(start) + F.col(length), width)).alias("__bin"))

    a, b = side(left, "l"), side(right, "r")
    ls, rs = F.col(f"l_{start}"), F.col(f"r_{start}")
    hit = (ls < rs + F.col(f"r_{length}")) & (rs < ls + F.col(f"l_{length}"))
    first = F.col("__bin") == F.floor(F.greatest(ls, rs) / width)
    return a.join(b, [*by, "__bin"]).where(hit & first).drop("__bin")


#: Rows of a bin, about, where no width is given.
BIN_ROWS = 100_000


def _fair_width(sides: Sequence[DataFrame]) -> int:
    """The extent of all positions, over as many bins as give each BIN_ROWS."""
    ends = [x.agg(F.min("x"), F.max("x"), F.count("x")).first() for x in sides]
    low, high, n = min((r[0] for r in ends if r[2]), default=0), max((r[1] for r in ends if r[2]), default=0), sum(r[2] for r in ends)
    return max(1, -(-int(high - low + 1) // max(1, n // BIN_ROWS)))


def asof(queries: DataFrame, bases: DataFrame, by: Sequence[str], at: str, base: str, payload: Sequence[str], width: int | None = None) -> DataFrame:
    """Every query row with the payload of the greatest base <= at (null if there is none).

    Time or address is cut into bins of a width, and a bin's window is seeded with the last base of earlier bins, so the work
    of one key is spread over its bins. Without a width it's chosen from the extent and number of the bases and queries, so
    that a bin has about BIN_ROWS of them. Bases of equal value: the greatest payload wins. Null keys are alike; a null position
    has no base.
    """
    if width is None:
        width = _fair_width([queries.select(F.col(at).alias("x")), bases.select(F.col(base).alias("x"))])
    q = queries.select("*", F.col(at).alias("__x"), F.lit(None).cast(bases.schema[base].dataType).alias(base), *(F.lit(None).cast(bases.schema[p].dataType).alias(p) for p in payload), F.lit(1).alias("__q"))
    b = bases.select(*by, F.col(base).alias("__x"), base, *payload, F.lit(0).alias("__q"))
    both = q.unionByName(b, allowMissingColumns=True).withColumn("__bin", F.floor(F.col("__x") / width))
    both = both.withColumn("__f", F.when(F.col("__q") == 0, F.struct(base, *payload)))
    # every bin begins with the last base of the bins before it, as one more row
    last = both.groupBy(*by, "__bin").agg(F.max("__f").alias("__f"))
    before = Window.partitionBy(*by).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    seeds = last.withColumn("__f", F.last("__f", ignorenulls=True).over(before)).where("__f IS NOT NULL").withColumn("__q", F.lit(-1))
    w = Window.partitionBy(*by, "__bin").orderBy(F.col("__q") >= 0, "__x", "__q", *payload)
    found = both.unionByName(seeds, allowMissingColumns=True).withColumn("__f", F.last("__f", ignorenulls=True).over(w))
    return found.where("__q = 1").select(*queries.columns, F.col(f"__f.{base}").alias(base), *(F.col(f"__f.{p}").alias(p) for p in payload))


def resolve(queries: DataFrame, ranges: DataFrame, by: Sequence[str], at: str, base: str, length: str, payload: Sequence[str] = (), width: int | None = None) -> DataFrame:
    """As-of plus containment: the range that holds `at`, with the offset in it; ranges must be disjoint within a key."""
    found = asof(queries, ranges, by, at, base, [length, *payload], width)
    inside = F.col(at) - F.col(base) < F.col(length)
    return found.select(*queries.columns, *(F.when(inside, F.col(c)).alias(c) for c in (base, length, *payload)), F.when(inside, F.col(at) - F.col(base)).alias("offset"))


def complement(regions: DataFrame, holes: DataFrame, by: Sequence[str], start: str, length: str, page: int = 1) -> DataFrame:
    """What is left of each region (one a key) without its holes: by, start, length. Hole ends are rounded out to pages."""
    low = F.col(start) - F.pmod(F.col(start), F.lit(page))
    end = F.col(start) + F.col(length)
    h = holes.select(*by, low.alias("__s"), (end + F.pmod(-end, F.lit(page))).alias("__e"))
    r = regions.select(*by, F.col(start).alias("__rs"), (F.col(start) + F.col(length)).alias("__re"))
    # a mark before and after the holes
    marks = h.unionByName(r.select(*by, F.col("__rs").alias("__s"), F.col("__rs").alias("__e"))).unionByName(r.select(*by, F.col("__re").alias("__s"), F.col("__re").alias("__e")))
    gaps = before_each(marks, by, ["__s", "__e"], {"__from": ("max", F.col("__e"))}).join(r, list(by))
    lo, hi = F.greatest("__from", "__rs"), F.least("__s", "__re")
    return gaps.select(*by, lo.alias(start), (hi - lo).alias(length)).where(F.col(start).isNotNull() & (F.col(length) > 0))


def translation_islands(mappings: DataFrame, by: Sequence[str], iova: str = "iova", gpa: str = "gpa", size: str = "size", width: int = BIN_BYTES) -> DataFrame:
    """Mappings joined where they're adjacent in both address spaces: a span may cross those, and no others."""
    rows = mappings.select(*by, iova, (F.col(iova) + F.col(size)).alias("__end"), (F.col(gpa) - F.col(iova)).alias("__tag"))
    return _joined(rows, by, iova, "__end", "__tag", width).select(*by, iova, (F.col(iova) + F.col("__tag")).alias(gpa), (F.col("__end") - F.col(iova)).alias(size))


def translate(requests: DataFrame, mappings: DataFrame, by: Sequence[str], addr: str = "addr", size: str = "size", width: int | None = None) -> DataFrame:
    """Requests with `translated`, null where the span isn't mapped throughout or has size 0. Mappings: iova, gpa, size."""
    whole = translation_islands(mappings, by).withColumnRenamed("size", "__len")
    found = asof(requests, whole.select(*by, F.col("iova").alias("__iova"), F.col("gpa").alias("__gpa"), "__len"), by, addr, "__iova", ["__gpa", "__len"], width)
    inside = (F.col(size) > 0) & (F.col(addr) - F.col("__iova") + F.col(size) <= F.col("__len"))
    return found.select(*requests.columns, F.when(inside, F.col("__gpa") + F.col(addr) - F.col("__iova")).alias("translated"))


def translate_back(requests: DataFrame, mappings: DataFrame, by: Sequence[str], addr: str = "addr", size: str = "size", width: int = 1 << 20) -> DataFrame:
    """The iova of spans of guest addresses; a span must lie in one mapping, and of several the lowest iova counts."""
    m = mappings.select(*by, F.col("iova").alias("__iova"), F.col("gpa").alias("__gpa"), F.col("size").alias("__len"))
    m = m.withColumn("__bin", F.explode(_bins(F.col("__gpa"), F.col("__gpa") + F.col("__len"), width)))
    q = requests.withColumn("__bin", F.floor(F.col(addr) / width))
    hit = (F.col(size) > 0) & (F.col(addr) >= F.col("__gpa")) & (F.col(addr) + F.col(size) <= F.col("__gpa") + F.col("__len"))
    joined = q.join(m, [*by, "__bin"], "left")
    return joined.groupBy(*requests.columns).agg(F.min(F.when(hit, F.col("__iova") + F.col(addr) - F.col("__gpa"))).alias("translated"))


def segments(requests: DataFrame, extents: DataFrame, by: Sequence[str], start: str, length: str, access: str, write: str, width: int) -> DataFrame:
    """Requests cut at extent ends: one row per overlap with seg_start, seg_length; `denied` for all of a request's rows if
    any of its extents has no access, or is read-only and the request writes."""
    hit = overlaps(requests, extents, by, start, length, width)
    lo = F.greatest(f"l_{start}", f"r_{start}")
    hi = F.least(F.col(f"l_{start}") + F.col(f"l_{length}"), F.col(f"r_{start}") + F.col(f"r_{length}"))
    bad = (F.col(f"r_{access}") == "NOACCESS") | (F.col(f"l_{write}") & (F.col(f"r_{access}") == "RDONLY"))
    mine = [c for c in hit.columns if c.startswith("l_")]
    out = hit.select("*", lo.alias("seg_start"), (hi - lo).alias("seg_length"), bad.alias("__bad"))
    return out.withColumn("denied", F.max("__bad").over(Window.partitionBy(*by, *mine))).drop("__bad")


def weighted_split(total: int, align: int, parts: DataFrame, order: str, weight: str, base: int = 0) -> DataFrame:
    """Ranges of a total, in units of floor(total / (align * weights)) * align by weight; the last has the rest.

    The parts are a short list (segments of a bus); their windows aren't partitioned."""
    w = Window.orderBy(order)
    unit = F.floor(F.lit(total) / (F.lit(align) * F.sum(weight).over(Window.partitionBy()))).cast("bigint") * align
    before = F.coalesce(F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * unit
    size = F.when(F.lead(order).over(w).isNull(), F.lit(total) - before).otherwise(F.col(weight) * unit)
    return parts.select("*", (F.lit(base) + before).cast("bigint").alias("start"), size.cast("bigint").alias("length"))


def policy_ranges(regions: DataFrame, extents: DataFrame, policy: str, width: int) -> DataFrame:
    """Ranges to send by policy. regions: region_id, gpa, length, persisted, sparse; extents: region_id, gpa, length.

    full: every region; skip_persisted: without those whose file stays; sparse: a region with known data extents by its
    extents, cut to the region, other regions whole."""
    whole = regions.select("region_id", "gpa", "length")
    if policy == "full":
        return whole
    if policy == "skip_persisted":
        return regions.where("NOT persisted").select("region_id", "gpa", "length")
    known = extents.select("region_id").distinct()
    cut = overlaps(whole, extents.select("region_id", "gpa", "length"), ["region_id"], "gpa", "length", width)
    lo = F.greatest("l_gpa", "r_gpa")
    hi = F.least(F.col("l_gpa") + F.col("l_length"), F.col("r_gpa") + F.col("r_length"))
    return cut.select("region_id", lo.alias("gpa"), (hi - lo).alias("length")).unionByName(whole.join(known, "region_id", "left_anti"))

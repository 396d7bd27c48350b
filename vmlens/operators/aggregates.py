"""Counters, latencies, benchmark statistics and other aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import adjust
from .state import ordered_fold, ordered_reduce


def mean(value: str) -> Column:
    return F.avg(value)


def std_deviation(value: str) -> Column:
    """Of the population."""
    return F.stddev_pop(value)


def largest(value: str) -> Column:
    """Maximum that ignores NaN (Spark's own max takes NaN as the largest)."""
    return F.max(F.when(~F.isnan(F.col(value).cast("double")), F.col(value)))


def smallest(value: str) -> Column:
    return F.min(F.when(~F.isnan(F.col(value).cast("double")), F.col(value)))


def benchmark_summary(runs: DataFrame, by: Sequence[str], iteration: str, value: str, warmup: int = 0, adjuster: str | None = None) -> DataFrame:
    """by, mean, std_dev, max, min, status. Iterations below `warmup` are dropped; statistics are adjusted after they're made.

    Without a usable iteration, or with a failed one (null value), all are 0 and the status is FAILED."""
    used = F.col(iteration) >= warmup
    v = F.when(used, F.col(value))
    stats = {"mean": F.avg(v), "std_dev": F.stddev_pop(v), "max": F.max(F.when(~F.isnan(v), v)), "min": F.min(F.when(~F.isnan(v), v))}
    out = runs.groupBy(*by, *([adjuster] if adjuster else [])).agg(*(s.alias(k) for k, s in stats.items()), F.count(v).alias("__n"), F.count(F.when(used, 1)).alias("__all"))
    passed = (F.col("__n") > 0) & (F.col("__n") == F.col("__all"))
    scaled = lambda k: adjust(F.col(k), F.col(adjuster)) if adjuster else F.col(k)
    return out.select(*by, *(F.when(passed, scaled(k)).otherwise(F.lit(0.0)).alias(k) for k in stats), F.when(passed, "PASSED").otherwise("FAILED").alias("status"))


def truncated(a: int, b: int) -> int:
    """a / b towards zero."""
    return abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)


def cumulative_average(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, scale: int = 10_000) -> DataFrame:
    """by, average: the scaled integer average that a counter keeps, whose steps truncate: it depends on the order.

    Rows are read as a sorted stream, a key's state is two numbers; avg() is the mergeable approximation. Null values don't
    count."""

    def make(first: dict):
        state = [0, 0]

        def step(row: dict) -> None:
            x = row[value] * scale
            state[0] += 1
            state[1] = x if state[0] == 1 else state[1] + truncated(x - state[1], state[0])

        step.state = state
        return step

    return ordered_reduce(df.where(F.col(value).isNotNull()).withColumn(value, F.col(value).cast("bigint")), by, order, make, lambda step: (truncated(step.state[1], scale),), "average long", [value])


def request_counters(df: DataFrame, by: Sequence[str], order: Sequence[str], direction: str = "direction", num_bytes: str = "bytes", latency: str = "latency_us", result: str = "result") -> DataFrame:
    """Long-format counters: by, counter, value. Byte and op counters are always there; latency ones only for a direction
    that had operations. Failed requests (result < 0) don't count. The average is cumulative_average()'s."""
    fine = F.col(result) >= 0
    aggs = []
    for d in ("read", "write"):
        mine = fine & (F.col(direction) == d)
        aggs += [F.coalesce(F.sum(F.when(mine, F.col(num_bytes))), F.lit(0)).cast("bigint").alias(f"{d}_bytes"), F.count(F.when(mine, 1)).alias(f"{d}_ops")]
        aggs += [f(F.when(mine, F.col(latency))).cast("bigint").alias(f"{d}_latency_{n}") for n, f in (("min", F.min), ("max", F.max))]
    wide = df.groupBy(*by).agg(*aggs)
    names = [c for c in wide.columns if c not in by]
    done = df.where(fine & F.col(direction).isin("read", "write"))
    averages = cumulative_average(done, [*by, direction], order, latency).select(*by, F.concat(direction, F.lit("_latency_avg")).alias("counter"), F.col("average").alias("value"))
    return wide.unpivot(list(by), names, "counter", "value").where("value IS NOT NULL").unionByName(averages)


def counter_maps(long: DataFrame, device: str = "device_id", counter: str = "counter", value: str = "value") -> DataFrame:
    """device, counters map; devices without counters are left out."""
    return long.where(F.col(value).isNotNull()).groupBy(device).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(counter, value)))).alias("counters"))


def memory_totals(df: DataFrame, size: str = "size", hotplugged: str = "hotplugged_size", zones: str = "zones") -> DataFrame:
    """total and hotplugged: own and those of the zones (array of struct(size, hotplugged_size)); nulls count as 0."""
    zero = F.lit(0).cast("bigint")
    over = lambda field: F.aggregate(F.coalesce(F.col(zones), F.array().cast(df.schema[zones].dataType)), zero, lambda s, z: s + F.coalesce(z[field].cast("bigint"), zero))
    plugged = F.coalesce(F.col(hotplugged), zero) + over("hotplugged_size")
    return df.withColumn("hotplugged", plugged).withColumn("total", F.col(size) + over("size") + F.col("hotplugged"))


def actual_memory(total: Column, hotplugged: Column, balloon: Column, plugged: Column) -> Column:
    return F.greatest(total - hotplugged - balloon, F.lit(0)) + plugged


def effective_size(ranges: DataFrame, by: Sequence[str], length: str) -> DataFrame:
    """Sum of a bag of ranges: overlaps count twice."""
    return ranges.groupBy(*by).agg(F.sum(length).alias("effective_size"))


def reference_counts(references: Sequence[DataFrame], items: DataFrame, key: str, most: int) -> DataFrame:
    """Every item with its number of references, and problem: 'overflow' beyond `most`; references to no item are rows with
    problem 'out of range'."""
    refs = references[0].select(key)
    for r in references[1:]:
        refs = refs.unionByName(r.select(key))
    counted = refs.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    out = items.select(key, F.lit(True).alias("__item")).join(counted, key, "full")
    problem = F.when(F.col("__item").isNull(), "out of range").when(F.col("n") > most, "overflow")
    return out.select(key, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), problem.alias("problem"))


def version_conflicts(df: DataFrame, name: str, version: str) -> DataFrame:
    """Names with more than one version: name, n_versions, versions."""
    return df.groupBy(name).agg(F.array_sort(F.collect_set(version)).alias("versions")).withColumn("n_versions", F.size("versions").cast("bigint")).where("n_versions > 1")


def digest_mismatches(df: DataFrame, data: str, expected: str) -> DataFrame:
    """Rows of `expected` (map of algorithm to digest) that the data don't have: all columns, algorithm, actual."""
    d = F.col(data)
    actual = F.create_map(F.lit("sha1"), F.sha1(d), F.lit("sha256"), F.sha2(d, 256), F.lit("sha512"), F.sha2(d, 512), F.lit("md5"), F.md5(d))
    rows = df.select("*", actual.alias("__all"), F.explode(expected).alias("algorithm", "__want"))
    return rows.withColumn("actual", F.try_element_at("__all", F.col("algorithm"))).where(~F.lower("__want").eqNullSafe(F.col("actual"))).drop("__all", "__want")


def complete_pages(df: DataFrame, by: Sequence[str], addr: str, page_size: int, sub: int = 4096) -> DataFrame:
    """Pages all of whose sub-pages were seen, in any order: by, page."""
    n = page_size // sub
    seen = df.groupBy(*by, (F.col(addr) - F.pmod(F.col(addr), F.lit(page_size))).alias("page")).agg(F.countDistinct(F.floor(F.pmod(F.col(addr), F.lit(page_size)) / sub)).alias("__n"))
    return seen.where(F.col("__n") == n).drop("__n")


def complete_pages_in_order(df: DataFrame, by: Sequence[str], order: Sequence[str], addr: str, page_size: int, sub: int = 4096) -> DataFrame:
    """by, page: those completed when an address of another page forgets what was seen, as a device with one bitmap does.

    One row for each time a page is completed; the state is one page's bitmap."""

    def make(first: dict):
        state = {"page": None, "seen": set()}

        def step(row: dict) -> tuple:
            page = row[addr] - row[addr] % page_size
            if page != state["page"]:
                state["page"], state["seen"] = page, set()
            state["seen"].add((row[addr] - page) // sub)
            if len(state["seen"]) < page_size // sub:
                return (None,)
            state["page"] = None
            return (page,)

        return step

    marked = ordered_fold(df.select(*by, *(c for c in order if c not in by), F.col(addr).cast("bigint").alias(addr)), by, order, make, "page long", [addr])
    return marked.where("page IS NOT NULL").select(*by, "page")


# further sums and counts


def stream_total(value: str) -> Column:
    """Throughput of several clients together; a client without a figure counts as 0."""
    return F.coalesce(F.sum(value), F.lit(0.0))


def plugged_size(plugged: str, device: str) -> Column:
    """Plugged bytes of the zones that have a device."""
    return F.coalesce(F.sum(F.when(F.col(device).isNotNull(), F.col(plugged))), F.lit(0)).cast("bigint")


def active_count(active: str) -> Column:
    return F.count_if(F.coalesce(F.col(active), F.lit(False)))

"""Constraint checks as queries for violations: each gives rows (rule, id, detail)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import is_aligned, is_power_of_two
from .prefix import before_each
from .ranges import asof, overlaps

Rule = Callable[..., DataFrame]
RULES: dict[str, Rule] = {}


def rule(f: Rule) -> Rule:
    RULES[f.__name__] = f
    return f


def _found(rows: DataFrame, name: str, ident: Column, detail: Column) -> DataFrame:
    return rows.select(F.lit(name).alias("rule"), ident.cast("string").alias("id"), detail.cast("string").alias("detail"))


def violations(results: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, results)


def first_violation(results: Sequence[DataFrame]) -> DataFrame:
    """What a fail-fast check reports: the first rule that is broken, and of its rows the one with the least id."""
    marked = [r.withColumn("__k", F.lit(k)) for k, r in enumerate(results)]
    return reduce(DataFrame.unionByName, marked).orderBy("__k", "id").limit(1).drop("__k")


@rule
def unique(df: DataFrame, key: str, name: str = "unique") -> DataFrame:
    rows = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _found(rows, name, F.col(key), F.col("n"))


@rule
def reserved_prefix(df: DataFrame, key: str, prefix: str = "__", name: str = "reserved_prefix") -> DataFrame:
    return _found(df.where(F.col(key).startswith(prefix)), name, F.col(key), F.lit(prefix))


@rule
def foreign_key(df: DataFrame, key: str, there: DataFrame, there_key: str, ident: str | None = None, name: str = "foreign_key") -> DataFrame:
    rows = df.where(F.col(key).isNotNull()).join(there.select(F.col(there_key).alias(key)).distinct(), key, "left_anti")
    return _found(rows, name, F.col(ident or key), F.col(key))


@rule
def condition(df: DataFrame, broken: Column, ident: str, detail: Column | None = None, name: str = "condition") -> DataFrame:
    """Cross-field bounds, mutual exclusion, forbidden constants and the like: rows where `broken` is true."""
    return _found(df.where(broken), name, F.col(ident), F.lit("") if detail is None else detail)


def vcpu_bounds(boot: str = "boot_vcpus", most: str = "max_vcpus", cap: int = 8192) -> Column:
    return (F.col(most) < F.col(boot)) | (F.col(most) > cap)


def topology_broken(parts: Sequence[str], most: str = "max_vcpus") -> Column:
    zero = reduce(lambda a, b: a | b, (F.col(p) == 0 for p in parts))
    return zero | (reduce(lambda a, b: a * b, (F.col(p) for p in parts)) != F.col(most))


def both_set(a: str, b: str) -> Column:
    return F.col(a).isNotNull() & F.col(b).isNotNull()


def needs(flag: str, needed: Column) -> Column:
    return F.coalesce(F.col(flag), F.lit(False)) & ~F.coalesce(needed, F.lit(False))


def not_power_of_two(value: str) -> Column:
    return ~is_power_of_two(F.col(value))


def beyond_bounds(offset: str, length: str, size: str) -> Column:
    """offset + length > size, in decimals so that it can't overflow."""
    return F.col(offset).cast("decimal(20,0)") + F.col(length).cast("decimal(20,0)") > F.col(size).cast("decimal(20,0)")


@rule
def exclusive_membership(df: DataFrame, owner: str, members: str, name: str = "exclusive_membership") -> DataFrame:
    """Members (of an array column) that more than one owner has."""
    rows = df.select(owner, F.explode(members).alias("m")).groupBy("m").agg(F.countDistinct(owner).alias("n")).where("n > 1")
    return _found(rows, name, F.col("m"), F.col("n"))


@rule
def disjoint(df: DataFrame, by: Sequence[str], start: str, length: str, granule: int = 1, most: int | None = None, name: str = "disjoint") -> DataFrame:
    """Ranges that overlap one before them in their key, aren't aligned, or are beyond the most a key may have."""
    rows = before_each(df, by, [start, length], {"__reach": ("max", F.col(start) + F.col(length)), "__n": ("sum", F.lit(1))})
    marked = rows.withColumns({"__o": F.col("__reach") > F.col(start), "__a": ~(is_aligned(F.col(start), F.lit(granule)) & is_aligned(F.col(length), F.lit(granule))), "__c": F.coalesce("__n", F.lit(0)) >= (most or 1 << 62)})
    what = F.concat_ws(",", F.when(F.col("__o"), "overlap"), F.when(F.col("__a"), "unaligned"), F.when(F.col("__c"), "too many"))
    return _found(marked.where(what != ""), name, F.concat_ws("/", *(F.col(c).cast("string") for c in (*by, start))), what)


@rule
def no_split(ranges: DataFrame, cuts: DataFrame, by: Sequence[str], start: str, length: str, width: int = 1 << 21, name: str = "no_split") -> DataFrame:
    """Ranges that an unmapping [start, start + length) would cut in two: they overlap it but aren't inside it.

    Both sides are dealt to bins of `width`, as overlaps() says; empty ranges and unmappings cut nothing."""
    columns = [*by, start, length]
    pairs = overlaps(ranges.select(*columns), cuts.select(*columns), by, start, length, width)
    low, cut = F.col(f"l_{start}"), F.col(f"r_{start}")
    rows = pairs.where((cut > low) | (cut + F.col(f"r_{length}") < low + F.col(f"l_{length}")))
    return _found(rows, name, F.concat_ws("/", *(F.col(x).cast("string") for x in by), low.cast("string")), cut)


def numa_mode(has_nodes: Column, has_zones: Column, hotplug: Column) -> Column:
    """How memory is laid out, or what is wrong with it."""
    return F.when(has_nodes & ~has_zones, "error: nodes without zones").when(has_nodes & hotplug, "nodes, zones hotplugged").when(has_nodes, "nodes").when(has_zones, "zones").otherwise("flat")


def numa_node_problem(device_id: Column, cpus: Column, zones: Column) -> Column:
    """What is wrong with a node that is a device's, or has CPUs, or zones; null if nothing. Absent is null, given may be empty."""
    device, own = device_id.isNotNull(), cpus.isNotNull() | zones.isNotNull()
    problem = F.when(device & own, "device_id excludes cpus and memory_zones").when(~device & ~own, "neither device_id nor cpus or memory_zones")
    problem = problem.when(device & (F.length(device_id) == 0), "device_id is empty").when(cpus.isNotNull() & (F.size(cpus) == 0), "cpus is empty")
    return problem.when(cpus.isNull() & zones.isNotNull() & (F.size(zones) == 0), "memory_zones is empty")


#: Context ids that no vsock device may have (fixed values; the last is all bits of 32).
SPECIAL_CIDS = (0, 1, 2, 0xFFFF_FFFF)


def special_cid(cid: str) -> Column:
    return F.col(cid).isin(*SPECIAL_CIDS)


@rule
def feature_compatibility(source: DataFrame, target: DataFrame, checks: DataFrame, name: str = "feature_compatibility") -> DataFrame:
    """All mismatches. source, target: leaf, register, value; checks: leaf, register, kind (subset, equal, not_greater).

    A missing leaf counts as 0."""
    s = source.select("leaf", "register", F.col("value").alias("s"))
    t = target.select("leaf", "register", F.col("value").alias("t"))
    both = checks.join(s, ["leaf", "register"], "left").join(t, ["leaf", "register"], "left").fillna(0, ["s", "t"])
    fine = F.when(F.col("kind") == "subset", F.col("s").bitwiseAND(F.bitwise_not(F.col("t"))) == 0).when(F.col("kind") == "equal", F.col("s") == F.col("t")).otherwise(F.col("s") <= F.col("t"))
    return _found(both.where(~fine), name, F.concat_ws("/", F.col("leaf").cast("string"), "register"), F.concat_ws(" ", "kind", F.col("s").cast("string"), F.col("t").cast("string")))


@rule
def restore_ranges(ranges: DataFrame, regions: DataFrame, order: str, page: int, name: str = "restore_ranges") -> DataFrame:
    """Saved ranges (vm, gpa, length) that aren't aligned, don't lie in one plain region, or whose place in the file isn't aligned.

    A machine's regions don't overlap, so the one that begins last before a range is the only one that can hold it."""
    r = before_each(ranges, ["vm"], [order], {"__at": ("sum", F.col("length"))}).withColumn("__at", F.coalesce("__at", F.lit(0)))
    homes = regions.where("plain").select("vm", F.col("gpa").alias("__g"), F.col("length").alias("__l"))
    inside = F.col("gpa") + F.col("length") <= F.col("__g") + F.col("__l")
    held = asof(r, homes, ["vm"], "gpa", "__g", ["__l"]).withColumn("__in", F.coalesce(inside, F.lit(False)))
    aligned = is_aligned(F.col("gpa"), F.lit(page)) & is_aligned(F.col("length"), F.lit(page)) & is_aligned(F.col("__at"), F.lit(page))
    what = F.concat_ws(",", F.when(~aligned, "unaligned"), F.when(~F.col("__in"), "outside"))
    return _found(held.where(what != ""), name, F.concat_ws("/", F.col("vm").cast("string"), F.col("gpa").cast("string")), what)


#: Legal steps of a machine's states (fixed values).
VM_TRANSITIONS = [
    ("Created", "Running"), ("Created", "Paused"), ("Created", "BreakPoint"), ("Created", "Shutdown"),
    ("Running", "Paused"), ("Running", "Shutdown"), ("Running", "BreakPoint"),
    ("Shutdown", "Running"),
    ("Paused", "Running"), ("Paused", "Shutdown"),
    ("BreakPoint", "Created"), ("BreakPoint", "Running"),
]


#: Legal steps of a migration's context (fixed values).
MIGRATION_TRANSITIONS = [("Begin", "VmPaused"), ("VmPaused", "Completed")]


@rule
def transitions(df: DataFrame, by: Sequence[str], order: str, state: str, legal: Sequence[tuple[str, str]] = VM_TRANSITIONS, name: str = "transitions") -> DataFrame:
    """Steps from one state to the next that aren't among the legal ones."""
    steps = before_each(df, by, [order], {"__before": ("last", F.struct(F.col(state).alias("s")))}).withColumn("__from", F.col("__before.s")).where("__from IS NOT NULL")
    allowed = reduce(lambda a, b: a | b, ((F.col("__from") == x) & (F.col(state) == y) for x, y in legal), F.lit(False))
    return _found(steps.where(~allowed), name, F.concat_ws("/", *(F.col(c).cast("string") for c in (*by, order))), F.concat_ws("->", "__from", state))


def version_supported(version: Column, current: int) -> Column:
    """The current version and the one before it, if there is one."""
    return version.between(max(0, current - 1), current)


@rule
def batch_keys(batch: DataFrame, in_flight: DataFrame, key: str, name: str = "batch_keys") -> DataFrame:
    """Keys that a batch has twice, or that are in flight already."""
    twice = batch.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key, F.lit("repeated").alias("w"))
    flying = batch.select(key).distinct().join(in_flight, key, "left_semi").select(key, F.lit("in flight").alias("w"))
    return _found(twice.unionByName(flying), name, F.col(key), F.col("w"))

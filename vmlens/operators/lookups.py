"""Filters, joins and set operations on devices, domains, features and disk maps."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import asof, translation_islands


def include_exclude(df: DataFrame, name: str, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Rows whose name holds any of `include` (all, if that is empty) and none of `exclude`."""
    anyof = lambda words: reduce(lambda a, b: a | b, (F.contains(F.col(name), F.lit(w)) for w in words))
    kept = df.where(anyof(include)) if include else df
    return kept.where(~anyof(exclude)) if exclude else kept


def pci_devices(nodes: DataFrame, bdf: str = "pci_bdf", handle: str = "handle") -> DataFrame:
    return nodes.where(F.col(bdf).isNotNull() & F.col(handle).isNotNull())


def remove_by(nodes: DataFrame, attribute: str, value, id_column: str = "id") -> tuple[DataFrame, DataFrame]:
    """(the first node with the value, all nodes but it); first is by id."""
    hit = nodes.where(F.col(attribute) == value).orderBy(id_column).limit(1)
    return hit, nodes.join(hit.select(id_column), id_column, "left_anti")


def remove_id(df: DataFrame, sections: Sequence[str], ident) -> DataFrame:
    """Documents without the element of that id in any of the array sections."""
    return df.withColumns({s: F.filter(s, lambda x: ~x["id"].eqNullSafe(F.lit(ident))) for s in sections})


def remove_range(df: DataFrame, key: str, low, high) -> DataFrame:
    """Rows whose key is not in [low, high]."""
    return df.where(~F.col(key).between(low, high))


def remove_listed(df: DataFrame, key: str, values: Sequence = (), ranges: Sequence[tuple] = ()) -> DataFrame:
    gone = reduce(lambda a, b: a | b, [F.col(key).between(a, b) for a, b in ranges], F.col(key).isin(*values))
    return df.where(~F.coalesce(gone, F.lit(False)))


def zone_mappings(mappings: DataFrame, zones: DataFrame, key: str = "zone_id") -> DataFrame:
    return mappings.join(zones, key)


def resolve_endpoints(requests: DataFrame, endpoints: DataFrame, domains: DataFrame, mappings: DataFrame, global_bypass: bool, msi: tuple[int, int] | None = None, width: int | None = None) -> DataFrame:
    """Requests (id, endpoint, addr, size) with `translated` and `problem`.

    An address in the MSI window [start, end] stays as it is. An endpoint's domain that bypasses, and for an endpoint
    without a domain the global bypass, keep the address; else it's translated in its domain. An endpoint with a domain
    that doesn't exist is a problem, as are one without a domain or bypass and an unmapped span."""
    chain = requests.join(endpoints, "endpoint", "left").join(domains.select("domain", "bypass"), "domain", "left")
    whole = translation_islands(mappings, ["domain"])
    found = asof(chain, whole.select("domain", F.col("iova").alias("__iova"), F.col("gpa").alias("__gpa"), F.col("size").alias("__len")), ["domain"], "addr", "__iova", ["__gpa", "__len"], width)
    mapped = F.when((F.col("size") > 0) & (F.col("addr") - F.col("__iova") + F.col("size") <= F.col("__len")), F.col("__gpa") + F.col("addr") - F.col("__iova"))
    same = F.col("domain").isNull() & F.lit(global_bypass) | F.coalesce(F.col("bypass"), F.lit(False))
    if msi:
        same = F.col("addr").between(*msi) | same
    problem = F.when(same, None).when(F.col("domain").isNull(), "no domain").when(F.col("bypass").isNull(), "unknown domain").when(mapped.isNull(), "unmapped")
    return found.select(*requests.columns, F.when(same, F.col("addr")).when(problem.isNull(), mapped).alias("translated"), problem.alias("problem"))


REGISTERS = ("eax", "ebx", "ecx", "edx")


def apply_patches(entries: DataFrame, patches: DataFrame, keys: Sequence[str] = ("function", "index")) -> DataFrame:
    """Entries with the bits of all patches of their key OR-ed in."""
    p = patches.groupBy(*keys).agg(*(F.bit_or(r).alias(f"__{r}") for r in REGISTERS))
    out = entries.join(p, list(keys), "left")
    return out.select(*keys, *(c for c in entries.columns if c not in (*keys, *REGISTERS)), *(F.col(r).bitwiseOR(F.coalesce(F.col(f"__{r}"), F.lit(0))).alias(r) for r in REGISTERS))


def adjust_registers(values: DataFrame, adjustments: DataFrame) -> DataFrame:
    """values: leaf, sub_leaf, register, value; adjustments: ord, leaf, low, high, register, mask, replacement.

    The first adjustment (by ord) whose sub-leaf range holds the value's gives (value AND mask) OR replacement; without
    one the value is 0."""
    a = adjustments.select("leaf", "register", "low", "high", F.struct("ord", "mask", "replacement").alias("a"))
    hit = values.join(a, ["leaf", "register"], "left").withColumn("a", F.when(F.col("sub_leaf").between(F.col("low"), F.col("high")), F.col("a")))
    best = hit.groupBy("leaf", "sub_leaf", "register", "value").agg(F.min("a").alias("a"))
    return best.select("leaf", "sub_leaf", "register", F.coalesce(F.col("value").bitwiseAND(F.col("a.mask")).bitwiseOR(F.col("a.replacement")), F.lit(0)).alias("value"))


def missing_replacements(adjustments: DataFrame, values: DataFrame) -> DataFrame:
    """Adjustments that replace something but match no value."""
    v = values.select("leaf", "register", F.col("sub_leaf").alias("__s")).distinct()
    return adjustments.where("replacement <> 0").join(v, (adjustments["leaf"] == v["leaf"]) & (adjustments["register"] == v["register"]) & v["__s"].between(adjustments["low"], adjustments["high"]), "left_anti")


#: Nodes of a system, whose pairs are all made.
MOST_NODES = 1024


def distance_matrix(nodes: DataFrame, distances: DataFrame, by: Sequence[str] = (), node: str = "node", local: int = 10, remote: int = 20) -> DataFrame:
    """All pairs of nodes of a system (by): the forward distance, else the reverse one, else the default.

    Without `by` all nodes are one system's; more than MOST_NODES are an error."""
    if not by and nodes.limit(MOST_NODES + 1).count() > MOST_NODES:
        raise ValueError(f"more than {MOST_NODES} nodes in one system")
    a = nodes.select(*by, F.col(node).alias("a"))
    b = nodes.select(*by, F.col(node).alias("b"))
    pairs = a.join(b, list(by)) if by else a.join(F.broadcast(b), F.lit(True))
    given = distances.groupBy(*by, "src", "dst").agg(F.min("distance").alias("d"))
    forward = given.select(*by, F.col("src").alias("a"), F.col("dst").alias("b"), F.col("d").alias("f"))
    back = given.select(*by, F.col("dst").alias("a"), F.col("src").alias("b"), F.col("d").alias("r"))
    out = pairs.join(forward, [*by, "a", "b"], "left").join(back, [*by, "a", "b"], "left")
    return out.select(*by, "a", "b", F.when(F.col("a") == F.col("b"), local).otherwise(F.coalesce("f", "r", F.lit(remote))).alias("distance"))


def dependents(edges: DataFrame, packages: DataFrame) -> DataFrame:
    """edges: id, dep_id; packages: id, name, version. Who depends on which package, by name."""
    a = packages.select(F.col("id"), F.col("name").alias("dependent"))
    b = packages.select(F.col("id").alias("dep_id"), F.col("name").alias("package"), "version")
    return edges.join(a, "id").join(b, "dep_id").select("package", "version", "dependent")


#: Files behind files, at most.
MAX_CHAIN = 10


def resolve_layers(clusters: DataFrame, layers: DataFrame, depth: int, key: str = "cluster") -> DataFrame:
    """For every cluster the first layer (0 on top) that says something: key, layer, kind, address; 'hole' if none does.

    layers: layer, key, kind (compressed, zero, standard, empty), address. An empty entry goes on to the layer behind it."""
    if depth > MAX_CHAIN:
        raise ValueError(f"more than {MAX_CHAIN} files behind one another")
    say = layers.where((F.col("kind") != "empty") & (F.col("layer") <= depth)).groupBy(key).agg(F.min(F.struct("layer", "kind", "address")).alias("s"))
    return clusters.select(key).distinct().join(say, key, "left").select(key, F.col("s.layer").alias("layer"), F.coalesce("s.kind", F.lit("hole")).alias("kind"), F.col("s.address").alias("address"))


def page_faults(faults: DataFrame, ranges: DataFrame, by: Sequence[str], page_size: int, width: int | None = None) -> DataFrame:
    """Faults (addr) with the range's base and the index of the page in it; null outside all ranges."""
    masked = faults.withColumn("page_addr", F.col("addr") - F.pmod(F.col("addr"), F.lit(page_size)))
    found = asof(masked, ranges.select(*by, F.col("base").alias("__b"), F.col("length").alias("__l")), by, "page_addr", "__b", ["__l"], width)
    inside = F.col("page_addr") - F.col("__b") < F.col("__l")
    return found.select(*masked.columns, F.when(inside, F.col("__b")).alias("base"), F.when(inside, F.floor((F.col("page_addr") - F.col("__b")) / page_size)).cast("bigint").alias("page"))


def assemble_numa(nodes: DataFrame, zones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node with zones resolved to regions, violations). nodes: node, cpus, distances, memory_zones, pci_segments; zones: zone, regions.

    Violations: node, problem - an unknown zone or distance destination, a repeated node or destination."""
    named = nodes.select("node", F.explode("memory_zones").alias("zone")).join(zones, "zone", "left")
    regions = named.groupBy("node").agg(F.flatten(F.array_sort(F.collect_list("regions"))).alias("regions"))
    out = nodes.join(regions, "node", "left")
    d = nodes.select("node", F.explode("distances").alias("d")).select("node", F.col("d.destination").alias("destination"))
    problems = [
        named.where("regions IS NULL").select("node", F.lit("unknown zone").alias("problem")),
        d.join(nodes.select(F.col("node").alias("destination")), "destination", "left_anti").select("node", F.lit("unknown destination").alias("problem")),
        d.groupBy("node", "destination").count().where("count > 1").select("node", F.lit("repeated destination").alias("problem")),
        nodes.groupBy("node").count().where("count > 1").select("node", F.lit("repeated node").alias("problem")),
    ]
    return out, reduce(DataFrame.unionByName, problems).distinct()


# order, first, sets


def sorted_distinct(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.dropDuplicates(list(keys)).orderBy(*keys)


def first_match(df: DataFrame, condition: Column, order: Sequence[str]) -> DataFrame:
    return df.where(condition).orderBy(*order).limit(1)


def kill_queue(connections: DataFrame, order: str, kill_time: str, size: int = 128) -> tuple[DataFrame, Column]:
    """The expiring connections that a bounded queue takes (the first `size` in scan order, not the earliest), by kill time."""
    return connections.where(F.col(kill_time).isNotNull()).orderBy(order).limit(size).orderBy(kill_time), F.lit(size)


def missing(required: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """Keys that are required but not there, each once."""
    return required.select(key).distinct().join(there, key, "left_anti")


def profile_keys(index: DataFrame, required: DataFrame, adjusted: DataFrame, key: str) -> DataFrame:
    """(index ∩ required) ∪ adjusted, each once, in order."""
    return index.select(key).join(required, key, "left_semi").union(adjusted.select(key)).distinct().orderBy(key)


def all_flags(df: DataFrame, by: Sequence[str], flags: str) -> DataFrame:
    return df.groupBy(*by).agg(F.bit_or(flags).alias(flags))


def latest(df: DataFrame, by: Sequence[str], order: str, valid: Column | None = None) -> DataFrame:
    """The latest valid row of every key."""
    rows = df if valid is None else df.where(valid)
    return rows.groupBy(*by).agg(F.max_by(F.struct(*df.columns), F.col(order)).alias("r")).select("r.*")


def latest_matches(df: DataFrame, by: Sequence[str], order: str, value: str, expected: Sequence[str]) -> DataFrame:
    """by, matched: whether the last len(expected) values are just those, in order."""
    w = Window.partitionBy(*by).orderBy(F.col(order).desc())
    last = df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= len(expected))
    got = last.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("__r")).alias("r"), F.col(value).alias("v")))), lambda x: x["v"]).alias("g"))
    return got.select(*by, F.coalesce(F.col("g") == F.array(*map(F.lit, expected)), F.lit(False)).alias("matched"))

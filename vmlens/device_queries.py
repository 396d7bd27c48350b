"""Queries of device filters, zone and domain joins, option and configuration rules, trees and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import options
from .operators import aggregates, graph, lookups, ranges, rules
from .plans import migration
from .registry import query, table


def _name(prefix, column):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


@query("SELECT c_custkey, c_nationkey AS bdf FROM customer WHERE c_custkey % 3 > 0 AND c_nationkey % 4 > 0")
def pci_nodes(spark, sf_dir):
    nodes = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 4 > 0, F.col("c_nationkey")).alias("pci_bdf"), F.when(F.col("c_custkey") % 3 > 0, "h").alias("handle"))
    return lookups.pci_devices(nodes).select("c_custkey", F.col("pci_bdf").alias("bdf"))


@query("""SELECT c_custkey AS id, 'removed' AS what FROM customer WHERE c_custkey = (SELECT min(c_custkey) FROM customer WHERE c_nationkey = 7)
UNION ALL SELECT c_custkey, 'left' FROM customer WHERE c_custkey <> (SELECT min(c_custkey) FROM customer WHERE c_nationkey = 7)""")
def point_removal(spark, sf_dir):
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("bdf"))
    hit, rest = lookups.remove_by(nodes, "bdf", 7)
    return hit.select("id", F.lit("removed").alias("what")).union(rest.select("id", F.lit("left")))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 1 THEN 1 ELSE 2 END AS disks, CASE WHEN n_nationkey % 5 = 1 THEN 0 ELSE 1 END AS nets FROM nation""")
def section_removal(spark, sf_dir):
    device = lambda c: F.struct(c.alias("id"))
    n = F.col("n_nationkey")
    docs = table(spark, sf_dir, "nation").select("n_nationkey", F.array(device(F.concat(F.lit("d"), (n % 3).cast("string"))), device(F.lit("x"))).alias("disks"), F.array(device(F.concat(F.lit("d"), (n % 5).cast("string")))).alias("nets"))
    return lookups.remove_id(docs, ["disks", "nets"], "d1").select("n_nationkey", F.size("disks").alias("disks"), F.size("nets").alias("nets"))


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderkey BETWEEN 100 AND 299) AND o_orderkey NOT IN (5, 7) AND NOT (o_orderkey BETWEEN 500 AND 600)")
def range_and_list_removal(spark, sf_dir):
    keys = lookups.remove_range(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 100, 299)
    return lookups.remove_listed(keys, "o_orderkey", [5, 7], [(500, 600)])


@query("SELECT c_custkey AS slot, 'z' || c_nationkey AS zone_id, n_regionkey AS host_node FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 4 > 0")
def zone_joins(spark, sf_dir):
    mappings = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("slot"), _name("z", "c_nationkey").alias("zone_id"))
    zones = table(spark, sf_dir, "nation").where("n_nationkey % 4 > 0").select(_name("z", "n_nationkey").alias("zone_id"), F.col("n_regionkey").alias("host_node"))
    return lookups.zone_mappings(mappings, zones).select("slot", "zone_id", "host_node")


def _chain_sql(bypass: bool, msi: bool) -> str:
    same = f"(e.domain IS NULL AND {bypass}) OR coalesce(d.bypass, false)" + (" OR q.addr BETWEEN 4000 AND 4095" if msi else "")
    return f"""WITH q AS (SELECT o_orderkey AS id, o_custkey % 20 AS endpoint, o_orderkey * 37 % 30000 AS addr, 4 AS size FROM orders),
e AS (SELECT n_nationkey AS endpoint, CASE WHEN n_nationkey % 4 > 0 THEN n_nationkey % 6 END AS domain FROM nation WHERE n_nationkey < 18), d AS (SELECT r_regionkey AS domain, r_regionkey % 2 = 1 AS bypass FROM region),
m AS (SELECT n_regionkey AS domain, n_nationkey * 1000 AS iova, n_nationkey * 1000 + 700000 + n_regionkey AS gpa, 600 AS size FROM nation)
SELECT q.id, CAST(CASE WHEN {same} THEN q.addr ELSE m.gpa + q.addr - m.iova END AS BIGINT) AS translated, CASE WHEN {same} THEN NULL WHEN e.domain IS NULL THEN 'no domain' WHEN d.domain IS NULL THEN 'unknown domain' WHEN m.gpa IS NULL THEN 'unmapped' END AS problem
FROM q LEFT JOIN e USING (endpoint) LEFT JOIN d ON d.domain = e.domain LEFT JOIN m ON m.domain = d.domain AND q.addr >= m.iova AND q.addr + q.size <= m.iova + m.size"""


def _chain(spark, sf_dir, bypass, msi):
    o, n = F.col("o_orderkey"), F.col("n_nationkey").cast("bigint")
    asked = table(spark, sf_dir, "orders").select(o.alias("id"), (F.col("o_custkey") % 20).cast("int").alias("endpoint"), (o * 37 % 30000).alias("addr"), F.lit(4).cast("bigint").alias("size"))
    nation = table(spark, sf_dir, "nation")
    ends = nation.where("n_nationkey < 18").select(F.col("n_nationkey").cast("int").alias("endpoint"), F.when(n % 4 > 0, n % 6).cast("int").alias("domain"))
    domains = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("domain"), (F.col("r_regionkey") % 2 == 1).alias("bypass"))
    held = nation.select(F.col("n_regionkey").cast("int").alias("domain"), (n * 1000).alias("iova"), (n * 1000 + 700000 + F.col("n_regionkey")).alias("gpa"), F.lit(600).cast("bigint").alias("size"))
    return lookups.resolve_endpoints(asked, ends, domains, held, bypass, msi, width=4096).select("id", "translated", "problem")


@query(_chain_sql(True, False))
def endpoint_chain(spark, sf_dir):
    return _chain(spark, sf_dir, True, None)


@query(_chain_sql(False, True))
def endpoint_chain_msi(spark, sf_dir):
    return _chain(spark, sf_dir, False, (4000, 4095))


@query("""WITH a AS (SELECT n_nationkey AS ord, n_nationkey % 9 AS leaf, 'eax' AS register, n_regionkey AS low, n_regionkey + 1 AS high, n_nationkey % 2 AS replacement FROM nation),
v AS (SELECT DISTINCT c_custkey % 5 AS leaf, c_custkey % 4 AS sub_leaf FROM customer) SELECT ord, leaf, low, high FROM a WHERE replacement <> 0 AND NOT EXISTS (SELECT 1 FROM v WHERE v.leaf = a.leaf AND sub_leaf BETWEEN low AND high)""")
def unmatched_adjustments(spark, sf_dir):
    n = F.col("n_nationkey")
    adjustments = table(spark, sf_dir, "nation").select(n.alias("ord"), (n % 9).cast("bigint").alias("leaf"), F.lit("eax").alias("register"), F.col("n_regionkey").alias("low"), (F.col("n_regionkey") + 1).alias("high"), (n % 2).alias("replacement"))
    values = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 5).alias("leaf"), F.lit("eax").alias("register"), (F.col("c_custkey") % 4).alias("sub_leaf"))
    return lookups.missing_replacements(adjustments, values).select("ord", "leaf", "low", "high")


@query("""WITH r AS (SELECT o_custkey AS cluster FROM orders UNION ALL SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT s_suppkey + 100000 FROM supplier)
SELECT coalesce(c_custkey, cluster) AS cluster, count(cluster) AS n, CASE WHEN any_value(c_custkey) IS NULL THEN 'out of range' WHEN count(cluster) > 12 THEN 'overflow' END AS problem
FROM r FULL JOIN customer ON cluster = c_custkey GROUP BY coalesce(c_custkey, cluster)""")
def reference_union(spark, sf_dir):
    """References of three tables together, as level-1, level-2 and refcount tables refer to clusters."""
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cluster"))
    refs = [table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cluster")), customer.where("cluster % 2 = 0"), table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 100_000).alias("cluster"))]
    return aggregates.reference_counts(refs, customer, "cluster", 12)


@query("""SELECT n_nationkey AS node, CASE WHEN n_nationkey % 7 <= 4 THEN list_sort([n_regionkey, n_nationkey % 7]) ELSE [n_regionkey] END AS regions FROM nation""")
def numa_regions(spark, sf_dir):
    zone = lambda c: F.concat(F.lit("z"), c.cast("string"))
    n = F.col("n_nationkey")
    nodes = table(spark, sf_dir, "nation").select(n.alias("node"), F.array(zone(F.col("n_regionkey")), zone(n % 7)).alias("memory_zones"), F.array(F.struct((n + 1).alias("destination"))).alias("distances"))
    zones = table(spark, sf_dir, "region").select(zone(F.col("r_regionkey")).alias("zone"), F.array("r_regionkey").alias("regions"))
    return lookups.assemble_numa(nodes, zones)[0].select("node", F.array_sort("regions").alias("regions"))


@query("""SELECT n_nationkey AS region_id, n_nationkey * 1000 AS gpa, 1000 AS length, unnest(CASE WHEN n_nationkey % 2 = 0 THEN ['full'] ELSE ['full', 'skip_persisted'] END) AS policy FROM nation""")
def whole_policy_ranges(spark, sf_dir):
    n = F.col("n_nationkey")
    regions = table(spark, sf_dir, "nation").select(n.alias("region_id"), (n.cast("bigint") * 1000).alias("gpa"), F.lit(1000).cast("bigint").alias("length"), (n % 2 == 0).alias("persisted"))
    none = regions.select("region_id", "gpa", "length").limit(0)
    return rules.violations([ranges.policy_ranges(regions, none, x, 1000).withColumn("policy", F.lit(x)) for x in ("full", "skip_persisted")])


@query("SELECT DISTINCT o_custkey FROM orders")
def sorted_keys(spark, sf_dir):
    return lookups.sorted_distinct(table(spark, sf_dir, "orders").select("o_custkey"), ["o_custkey"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 100000 ORDER BY o_custkey, o_orderkey LIMIT 1")
def first_device(spark, sf_dir):
    return lookups.first_match(table(spark, sf_dir, "orders"), F.col("o_totalprice") > 100_000, ["o_custkey", "o_orderkey"]).select("o_orderkey", "o_custkey")


@query("""SELECT user_id, min(event_id) AS iteration, min_by(d, event_id) AS decision FROM (SELECT user_id, event_id, CASE WHEN event_id % 90 = 0 THEN 'done' WHEN event_id % 700 <= 3 THEN 'fits' WHEN event_id % 40 * 100 >= 3600 THEN 'timeout' END AS d FROM events) WHERE d IS NOT NULL GROUP BY user_id""")
def convergence_ignoring_timeouts(spark, sf_dir):
    i = F.col("event_id")
    rounds = table(spark, sf_dir, "events").select("user_id", "event_id", (i % 90).alias("num_bytes"), (i % 700 / 10).alias("est_downtime_s"), (i % 40 * 100).alias("elapsed_s"))
    return migration.convergence(migration.decisions(rounds, "num_bytes", "elapsed_s", on_timeout="ignore"), ["user_id"], "event_id")


@query("""WITH p AS (SELECT p_partkey AS id, p_partkey % 3 = 0 AS sock, p_partkey % 2 = 0 AS pth, p_partkey % 5 = 0 AS vu, p_partkey % 7 > 0 AS shared, CASE p_partkey % 6 WHEN 5 THEN 4294967295 ELSE p_partkey % 6 END AS cid, p_size AS balloon, p_partkey % 60 AS ram,
p_partkey % 4 AS v FROM part)
SELECT 'socket_and_path' AS rule, CAST(id AS VARCHAR) AS id, '' AS detail FROM p WHERE sock AND pth UNION ALL SELECT 'shared_memory', CAST(id AS VARCHAR), '' FROM p WHERE vu AND NOT shared
UNION ALL SELECT 'socket_needed', CAST(id AS VARCHAR), '' FROM p WHERE vu AND NOT sock UNION ALL SELECT 'special_cid', CAST(id AS VARCHAR), CAST(cid AS VARCHAR) FROM p WHERE cid IN (0, 1, 2, 4294967295)
UNION ALL SELECT 'balloon_larger_than_ram', CAST(id AS VARCHAR), '' FROM p WHERE balloon >= ram UNION ALL SELECT 'version', CAST(id AS VARCHAR), '' FROM p WHERE v NOT IN (1, 2)""")
def device_rules(spark, sf_dir):
    key = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(key.alias("id"), F.when(key % 3 == 0, "s").alias("socket"), F.when(key % 2 == 0, "p").alias("path"), (key % 5 == 0).alias("vhost_user"), F.when(key % 7 > 0, True).alias("shared"), F.when(key % 6 == 5, 0xFFFF_FFFF).otherwise(key % 6).alias("cid"), F.col("p_size").alias("balloon"), (key % 60).alias("ram"), (key % 4).alias("v"))
    checks = {"socket_and_path": rules.both_set("socket", "path"), "shared_memory": rules.needs("vhost_user", F.col("shared")), "socket_needed": rules.needs("vhost_user", F.col("socket").isNotNull()), "balloon_larger_than_ram": F.col("balloon") >= F.col("ram"), "version": ~rules.version_supported(F.col("v"), 2)}
    return rules.violations([*(rules.condition(p, broken, "id", name=what) for what, broken in checks.items()), rules.condition(p, rules.special_cid("cid"), "id", F.col("cid"), "special_cid")])


@query("""WITH n AS (SELECT p_partkey AS id, p_partkey % 4 AS d, p_partkey // 4 % 3 AS c, p_partkey // 12 % 3 AS z FROM part)
SELECT id, CASE WHEN d > 1 AND (c > 0 OR z > 0) THEN 'device_id excludes cpus and memory_zones' WHEN d <= 1 AND c = 0 AND z = 0 THEN 'neither device_id nor cpus or memory_zones' WHEN d = 2 THEN 'device_id is empty'
WHEN c = 1 THEN 'cpus is empty' WHEN c = 0 AND z = 1 THEN 'memory_zones is empty' END AS problem FROM n""")
def numa_node_modes(spark, sf_dir):
    k = F.col("p_partkey")
    empty = lambda kind: F.array().cast(kind)
    device = F.when(k % 4 == 2, "").when(k % 4 == 3, "gpu")
    cpus = F.when(F.floor(k / 4) % 3 == 1, empty("array<int>")).when(F.floor(k / 4) % 3 == 2, F.array(F.lit(1)))
    zones = F.when(F.floor(k / 12) % 3 == 1, empty("array<string>")).when(F.floor(k / 12) % 3 == 2, F.array(F.lit("z")))
    return table(spark, sf_dir, "part").select(k.alias("id"), rules.numa_node_problem(device, cpus, zones).alias("problem"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 1 AND n_nationkey % 3 = 0 THEN 'error: nodes without zones' WHEN n_nationkey % 2 = 1 AND n_nationkey % 5 = 0 THEN 'nodes, zones hotplugged' WHEN n_nationkey % 2 = 1 THEN 'nodes' WHEN n_nationkey % 3 > 0 THEN 'zones' ELSE 'flat' END AS mode FROM nation")
def memory_modes(spark, sf_dir):
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select("n_nationkey", rules.numa_mode(n % 2 == 1, n % 3 > 0, n % 5 == 0).alias("mode"))


@query("""WITH c AS (SELECT c_custkey AS leaf, 'e' || c_custkey % 2 AS register, CASE c_custkey % 3 WHEN 0 THEN 'subset' WHEN 1 THEN 'equal' ELSE 'not_greater' END AS kind, coalesce(CASE WHEN c_custkey % 11 > 0 THEN c_custkey % 8 END, 0) AS s,
coalesce(CASE WHEN c_custkey % 13 > 0 THEN c_nationkey % 8 END, 0) AS t FROM customer)
SELECT 'feature_compatibility' AS rule, leaf || '/' || register AS id, kind || ' ' || s || ' ' || t AS detail FROM c WHERE NOT CASE kind WHEN 'subset' THEN (s & ~t) = 0 WHEN 'equal' THEN s = t ELSE s <= t END""")
def feature_kinds(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k.alias("leaf"), F.concat(F.lit("e"), (k % 2).cast("string")).alias("register"), (k % 8).alias("s"), (F.col("c_nationkey") % 8).cast("bigint").alias("t"))
    kinds = F.element_at(F.array(F.lit("subset"), F.lit("equal"), F.lit("not_greater")), (F.col("leaf") % 3 + 1).cast("int"))
    side = lambda v, gap: c.where(F.col("leaf") % gap > 0).select("leaf", "register", F.col(v).alias("value"))
    return rules.feature_compatibility(side("s", 11), side("t", 13), c.select("leaf", "register", kinds.alias("kind")))


@query("""WITH s AS (SELECT user_id, event_id, ['Begin', 'VmPaused', 'Completed'][1 + event_id % 3] AS s FROM events), l AS (SELECT *, lag(s) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM s)
SELECT 'migration_order' AS rule, user_id || '/' || event_id AS id, p || '->' || s AS detail FROM l WHERE p IS NOT NULL AND NOT (p = 'Begin' AND s = 'VmPaused') AND NOT (p = 'VmPaused' AND s = 'Completed')""")
def migration_order(spark, sf_dir):
    states = F.element_at(F.array(F.lit("Begin"), F.lit("VmPaused"), F.lit("Completed")), (F.col("event_id") % 3 + 1).cast("int"))
    steps = table(spark, sf_dir, "events").select("user_id", "event_id", states.alias("state"))
    return rules.transitions(steps, ["user_id"], "event_id", "state", rules.MIGRATION_TRANSITIONS, "migration_order")


@query("""SELECT 'c' || c_custkey AS id, 2 AS depth, ['r' || n_regionkey, 'n' || n_nationkey, 'c' || c_custkey] AS path FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'n' || n_nationkey, 1, ['r' || n_regionkey, 'n' || n_nationkey] FROM nation UNION ALL SELECT 'r' || r_regionkey, 0, ['r' || r_regionkey] FROM region""")
def reverse_hierarchy(spark, sf_dir):
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    nodes = table(spark, sf_dir, "region").select(_name("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"))
    nodes = nodes.union(nation.select(_name("n", "n_nationkey"), _name("r", "n_regionkey"))).union(customer.select(_name("c", "c_custkey"), _name("n", "c_nationkey")))
    edges = nodes.where("parent IS NOT NULL").select("parent", F.xxhash64("id").alias("ord"), F.col("id").alias("child"))
    return graph.breadth_first(nodes, edges, reverse=True)


@query("SELECT o_orderkey AS vcpus, o_orderpriority AS kind FROM orders WHERE o_custkey = 7")
def snapshot_states(spark, sf_dir):
    data = F.to_json(F.struct(F.col("o_orderkey").alias("vcpus"), F.col("o_orderpriority").alias("kind"), F.lit(1).alias("rest")))
    snapshots = table(spark, sf_dir, "orders").select(F.array(F.lit("vm"), F.lit("cpu-manager"), _name("c", "o_custkey")).alias("path"), data.alias("data"))
    return graph.snapshot_state(snapshots, ["vm", "cpu-manager", "c7"], "vcpus bigint, kind string").select("state.*")


@query("""SELECT o_orderkey, CAST(o_orderkey % 64 * 1048576 AS BIGINT) AS size, o_orderkey % 2 = 0 AS shared, 'z' || o_custkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 8 END AS host_numa_node FROM orders""")
def memory_zone_options(spark, sf_dir):
    given = F.concat(_name("id=z", "o_custkey"), F.lit(",size="), (F.col("o_orderkey") % 64).cast("string"), F.lit("M,shared="), F.when(F.col("o_orderkey") % 2 == 0, "on").otherwise("off"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(",host_numa_node="), (F.col("o_custkey") % 8).cast("string"))).otherwise(""))
    o = table(spark, sf_dir, "orders").select("o_orderkey", options.typed_section("memory-zone", given).alias("o"))
    return o.select("o_orderkey", "o.size", "o.shared", "o.id", "o.host_numa_node")

"""Driver-facing queries of the telemetry and range operators, each with the equivalent DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import numbers, options, text
from .operators import aggregates, graph, lookups, ranges, rules, sequences
from .plans import migration
from .registry import _QUERIES, _SQL, query, table
from .sources import telemetry

DAY = 86_400


def _events(spark, sf_dir, *columns):
    return table(spark, sf_dir, "events").select("event_id", "user_id", *columns)


def _cents():
    return F.round(F.col("value") * 100).cast("bigint").alias("cents")


@query("SELECT event_type, count(*) AS n, min(value) AS min_value, max(value) AS max_value, round(avg(value), 6) AS avg_value FROM events GROUP BY event_type")
def counters_by_event(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), aggregates.smallest("value").alias("min_value"), aggregates.largest("value").alias("max_value"), F.round(F.avg("value"), 6).alias("avg_value"))


@query("""SELECT user_id, CASE WHEN count(v) > 0 THEN round(avg(v) * 1000, 4) ELSE 0 END AS mean, CASE WHEN count(v) > 0 THEN round(stddev_pop(v) * 1000, 4) ELSE 0 END AS std_dev,
CASE WHEN count(v) > 0 THEN round(max(v) * 1000, 4) ELSE 0 END AS max, CASE WHEN count(v) > 0 THEN round(min(v) * 1000, 4) ELSE 0 END AS min, CASE WHEN count(v) > 0 THEN 'PASSED' ELSE 'FAILED' END AS status
FROM (SELECT user_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 2 THEN value END AS v FROM events) GROUP BY user_id""")
def bench_summary(spark, sf_dir):
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    runs = _events(spark, sf_dir, "value").withColumn("iteration", order).withColumn("adjuster", F.lit("s_to_ms"))
    out = aggregates.benchmark_summary(runs, ["user_id"], "iteration", "value", warmup=2, adjuster="adjuster")
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std_dev", "max", "min")})


@query("""WITH RECURSIVE o AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r, CAST(round(value * 100) AS BIGINT) AS v FROM events),
a AS (SELECT event_type, r, v * 10000 AS s FROM o WHERE r = 1
  UNION ALL SELECT o.event_type, o.r, a.s + CAST(trunc((CAST(o.v AS HUGEINT) * 10000 - a.s) // o.r) AS BIGINT) FROM a JOIN o ON o.event_type = a.event_type AND o.r = a.r + 1)
SELECT event_type, CAST(s // 10000 AS BIGINT) AS average FROM a WHERE (event_type, r) IN (SELECT event_type, max(r) FROM o GROUP BY event_type)""")
def cumulative_avg_int(spark, sf_dir):
    return aggregates.cumulative_average(_events(spark, sf_dir, "event_type", _cents()), ["event_type"], ["event_id"], "cents")


def _counters_sql(rows: str) -> str:
    """Request counters of `rows` (device_id, o, d, b, lat, fine); the average by recursion over the requests in order."""
    return f"""WITH RECURSIVE q AS ({rows}), f AS (SELECT device_id, d, b, lat, row_number() OVER (PARTITION BY device_id, d ORDER BY o) AS r FROM q WHERE fine AND d IS NOT NULL),
a AS (SELECT device_id, d, r, CAST(lat * 10000 AS BIGINT) AS s FROM f WHERE r = 1
  UNION ALL SELECT f.device_id, f.d, f.r, a.s + CAST(trunc((CAST(f.lat AS HUGEINT) * 10000 - a.s) // f.r) AS BIGINT) FROM a JOIN f ON f.device_id = a.device_id AND f.d = a.d AND f.r = a.r + 1),
m AS (SELECT device_id, d, CAST(arg_max(s, r) // 10000 AS BIGINT) AS mean FROM a GROUP BY 1, 2),
g AS (SELECT device_id, d, sum(b) AS b, count(*) AS n, min(lat) AS lo, max(lat) AS hi FROM f GROUP BY 1, 2),
w AS (SELECT x.device_id, y.d, coalesce(b, 0) AS b, coalesce(n, 0) AS n, lo, hi, mean FROM (SELECT DISTINCT device_id FROM q) x CROSS JOIN (VALUES ('read'), ('write')) y(d) LEFT JOIN g USING (device_id, d) LEFT JOIN m USING (device_id, d))
SELECT device_id, d || '_bytes' AS counter, CAST(b AS BIGINT) AS value FROM w UNION ALL SELECT device_id, d || '_ops', n FROM w UNION ALL SELECT device_id, d || '_latency_min', lo FROM w WHERE n > 0
UNION ALL SELECT device_id, d || '_latency_max', hi FROM w WHERE n > 0 UNION ALL SELECT device_id, d || '_latency_avg', mean FROM w WHERE n > 0"""


@query(_counters_sql("""SELECT 'd' || user_id % 7 AS device_id, event_id AS o, CASE event_type WHEN 'view' THEN 'read' WHEN 'purchase' THEN 'write' END AS d, CAST(round(value * 100) AS BIGINT) AS b,
CAST(event_id % 1000 AS BIGINT) AS lat, event_type <> 'error' AS fine FROM events"""))
def device_counters(spark, sf_dir):
    d = F.when(F.col("event_type") == "view", "read").when(F.col("event_type") == "purchase", "write")
    rows = _events(spark, sf_dir, "event_type", _cents()).select("event_id", F.concat(F.lit("d"), (F.col("user_id") % 7).cast("string")).alias("device_id"), d.alias("direction"), F.col("cents").alias("bytes"), (F.col("event_id") % 1000).alias("latency_us"), F.when(F.col("event_type") == "error", -1).otherwise(0).alias("result"))
    return aggregates.request_counters(rows, ["device_id"], ["event_id"])


@query("SELECT o.o_orderpriority AS priority, round(sum(l_extendedprice * (1 - l_discount)) / sum(l_extendedprice), 6) AS kept_ratio, count(*) AS n FROM orders o JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def net_loss_ratio(spark, sf_dir):
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    kept = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / F.sum("l_extendedprice")
    return joined.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.round(kept, 6).alias("kept_ratio"), F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS k_max FROM events GROUP BY 1")
def json_props(spark, sf_dir):
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("k_sum"), F.max(k).alias("k_max"))


@query("SELECT p_partkey, p_name FROM part WHERE (contains(p_name, 'an') OR contains(p_name, 'e')) AND NOT contains(p_name, 'b')")
def include_exclude_filter(spark, sf_dir):
    return lookups.include_exclude(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", ["an", "e"], ["b"])


@query("""SELECT user_id, min(d) AS first, count(*) AS n FROM (SELECT user_id, d, d - row_number() OVER (PARTITION BY user_id ORDER BY d) AS g
FROM (SELECT DISTINCT user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS d FROM events)) GROUP BY user_id, g""")
def day_islands(spark, sf_dir):
    return ranges.islands(_events(spark, sf_dir, F.floor(F.unix_timestamp("ts") / DAY).cast("bigint").alias("day")), ["user_id"], "day")


@query("""SELECT user_id, min(d) AS start, count(*) AS length FROM (SELECT user_id, d, d - row_number() OVER (PARTITION BY user_id ORDER BY d) AS g
FROM (SELECT DISTINCT user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS d FROM events)) GROUP BY user_id, g""")
def adjacent_days(spark, sf_dir):
    days = _events(spark, sf_dir, F.floor(F.unix_timestamp("ts") / DAY).cast("bigint").alias("start")).select("user_id", "start", F.lit(1).cast("bigint").alias("length")).distinct()
    return ranges.merge_adjacent(days, ["user_id"], "start", "length")


@query("""SELECT user_id, run, event_type, count(*) AS n FROM (SELECT user_id, event_type, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS run
FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS c FROM events)) GROUP BY 1, 2, 3""")
def run_length_types(spark, sf_dir):
    return ranges.runs(_events(spark, sf_dir, "event_type"), ["user_id"], ["event_id"], ["event_type"])


@query("SELECT user_id, event_id, CAST(round(value * 100) AS BIGINT) AS cents, CAST(coalesce(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_cents FROM events")
def running_offset(spark, sf_dir):
    return ranges.running_offset(_events(spark, sf_dir, _cents()), ["user_id"], ["event_id"], "cents", "offset_cents").select("user_id", "event_id", "cents", "offset_cents")


@query("""WITH o AS (SELECT o_custkey, o_orderkey AS gpa, 1 + o_orderkey % 9 AS len FROM orders),
a AS (SELECT *, CAST(coalesce(sum(len) OVER (PARTITION BY o_custkey ORDER BY gpa DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a FROM o),
c AS (SELECT *, unnest(generate_series(a // 10, (a + len - 1) // 10)) AS chunk FROM a)
SELECT o_custkey, chunk, gpa + len - (least(a + len, (chunk + 1) * 10) - a) AS gpa, least(a + len, (chunk + 1) * 10) - greatest(a, chunk * 10) AS length FROM c""")
def chunk_partition(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("gpa"), (1 + F.col("o_orderkey") % 9).alias("length"))
    return ranges.chunks(rows, ["o_custkey"], ["gpa"], "gpa", "length", 10)


@query("SELECT user_id, event_id, value, previous FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events) WHERE previous > value")
def monotonic_violations(spark, sf_dir):
    return sequences.unsorted(_events(spark, sf_dir, "value"), ["user_id"], "event_id", "value").select("user_id", "event_id", "value", "previous")


@query("""WITH a AS (SELECT user_id, min(event_id) AS i FROM events WHERE event_type = 'signup' GROUP BY 1),
b AS (SELECT e.user_id, min(event_id) AS i FROM events e JOIN a ON e.user_id = a.user_id AND event_id > a.i WHERE event_type = 'view' GROUP BY 1),
c AS (SELECT e.user_id, min(event_id) AS i FROM events e JOIN b ON e.user_id = b.user_id AND event_id > b.i WHERE event_type = 'purchase' GROUP BY 1)
SELECT u.user_id, c.i IS NOT NULL AS matched, CAST((a.i IS NOT NULL) AS INT) + CAST((b.i IS NOT NULL) AS INT) + CAST((c.i IS NOT NULL) AS INT) AS n_matched
FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN a USING (user_id) LEFT JOIN b USING (user_id) LEFT JOIN c USING (user_id)""")
def subsequence_match(spark, sf_dir):
    return sequences.subsequence_match(_events(spark, sf_dir, "event_type"), ["user_id"], ["event_id"], "event_type", [("signup", None), ("view", None), ("purchase", None)])


@query("""SELECT user_id, coalesce(list(event_type ORDER BY event_id) = ['view', 'click'], false) AS matched FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 2 GROUP BY 1""")
def latest_n_exact(spark, sf_dir):
    return lookups.latest_matches(_events(spark, sf_dir, "event_type"), ["user_id"], "event_id", "event_type", ["view", "click"])


@query("""WITH o AS (SELECT DISTINCT o_custkey % 50 AS k, CAST(epoch(o_orderdate) AS BIGINT) AS base FROM orders),
e AS (SELECT event_id, user_id % 50 AS k, CAST(epoch(date_trunc('second', ts)) AS BIGINT) - 86400 * 365 * (26 + event_id % 6) AS asked_at FROM events)
SELECT e.event_id, e.k, e.asked_at AS "at", o.base FROM e ASOF LEFT JOIN o ON e.k = o.k AND e.asked_at >= o.base""")
def asof_lookup(spark, sf_dir):
    bases = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("k"), F.unix_timestamp("o_orderdate").alias("base")).distinct()
    asked = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 50).alias("k"), (F.unix_timestamp("ts") - DAY * 365 * (26 + F.col("event_id") % 6)).alias("at"))
    return ranges.asof(asked, bases, ["k"], "at", "base", [], 90 * DAY).select("event_id", "k", "at", "base")


@query("""WITH o AS (SELECT DISTINCT o_custkey % 50 AS k, CAST(epoch(o_orderdate) AS BIGINT) AS base FROM orders),
e AS (SELECT event_id, user_id % 50 AS k, CAST(epoch(date_trunc('second', ts)) AS BIGINT) - 86400 * 365 * (26 + event_id % 6) AS asked_at FROM events),
f AS (SELECT e.event_id, e.asked_at, o.base FROM e ASOF LEFT JOIN o ON e.k = o.k AND e.asked_at >= o.base)
SELECT event_id, CASE WHEN asked_at - base < 864000 THEN base END AS base, CASE WHEN asked_at - base < 864000 THEN asked_at - base END AS "offset" FROM f""")
def containment_lookup(spark, sf_dir):
    bases = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("k"), F.unix_timestamp("o_orderdate").alias("base")).distinct().withColumn("len", F.lit(10 * DAY).cast("bigint"))
    asked = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 50).alias("k"), (F.unix_timestamp("ts") - DAY * 365 * (26 + F.col("event_id") % 6)).alias("at"))
    return ranges.resolve(asked, bases, ["k"], "at", "base", "len", width=90 * DAY).select("event_id", "base", "offset")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, CAST(epoch(o_orderdate) // 86400 AS BIGINT) AS d FROM orders)
SELECT a.o_custkey, a.o_orderkey AS l_key, b.o_orderkey AS r_key FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.d < b.d + 30 AND b.d < a.d + 30""")
def interval_overlap(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("key"), F.floor(F.unix_timestamp("o_orderdate") / DAY).cast("bigint").alias("day"), F.lit(30).cast("bigint").alias("days"))
    return ranges.overlaps(o, o, ["o_custkey"], "day", "days", 30).where("l_key < r_key").select("o_custkey", "l_key", "r_key")


@query("""WITH m AS (SELECT o_custkey % 10 AS d, o_orderkey * 16 AS iova, o_orderkey * 16 + CASE WHEN o_orderkey % 5 < 3 THEN 1000000 ELSE 5000000 END AS gpa, 16 AS size FROM orders),
x AS (SELECT *, CASE WHEN lag(iova + size) OVER w = iova AND lag(gpa - iova) OVER w = gpa - iova THEN 0 ELSE 1 END AS c FROM m WINDOW w AS (PARTITION BY d ORDER BY iova)),
y AS (SELECT *, sum(c) OVER (PARTITION BY d ORDER BY iova) AS g FROM x), z AS (SELECT d, min(iova) AS iova, min(gpa) AS gpa, sum(size) AS len FROM y GROUP BY d, g),
q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_orderkey % 10 AS d, l_orderkey * 16 + l_linenumber AS addr, l_linenumber * 4 AS size FROM lineitem)
SELECT q.d, q.addr, q.size, CAST(CASE WHEN q.addr - z.iova + q.size <= z.len THEN z.gpa + q.addr - z.iova END AS BIGINT) AS translated FROM q ASOF LEFT JOIN z ON q.d = z.d AND q.addr >= z.iova""")
def translate_islands(spark, sf_dir):
    iova = F.col("o_orderkey") * 16
    m = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 10).alias("d"), iova.alias("iova"), (iova + F.when(F.col("o_orderkey") % 5 < 3, 1_000_000).otherwise(5_000_000)).alias("gpa"), F.lit(16).cast("bigint").alias("size"))
    q = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 10).alias("d"), (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("addr"), (F.col("l_linenumber") * 4).cast("bigint").alias("size"))
    return ranges.translate(q, m, ["d"], width=1 << 16).select("d", "addr", "size", "translated")


@query("""WITH n AS (SELECT n_regionkey, n_nationkey AS node FROM nation), g AS (SELECT DISTINCT c.c_nationkey AS src, s.s_nationkey AS dst FROM customer c JOIN supplier s ON c_custkey = s_suppkey),
d AS (SELECT n_regionkey, src, dst, 11 + (src * 7 + dst) % 8 AS distance FROM g JOIN nation ON n_nationkey = src)
SELECT a.n_regionkey, a.node AS a, b.node AS b, CASE WHEN a.node = b.node THEN 10 ELSE coalesce(f.distance, r.distance, 20) END AS distance
FROM n a JOIN n b USING (n_regionkey) LEFT JOIN d f ON f.n_regionkey = a.n_regionkey AND f.src = a.node AND f.dst = b.node LEFT JOIN d r ON r.n_regionkey = a.n_regionkey AND r.src = b.node AND r.dst = a.node""")
def matrix_fill(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    pairs = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "supplier"), F.col("c_custkey") == F.col("s_suppkey")).select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).distinct()
    d = pairs.join(nation.select("n_regionkey", F.col("n_nationkey").alias("src")), "src").withColumn("distance", 11 + (F.col("src") * 7 + F.col("dst")) % 8)
    return lookups.distance_matrix(nation.select("n_regionkey", F.col("n_nationkey").alias("node")), d, ["n_regionkey"])


_LAYERS = "SELECT l_linenumber - 1 AS layer, l_partkey AS cluster, CASE l_suppkey % 3 WHEN 0 THEN 'empty' WHEN 1 THEN 'zero' ELSE 'standard' END AS kind, l_orderkey AS address FROM lineitem"


@query(f"""WITH l AS ({_LAYERS}), s AS (SELECT cluster, min({{'layer': layer, 'kind': kind, 'address': address}}) AS s FROM l WHERE kind <> 'empty' AND layer <= 3 GROUP BY cluster)
SELECT p_partkey AS cluster, s.layer AS layer, coalesce(s.kind, 'hole') AS kind, s.address AS address FROM part LEFT JOIN s ON cluster = p_partkey""")
def overlay_resolve(spark, sf_dir):
    kind = F.when(F.col("l_suppkey") % 3 == 0, "empty").when(F.col("l_suppkey") % 3 == 1, "zero").otherwise("standard")
    layers = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") - 1).alias("layer"), F.col("l_partkey").alias("cluster"), kind.alias("kind"), F.col("l_orderkey").alias("address"))
    return lookups.resolve_layers(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cluster")), layers, 3)


@query("SELECT c_custkey, count(o_orderkey) AS n, CASE WHEN count(o_orderkey) > 20 THEN 'overflow' END AS problem FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def refcount(spark, sf_dir):
    refs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return aggregates.reference_counts([refs], table(spark, sf_dir, "customer"), "c_custkey", 20)


@query("SELECT p_brand, count(DISTINCT p_type) AS n_versions, list_sort(list(DISTINCT p_type)) AS versions FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1")
def version_conflicts(spark, sf_dir):
    return aggregates.version_conflicts(table(spark, sf_dir, "part"), "p_brand", "p_type").select("p_brand", "n_versions", "versions")


@query("SELECT 'labelled' AS rule, CAST(doc_id AS VARCHAR) AS id, CAST(doc_id AS VARCHAR) AS detail FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def fk_violations(spark, sf_dir):
    return rules.foreign_key(table(spark, sf_dir, "documents"), "doc_id", table(spark, sf_dir, "labels"), "doc_id", name="labelled")


@query("SELECT 'line' AS rule, id, CAST(count(*) AS VARCHAR) AS detail FROM (SELECT l_orderkey || '/' || l_linenumber AS id FROM lineitem) GROUP BY id HAVING count(*) > 1")
def unique_violations(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("key"))
    return rules.unique(lines, "key", "line")


@query("SELECT 'exclusive' AS rule, CAST(p AS VARCHAR) AS id, CAST(count(DISTINCT o) AS VARCHAR) AS detail FROM (SELECT l_partkey AS p, l_suppkey AS o FROM lineitem) GROUP BY p HAVING count(DISTINCT o) > 1")
def exclusive_membership(spark, sf_dir):
    owned = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.collect_set("l_partkey").alias("parts"))
    return rules.exclusive_membership(owned, "l_suppkey", "parts", "exclusive")


@query("""WITH b AS (SELECT user_id, bit_or(CASE WHEN day(ts) <= 15 THEN m ELSE 0 END) AS s, bit_or(CASE WHEN day(ts) = 16 THEN m ELSE 0 END) AS t
FROM (SELECT *, CAST(CASE event_type WHEN 'view' THEN 1 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 4 WHEN 'click' THEN 8 ELSE 16 END AS BIGINT) AS m FROM events) GROUP BY 1)
SELECT 'feature_compatibility' AS rule, user_id || '/types' AS id, 'subset ' || s || ' ' || t AS detail FROM b WHERE (s & ~t) <> 0""")
def feature_compat(spark, sf_dir):
    bit = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "purchase", 4).when(F.col("event_type") == "click", 8).otherwise(16).cast("bigint")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("leaf"), F.lit("types").alias("register"), bit.alias("value"), F.dayofmonth("ts").alias("day"))
    half = lambda c: lookups.all_flags(e.where(c), ["leaf", "register"], "value")
    checks = e.select("leaf", "register").distinct().withColumn("kind", F.lit("subset"))
    found = rules.feature_compatibility(half("day <= 15"), half("day = 16"), checks)
    return found.withColumn("detail", F.regexp_replace("detail", "^kind", "subset"))


@query("""SELECT 'turns' AS rule, conv_id || '/' || turn AS id, previous || '->' || role AS detail FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations)
WHERE previous IS NOT NULL AND NOT ((previous = 'user' AND role = 'assistant') OR (previous = 'system' AND role = 'user'))""")
def state_transitions(spark, sf_dir):
    legal = [("user", "assistant"), ("system", "user")]
    return rules.transitions(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role", legal, "turns")


@query("""WITH h AS (SELECT user_id % 5 AS k, event_type, (day(ts) - 1) * 24 + hour(ts) AS h FROM events),
w AS (SELECT k, event_type, CAST(h // 62 AS BIGINT) AS word, CAST(bit_or(CAST(1 AS BIGINT) << CAST(h % 62 AS BIGINT)) AS BIGINT) AS bits FROM h GROUP BY 1, 2, 3)
SELECT a.k, a.word, CAST(a.bits | b.bits AS BIGINT) AS bits FROM w a JOIN w b ON a.k = b.k AND a.word = b.word WHERE a.event_type = 'view' AND b.event_type = 'click'""")
def dirty_bitmap_union(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("k"), "event_type", ((F.dayofmonth("ts") - 1) * 24 + F.hour("ts")).cast("bigint").alias("h"))
    # 62 hours a word keep the oracle's shifts within signed integers; flags_to_words() has 64
    w = e.groupBy("k", "event_type", F.floor(F.col("h") / 62).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(h % 62 AS INT))")).alias("bits"))
    return ranges.bitmap_union(w.where("event_type = 'view'"), w.where("event_type = 'click'"), ["k"])


@query("""WITH d AS (SELECT DISTINCT user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS d FROM events), r AS (SELECT min(d) AS lo, max(d) AS hi FROM d),
a AS (SELECT user_id, unnest(generate_series(lo, hi)) AS d FROM (SELECT DISTINCT user_id FROM d), r), m AS (SELECT * FROM a EXCEPT SELECT * FROM d)
SELECT user_id, min(d) AS start, count(*) AS length FROM (SELECT *, d - row_number() OVER (PARTITION BY user_id ORDER BY d) AS g FROM m) GROUP BY user_id, g""")
def range_complement(spark, sf_dir):
    days = _events(spark, sf_dir, F.floor(F.unix_timestamp("ts") / DAY).cast("bigint").alias("start"))
    holes = days.select("user_id", "start", F.lit(1).cast("bigint").alias("length")).distinct()
    ends = days.agg(F.min("start").alias("start"), (F.max("start") - F.min("start") + 1).alias("length"))
    regions = days.select("user_id").distinct().join(F.broadcast(ends))  # ends is one row
    return ranges.complement(regions, holes, ["user_id"], "start", "length")


@query("""SELECT 'r' || r_regionkey AS id, 0 AS depth FROM region UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation UNION ALL SELECT 'c' || c_custkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def bfs_hierarchy(spark, sf_dir):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    nodes = table(spark, sf_dir, "region").select(name("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"))
    nodes = nodes.union(nation.select(name("n", "n_nationkey"), name("r", "n_regionkey"))).union(customer.select(name("c", "c_custkey"), name("n", "c_nationkey")))
    edges = nodes.where("parent IS NOT NULL").select("parent", F.xxhash64("id").alias("ord"), F.col("id").alias("child"))
    return graph.breadth_first(nodes, edges, 3).select("id", "depth")


@query("""WITH d AS (SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) AS i, event_type AS m, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS b, count(*) / 10.0 AS t FROM events GROUP BY 1, 2),
w AS (SELECT *, CASE WHEN t > 0 THEN b / CAST(t AS DOUBLE) ELSE 0 END AS bw FROM d), e AS (SELECT *, lag(bw) OVER (PARTITION BY m ORDER BY i) AS p, sum(b) OVER (PARTITION BY m ORDER BY i) AS tot FROM w)
SELECT m, i, b, round(bw, 6) AS bandwidth, round(CASE WHEN b = 0 THEN 0 WHEN p > 0 THEN b / p END, 6) AS est_downtime_s, CAST(tot AS BIGINT) AS total_bytes FROM e""")
def migration_metrics(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.floor(F.unix_timestamp("ts") / DAY).cast("bigint").alias("i"), F.col("event_type").alias("m")).agg(F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("b"), (F.count(F.lit(1)) / 10.0).cast("double").alias("t"))
    return migration.iteration_metrics(e, ["m"], "i", "b", "t").select("m", "i", "b", F.round("bandwidth", 6).alias("bandwidth"), F.round("est_downtime_s", 6).alias("est_downtime_s"), "total_bytes")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events WHERE event_type <> 'error' GROUP BY 1")
def latest_value(spark, sf_dir):
    return lookups.latest(_events(spark, sf_dir, "event_type", "value"), ["user_id"], "event_id", F.col("event_type") != "error")


@query("SELECT o_orderkey, printf('%04x:%02x:%02x.%x', (o_orderkey >> 16) & 65535, (o_orderkey >> 8) & 255, (o_orderkey >> 3) & 31, o_orderkey & 7) AS bdf, o_orderkey AS parsed FROM orders")
def bdf_format(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", numbers.format_bdf(F.col("o_orderkey")).alias("bdf"))
    return o.withColumn("parsed", numbers.parse_bdf(F.col("bdf")))


@query("""SELECT o_orderkey, o_orderkey % 1000 * CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 ELSE 1073741824 END AS bytes FROM orders""")
def byte_size(spark, sf_dir):
    unit = F.element_at(F.array(F.lit(""), F.lit("K"), F.lit("M"), F.lit("G")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", options.byte_size(F.concat((F.col("o_orderkey") % 1000).cast("string"), unit)).alias("bytes"))


@query("SELECT o_orderkey, list_concat([o_orderkey % 7], generate_series(o_orderkey % 7 + 2, o_orderkey % 7 + 5)) AS numbers FROM orders")
def int_list(spark, sf_dir):
    a = F.col("o_orderkey") % 7
    return table(spark, sf_dir, "orders").select("o_orderkey", options.integer_list(F.format_string("[%d,%d-%d]", a, a + 2, a + 5)).alias("numbers"))


@query("SELECT o_orderkey, o_orderkey % 9 AS boot, 'a,b' AS features, CAST(o_orderkey % 2 = 0 AS BOOLEAN) AS has_max FROM orders")
def option_strings(spark, sf_dir):
    given = F.concat(F.lit("boot="), (F.col("o_orderkey") % 9).cast("string"), F.lit(',features="a,b"'), F.when(F.col("o_orderkey") % 2 == 0, ",max=").otherwise(""))
    o = table(spark, sf_dir, "orders").select("o_orderkey", options.parse_section("cpus", given).alias("o"))
    return o.select("o_orderkey", options.option(F.col("o"), "boot").cast("bigint").alias("boot"), options.option(F.col("o"), "features").alias("features"), options.is_set(F.col("o"), "max").alias("has_max"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN round(abs(value) / 1000, 6) WHEN 1 THEN round(abs(value), 6) WHEN 2 THEN round(abs(value) * 1000, 6) ELSE round(abs(value) * 1000000, 6) END AS us FROM events")
def duration_units(spark, sf_dir):
    unit = F.element_at(F.array(F.lit("ns"), F.lit("us"), F.lit("ms"), F.lit("s")), (F.col("event_id") % 4 + 1).cast("int"))
    shown = F.concat(F.abs("value").cast("decimal(20,6)").cast("string"), unit)
    return table(spark, sf_dir, "events").select("event_id", F.round(numbers.duration_us(shown), 6).alias("us"))


@query("""WITH s AS (SELECT o_custkey AS k, o_orderkey AS id, CAST(epoch(o_orderdate) // 86400 AS BIGINT) AS a, CAST(epoch(o_orderdate) // 86400 AS BIGINT) // 256 * 256 + 256 AS b FROM orders)
SELECT x.k, x.id, count(y.id) AS depth FROM s x LEFT JOIN s y ON x.k = y.k AND x.id <> y.id AND y.b >= x.b AND y.b > x.a AND (y.a < x.a OR (y.a = x.a AND (y.b > x.b OR y.id < x.id))) GROUP BY 1, 2""")
def trace_depth(spark, sf_dir):
    day = F.floor(F.unix_timestamp("o_orderdate") / DAY).cast("bigint")
    spans = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), day.alias("a"), (day - F.pmod(day, F.lit(256)) + 256).alias("b"))
    return sequences.span_depths(spans, ["k"], "a", "b", "id").select("k", "id", "depth")


@query("SELECT p_partkey, 'brand = ' || p_brand || ', type = ' || p_type AS properties FROM part")
def properties_text(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.format_properties(F.create_map(F.lit("type"), F.col("p_type"), F.lit("brand"), F.col("p_brand"))).alias("properties"))


@query("""WITH o AS (SELECT o_custkey AS k, o_orderkey % 400 * 8 AS s, 4 + o_orderkey % 13 AS l FROM orders), w AS (SELECT *, max(s + l) OVER (PARTITION BY k ORDER BY s, l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM o)
SELECT 'disjoint' AS rule, k || '/' || s AS id, concat_ws(',', CASE WHEN r > s THEN 'overlap' END, CASE WHEN s % 4 <> 0 OR l % 4 <> 0 THEN 'unaligned' END) AS detail FROM w WHERE r > s OR s % 4 <> 0 OR l % 4 <> 0""")
def disjoint_violations(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 400 * 8).alias("s"), (4 + F.col("o_orderkey") % 13).alias("l"))
    return rules.disjoint(o, ["k"], "s", "l", 4)


@query("SELECT o_orderkey, (o_orderkey % 2) | ((o_orderkey // 2 % 3) << 1) | ((o_orderkey // 6) << 3) AS apic FROM orders")
def x2apic_ids(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.x2apic_id(F.col("o_orderkey"), 2, 3, 1).alias("apic"))


@query("SELECT n_regionkey, sum(n_nationkey) AS effective_size FROM (SELECT n_regionkey, n_nationkey FROM nation UNION ALL SELECT n_regionkey, n_nationkey FROM nation) GROUP BY 1")
def range_bag(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_regionkey", F.col("n_nationkey").cast("bigint").alias("length"))
    return aggregates.effective_size(migration.final_delta(n, n), ["n_regionkey"], "length")


@query("""WITH o AS (SELECT o_custkey AS k, o_orderkey % 400 * 8 AS s, 4 + o_orderkey % 13 AS l FROM orders), c AS (SELECT o_custkey AS k, o_orderkey % 37 * 64 AS s, 100 AS l FROM orders)
SELECT 'no_split' AS rule, o.k || '/' || o.s AS id, CAST(c.s AS VARCHAR) AS detail FROM o JOIN c ON o.k = c.k AND ((c.s > o.s AND c.s < o.s + o.l) OR (c.s + c.l > o.s AND c.s + c.l < o.s + o.l))""")
def split_violations(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    held = o.select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 400 * 8).alias("s"), (4 + F.col("o_orderkey") % 13).alias("l"))
    cuts = o.select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 37 * 64).alias("s"), F.lit(100).cast("bigint").alias("l"))
    return rules.no_split(held, cuts, ["k"], "s", "l", width=128)


@query("""WITH r AS (SELECT o_custkey AS vm, o_orderkey % 64 * 4096 AS gpa, (1 + o_orderkey % 3) * 4096 + CASE WHEN o_orderkey % 11 = 0 THEN 8 ELSE 0 END AS l, o_orderkey AS i FROM orders),
p AS (SELECT *, coalesce(sum(l) OVER (PARTITION BY vm ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_ FROM r),
w AS (SELECT vm, gpa, concat_ws(',', CASE WHEN l % 4096 <> 0 OR at_ % 4096 <> 0 THEN 'unaligned' END, CASE WHEN NOT (vm % 2 = 0 AND gpa + l <= CASE WHEN gpa < 131072 THEN 131072 ELSE 262144 END) THEN 'outside' END) AS what FROM p)
SELECT 'restore_ranges' AS rule, vm || '/' || gpa AS id, what AS detail FROM w WHERE what <> ''""")
def restore_violations(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "vm")
    length = (1 + F.col("o_orderkey") % 3) * 4096 + F.when(F.col("o_orderkey") % 11 == 0, 8).otherwise(0)
    saved = o.select("vm", (F.col("o_orderkey") % 64 * 4096).alias("gpa"), length.alias("length"), F.col("o_orderkey").alias("i"))
    halves = F.explode(F.array(F.lit(0).cast("bigint"), F.lit(131072).cast("bigint"))).alias("gpa")
    regions = o.select("vm").distinct().select("vm", halves, F.lit(131072).cast("bigint").alias("length"), (F.col("vm") % 2 == 0).alias("plain"))
    return rules.restore_ranges(saved, regions, "i", 4096)


@query("""WITH o AS (SELECT o_orderkey, o_orderkey * 128 AS size, CASE WHEN o_orderkey % 2 = 0 THEN 64 ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 AND o_custkey % 2 = 0 THEN 8 ELSE 0 END AS hotplugged, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE 0 END AS zone FROM orders)
SELECT o_orderkey, hotplugged, size + zone + hotplugged AS total, greatest(size + zone - o_orderkey % 1000 * 100, 0) + 5 AS actual FROM o""")
def memory_sizes(spark, sf_dir):
    zone = F.struct(F.col("o_custkey").cast("bigint").alias("size"), F.when(F.col("o_custkey") % 2 == 0, F.lit(8).cast("bigint")).alias("hotplugged_size"))
    machines = table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_orderkey") * 128).alias("size"), F.when(F.col("o_orderkey") % 2 == 0, F.lit(64).cast("bigint")).alias("hotplugged_size"), F.when(F.col("o_orderkey") % 3 == 0, F.array(zone)).alias("zones")
    )
    out = aggregates.memory_totals(machines)
    return out.select("o_orderkey", "hotplugged", "total", aggregates.actual_memory(F.col("total"), F.col("hotplugged"), F.col("o_orderkey") % 1000 * 100, F.lit(5)).alias("actual"))


@query("""WITH n AS (SELECT n_nationkey, n_regionkey + 1 AS weight, 1048576 // (4096 * sum(n_regionkey + 1) OVER ()) * 4096 AS unit FROM nation),
b AS (SELECT *, coalesce(sum(weight) OVER (ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * unit AS start FROM n)
SELECT n_nationkey, CAST(start AS BIGINT) AS start, CAST(CASE WHEN lead(n_nationkey) OVER (ORDER BY n_nationkey) IS NULL THEN 1048576 - start ELSE weight * unit END AS BIGINT) AS length FROM b""")
def segment_split(spark, sf_dir):
    parts = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_regionkey") + 1).alias("weight"))
    return ranges.weighted_split(1 << 20, 4096, parts, "n_nationkey", "weight").select("n_nationkey", "start", "length")


@query("""WITH o AS (SELECT DISTINCT o_custkey AS k, o_orderkey % 50 * 4 AS s FROM orders), m AS (SELECT *, CASE WHEN lag(s) OVER (PARTITION BY k ORDER BY s) + 4 = s THEN 0 ELSE 1 END AS f FROM o),
g AS (SELECT *, sum(f) OVER (PARTITION BY k ORDER BY s) AS r FROM m) SELECT k, min(s) AS s, count(*) * 4 AS l FROM g GROUP BY k, r""")
def adjacent_regions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 50 * 4).alias("s"), F.lit(4).cast("bigint").alias("l")).distinct()
    return ranges.merge_adjacent(o, ["k"], "s", "l")


@query("SELECT * FROM (SELECT user_id, event_id, lag(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id) AS previous, CAST(round(value * 100) AS BIGINT) AS cents FROM events) WHERE previous > cents")
def sortedness_check(spark, sf_dir):
    return sequences.unsorted(_events(spark, sf_dir, _cents()), ["user_id"], "event_id", "cents").select("user_id", "event_id", "previous", "cents")


@query("SELECT o_custkey, CASE WHEN count(*) = 2 THEN max_by(o_orderkey, o_orderkey) - min(o_orderkey) END AS delta FROM orders GROUP BY o_custkey")
def boot_delta(spark, sf_dir):
    return sequences.first_to_second(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", "o_orderkey")


@query("""SELECT user_id, min(event_id) AS iteration, min_by(d, event_id) AS decision FROM (SELECT user_id, event_id, CASE WHEN event_id % 50 = 0 THEN 'done' WHEN event_id % 700 <= 30 THEN 'fits' WHEN event_id % 40 * 100 >= 3600 THEN 'error' END AS d FROM events) WHERE d IS NOT NULL GROUP BY user_id""")
def convergence_decision(spark, sf_dir):
    rounds = _events(spark, sf_dir, (F.col("event_id") % 50).alias("num_bytes"), (F.col("event_id") % 700 / 100).alias("est_downtime_s"), (F.col("event_id") % 40 * 100).alias("elapsed_s"))
    return migration.convergence(migration.decisions(rounds, "num_bytes", "elapsed_s"), ["user_id"], "event_id")


@query("SELECT user_id, page FROM (SELECT user_id, event_id % 64 // 4 * 16384 AS page, event_id % 64 % 4 AS sub FROM events) GROUP BY 1, 2 HAVING count(DISTINCT sub) = 4")
def whole_pages(spark, sf_dir):
    return aggregates.complete_pages(_events(spark, sf_dir).withColumn("addr", F.col("event_id") % 64 * 4096), ["user_id"], "addr", 16384)


@query("""SELECT c_custkey AS function, 0 AS index, c_custkey AS eax, c_nationkey | coalesce(b, 0) AS ebx, 0 AS ecx, 0 | coalesce(d, 0) AS edx FROM customer
LEFT JOIN (SELECT o_custkey, bit_or(o_orderkey % 64) AS b, bit_or(o_orderkey % 8) AS d FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def patched_registers(spark, sf_dir):
    zero = F.lit(0).cast("bigint")
    entries = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("function"), zero.alias("index"), F.col("c_custkey").alias("eax"), F.col("c_nationkey").cast("bigint").alias("ebx"), zero.alias("ecx"), zero.alias("edx"))
    patches = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("function"), zero.alias("index"), zero.alias("eax"), (F.col("o_orderkey") % 64).alias("ebx"), zero.alias("ecx"), (F.col("o_orderkey") % 8).alias("edx"))
    return lookups.apply_patches(entries, patches)


@query("""WITH v AS (SELECT DISTINCT o_custkey % 5 AS leaf, o_orderkey % 8 AS sub_leaf, 'eax' AS register, o_orderkey % 31 AS value FROM orders),
h AS (SELECT v.*, min_by((v.value & 12) | (n_nationkey % 2), n_nationkey) AS new FROM v LEFT JOIN nation ON n_nationkey % 5 = leaf AND sub_leaf BETWEEN n_regionkey AND n_regionkey + 2 GROUP BY ALL)
SELECT leaf, sub_leaf, register, coalesce(new, 0) AS value FROM h""")
def adjusted_registers(spark, sf_dir):
    values = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 5).alias("leaf"), (F.col("o_orderkey") % 8).alias("sub_leaf"), F.lit("eax").alias("register"), (F.col("o_orderkey") % 31).cast("bigint").alias("value")).distinct()
    nation = table(spark, sf_dir, "nation")
    rows = nation.select(F.col("n_nationkey").alias("ord"), (F.col("n_nationkey") % 5).alias("leaf"), F.col("n_regionkey").alias("low"), (F.col("n_regionkey") + 2).alias("high"), F.lit("eax").alias("register"), F.lit(12).cast("bigint").alias("mask"), (F.col("n_nationkey") % 2).cast("bigint").alias("replacement"))
    return lookups.adjust_registers(values, rows)


@query("SELECT c_custkey, printf('%02x:%02x:%02x:%02x:%02x:%02x', 2, c_custkey % 256, c_custkey // 256 % 256, c_nationkey, 255, 0) AS mac, [2, c_custkey % 256, c_custkey // 256 % 256, c_nationkey, 255, 0] AS parts FROM customer")
def mac_round_trip(spark, sf_dir):
    k = F.col("c_custkey")
    given = F.array(*(x.cast("int") for x in (F.lit(2), k % 256, F.floor(k / 256) % 256, F.col("c_nationkey"), F.lit(255), F.lit(0))))
    shown = table(spark, sf_dir, "customer").select("c_custkey", numbers.format_mac(given).alias("mac"))
    return shown.withColumn("parts", numbers.parse_mac(F.col("mac")))


@query("SELECT o_orderkey, list_filter(range(0, 63), lambda i: (o_orderkey >> i) & 1 = 1) AS bits, ((o_orderkey >> 3) & 1) = 1 AS has_3 FROM orders")
def feature_bits(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", numbers.bit_positions(F.col("o_orderkey")).alias("bits"), numbers.has_feature(F.col("o_orderkey"), F.lit(3)).alias("has_3"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS toggled,
CASE WHEN p_partkey % 5 > 0 THEN ['a', CAST(p_partkey AS VARCHAR)] END AS keys, CASE WHEN p_partkey % 5 > 0 THEN ['[1,2]', '"x@y"'] END AS vals FROM part""")
def toggles_and_pairs(spark, sf_dir):
    k = F.col("p_partkey")
    word = F.element_at(F.array(F.lit("ON"), F.lit(""), F.lit("true"), F.lit("yes")), (k % 4 + 1).cast("int"))
    pairs = options.pair_list(F.concat(F.lit("[a@[1,2],"), F.when(k % 5 > 0, k.cast("string")).otherwise(""), F.lit('@"x@y"]')))
    return table(spark, sf_dir, "part").select("p_partkey", options.toggle(word).alias("toggled"), pairs["key"].alias("keys"), pairs["value"].alias("vals"))


@query("""SELECT p_partkey, 'md5' AS algorithm, md5(p_name) AS actual FROM part WHERE p_partkey % 7 = 0 UNION ALL SELECT p_partkey, 'sha256', sha256(p_name) FROM part WHERE p_partkey % 3 = 0""")
def digest_check(spark, sf_dir):
    name = F.col("p_name").cast("binary")
    want = F.create_map(F.lit("md5"), F.when(F.col("p_partkey") % 7 == 0, "0").otherwise(F.upper(F.md5(name))), F.lit("sha256"), F.when(F.col("p_partkey") % 3 == 0, "0").otherwise(F.sha2(name, 256)))
    files = table(spark, sf_dir, "part").select("p_partkey", name.alias("data"), want.alias("expected"))
    return aggregates.digest_mismatches(files, "data", "expected").select("p_partkey", "algorithm", "actual")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS image, list_transform(list_filter(range(1, 11), lambda i: (p_partkey >> i) > 0), lambda i: CAST(p_partkey >> i AS VARCHAR)) AS chain, (p_partkey >> 11) > 0 AS too_deep FROM part""")
def backing_chains(spark, sf_dir):
    half = F.shiftright(F.col("p_partkey"), 1)
    return graph.backing_chain(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("image"), F.when(half > 0, half.cast("string")).alias("backing")))


@query("SELECT user_id, sum(event_id) AS total_bytes, max(event_id % 3) AS elapsed_s, CASE WHEN max(event_id % 3) > 0 THEN round(sum(event_id) / max(event_id % 3), 6) ELSE 0 END AS average FROM events GROUP BY user_id")
def average_bandwidths(spark, sf_dir):
    out = migration.average_bandwidth(_events(spark, sf_dir).withColumn("elapsed", F.col("event_id") % 3), ["user_id"], "event_id", "elapsed")
    return out.withColumn("average", F.round("average", 6))


@query("""SELECT o_custkey, o_orderkey, round(10 + o_orderkey * 980.0 / 1e9, 9) AS x, round(o_custkey * 1000000 * 980.0 / 1e9, 6) AS w, CAST(o_custkey AS BIGINT) AS label_ms, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ord FROM orders WHERE o_orderkey % 9 > 0""")
def span_drawing(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 9 > 0, F.col("o_orderkey") + F.col("o_custkey") * 1_000_000).alias("stop"), F.lit(1e9).alias("total"))
    return sequences.span_layout(o, "o_custkey", "o_orderkey", "stop", "total").select("o_custkey", "o_orderkey", F.round("x", 9).alias("x"), F.round("w", 6).alias("w"), "label_ms", "ord")


@query("SELECT DISTINCT k FROM (SELECT o_custkey AS k FROM orders WHERE o_custkey IN (SELECT n_nationkey FROM nation) UNION ALL SELECT r_regionkey + 1000 FROM region)")
def profile_index(spark, sf_dir):
    index, required = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    return lookups.profile_keys(index, required, table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1000).alias("k")), "k")


@query("SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey // 2 * 2 FROM orders)")
def missing_keys(spark, sf_dir):
    there = table(spark, sf_dir, "orders").select((F.col("o_custkey") - F.col("o_custkey") % 2).alias("k"))
    return lookups.missing(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), there, "k")


@query(_counters_sql("""SELECT l_suppkey % 10 AS device_id, l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS o, CASE WHEN l_linenumber % 2 = 0 THEN 'read' ELSE 'write' END AS d, CAST(l_quantity AS BIGINT) * 512 AS b,
l_partkey % 1000 AS lat, l_orderkey % 17 <> 0 AS fine FROM lineitem"""))
def block_request_counters(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 10).alias("device_id"), (F.col("l_orderkey") * 1_000_000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("o"), F.when(F.col("l_linenumber") % 2 == 0, "read").otherwise("write").alias("direction"),
        (F.col("l_quantity").cast("bigint") * 512).alias("bytes"), (F.col("l_partkey") % 1000).alias("latency_us"), F.when(F.col("l_orderkey") % 17 == 0, -1).otherwise(0).alias("result"),
    )
    return aggregates.request_counters(rows, ["device_id"], ["o", "latency_us"])


@query("""WITH f AS (SELECT CAST(o_custkey % 5 AS INTEGER) AS k, o_orderkey AS id, o_orderkey * 37 % 210000 AS addr, o_orderkey * 37 % 210000 // 4096 * 4096 AS page_addr FROM orders)
SELECT f.*, CAST(n_nationkey AS BIGINT) * 8192 AS base, CASE WHEN n_nationkey IS NOT NULL THEN (page_addr - n_nationkey * 8192) // 4096 END AS page
FROM f LEFT JOIN nation ON n_regionkey = k AND page_addr >= n_nationkey * 8192 AND page_addr < n_nationkey * 8192 + 6144""")
def page_fault_lookup(spark, sf_dir):
    faults = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 5).cast("int").alias("k"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * 37 % 210000).alias("addr"))
    held = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("k"), (F.col("n_nationkey").cast("bigint") * 8192).alias("base"), F.lit(6144).cast("bigint").alias("length"))
    return lookups.page_faults(faults, held, ["k"], 4096)


@query("""WITH q AS (SELECT CAST(o_custkey % 5 AS INTEGER) AS k, o_orderkey AS id, o_orderkey * 11 % 160000 AS addr, 1 + o_orderkey % 4096 AS size FROM orders)
SELECT k, id, addr, size, min(n_nationkey * 100000 + addr - n_nationkey * 6000) AS translated
FROM q LEFT JOIN nation ON n_regionkey = k AND addr >= n_nationkey * 6000 AND addr + size <= n_nationkey * 6000 + 8000 GROUP BY 1, 2, 3, 4""")
def reverse_translation(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 5).cast("int").alias("k"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * 11 % 160000).alias("addr"), (1 + F.col("o_orderkey") % 4096).alias("size"))
    n = F.col("n_nationkey").cast("bigint")
    held = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("k"), (n * 100000).alias("iova"), (n * 6000).alias("gpa"), F.lit(8000).cast("bigint").alias("size"))
    return ranges.translate_back(asked, held, ["k"], width=8192)


@query("""WITH q AS (SELECT CAST(o_custkey % 5 AS INTEGER) AS k, o_orderkey AS id, o_orderkey * 13 % 50000 AS s, 1 + o_orderkey % 9000 AS l, o_orderkey % 2 = 0 AS w FROM orders),
e AS (SELECT n_regionkey AS k, CAST(n_nationkey AS BIGINT) * 2000 AS s, CASE n_nationkey % 7 WHEN 0 THEN 'RDONLY' WHEN 1 THEN 'NOACCESS' ELSE 'RW' END AS access FROM nation)
SELECT q.k, q.id, greatest(q.s, e.s) AS seg_start, least(q.s + q.l, e.s + 2000) - greatest(q.s, e.s) AS seg_length, bool_or(access = 'NOACCESS' OR (w AND access = 'RDONLY')) OVER (PARTITION BY q.k, q.id) AS denied
FROM q JOIN e ON q.k = e.k AND q.s < e.s + 2000 AND e.s < q.s + q.l""")
def extent_segments(spark, sf_dir):
    o, n = F.col("o_orderkey"), F.col("n_nationkey")
    asked = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 5).cast("int").alias("k"), o.alias("id"), (o * 13 % 50000).alias("start"), (1 + o % 9000).alias("length"), (o % 2 == 0).alias("write"))
    access = F.when(n % 7 == 0, "RDONLY").when(n % 7 == 1, "NOACCESS").otherwise("RW")
    held = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("k"), (n.cast("bigint") * 2000).alias("start"), F.lit(2000).cast("bigint").alias("length"), access.alias("access"))
    return ranges.segments(asked, held, ["k"], "start", "length", "access", "write", 8192).select("k", F.col("l_id").alias("id"), "seg_start", "seg_length", "denied")


@query("""SELECT b.p_name AS package, b.p_size AS version, a.p_name AS dependent FROM (SELECT DISTINCT l_partkey AS id, l_suppkey AS dep_id FROM lineitem) e JOIN part a ON a.p_partkey = e.id JOIN part b ON b.p_partkey = e.dep_id""")
def package_dependents(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("dep_id")).distinct()
    return lookups.dependents(edges, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("version")))


@query("""WITH d AS (SELECT n_nationkey AS node, unnest([n_nationkey + 1, n_nationkey * 2 % 30]) AS dest FROM nation)
SELECT DISTINCT * FROM (SELECT n_nationkey AS node, 'unknown zone' AS problem FROM nation WHERE n_nationkey % 7 > 4
UNION ALL SELECT node, 'unknown destination' FROM d WHERE dest NOT IN (SELECT n_nationkey FROM nation) UNION ALL SELECT node, 'repeated destination' FROM d GROUP BY node, dest HAVING count(*) > 1)""")
def numa_problems(spark, sf_dir):
    n = F.col("n_nationkey")
    zone = lambda c: F.concat(F.lit("z"), c.cast("string"))
    distance = lambda c: F.struct(c.alias("destination"), F.lit(20).alias("distance"))
    nodes = table(spark, sf_dir, "nation").select(n.alias("node"), F.array(zone(F.col("n_regionkey")), zone(n % 7)).alias("memory_zones"), F.array(distance(n + 1), distance(n * 2 % 30)).alias("distances"))
    zones = table(spark, sf_dir, "region").select(zone(F.col("r_regionkey")).alias("zone"), F.array("r_regionkey").alias("regions"))
    return lookups.assemble_numa(nodes, zones)[1]


@query("""WITH p AS (SELECT p_partkey AS id, p_size AS boot, p_partkey % 60 AS most, p_partkey % 4 AS a, p_partkey % 3 AS b, CASE WHEN p_partkey % 13 = 0 THEN '__' || p_partkey ELSE 'd' || p_partkey END AS name FROM part)
SELECT 'vcpus' AS rule, CAST(id AS VARCHAR) AS id, '' AS detail FROM p WHERE most < boot OR most > 55 UNION ALL SELECT 'topology', CAST(id AS VARCHAR), '' FROM p WHERE a = 0 OR b = 0 OR a * b <> most
UNION ALL SELECT 'queue_size', CAST(id AS VARCHAR), '' FROM p WHERE boot <= 0 OR bit_count(boot) <> 1 UNION ALL SELECT 'bounds', CAST(id AS VARCHAR), '' FROM p WHERE boot + a > most UNION ALL SELECT 'reserved_prefix', name, '__' FROM p WHERE starts_with(name, '__')""")
def config_violations(spark, sf_dir):
    key = F.col("p_partkey")
    name = F.when(key % 13 == 0, F.concat(F.lit("__"), key.cast("string"))).otherwise(F.concat(F.lit("d"), key.cast("string")))
    p = table(spark, sf_dir, "part").select(key.alias("id"), F.col("p_size").alias("boot"), (key % 60).alias("most"), (key % 4).alias("a"), (key % 3).alias("b"), name.alias("name"))
    checks = {"vcpus": rules.vcpu_bounds("boot", "most", 55), "topology": rules.topology_broken(["a", "b"], "most"), "queue_size": rules.not_power_of_two("boot"), "bounds": rules.beyond_bounds("boot", "a", "most")}
    return rules.violations([*(rules.condition(p, broken, "id", name=what) for what, broken in checks.items()), rules.reserved_prefix(p, "name")])


@query("""WITH b AS (SELECT o_custkey AS key FROM orders)
SELECT 'batch_keys' AS rule, CAST(key AS VARCHAR) AS id, 'repeated' AS detail FROM b GROUP BY key HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'batch_keys', CAST(key AS VARCHAR), 'in flight' FROM b WHERE key IN (SELECT s_suppkey FROM supplier)""")
def batch_key_violations(spark, sf_dir):
    return rules.batch_keys(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key")), "key")


@query("""WITH r AS (SELECT n_nationkey AS region_id, CAST(n_nationkey AS BIGINT) * 1000 AS gpa FROM nation), e AS (SELECT s_nationkey AS region_id, s_nationkey * 1000 + s_suppkey % 900 AS gpa FROM supplier)
SELECT region_id, greatest(r.gpa, e.gpa) AS gpa, least(r.gpa + 1000, e.gpa + 300) - greatest(r.gpa, e.gpa) AS length FROM r JOIN e USING (region_id) UNION ALL SELECT region_id, gpa, 1000 FROM r WHERE region_id NOT IN (SELECT region_id FROM e)""")
def sparse_policy_ranges(spark, sf_dir):
    n = F.col("n_nationkey")
    regions = table(spark, sf_dir, "nation").select(n.alias("region_id"), (n.cast("bigint") * 1000).alias("gpa"), F.lit(1000).cast("bigint").alias("length"), (n % 2 == 0).alias("persisted"))
    extents = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("region_id"), (F.col("s_nationkey") * 1000 + F.col("s_suppkey") % 900).alias("gpa"), F.lit(300).cast("bigint").alias("length"))
    return ranges.policy_ranges(regions, extents, "sparse", 1000)


@query("SELECT o_orderkey, o_custkey % 50 AS kill_time FROM orders WHERE o_orderkey % 3 = 0 ORDER BY o_orderkey LIMIT 128")
def kill_queue_take(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey") % 50).alias("kill_time"))
    return lookups.kill_queue(o, "o_orderkey", "kill_time")[0]


@query("""SELECT o_orderkey, gcd(o_orderkey, o_custkey) AS common, o_orderkey // 8 * 8 AS down, (o_orderkey + 7) // 8 * 8 AS up, (o_orderkey + 6) // 7 AS parts, o_orderkey >> 9 AS l1, o_orderkey & 511 AS l2,
array_to_string(list_filter(range(64), lambda i: (o_orderkey >> i) & 1 = 1), ',') AS bits, CASE WHEN o_custkey % 5 > 0 THEN o_orderkey + o_custkey % 5 - 1 END AS last,
CASE WHEN o_custkey % 5 > 0 THEN round(o_orderkey / (o_custkey % 5), 6) ELSE 0 END AS rate, o_totalprice > 100000 * 0.9 AND o_totalprice < 100000 * 1.1 AS near FROM orders""")
def integer_arithmetic(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("o_custkey") % 5
    index = numbers.split_index(o, 512)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", numbers.gcd(o, F.col("o_custkey")).alias("common"), numbers.align_down(o, F.lit(8)).alias("down"), numbers.align_up(o, F.lit(8)).alias("up"), numbers.div_round_up(o, F.lit(7)).alias("parts"), index["l1"].alias("l1"), index["l2"].alias("l2"),
        F.array_join(numbers.bit_positions(o).cast("array<string>"), ",").alias("bits"), numbers.inclusive_end(o, c).cast("bigint").alias("last"), F.round(numbers.bandwidth(o, c), 6).alias("rate"), numbers.within_tolerance(F.col("o_totalprice"), F.lit(100000), 0.1).alias("near"),
    )


@query("SELECT o_orderkey, printf('%dms (final_iter:%dms state:%dms send_state:%dms complete:%dms)', o_orderkey, o_custkey, o_orderkey % 7, o_orderkey % 11, o_orderkey % 13) AS line FROM orders")
def downtime_lines(spark, sf_dir):
    o = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.downtime_line(o, F.col("o_custkey"), o % 7, o % 11, o % 13).alias("line"))


@query("""WITH u AS (SELECT o_custkey, list(DISTINCT o_orderkey % 5) AS used FROM orders GROUP BY 1) SELECT o_custkey, 'disk' || list_filter(range(1, 8), lambda i: NOT list_contains(used, i))[1] AS name FROM u""")
def next_device_names(spark, sf_dir):
    used = F.collect_set(F.concat(F.lit("disk"), (F.col("o_orderkey") % 5).cast("string")))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(used.alias("used")).select("o_custkey", text.next_name("disk", F.col("used"), F.lit(1)).alias("name"))


@query("SELECT c_custkey, CASE lower(c_mktsegment) WHEN 'building' THEN 'Local' WHEN 'machinery' THEN 'Remote' END AS mode, right(c_name, 6) AS tail FROM customer")
def enum_and_tail(spark, sf_dir):
    mode = text.parse_enum(F.col("c_mktsegment"), {"Building": "Local", "Machinery": "Remote"})
    return table(spark, sf_dir, "customer").select("c_custkey", mode.alias("mode"), text.keep_tail(F.col("c_name").cast("binary"), 6).cast("string").alias("tail"))


@query("""SELECT o_orderkey, o_totalprice AS sent, round((o_custkey * 3.0 - o_orderkey % 3) / 5.5, 6) AS packets, round(o_custkey * 512 / ((1 + o_orderkey % 9) / 1000.0) + o_orderkey / 0.25, 4) AS bytes FROM orders""")
def tool_outputs(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    rate = lambda total, ms: F.struct(total.cast("double").alias("io_bytes"), ms.cast("double").alias("runtime"))
    network = F.struct(F.struct(F.col("o_totalprice").alias("bits_per_second")).alias("sum_sent"), F.struct((c * 3).cast("double").alias("packets"), (o % 3).cast("double").alias("lost_packets"), F.lit(5.5).alias("seconds")).alias("sum"))
    jobs = F.array(F.struct(rate(c * 512, 1 + o % 9).alias("read")), F.struct(rate(o, F.lit(250)).alias("read")))
    shown = table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.struct(network.alias("end"))).alias("iperf"), F.to_json(F.struct(jobs.alias("jobs"))).alias("fio"))
    return shown.select("o_orderkey", telemetry.iperf_value(F.col("iperf")).alias("sent"), F.round(telemetry.iperf_value(F.col("iperf"), what="packets"), 6).alias("packets"), F.round(telemetry.fio_value(F.col("fio"), 2), 4).alias("bytes"))


@query("SELECT 'supplier' || s_suppkey AS device_id, unnest(['rx_bytes', 'tx_bytes']) AS counter, unnest([s_suppkey * 1500, CAST(s_nationkey AS BIGINT)]) AS value FROM supplier")
def counter_snapshot(spark, sf_dir):
    counters = F.create_map(F.lit("rx_bytes"), F.col("s_suppkey") * 1500, F.lit("tx_bytes"), F.col("s_nationkey").cast("bigint"))
    shown = table(spark, sf_dir, "supplier").select(F.to_json(F.create_map(F.concat(F.lit("supplier"), F.col("s_suppkey").cast("string")), counters)).alias("value"))
    return telemetry.parse_counters(shown).withColumn("value", F.col("value").cast("bigint"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


from . import device_queries, source_queries, state_queries  # noqa: E402, F401 - they register theirs

"""Queries of the sources: their formats are made from the tables, read back, and held against the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import numbers, options, text
from .operators import aggregates, ranges, sequences
from .registry import query, table
from .sources import binary, telemetry

SECOND = 1_000_000_000


def _text(c):
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


@query("SELECT event_id * 1000000000 + event_id % 1000 AS ts_ns, 'vm' AS source, event_type AS event, CAST(user_id AS VARCHAR) AS user FROM events WHERE event_id % 10 > 1")
def event_log_read(spark, sf_dir):
    i = F.col("event_id")
    stamp = F.struct(i.alias("secs"), (i % 1000).cast("int").alias("nanos"))
    good = F.to_json(F.struct(stamp.alias("timestamp"), F.lit("vm").alias("source"), F.col("event_type").alias("event"), F.create_map(F.lit("user"), _text("user_id")).alias("properties")))
    lines = table(spark, sf_dir, "events").select(F.when(i % 10 == 0, '{"timestamp": {"secs": 1').when(i % 10 == 1, "  ").otherwise(good).alias("value"))
    return telemetry.parse_events(lines).select("ts_ns", "source", "event", F.col("properties")["user"].alias("user"))


@query("SELECT (event_id + 7) * 1000000003 - 5000000000 AS ts_ns, event_type AS source, 'e' || event_id AS event FROM events")
def event_log_write(spark, sf_dir):
    i = F.col("event_id")
    events = table(spark, sf_dir, "events").select(((i + 7) * (SECOND + 3)).alias("at"), F.col("event_type").alias("source"), F.concat(F.lit("e"), _text(i)).alias("event"), F.create_map(F.lit("k"), _text("user_id")).alias("properties"))
    shown = telemetry.event_text(telemetry.stamped(events, "at", F.lit(5 * SECOND)))
    return telemetry.parse_events(shown, strict=True).select("ts_ns", "source", "event")


@query("""SELECT o_custkey AS run, 't' || o_orderkey % 3 AS thread, o_orderpriority AS event, o_orderkey * 1000003 AS start_ns, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey * 1000003 + o_custkey END AS end_ns,
CAST(o_orderkey % 4 AS BIGINT) AS depth, 9000000000 AS total_ns FROM orders""")
def trace_round_trip(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    spans = table(spark, sf_dir, "orders").select(c.alias("run"), F.concat(F.lit("t"), _text(o % 3)).alias("thread"), F.col("o_orderpriority").alias("event"), (o * 1_000_003).alias("start_ns"), F.when(o % 7 > 0, o * 1_000_003 + c).alias("end_ns"), (o % 4).cast("decimal(20,0)").alias("depth"))
    out = telemetry.parse_traces(telemetry.trace_report(spans, 9 * SECOND, ["run"]), by=["run"])
    return out.withColumn("depth", F.col("depth").cast("bigint"))


@query("""SELECT o_orderkey, round(o_custkey * 1000.0 / (1 + o_orderkey % 9) + o_orderkey / 0.25, 4) AS write_bytes, round(2 * o_custkey * 1000.0 / (1 + o_orderkey % 9) + 2 * o_orderkey / 0.25, 4) AS both_bytes,
round((o_custkey + 5) * 1000.0 / (1 + o_orderkey % 9) + (o_orderkey + 5) / 0.25, 4) AS read_ios, round((o_custkey + 5) * 2000.0 / (1 + o_orderkey % 9) + 2 * (o_orderkey + 5) / 0.25, 4) AS both_ios FROM orders""")
def fio_outputs(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    side = lambda n, ms: F.struct(n.cast("double").alias("io_bytes"), (n + 5).cast("double").alias("total_ios"), ms.cast("double").alias("runtime"))
    job = lambda n, ms: F.struct(side(n, ms).alias("read"), side(n, ms).alias("write"))
    shown = table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.struct(F.array(job(c, 1 + o % 9), job(o, F.lit(250))).alias("jobs"))).alias("fio"))
    value = lambda ops, field: F.round(telemetry.fio_value(F.col("fio"), 2, ops, field), 4)
    return shown.select("o_orderkey", value("write", "io_bytes").alias("write_bytes"), value("both", "io_bytes").alias("both_bytes"), value("read", "total_ios").alias("read_ios"), value("both", "total_ios").alias("both_ios"))


@query("SELECT CAST(o_custkey * CASE o_orderkey % 3 WHEN 1 THEN 1 ELSE 1000 END AS DOUBLE) AS avg_us FROM orders WHERE o_orderkey % 3 > 0")
def ethr_outputs(spark, sf_dir):
    o = F.col("o_orderkey")
    shown = F.concat(_text("o_custkey"), F.when(o % 3 == 1, "us").otherwise("ms"))
    lines = table(spark, sf_dir, "orders").select(F.when(o % 3 == 0, '{"Message":"INFO"}').otherwise(F.to_json(F.struct(shown.alias("Avg")))).alias("value"))
    return telemetry.ethr_latencies(lines).select(F.round("avg_us", 3).alias("avg_us"))


@query("SELECT c_custkey AS run, round(c_custkey / 8.0, 4) AS seconds FROM customer")
def boot_times(spark, sf_dir):
    c = F.col("c_custkey")
    line = lambda code, at: F.concat(F.lit(f"cloud: {telemetry.BOOT_MARK} {code}] "), at.cast("string"), F.lit(" seconds"))
    lines = table(spark, sf_dir, "customer").select(c.alias("run"), F.explode(F.array(F.lit("other output"), line("0x41", c / 4), F.lit("0x40 0x41 5 seconds"), line("0x40", c / 8))).alias("value"))
    return telemetry.boot_seconds(lines, by=["run"]).withColumn("seconds", F.round("seconds", 4))


@query("SELECT user_id, CAST(min(event_id * 1000 + 0.5) AS DOUBLE) AS restore_ms FROM events WHERE event_type = 'click' GROUP BY user_id")
def restore_times(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") == "click", "restored").otherwise(F.col("event_type")).alias("event"), (F.col("event_id") * SECOND + 500_000).alias("ts_ns"))
    return telemetry.restore_ms(events, ["user_id"])


@query("""SELECT 'abc' AS revision, '2024-01-01' AS date, event_type AS name, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std_dev, max(value) AS max, min(value) AS min, 'PASSED' AS status FROM events GROUP BY event_type""")
def metrics_report(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), "value", F.lit(0).alias("iteration"))
    results = aggregates.benchmark_summary(events, ["name"], "iteration", "value").withColumns({c: F.round(c, 6) for c in ("mean", "std_dev")})
    report = telemetry.metrics_report(results, {"revision": "abc"}, "2024-01-01")
    schema = "revision string, date string, results array<struct<name:string,mean:double,std_dev:double,max:double,min:double,status:string>>"
    return report.select(F.from_json("value", schema).alias("r")).select("r.revision", "r.date", F.explode("r.results").alias("x")).select("revision", "date", "x.*")


@query("SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, o_orderkey * 4096 AS gpa, (1 + o_orderkey % 5) * 1000000007 AS length FROM orders")
def range_tables(spark, sf_dir):
    o = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", (o * 4096).alias("gpa"), ((1 + o % 5) * 1_000_000_007).alias("length"))
    out = binary.read_ranges(binary.write_ranges(rows, ["k"], "o_orderkey"))
    return out.select("k", F.col("pos").cast("bigint").alias("pos"), F.col("gpa").cast("bigint").alias("gpa"), F.col("length").cast("bigint").alias("length"))


def _little(value, width):
    digits = F.lpad(F.hex(value), 2 * width, "0")
    return F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in reversed(range(width))))


def _packed(rows, by, order, record):
    """by, content: the records (hexadecimal) of a key in order."""
    parts = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), record.alias("x")))).alias("r"))
    return parts.select(*by, F.unhex(F.array_join(F.transform("r", lambda x: x["x"]), "")).alias("content"))


@query("SELECT o_custkey AS k, " + ", ".join(f"max(o_orderkey) FILTER (o_orderkey % 18 = {k}) AS {name}" for k, name in enumerate(binary.BALLOON_TAGS)) + " FROM orders GROUP BY o_custkey")
def balloon_statistics(spark, sf_dir):
    o = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    out = binary.read_balloon(_packed(rows, ["k"], "o_orderkey", F.concat(_little(o % 18, 2), _little(o, 8))), ["k"])
    return out.select("k", *(F.col(c).cast("bigint").alias(c) for c in binary.BALLOON_TAGS))


@query("""SELECT p_partkey, CAST(p_size AS VARCHAR) AS version, p_brand AS kind, unnest(['RW', 'RDONLY']) AS access, unnest([p_partkey + 1, 10]) AS size_in_sectors, unnest(['FLAT', 'SPARSE']) AS extent_type,
unnest([p_name || '-flat.vmdk', 'x y.vmdk']) AS filename, unnest([0, p_partkey * 8]) AS offset_in_sectors FROM part""")
def vmdk_descriptors(spark, sf_dir):
    shown = F.concat(
        F.lit("# Disk DescriptorFile\nversion="), _text("p_size"), F.lit('\ncreateType="'), F.col("p_brand"), F.lit('"\nnonsense\n\n# Extent description\n\nRW '), _text(F.col("p_partkey") + 1), F.lit(' FLAT "'), F.col("p_name"),
        F.lit('-flat.vmdk"\n  RDONLY 10 SPARSE "x y.vmdk" '), _text(F.col("p_partkey") * 8), F.lit('\n\n# The Disk Data Base\n#DDB\nddb.adapterType = "ide"\n'),
    )
    d = table(spark, sf_dir, "part").select("p_partkey", binary.read_vmdk_descriptor(shown).alias("d"))
    return d.select("p_partkey", F.col("d.header")["version"].alias("version"), F.col("d.header")["createType"].alias("kind"), F.explode("d.extents").alias("e")).select("p_partkey", "version", "kind", "e.*")


@query("""SELECT o_custkey AS k, r - 1 AS pos, o_orderkey % 8 AS state, o_orderkey * 1048576 AS "offset" FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 5""")
def vhdx_tables(spark, sf_dir):
    o = F.col("o_orderkey")
    # 4 blocks and one bitmap after each 2 but the last
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    out = binary.read_vhdx_bat(_packed(rows, ["k"], "o_orderkey", _little(F.shiftleft(o, 20) + o % 8, 8)), 4, 2)
    return out.select("k", F.col("pos").cast("bigint").alias("pos"), F.col("state").cast("bigint").alias("state"), F.col("offset").cast("bigint").alias("offset"))


def _big(value, width):
    return F.lpad(F.hex(value.cast("bigint")), 2 * width, "0")


def _qcow2(rows):
    """rows with `content`: headers of version 2 or 3, two level-1 entries at 104 and three refcounts at 120."""
    p = F.col("p_partkey")
    one = lambda n: F.lit(n).cast("bigint")
    old = [F.lit("514649FB"), _big(2 + p % 2, 4), _big(one(0), 8), _big(one(0), 4), _big(one(16), 4), _big(p * 65536, 8), _big(one(0), 4), _big(one(2), 4), _big(one(104), 8), _big(one(120), 8), _big(one(1), 4), _big(one(0), 4), _big(one(0), 8)]
    new = [_big(p % 4, 8), _big(one(1), 8), _big(one(0), 8), _big(one(4), 4), _big(one(104), 4)]
    tables = [_big(p * 65536 + 1, 8), _big(p * 512, 8), *(_big(p % 7 + k, 2) for k in range(3))]
    return rows.withColumn("content", F.unhex(F.concat(*old, *new, *tables)))


@query("""SELECT p_partkey, 2 + p_partkey % 2 AS version, 16 AS cluster_bits, p_partkey * 65536 AS size, CASE WHEN p_partkey % 2 = 1 THEN p_partkey % 4 ELSE 0 END AS incompatible,
CASE WHEN p_partkey % 2 = 1 THEN 1 ELSE 0 END AS compatible, 4 AS refcount_order, CASE WHEN p_partkey % 2 = 1 THEN 104 ELSE 72 END AS header_size FROM part""")
def qcow2_headers(spark, sf_dir):
    rows = _qcow2(table(spark, sf_dir, "part").select("p_partkey")).withColumn("h", binary.qcow2_header(F.col("content")))
    return rows.select("p_partkey", *(F.col(f"h.{c}").cast("bigint").alias(c) for c in ("version", "cluster_bits", "size", "incompatible", "compatible", "refcount_order", "header_size")))


@query("""SELECT p_partkey, 'l1' AS kind, unnest([0, 1]) AS pos, unnest([p_partkey * 65536 + 1, p_partkey * 512]) AS entry FROM part
UNION ALL SELECT p_partkey, 'refcount', unnest([0, 1, 2]), unnest([p_partkey % 7, p_partkey % 7 + 1, p_partkey % 7 + 2]) FROM part""")
def qcow2_entries(spark, sf_dir):
    rows = _qcow2(table(spark, sf_dir, "part").select("p_partkey")).withColumn("h", binary.qcow2_header(F.col("content")))
    l1 = binary.qcow2_pointers(rows, F.col("h.l1_offset"), F.col("h.l1_size"))
    counts = binary.qcow2_refcounts(rows, F.col("h.refcount_offset"), F.lit(3), 4)
    return l1.select("p_partkey", F.lit("l1").alias("kind"), "pos", "entry").union(counts.select("p_partkey", F.lit("refcount"), "pos", F.col("refcount").cast("bigint")))


@query("SELECT p_brand AS file, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS item, p_name AS name, 'http://x/' || p_size AS url FROM part")
def asset_manifests(spark, sf_dir):
    lines = F.array(F.lit("# a comment"), F.concat(F.lit("- name: "), F.col("p_name")), F.concat(F.lit("  url: 'http://x/"), _text("p_size"), F.lit("'")), F.lit(""))
    files = table(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), "p_partkey", F.posexplode(lines).alias("i", "value")).withColumn("pos", F.col("p_partkey") * 10 + F.col("i"))
    return binary.parse_manifest(files, ["file"]).select("file", "item", F.col("entry")["name"].alias("name"), F.col("entry")["url"].alias("url"))


@query("SELECT p_partkey, p_partkey * 4096 AS gpa, p_partkey * 4096 + 7 AS hva, p_size AS size FROM part UNION ALL SELECT p_partkey, 0, 1, 2 FROM part")
def required_mappings(spark, sf_dir):
    at = F.col("p_partkey") * 4096
    one = lambda a, b, c: F.struct(a.cast("bigint").alias("gpa"), b.cast("bigint").alias("vm_addr"), c.cast("bigint").alias("size"))
    shown = F.to_json(F.struct(F.array(one(at, at + 7, F.col("p_size")), one(F.lit(0), F.lit(1), F.lit(2))).alias("guest_ram_mappings"), F.lit(1).alias("other")))
    m = table(spark, sf_dir, "part").select("p_partkey", F.explode(binary.required_mappings(shown)).alias("m"))
    return m.select("p_partkey", F.col("m.gpa").alias("gpa"), F.col("m.vm_addr").alias("hva"), F.col("m.size").alias("size"))


@query("""SELECT p_partkey, CAST(4294967295 - list_sum(list_transform(string_split(s[:64] || s[69:], ''), lambda c: ord(c))) AS BIGINT) AS sum
FROM (SELECT p_partkey, repeat(p_name || '/', 8) AS s FROM part)""")
def byte_checksums(spark, sf_dir):
    data = F.repeat(F.concat(F.col("p_name"), F.lit("/")), 8).cast("binary")
    return table(spark, sf_dir, "part").select("p_partkey", numbers.checksum(data).alias("sum"))


@query("""WITH RECURSIVE t AS (SELECT p_partkey, p_name || '+' || p_brand AS s FROM part), b AS (SELECT p_partkey, s, 0 AS i, CAST(4294967295 AS BIGINT) AS c FROM t
  UNION ALL SELECT p_partkey, s, i + 1, list_reduce(range(0, 8), lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 2197175160) ELSE x >> 1 END, xor(c, CAST(CASE WHEN i BETWEEN 4 AND 7 THEN 0 ELSE ord(s[i + 1:i + 1]) END AS BIGINT))) FROM b WHERE i < length(s))
SELECT p_partkey, xor(c, 4294967295) AS crc FROM b WHERE i = length(s)""")
def crc32c_checks(spark, sf_dir):
    data = F.concat(F.col("p_name"), F.lit("+"), F.col("p_brand")).cast("binary")
    return table(spark, sf_dir, "part").select("p_partkey", numbers.crc32c_without(data, 4).alias("crc"))


@query("""WITH w AS (SELECT DISTINCT o_custkey, o_orderkey % 63 AS i FROM orders)
SELECT o_custkey, min(i) * 4096 + 1048576 AS gpa, count(*) * 4096 AS length FROM (SELECT o_custkey, i, i - row_number() OVER (PARTITION BY o_custkey ORDER BY i) AS g FROM w) GROUP BY o_custkey, g""")
def dirty_ranges(spark, sf_dir):
    bits = F.bit_or(F.expr("shiftleft(1L, CAST(o_orderkey % 63 AS INT))"))
    words = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array(bits).alias("words")).withColumns({"start": F.lit(1 << 20).cast("bigint"), "page": F.lit(4096).cast("bigint")})
    return ranges.bitmap_ranges(words, ["o_custkey"], "words", "start", "page")


@query("SELECT o_orderkey, unnest(list_filter(range(0, 48), lambda i: ((o_orderkey * 5) >> i) & 1 = 1)) * 4096 + 65536 AS address FROM orders UNION ALL SELECT o_orderkey, 64 * 4096 + 65536 FROM orders")
def shared_pages(spark, sf_dir):
    words = F.array(F.col("o_orderkey") * 5, F.lit(1).cast("bigint"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(numbers.page_addresses(F.lit(65536).cast("bigint"), words, 4096)).alias("address"))


@query("SELECT o_custkey, i // 64 AS word, bit_or(CAST(1 AS BIGINT) << CAST(i % 64 AS INT)) AS bits FROM (SELECT o_custkey, o_orderkey % 3 * 64 + o_orderkey % 63 AS i FROM orders) GROUP BY 1, 2")
def bitmap_words(spark, sf_dir):
    o = F.col("o_orderkey")
    return ranges.flags_to_words(table(spark, sf_dir, "orders").select("o_custkey", (o % 3 * 64 + o % 63).alias("index")), ["o_custkey"], "index")


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'empty' WHEN 1 THEN 'compressed' WHEN 2 THEN 'zero' ELSE 'standard' END AS kind,
CASE o_orderkey % 4 WHEN 1 THEN o_orderkey * 700 + 3 WHEN 2 THEN o_orderkey * 65536 WHEN 3 THEN o_orderkey * 65536 END AS address,
CASE o_orderkey % 4 WHEN 1 THEN (o_orderkey % 200 + 1) * 512 - (o_orderkey * 700 + 3) % 512 END AS bytes FROM orders""")
def level2_entries(spark, sf_dir):
    o = F.col("o_orderkey")
    packed = F.lit(numbers.COMPRESSED_FLAG).bitwiseOR(F.shiftleft(o % 200, 54)).bitwiseOR(o * 700 + 3)
    entry = F.when(o % 4 == 0, F.lit(0).cast("bigint")).when(o % 4 == 1, packed).when(o % 4 == 2, numbers.make_l2_entry(o * 65536, zero=True)).otherwise(numbers.make_l2_entry(o * 65536))
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.l2_entry(entry).alias("e")).select("o_orderkey", "e.*")


@query("""SELECT o_custkey, round(sum(CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice ELSE 0 END), 4) AS total, CAST(sum(CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey ELSE 0 END) AS BIGINT) AS plugged, count(*) FILTER (o_orderkey % 2 = 0) AS active FROM orders GROUP BY 1""")
def fleet_totals(spark, sf_dir):
    o = F.col("o_orderkey")
    clients = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(o % 5 > 0, F.col("o_totalprice")).alias("rate"), F.when(o % 3 > 0, "device").alias("device"), F.when(o % 4 != 1, o % 2 == 0).alias("active"))
    return clients.groupBy("o_custkey").agg(F.round(aggregates.stream_total("rate"), 4).alias("total"), aggregates.plugged_size("o_orderkey", "device").alias("plugged"), aggregates.active_count("active").alias("active"))


@query("SELECT s_nationkey AS device_id, list_sort(list(k || '=' || v)) AS counters FROM (SELECT s_nationkey, 'c' || s_suppkey AS k, s_suppkey * 3 AS v FROM supplier WHERE s_suppkey % 4 > 0) GROUP BY 1")
def device_counter_maps(spark, sf_dir):
    s = F.col("s_suppkey")
    long = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("device_id"), F.concat(F.lit("c"), _text(s)).alias("counter"), F.when(s % 4 > 0, s * 3).alias("value"))
    out = aggregates.counter_maps(long)
    return out.select("device_id", F.array_sort(F.transform(F.map_entries("counters"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))).alias("counters"))


@query("SELECT o_orderkey, ['a' || o_custkey, 'b'] || CASE WHEN o_orderkey % 2 = 0 THEN ['\"c,d\"'] ELSE [] END AS strings FROM orders")
def string_lists(spark, sf_dir):
    shown = F.concat(F.lit("[a"), _text("o_custkey"), F.lit(",b"), F.when(F.col("o_orderkey") % 2 == 0, ',"c,d"').otherwise(""), F.lit("]"))
    return table(spark, sf_dir, "orders").select("o_orderkey", options.string_list(shown).alias("strings"))


@query("SELECT event_id, '{' || upper(event_type) || '} ' || user_id || ': ' || event_id % 7 || '%' AS line FROM events")
def log_lines(spark, sf_dir):
    tokens = {"level": F.upper("event_type"), "user": F.col("user_id"), "n": F.col("event_id") % 7}
    return table(spark, sf_dir, "events").select("event_id", text.log_line("{{{level}}} {user}: {n}%", tokens).alias("line"))


@query("""SELECT o_orderkey, printf('iter=%d curr=%dMiB total=%dMiB bw=%.2fMiB/s transfer=%.2fs overhead=%dms est_downtime=%dms elapsed=%.2fs avg_bw=%.2fMiB/s', o_orderkey % 9, (o_orderkey * 1000 + 1048575) // 1048576, o_custkey, o_custkey / 4.0, 1.5,
o_orderkey % 5, CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE o_custkey END, 2.25, 0.5) AS line FROM orders""")
def migration_lines(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    line = text.migration_line(o % 9, o * 1000, c * text.MIB, c * (text.MIB / 4), F.lit(1.5), o % 5, F.when(o % 9 > 0, c), F.lit(2.25), F.lit(text.MIB * 0.5))
    return table(spark, sf_dir, "orders").select("o_orderkey", line.alias("line"))


#: Adjuster -> its factor in SQL, and decimals that both engines' sums agree in.
_ADJUSTED = {"identity": ("1", 6), "s_to_us": ("1000000", 1), "bps_to_gbps": ("1 / 1e9", 15), "bytes_to_mib": ("1 / 1048576", 10)}


@query(f"""SELECT user_id, adjuster, CASE adjuster {" ".join(f"WHEN '{k}' THEN round(avg(value) * {f}, {d})" for k, (f, d) in _ADJUSTED.items())} END AS mean
FROM (SELECT *, {list(_ADJUSTED)}[1 + user_id % 4] AS adjuster FROM events) GROUP BY 1, 2""")
def adjusted_means(spark, sf_dir):
    kinds = F.array(*map(F.lit, _ADJUSTED))
    means = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("m")).withColumn("adjuster", F.element_at(kinds, (1 + F.col("user_id") % 4).cast("int")))
    value, mean = numbers.adjust(F.col("m"), F.col("adjuster")), F.lit(None).cast("double")
    for name, (_, decimals) in _ADJUSTED.items():
        mean = F.when(F.col("adjuster") == name, F.round(value, decimals)).otherwise(mean)
    return means.select("user_id", "adjuster", mean.alias("mean"))


@query("SELECT user_id, max(value) FILTER (event_id % 3 > 0) AS most, min(value) FILTER (event_id % 3 > 0) AS least FROM events GROUP BY 1")
def extremes_without_nan(spark, sf_dir):
    v = F.when(F.col("event_id") % 3 > 0, F.col("value")).otherwise(float("nan")).alias("v")
    return table(spark, sf_dir, "events").select("user_id", v).groupBy("user_id").agg(aggregates.largest("v").alias("most"), aggregates.smallest("v").alias("least"))


@query("SELECT o_custkey, o_orderkey, o_totalprice, previous FROM (SELECT *, lag(floor(o_totalprice / 1000)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous FROM orders) WHERE previous >= floor(o_totalprice / 1000)")
def counters_not_increasing(spark, sf_dir):
    snapshots = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.floor(F.col("o_totalprice") / 1000).cast("double").alias("counter"))
    return sequences.not_increasing(snapshots, ["o_custkey"], "o_orderkey", "counter").select("o_custkey", "o_orderkey", "o_totalprice", "previous")


@query("SELECT o_orderkey FROM orders")
def permuted_keys(spark, sf_dir):
    """The permutation has every key once; that its order isn't the keys' is held by a test."""
    return sequences.permutation(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")

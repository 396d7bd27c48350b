"""Event logs, traces, counter snapshots, outputs of benchmark tools, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import duration_ns, duration_us

DURATION = "struct<secs:bigint,nanos:int>"
EVENT = f"timestamp {DURATION}, source string, event string, properties map<string,string>"
TRACE = f"duration {DURATION}, events map<string, array<struct<timestamp:{DURATION}, event:string, end_timestamp:{DURATION}, depth:decimal(20,0)>>>"


def parse_events(texts: DataFrame, column: str = "value", strict: bool = False) -> DataFrame:
    """Events from JSON texts: ts_ns, source, event, properties. Blank texts are no events; a bad one is an error if
    `strict`, and else left out (the file may still be being written)."""
    rows = texts.where(F.trim(F.col(column)) != "")
    e = F.from_json(F.col(column), EVENT, {"mode": "FAILFAST" if strict else "PERMISSIVE"})
    out = rows.select(e.alias("e")).where("e.event IS NOT NULL" if not strict else "TRUE")
    return out.select(duration_ns(F.col("e.timestamp")).alias("ts_ns"), "e.source", "e.event", "e.properties")


def read_events(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """An event log: JSON objects with a blank line between them."""
    return parse_events(spark.read.text(path, lineSep="\n\n"), "value", strict)


def stamped(events: DataFrame, at_ns: str, begin_ns: Column) -> DataFrame:
    """Events with ts_ns, the time since the monitor's begin."""
    return events.withColumn("ts_ns", F.col(at_ns) - begin_ns)


def event_text(events: DataFrame) -> DataFrame:
    """Events as texts to write with lineSep two newlines: the source's format."""
    secs = F.expr("ts_ns div 1000000000").alias("secs")
    stamp = F.struct(secs, (F.col("ts_ns") % 1_000_000_000).cast("int").alias("nanos"))
    return events.select(F.to_json(F.struct(stamp.alias("timestamp"), "source", "event", "properties"), {"pretty": "true"}).alias("value"))


def write_events(events: DataFrame, path: str) -> None:
    event_text(events).write.text(path, lineSep="\n\n")


def parse_traces(texts: DataFrame, column: str = "value", by: Sequence[str] = ()) -> DataFrame:
    """Trace reports to spans: by (the run), thread, event, start_ns, end_ns (null for points), depth, total_ns."""
    t = texts.select(*by, F.from_json(F.col(column), TRACE).alias("t")).select(*by, duration_ns(F.col("t.duration")).alias("total_ns"), F.explode("t.events").alias("thread", "spans"))
    spans = t.select(*by, "total_ns", "thread", F.explode("spans").alias("s"))
    return spans.select(*by, "thread", "s.event", duration_ns(F.col("s.timestamp")).alias("start_ns"), duration_ns(F.col("s.end_timestamp")).alias("end_ns"), "s.depth", "total_ns")


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    return parse_traces(spark.read.text(path, wholetext=True))


def trace_report(spans: DataFrame, total_ns: int, by: Sequence[str] = ()) -> DataFrame:
    """by, value: one JSON report of all spans of a run, by thread in time order."""
    as_duration = lambda c: F.when(c.isNotNull(), F.struct(F.floor(c / 1_000_000_000).cast("bigint").alias("secs"), (c % 1_000_000_000).cast("int").alias("nanos")))
    s = F.struct(as_duration(F.col("start_ns")).alias("timestamp"), "event", as_duration(F.col("end_ns")).alias("end_timestamp"), "depth")
    threads = spans.groupBy(*by, "thread").agg(F.array_sort(F.collect_list(F.struct("start_ns", s.alias("s")))).alias("l")).select(*by, "thread", F.transform("l", lambda x: x["s"]).alias("l"))
    report = threads.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("thread", "l"))).alias("events"))
    return report.select(*by, F.to_json(F.struct(as_duration(F.lit(total_ns)).alias("duration"), "events")).alias("value"))


def parse_counters(texts: DataFrame, column: str = "value") -> DataFrame:
    """Counter snapshots to rows: device_id, counter, value decimal(20,0)."""
    m = F.from_json(F.col(column), "map<string, map<string, decimal(20,0)>>")
    return texts.select(F.explode(m).alias("device_id", "c")).select("device_id", F.explode("c").alias("counter", "value"))


def required(value: Column, what: str) -> Column:
    return F.coalesce(value, F.raise_error(F.lit(f"missing {what}")).cast("double"))


IPERF = "end struct<sum_sent:struct<bits_per_second:double>, sum_received:struct<bits_per_second:double>, sum:struct<packets:double,lost_packets:double,seconds:double>>"


def iperf_value(text: Column, sender: bool = True, what: str = "bandwidth") -> Column:
    """Bits a second of the sender or receiver, or packets a second that weren't lost. A missing field is an error."""
    end = F.from_json(text, IPERF)["end"]
    if what == "bandwidth":
        return required(end["sum_sent" if sender else "sum_received"]["bits_per_second"], "bits_per_second")
    return required((end["sum"]["packets"] - end["sum"]["lost_packets"]) / end["sum"]["seconds"], "packets, lost_packets or seconds")


_FIO = "struct<io_bytes:double,total_ios:double,runtime:double>"
FIO = f"jobs array<struct<read:{_FIO},write:{_FIO}>>"


def fio_value(text: Column, jobs: int, ops: str = "read", field: str = "io_bytes") -> Column:
    """Sum over the jobs of bytes (or total_ios) a second; ops: read, write or both. Another number of jobs is an error."""
    j = F.from_json(text, FIO)["jobs"]
    kinds = ("read", "write") if ops == "both" else (ops,)
    rate = lambda x: sum((required(x[k][field] / (x[k]["runtime"] / 1000), f"{field} or runtime") for k in kinds), F.lit(0.0))
    total = F.aggregate(F.transform(j, rate), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(j) == jobs, total).otherwise(F.raise_error(F.lit("unexpected number of jobs")).cast("double"))


def ethr_latencies(lines: DataFrame, column: str = "value") -> DataFrame:
    """Average latencies in µs from lines of JSON that have a string Avg."""
    avg = F.get_json_object(F.col(column), "$.Avg")
    return lines.select(duration_us(avg).alias("avg_us")).where("avg_us IS NOT NULL")


BOOT_MARK = "Debug I/O port: Kernel code"


def boot_seconds(lines: DataFrame, column: str = "value", by: Sequence[str] = ()) -> DataFrame:
    """by, seconds: a row for each run with boot lines, from code 0x40 to code 0x41. There must be just one line of each."""
    marked = lines.where(F.contains(F.col(column), F.lit(BOOT_MARK)))
    code = F.regexp_extract(F.col(column), r"(0x4[01])", 1)
    at = F.regexp_extract(F.col(column), r"(\d+(?:\.\d+)?)\s+seconds", 1).try_cast("double")
    t = marked.select(*by, code.alias("code"), at.alias("at")).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("code") == "0x40", F.col("at"))).alias("a"), F.max(F.when(F.col("code") == "0x41", F.col("at"))).alias("b"))
    fine = (F.col("n") == 2) & F.col("a").isNotNull() & F.col("b").isNotNull()
    return t.select(*by, F.when(fine, F.col("b") - F.col("a")).otherwise(F.raise_error(F.lit("expected two boot lines")).cast("double")).alias("seconds"))


def restore_ms(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, restore_ms: milliseconds of the first event named restored."""
    return events.where("event = 'restored'").groupBy(*by).agg((F.min("ts_ns") / 1_000_000).alias("restore_ms"))


def metrics_report(results: DataFrame, git: dict[str, str], date: str) -> DataFrame:
    """One row with the JSON report of a summary (name, mean, std_dev, max, min, status)."""
    fields = ("name", "mean", "std_dev", "max", "min", "status")
    rows = results.agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("results"))
    return rows.select(F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in git.items()), F.lit(date).alias("date"), "results"), {"pretty": "true"}).alias("value"))

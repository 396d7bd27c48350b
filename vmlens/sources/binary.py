"""Binary tables and disk descriptors, decoded with column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import le_unsigned


def _records(df: DataFrame, data: str, width: int, what: str) -> DataFrame:
    """df with pos (from 0) for every record; a length that isn't a multiple of the width is an error."""
    n = F.octet_length(data)
    fine = F.when(n % width == 0, n / width).otherwise(F.raise_error(F.lit(f"{what}: length is not a multiple of {width}")).cast("double")).cast("int")
    return df.withColumn("__n", fine).where("__n > 0").withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("__n") - 1))).drop("__n")


def read_ranges(df: DataFrame, data: str = "content") -> DataFrame:
    """Little-endian (u64, u64) rows to pos, gpa, length."""
    rows = _records(df, data, 16, "range table")
    return rows.select(*(c for c in df.columns if c != data), "pos", le_unsigned(F.col(data), F.col("pos") * 16 + 1, 8).alias("gpa"), le_unsigned(F.col(data), F.col("pos") * 16 + 9, 8).alias("length"))


def _le_bytes(value: Column, width: int = 8) -> Column:
    digits = F.lpad(F.conv(value.cast("string"), 10, 16), 2 * width, "0")
    return F.unhex(F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in reversed(range(width)))))


def write_ranges(df: DataFrame, by: list[str], order: str, gpa: str = "gpa", length: str = "length") -> DataFrame:
    """by, content: the ranges of a key as the table that read_ranges() reads."""
    row = F.concat(_le_bytes(F.col(gpa)), _le_bytes(F.col(length)))
    parts = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.hex(row).alias("x")))).alias("r"))
    return parts.select(*by, F.unhex(F.array_join(F.transform("r", lambda x: x["x"]), "")).alias("content"))


#: Tags 0 to 15 of memory statistics, in order (fixed by the device).
BALLOON_TAGS = ["swap_in", "swap_out", "major_faults", "minor_faults", "free_memory", "total_memory", "available_memory", "disk_caches", "hugetlb_allocations", "hugetlb_failures", "oom_kills", "alloc_stalls", "async_scans", "direct_scans", "async_reclaims", "direct_reclaims"]


def read_balloon(df: DataFrame, by: list[str], data: str = "content") -> DataFrame:
    """(tag u16, value u64) rows to one wide row: unknown tags are left out, the last of equal tags counts."""
    rows = _records(df, data, 10, "statistics")
    tags = rows.select(*by, "pos", le_unsigned(F.col(data), F.col("pos") * 10 + 1, 2).cast("int").alias("tag"), le_unsigned(F.col(data), F.col("pos") * 10 + 3, 8).alias("val"))
    return tags.groupBy(*by).agg(*(F.max_by(F.when(F.col("tag") == k, F.col("val")), F.when(F.col("tag") == k, F.col("pos"))).alias(name) for k, name in enumerate(BALLOON_TAGS)))


def read_vmdk_descriptor(text: Column) -> Column:
    """struct(header map, extents): header k=v lines up to the first comment, then the extents up to the disk data base.

    An extent is `access sectors type "file" [offset]`; anything else between is an error."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x))
    first = F.when(F.get(lines, F.lit(0)) == "# Disk DescriptorFile", lines).otherwise(F.raise_error(F.lit("no descriptor header")).cast("array<string>"))
    body = F.slice(first, 2, F.greatest(F.size(first) - 1, F.lit(0)))
    comment = F.coalesce(F.array_position(F.transform(body, lambda x: x.startswith("#")), True), F.lit(0))
    ddb = F.array_position(F.transform(body, lambda x: x.startswith("# The Disk Data Base")), True)
    end = F.when(ddb > 0, ddb).otherwise(F.size(body) + 1)
    header = F.filter(F.slice(body, F.lit(1), F.greatest(comment - 1, F.lit(0)).cast("int")), lambda x: F.contains(x, F.lit("=")))
    entries = F.transform(header, lambda x: F.struct(F.trim(F.split(x, "=", 2)[0]), F.trim(F.split(x, "=", 2)[1], F.lit(' "'))))
    rest = F.filter(F.slice(body, F.greatest(comment, F.lit(1)).cast("int"), F.greatest(end - comment, F.lit(0)).cast("int")), lambda x: (x != "") & ~x.startswith("#"))
    pattern = r'^(RW|RDONLY|NOACCESS)\s+(\d+)\s+(\S+)\s+"([^"]*)"(?:\s+(\d+))?$'
    part = lambda x, i: F.regexp_extract(x, pattern, i)
    extent = lambda x: F.when(
        x.rlike(pattern),
        F.struct(part(x, 1).alias("access"), part(x, 2).cast("bigint").alias("size_in_sectors"), part(x, 3).alias("extent_type"), part(x, 4).alias("filename"), F.coalesce(part(x, 5).try_cast("bigint"), F.lit(0)).cast("bigint").alias("offset_in_sectors")),
    ).otherwise(F.raise_error(F.concat(F.lit("bad extent: "), x)).cast("struct<access:string,size_in_sectors:bigint,extent_type:string,filename:string,offset_in_sectors:bigint>"))
    return F.struct(F.map_from_entries(entries).alias("header"), F.transform(rest, extent).alias("extents"))


def read_vhdx_bat(df: DataFrame, blocks: int, chunk_ratio: int, data: str = "content") -> DataFrame:
    """Block allocation table: pos, state (low 3 bits), offset (the bits from 20 on). Its length gives n = blocks + bitmaps."""
    n = blocks + (blocks - 1) // chunk_ratio
    rows = _records(df, data, 8, "block allocation table").where(F.col("pos") < n)
    entry = le_unsigned(F.col(data), F.col("pos") * 8 + 1, 8)
    state = (entry % 8).cast("int")
    return rows.select(*(c for c in df.columns if c != data), "pos", state.alias("state"), (entry - entry % (1 << 20)).cast("decimal(20,0)").alias("offset"))


def _be(data: Column, at: int, width: int) -> Column:
    return F.conv(F.hex(F.substring(data, at + 1, width)), 16, 10).cast("decimal(20,0)")


def image_type(data: Column) -> Column:
    """By magic: qcow2, vhdx, vhd (footer at the end) or raw."""
    return F.when(F.hex(F.substring(data, 1, 4)) == "514649FB", "qcow2").when(F.substring(data, 1, 8) == F.lit(b"vhdxfile"), "vhdx").when(F.substring(data, F.greatest(F.octet_length(data) - 511, F.lit(1)), F.lit(8)) == F.lit(b"conectix"), "vhd").otherwise("raw")


#: Fields of the header, (offset, bytes), and those that version 3 added (fixed by the format).
QCOW2_FIELDS = {"version": (4, 4), "backing_offset": (8, 8), "backing_size": (16, 4), "cluster_bits": (20, 4), "size": (24, 8), "l1_size": (36, 4), "l1_offset": (40, 8), "refcount_offset": (48, 8), "refcount_clusters": (56, 4)}
QCOW2_V3_FIELDS = {"incompatible": (72, 8), "compatible": (80, 8), "autoclear": (88, 8), "refcount_order": (96, 4), "header_size": (100, 4)}


def qcow2_header(data: Column) -> Column:
    """The big-endian fields; null for other files. A version 2 file has what version 3 stands for without its fields:
    no feature bits, refcounts of 16 bits and 72 bytes of header."""
    fields = [_be(data, a, w).alias(k) for k, (a, w) in QCOW2_FIELDS.items()]
    old = {"refcount_order": 4, "header_size": 72}
    new = [F.when(_be(data, 4, 4) >= 3, _be(data, a, w)).otherwise(F.lit(old.get(k, 0))).cast("decimal(20,0)").alias(k) for k, (a, w) in QCOW2_V3_FIELDS.items()]
    return F.when(image_type(data) == "qcow2", F.struct(*fields, *new))


def qcow2_refcounts(df: DataFrame, offset: Column, count: Column, order: int = 4, data: str = "content") -> DataFrame:
    """pos, refcount of a block of big-endian counters of 2 to the `order` bits (8 at least) in the file."""
    width = (1 << order) // 8
    rows = df.withColumn("__o", offset.cast("bigint")).where(count > 0).withColumn("pos", F.explode(F.sequence(F.lit(0).cast("bigint"), count.cast("bigint") - 1)))
    digits = F.hex(F.substring(F.col(data), (F.col("__o") + F.col("pos") * width + 1).cast("int"), F.lit(width)))
    return rows.select(*(c for c in df.columns if c != data), "pos", F.conv(digits, 16, 10).cast("decimal(20,0)").alias("refcount"))


def qcow2_pointers(df: DataFrame, offset: Column, count: Column, data: str = "content") -> DataFrame:
    """pos, entry (bigint bits) of a table of big-endian u64 pointers in the file."""
    rows = df.withColumn("__o", offset.cast("bigint")).where(count > 0).withColumn("pos", F.explode(F.sequence(F.lit(0).cast("bigint"), count.cast("bigint") - 1)))
    digits = F.hex(F.substring(F.col(data), (F.col("__o") + F.col("pos") * 8 + 1).cast("int"), F.lit(8)))
    return rows.select(*(c for c in df.columns if c != data), "pos", F.conv(digits, 16, -10).cast("bigint").alias("entry"))


def parse_manifest(lines: DataFrame, by: list[str], order: str = "pos", column: str = "value") -> DataFrame:
    """A flat YAML list of maps ("- key: value", then "  key: value") to rows: by, item, entry map. by: the file."""
    from pyspark.sql import Window

    t = lines.where((F.trim(column) != "") & ~F.trim(column).startswith("#"))
    item = F.sum(F.when(F.col(column).rlike(r"^\s*-\s"), 1).otherwise(0)).over(Window.partitionBy(*by).orderBy(order))
    pattern = r"""^\s*(?:-\s+)?([^:]+?)\s*:\s*["']?(.*?)["']?\s*$"""
    kv = t.select(*by, item.alias("item"), F.struct(F.regexp_extract(column, pattern, 1).alias("k"), F.regexp_extract(column, pattern, 2).alias("v")).alias("kv")).where("kv.k <> '' AND item > 0")
    return kv.groupBy(*by, "item").agg(F.map_from_entries(F.collect_list("kv")).alias("entry"))


def required_mappings(text: Column) -> Column:
    """array<struct(gpa, hva, size)> of the JSON field guest_ram_mappings; its absence is an error."""
    m = F.from_json(text, "guest_ram_mappings array<struct<gpa:bigint,vm_addr:bigint,size:bigint>>")["guest_ram_mappings"]
    return F.coalesce(m, F.raise_error(F.lit("missing guest_ram_mappings")).cast("array<struct<gpa:bigint,vm_addr:bigint,size:bigint>>"))

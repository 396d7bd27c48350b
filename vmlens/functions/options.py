"""Option strings: comma lists with quotes and nested brackets, key=value options and typed values. No UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _tokens(text: Column, special: str) -> Column:
    """The text in pieces: each special character by itself, and the runs between them."""
    return F.regexp_extract_all(text, F.lit(f"[^{special}]+|[{special}]"), F.lit(0))


def split_commas(text: Column) -> Column:
    """array<string>: split at commas outside quotes and brackets; null if quotes or brackets don't balance.

    Within quotes only the quote is special. Every part keeps its quotes; a blank text is one empty part.
    """
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("bad"), F.array(F.lit("")).alias("parts"))

    def step(s: Column, c: Column) -> Column:
        quote, plain = c == '"', ~s["quoted"]
        cut = plain & (c == ",") & (s["depth"] == 0)
        opened = F.when(plain & (c == "["), 1).when(plain & (c == "]"), -1).otherwise(0)
        last = F.element_at(s["parts"], -1)
        grown = F.concat(F.slice(s["parts"], 1, F.size(s["parts"]) - 1), F.array(F.concat(last, c)))
        return F.struct(
            (s["depth"] + opened).alias("depth"),
            (s["quoted"] != quote).alias("quoted"),
            (s["bad"] | (s["depth"] + opened < 0)).alias("bad"),
            F.when(cut, F.concat(s["parts"], F.array(F.lit("")))).otherwise(grown).alias("parts"),
        )

    t = F.trim(text)
    nested = F.aggregate(_tokens(t, r"\",\[\]"), start, step, lambda s: F.when(~s["bad"] & ~s["quoted"] & (s["depth"] == 0), s["parts"]))
    return F.when(t.rlike(r'["\[\]]'), nested).otherwise(F.split(t, ","))


def dequote(text: Column) -> Column:
    """Quotes removed; two quotes that open where the last one closed give one."""
    start = F.struct(F.lit("").alias("prev"), F.lit(False).alias("quoted"), F.lit("").alias("out"))

    def step(s: Column, c: Column) -> Column:
        quote = c == '"'
        added = F.when(~quote, c).when((s["prev"] == '"') & ~s["quoted"], '"').otherwise("")
        return F.struct(c.alias("prev"), (s["quoted"] != quote).alias("quoted"), F.concat(s["out"], added).alias("out"))

    return F.when(F.contains(text, F.lit('"')), F.aggregate(_tokens(text, '"'), start, step, lambda s: s["out"])).otherwise(text)


def parse_options(text: Column, keys: list[str], flags: list[str] = (), subset: bool = False) -> Column:
    """map<string,string> of the options set: `keys` need a value, `flags` don't. Later ones win; blank input sets none.

    Null for unbalanced input, a key without "=" and (unless `subset`) an unknown name. Names are exact, values trimmed.
    """

    def body(parts: Column) -> Column:
        pairs = F.transform(parts, lambda p: F.struct(F.split(p, "=", 2)[0].alias("k"), F.get(F.split(p, "=", 2), F.lit(1)).alias("v")))
        known = lambda p: p["k"].isin(*keys, *flags) if keys or flags else F.lit(False)
        bad = F.exists(pairs, lambda p: (p["k"].isin(*keys) & p["v"].isNull()) if keys else F.lit(False))
        bad = bad | (F.lit(False) if subset else F.exists(pairs, lambda p: ~known(p)))
        kept = F.filter(pairs, known)
        # the last of equal names
        last = F.filter(kept, lambda p, i: ~F.exists(F.slice(kept, i + 2, F.size(kept)), lambda q: q["k"] == p["k"]))
        value = lambda p: F.when(p["k"].isin(*flags), "").otherwise(F.trim(p["v"])) if flags else F.trim(p["v"])
        return F.when(parts.isNotNull() & ~bad, F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], value(p)))))

    empty = F.from_json(F.lit("{}"), "map<string,string>")
    return F.when(F.trim(text) == "", empty).otherwise(_let(split_commas(text), body))


def option(options: Column, name: str) -> Column:
    """Value of an option, dequoted; null if it isn't set or empty."""
    value = F.try_element_at(options, F.lit(name))
    return F.when(value != "", dequote(value))


def is_set(options: Column, name: str) -> Column:
    return F.map_contains_key(options, name)


def byte_size(text: Column) -> Column:
    """bigint bytes: digits with K, M or G after them (upper case; all of them are stripped, the last one counts)."""
    t = F.trim(text)
    shift = F.when(t.endswith("K"), 1 << 10).when(t.endswith("M"), 1 << 20).when(t.endswith("G"), 1 << 30).otherwise(1).cast("decimal(20,0)")
    digits = F.regexp_extract(t, r"^\+?(\d{1,20})[KMG]*$", 1)
    number = F.when(digits != "", digits.cast("decimal(20,0)"))
    # high bits are shifted out of 64
    wrapped = (number * shift) % F.lit("18446744073709551616").cast("decimal(20,0)")
    signed = F.when(wrapped > F.lit("9223372036854775807").cast("decimal(20,0)"), wrapped - F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(wrapped)
    return F.when(number <= F.lit("18446744073709551615").cast("decimal(20,0)"), signed.cast("bigint"))


def toggle(text: Column) -> Column:
    """on, true / off, false, empty; case doesn't matter."""
    t = F.lower(text)
    return F.when(t.isin("on", "true"), True).when(t.isin("off", "false", ""), False)


def _unbracket(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"^[\[\]]+|[\[\]]+$", "")


def integer_list(text: Column, bits: int = 63) -> Column:
    """array<bigint>: numbers and a-b ranges (a < b) in order, repeats kept; null if any part is invalid or too wide."""
    most = (1 << bits) - 1

    def body(parts: Column) -> Column:
        fine = F.forall(parts, lambda p: p.rlike(r"^\+?\d{1,18}(-\+?\d{1,18})?$"))
        ends = F.transform(parts, lambda p: F.transform(F.split(p, "-"), lambda x: x.cast("bigint")))
        sound = F.forall(ends, lambda e: F.when(F.size(e) == 2, e[0] < F.get(e, F.lit(1))).otherwise(F.lit(True)) & (F.element_at(e, -1) <= most))
        return F.when(fine, F.when(sound, F.flatten(F.transform(ends, lambda e: F.sequence(e[0], F.element_at(e, -1))))))

    return _let(F.split(_unbracket(text), ","), body)


def format_integer_list(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(values.cast("array<string>"), ","), F.lit("]"))


def string_list(text: Column) -> Column:
    """array<string>, brackets optional, parts not dequoted."""
    return split_commas(_unbracket(text))


def pair(text: Column) -> Column:
    """struct(key, value) of key@value with one @ outside quotes and a key; null otherwise. Both are as written."""
    t = F.trim(text)
    start = F.struct(F.lit(False).alias("quoted"), F.lit(0).alias("ats"), F.lit(-1).alias("at"), F.lit(0).alias("i"))

    def step(s: Column, c: Column) -> Column:
        at = (c == "@") & ~s["quoted"]
        return F.struct((s["quoted"] != (c == '"')).alias("quoted"), (s["ats"] + at.cast("int")).alias("ats"), F.when(at, s["i"]).otherwise(s["at"]).alias("at"), (s["i"] + F.length(c)).alias("i"))

    found = F.aggregate(_tokens(t, '"@'), start, step, lambda s: F.when((s["ats"] == 1) & (s["at"] > 0), s["at"]))
    return _let(found, lambda at: F.when(at.isNotNull(), F.struct(F.substring(t, F.lit(1), at).alias("key"), t.substr(at + 2, F.length(t)).alias("value"))))


def pair_list(text: Column) -> Column:
    """array<struct(key, value)> of [k@v,...]; the outer brackets are needed; null if any part is invalid."""
    t = F.trim(text)
    inner = F.when(t.startswith("[") & t.endswith("]") & (F.length(t) >= 2), t.substr(F.lit(2), F.length(t) - 2))
    pairs = F.transform(split_commas(inner), lambda p: pair(p))
    return _let(pairs, lambda ps: F.when(F.forall(ps, lambda p: p.isNotNull()), ps))


#: Options that many sections have, as "key type" (fixed values, like those of SECTIONS).
_DEVICE = "id text, pci_segment int, pci_device_id int"
_IOMMU = f"{_DEVICE}, iommu toggle"
_LIMITER = "bw_size int, bw_one_time_burst int, bw_refill_time int, ops_size int, ops_one_time_burst int, ops_refill_time int"
_MEMORY = "size bytes, file text, shared toggle, hugepages toggle, hugepage_size bytes, hotplug_size bytes, hotplugged_size bytes, prefault toggle, reserve toggle, mergeable toggle"
_CONSOLE = "off flag, pty flag, tty flag, null flag, file text, socket text"

#: Section -> its options and their types: text, int, bytes, toggle, ints, strings, pairs, or flag (one without a value).
SECTIONS: dict[str, str] = {
    "cpus": "boot int, max int, topology text, kvm_hyperv toggle, max_phys_bits int, affinity pairs, features strings, nested toggle, core_scheduling text, profile text",
    "pci-segment": "mmio32_aperture_weight int, mmio64_aperture_weight int, pci_segment int",
    "platform": "num_pci_segments int, iommu_segments ints, iommu_address_width int, serial_number text, uuid text, oem_strings strings, iommufd toggle, iommufd_fd int, vfio_p2p_dma toggle, tdx toggle, sev_snp toggle",
    "memory": f"{_MEMORY}, hotplug_method text, thp toggle",
    "memory-zone": f"id text, {_MEMORY}, host_numa_node int",
    "rate-limit-group": f"{_LIMITER}, id text",
    "disk": f"path text, readonly toggle, direct toggle, queue_size int, num_queues int, vhost_user toggle, socket text, _disable_io_uring toggle, _disable_aio toggle, serial text, rate_limit_group text, queue_affinity pairs, backing_files toggle, sparse toggle, image_type text, lock_granularity text, guest_block_size int, {_LIMITER}, {_IOMMU}",
    "net": f"tap text, ip text, mask text, mac text, host_mac text, offload_tso toggle, offload_ufo toggle, offload_csum toggle, mtu int, queue_size int, num_queues int, vhost_user toggle, socket text, vhost_mode text, fd ints, {_LIMITER}, {_IOMMU}",
    "rng": f"src text, {_IOMMU}",
    "rtc": _IOMMU,
    "balloon": f"size bytes, deflate_on_oom toggle, free_page_reporting toggle, {_IOMMU}",
    "generic-vhost-user": f"device_type text, virtio_id text, queue_sizes ints, socket text, {_DEVICE}",
    "fs": f"tag text, queue_size int, num_queues int, socket text, {_DEVICE}",
    "fw-cfg": "e820 toggle, kernel toggle, cmdline toggle, initramfs toggle, acpi_table toggle, items text",
    "fw-cfg-item": "name text, file text, string text",
    "pmem": f"size bytes, file text, discard_writes toggle, {_IOMMU}",
    "console": f"{_CONSOLE}, {_IOMMU}",
    "serial": _CONSOLE,
    "debug-console": "off flag, pty flag, tty flag, null flag, file text, iobase text",
    "device": f"path text, fd int, x_nv_gpudirect_clique int, x_exclude_mmap_bars ints, {_IOMMU}",
    "user-device": f"socket text, {_DEVICE}",
    "vdpa": f"path text, num_queues int, {_IOMMU}",
    "vsock": f"socket text, cid int, {_IOMMU}",
    "numa": "guest_numa_id int, cpus ints, distances pairs, device_id text, memory_zones strings, pci_segments ints",
    "restore": "source_url text, prefault toggle, memory_restore_mode text, net_fds pairs, vfio_fds pairs, iommufd_fd int, resume toggle, zone_updates pairs",
    "tpm": "socket text",
    "landlock": "path text, access text",
    "ivshmem": f"path text, size bytes, {_DEVICE}",
}


def section_types(section: str) -> dict[str, str]:
    return dict(x.split(" ") for x in SECTIONS[section].split(", "))


def parse_section(section: str, text: Column, subset: bool = False) -> Column:
    """map<string,string> of a section's options, as parse_options()."""
    types = section_types(section)
    return parse_options(text, [k for k, t in types.items() if t != "flag"], [k for k, t in types.items() if t == "flag"], subset)


def _typed(kind: str, value: Column) -> Column:
    if kind == "int":
        return value.try_cast("bigint")
    return {"bytes": byte_size, "toggle": toggle, "ints": integer_list, "strings": string_list, "pairs": pair_list, "text": lambda x: x}[kind](value)


#: Types whose lists and pairs are taken before quotes are removed.
_RAW = ("strings", "pairs")


def typed_section(section: str, text: Column) -> Column:
    """A struct of all options of a section in their types (null: not set; flags are booleans) and `problem`: the options
    whose value isn't of its type, joined by commas, or "syntax"."""

    def body(o: Column) -> Column:
        raw = lambda k: F.try_element_at(o, F.lit(k))
        given = lambda k, t: F.when(raw(k) != "", raw(k) if t in _RAW else dequote(raw(k)))
        types = section_types(section)
        fields = {k: F.coalesce(is_set(o, k), F.lit(False)) if t == "flag" else _typed(t, given(k, t)) for k, t in types.items()}
        wrong = [F.when(given(k, t).isNotNull() & fields[k].isNull(), k) for k, t in types.items() if t not in ("flag", "text")]
        problem = F.when(o.isNull(), "syntax").otherwise(F.nullif(F.concat_ws(",", *wrong), F.lit("")))
        return F.struct(*(v.alias(k) for k, v in fields.items()), problem.alias("problem"))

    return _let(parse_section(section, text), body)

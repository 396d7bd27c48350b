"""Units, integer and bit arithmetic. u64 numbers are decimal(20,0), u64 bit sets bigint in two's complement."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: 2 to the 64th.
U64 = "18446744073709551616"


def duration_us(text: Column) -> Column:
    """Microseconds of "1.5ms" and the like: ns, us, µs, ms, s; null otherwise."""
    pattern = r"^\s*([0-9]+(?:\.[0-9]+)?)\s*(µs|us|ns|ms|s)\s*$"
    unit = F.regexp_extract(text, pattern, 2)
    factor = F.when(unit == "ns", 1e-3).when(unit.isin("us", "µs"), 1.0).when(unit == "ms", 1e3).when(unit == "s", 1e6)
    return F.when(factor.isNotNull(), F.regexp_extract(text, pattern, 1).try_cast("double") * factor)


#: Unit adjusters; each is a scaling, so mean, deviation and extremes may be adjusted after aggregation.
ADJUSTERS = {"identity": 1.0, "s_to_ms": 1e3, "s_to_us": 1e6, "bps_to_gbps": 1 / 1e9, "bytes_to_mib": 1 / (1 << 20)}


def adjust(value: Column, adjuster: Column) -> Column:
    out = value
    for name, factor in ADJUSTERS.items():
        if name != "identity":
            out = F.when(adjuster == name, value * factor).otherwise(out)
    return out


def duration_ns(d: Column) -> Column:
    """bigint nanoseconds of struct(secs, nanos)."""
    return d["secs"].cast("bigint") * 1_000_000_000 + d["nanos"].cast("bigint")


def floor_ms(ns: Column) -> Column:
    return F.floor(ns / 1_000_000).cast("bigint")


def gcd(a: Column, b: Column) -> Column:
    """Euclid in at most 93 steps (bigint)."""
    start = F.struct(F.abs(a.cast("bigint")).alias("x"), F.abs(b.cast("bigint")).alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), F.try_mod(s["x"], s["y"]).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, step, lambda s: s["x"])


def align_down(x: Column, to: Column) -> Column:
    return x - F.pmod(x, to)


def align_up(x: Column, to: Column) -> Column:
    return x + F.pmod(-x, to)


def is_aligned(x: Column, to: Column) -> Column:
    return F.pmod(x, to) == 0


def is_power_of_two(x: Column) -> Column:
    return (x > 0) & (F.bit_count(x) == 1)


def int_div(a: Column, b: Column) -> Column:
    """Integer division, truncating."""
    return F.try_divide(a.cast("decimal(20,0)") - F.try_mod(a.cast("decimal(20,0)"), b.cast("decimal(20,0)")), b.cast("decimal(20,0)")).cast("bigint")


def div_round_up(a: Column, b: Column) -> Column:
    return int_div(a + b - 1, b)


def bandwidth(num_bytes: Column, seconds: Column) -> Column:
    """Bytes a second; 0 for no time."""
    return F.when(seconds > 0, num_bytes / seconds).otherwise(F.lit(0.0))


def within_tolerance(value: Column, target: Column, tolerance: float) -> Column:
    """Strictly between target * (1 - t) and target * (1 + t)."""
    return (value > target * (1 - tolerance)) & (value < target * (1 + tolerance))


def inclusive_end(base: Column, size: Column) -> Column:
    """base + size - 1 as decimal(20,0); null for size 0 or an end beyond 64 bits."""
    end = base.cast("decimal(20,0)") + size.cast("decimal(20,0)") - 1
    return F.when((size > 0) & (end < F.lit(U64).cast("decimal(21,0)")), end.cast("decimal(20,0)"))


def wrapping_delta(later: Column, earlier: Column) -> Column:
    """Increase of a u64 counter that may have wrapped once (decimal)."""
    d = later.cast("decimal(21,0)") - earlier.cast("decimal(21,0)")
    return F.when(d < 0, d + F.lit(U64).cast("decimal(21,0)")).otherwise(d).cast("decimal(20,0)")


def bit_positions(word: Column) -> Column:
    """array<int> of the set bits, lowest first."""
    return F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(word.cast("bigint"), i) == 1)


def has_feature(mask: Column, bit: Column) -> Column:
    return F.getbit(mask.cast("bigint"), bit) == 1


def page_addresses(base: Column, words: Column, page_size: int) -> Column:
    """array<bigint> of the addresses of pages whose bit is set in an array of 64-bit words."""
    per = F.transform(words, lambda w, k: F.transform(bit_positions(w), lambda i: base + (k.cast("bigint") * 64 + i) * page_size))
    return F.flatten(per)


def split_index(cluster: Column, entries: int) -> Column:
    """struct(l1, l2): which table, and which of its entries."""
    return F.struct(F.shiftright(cluster, entries.bit_length() - 1).alias("l1"), cluster.bitwiseAND(F.lit(entries - 1)).alias("l2"))


#: Flags and masks of a level-2 entry (fixed by the format).
ZERO_FLAG, COMPRESSED_FLAG, USED_FLAG = 1, 1 << 62, 1 << 63
OFFSET_MASK = 0x00FF_FFFF_FFFF_FE00
SECTOR = 512


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def l2_entry(entry: Column, cluster_bits: int = 16) -> Column:
    """struct(kind, address, bytes) of a level-2 entry: empty, compressed, zero or standard; bytes for compressed ones."""
    shift = 62 - (cluster_bits - 8)
    address = entry.bitwiseAND(F.lit((1 << shift) - 1))
    sectors = F.shiftrightunsigned(entry, shift).bitwiseAND(F.lit((1 << (cluster_bits - 8)) - 1)) + 1
    packed = entry.bitwiseAND(F.lit(COMPRESSED_FLAG)) != 0
    kind = F.when(entry == 0, "empty").when(packed, "compressed").when(entry.bitwiseAND(F.lit(ZERO_FLAG)) != 0, "zero").otherwise("standard")
    return F.struct(
        kind.alias("kind"),
        F.when(entry == 0, None).when(packed, address).otherwise(entry.bitwiseAND(F.lit(OFFSET_MASK))).alias("address"),
        F.when(packed, sectors * SECTOR - address.bitwiseAND(F.lit(SECTOR - 1))).alias("bytes"),
    )


def make_l2_entry(address: Column, zero: bool = False) -> Column:
    return address.bitwiseAND(F.lit(OFFSET_MASK)).bitwiseOR(F.lit(_signed(USED_FLAG | (ZERO_FLAG if zero else 0))))


def x2apic_id(cpu: Column, threads: int, cores: int, dies: int) -> Column:
    """Packed id of a CPU: each part takes the bits of its count less one."""
    t, c, d = ((n - 1).bit_length() for n in (threads, cores, dies))
    part = lambda div, mod: F.floor(cpu / div).cast("bigint") % mod
    out = part(1, threads).bitwiseOR(F.shiftleft(part(threads, cores), t)).bitwiseOR(F.shiftleft(part(threads * cores, dies), t + c))
    return out.bitwiseOR(F.shiftleft(F.floor(cpu / (threads * cores * dies)).cast("bigint"), t + c + d))


def pack_bdf(segment: Column, bus: Column, device: Column, function: Column) -> Column:
    return F.shiftleft(segment.cast("bigint"), 16).bitwiseOR(F.shiftleft(bus.cast("bigint"), 8)).bitwiseOR(F.shiftleft(device.cast("bigint"), 3)).bitwiseOR(function.cast("bigint"))


def unpack_bdf(bdf: Column) -> Column:
    b = bdf.cast("bigint")
    part = lambda shift, mask: F.shiftright(b, shift).bitwiseAND(F.lit(mask))
    return F.struct(part(16, 0xFFFF).alias("segment"), part(8, 0xFF).alias("bus"), part(3, 0x1F).alias("device"), part(0, 7).alias("function"))


def format_bdf(bdf: Column) -> Column:
    """ssss:bb:dd.f"""
    p = unpack_bdf(bdf)
    return F.format_string("%04x:%02x:%02x.%x", p["segment"], p["bus"], p["device"], p["function"])


def parse_bdf(text: Column) -> Column:
    pattern = r"^([0-9a-fA-F]{1,4}):([0-9a-fA-F]{1,2}):([0-9a-fA-F]{1,2})\.([0-7])$"
    part = lambda i: F.conv(F.regexp_extract(text, pattern, i), 16, 10).cast("bigint")
    return F.when(text.rlike(pattern) & (part(3) < 32), pack_bdf(part(1), part(2), part(3), part(4)))


def parse_mac(text: Column) -> Column:
    """array<int> of six two-digit hexadecimal parts, or null."""
    return F.when(text.rlike(r"^([0-9a-fA-F]{2}:){5}[0-9a-fA-F]{2}$"), F.transform(F.split(text, ":"), lambda x: F.conv(x, 16, 10).cast("int")))


def format_mac(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")), ":")


def le_unsigned(data: Column, at: Column, width: int) -> Column:
    """decimal(20,0): the little-endian unsigned integer of `width` bytes at a 1-based byte position of a binary."""
    digits = F.hex(F.substring(data, at, F.lit(width)))
    swapped = F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in reversed(range(width))))
    return F.conv(swapped, 16, 10).cast("decimal(20,0)")


def checksum(data: Column, skip_from: int = 64, skip_to: int = 68) -> Column:
    """bigint in 32 bits: one's complement of the sum of the bytes outside [skip_from, skip_to)."""
    digits = F.hex(data)
    total = F.aggregate(
        F.sequence(F.lit(0), F.greatest(F.octet_length(data) - 1, F.lit(0))),
        F.lit(0).cast("bigint"),
        lambda s, i: s + F.when((i < skip_from) | (i >= skip_to), F.coalesce(F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint"), F.lit(0).cast("bigint"))).otherwise(F.lit(0).cast("bigint")),
    )
    return F.bitwise_not(total).bitwiseAND(F.lit(0xFFFFFFFF))


#: CRC-32C's polynomial, reversed (fixed by the format).
CASTAGNOLI = 0x82F63B78


class Crc32c:
    """A buffer is taken as rows of equal length, which go through the table side by side; the rows' values are then joined.

    The register is linear over GF(2): that of two parts is that of the first, shifted by the length of the second, XOR that
    of the second. Zeros in front change nothing, and the initial value is the same as inverting the first four bytes."""

    def __init__(self):
        import numpy as np

        table = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            table = table >> 1 ^ np.where(table & 1, np.uint32(CASTAGNOLI), np.uint32(0))
        self.table, self.shifts = table, {}

    def shift(self, zeros: int):
        """Tables of the register after so many zero bytes, by its four bytes."""
        import numpy as np

        if zeros not in self.shifts:
            bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
            for _ in range(zeros):
                bits = self.table[bits & 0xFF] ^ bits >> 8
            picked = (np.arange(256)[:, None] >> np.arange(8)) & 1
            self.shifts[zeros] = [np.bitwise_xor.reduce(np.where(picked, bits[8 * k : 8 * k + 8], 0), axis=1).astype(np.uint32) for k in range(4)]
        return self.shifts[zeros]

    def __call__(self, data: bytes) -> int:
        import numpy as np

        n = max(len(data), 4)
        width = 1 << max(2, (n.bit_length() + 1) // 2)
        rows = np.zeros(-(-n // width) * width, dtype=np.uint8)
        # short buffers: the inverted bytes before them
        head = np.frombuffer(data, dtype=np.uint8).copy()
        head[:4] ^= 0xFF
        rows[len(rows) - len(data) :] = head
        register = np.zeros(len(rows) // width, dtype=np.uint32)
        for column in rows.reshape(-1, width).T:
            register = self.table[(register ^ column) & 0xFF] ^ register >> 8
        a, b, c, d = self.shift(width)
        total = 0
        for r in register.tolist():
            total = int(a[total & 0xFF] ^ b[total >> 8 & 0xFF] ^ c[total >> 16 & 0xFF] ^ d[total >> 24]) ^ r
        if len(data) < 4:
            # what is left of the initial value after fewer than four bytes
            total ^= 0xFFFFFFFF >> 8 * len(data)
        return total ^ 0xFFFFFFFF


def crc32c(data: Column) -> Column:
    """CRC-32C (Castagnoli) of a binary; Spark's crc32 has another polynomial, so this is an Arrow UDF."""

    @F.pandas_udf("long")
    def crc(values: pd.Series) -> pd.Series:
        one = Crc32c()
        return pd.Series([None if v is None else one(v) for v in values], dtype="Int64")

    return crc(data)


def crc32c_without(data: Column, at: int) -> Column:
    """crc32c with the four bytes of the checksum field at `at` taken as zero."""
    zero = F.unhex(F.lit("00000000"))
    return crc32c(F.concat(F.substring(data, 1, at), zero, F.substring(data, F.lit(at + 5), F.octet_length(data))))

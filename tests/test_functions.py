import pytest
from pyspark.sql import functions as F

from vmlens.functions import numbers as N
from vmlens.functions import options as O
from vmlens.functions import strict
from vmlens.functions import text as T

L = F.lit

CASES = {
    "split": (lambda: O.split_commas(L('a,"b,c",[d,[e,f]],g')), ["a", '"b,c"', "[d,[e,f]]", "g"]),
    "split_unopened": (lambda: O.split_commas(L("a],b")), None),
    "split_unclosed": (lambda: O.split_commas(L('a,"b')), None),
    "dequote": (lambda: O.dequote(L('aβ"a"""')), 'aβa"'),
    "later_wins": (lambda: O.parse_options(L("a=1,b= 2 ,a=3,f"), ["a", "b"], ["f"]), {"a": "3", "b": "2", "f": ""}),
    "unknown": (lambda: O.parse_options(L("z=1"), ["a"]), None),
    "subset": (lambda: O.parse_options(L("z=1,a=2"), ["a"], subset=True), {"a": "2"}),
    "no_value": (lambda: O.parse_options(L("a"), ["a"]), None),
    "blank": (lambda: O.parse_options(L("  "), ["a"]), {}),
    "empty_value": (lambda: O.option(O.parse_options(L("a="), ["a"]), "a"), None),
    "empty_is_set": (lambda: O.is_set(O.parse_options(L("a="), ["a"]), "a"), True),
    "integers": (lambda: O.integer_list(L("[0,2-4,7]")), [0, 2, 3, 4, 7]),
    "integers_narrow": (lambda: O.integer_list(L("[300]"), 8), None),
    "integers_text": (lambda: O.format_integer_list(F.array(L(1), L(3))), "[1,3]"),
    "strings": (lambda: O.string_list(L('[a,"b,c"]')), ["a", '"b,c"']),
    "pair": (lambda: O.pair(L('a@"x@y"')), ("a", '"x@y"')),
    "pair_no_key": (lambda: O.pair(L("@b")), None),
    "pair_twice": (lambda: O.pair(L("a@b@c")), None),
    "pairs": (lambda: O.pair_list(L("[1@[2,3],4@5]")), [("1", "[2,3]"), ("4", "5")]),
    "pairs_bare": (lambda: O.pair_list(L("1@2")), None),
    "gcd": (lambda: N.gcd(L(1000), L(10**9)), 1000),
    "bdf": (lambda: N.format_bdf(N.parse_bdf(L("0001:02:1f.7"))), "0001:02:1f.7"),
    "bdf_device": (lambda: N.parse_bdf(L("0001:02:20.7")), None),
    "mac": (lambda: N.format_mac(N.parse_mac(L("0a:1b:2C:3d:4e:5f"))), "0a:1b:2c:3d:4e:5f"),
    "mac_short": (lambda: N.parse_mac(L("0a:1b:2c:3d:4e")), None),
    "bits": (lambda: N.bit_positions(L(0b101001)), [0, 3, 5]),
    "sign_bit": (lambda: N.bit_positions(L(-(1 << 63))), [63]),
    "crc32c": (lambda: N.crc32c(L(b"123456789")), 0xE3069283),
    "checksum": (lambda: N.checksum(F.unhex(L("0102FF"))), ~(1 + 2 + 255) & 0xFFFFFFFF),
    "zero_cluster": (lambda: N.l2_entry(L(0x50001).cast("bigint")), ("zero", 0x50000, None)),
    "round_up": (lambda: N.div_round_up(L(10), L(4)), 3),
    "wrapped": (lambda: N.wrapping_delta(L(5), L("18446744073709551615").cast("decimal(20,0)")).cast("int"), 6),
    "end_overflows": (lambda: N.inclusive_end(L("18446744073709551615").cast("decimal(20,0)"), L(2)), None),
    "align": (lambda: F.array(N.align_up(L(5), L(4)), N.align_down(L(5), L(4))), [8, 4]),
    "tolerance_is_strict": (lambda: N.within_tolerance(L(150.0), L(100.0), 0.5), False),
    "no_time": (lambda: N.bandwidth(L(5), L(0.0)), 0.0),
    "properties": (lambda: T.format_properties(F.create_map(L("b"), L("2"), L("a"), L("1"))), "a = 1, b = 2"),
    "log_line": (lambda: T.log_line("{{{a}}} x", {"a": L(5)}), "{5} x"),
    "next_name": (lambda: T.next_name("_disk", F.array(L("_disk0"), L("_disk1")), L(0)), "_disk2"),
    "mode": (lambda: T.parse_enum(L("Precopy"), {"precopy": "precopy"}), "precopy"),
    "tail": (lambda: T.keep_tail(L(b"abcdef"), 2), bytearray(b"ef")),
    "status": (
        lambda: T.migration_line(L(2), L(1048577), L(5 << 20), L(1048576.0), L(1.5), L(7), L(None).cast("bigint"), L(2.0), L(2097152.0)),
        "iter=2 curr=2MiB total=5MiB bw=1.00MiB/s transfer=1.50s overhead=7ms est_downtime=0ms elapsed=2.00s avg_bw=2.00MiB/s",
    ),
}


@pytest.mark.parametrize("name", CASES)
def test_golden(value, name):
    column, want = CASES[name]
    got = value(column())
    if isinstance(want, tuple):
        got = tuple(got)
    elif isinstance(want, list) and want and isinstance(want[0], tuple):
        got = [tuple(x) for x in got]
    assert got == want


@pytest.mark.parametrize(("text", "want"), [("1024", 1024), ("1K", 1024), ("2M", 2 << 20), ("4G", 4 << 30), ("0K", 0), ("xyzK", None), ("", None), ("1KM", 1 << 20)])
def test_byte_size(value, text, want):
    assert value(O.byte_size(L(text))) == want


@pytest.mark.parametrize("text", ["[5-3]", "[5-5]", "[1-2-3]", "a"])
def test_bad_integer_lists(value, text):
    assert value(O.integer_list(L(text))) is None


@pytest.mark.parametrize(("text", "want"), [("971.230us", 971.23), ("1.619ms", 1619.0), ("1.5s", 1500000.0), ("5ns", 0.005), ("x", None)])
def test_durations(value, text, want):
    got = value(N.duration_us(L(text)))
    assert got is None if want is None else got == pytest.approx(want)


def test_x2apic(value):
    assert [value(N.x2apic_id(L(i), 2, 3, 1)) for i in (0, 1, 2, 6, 7, 8)] == [0, 1, 2, 8, 9, 10]


def test_strict(value):
    with pytest.raises(Exception, match="bad size: x"):
        value(strict(O.byte_size(L("x")), L("x"), "bad size"))


def test_log_template_errors():
    for template in ("{a", "a}", "{b}"):
        with pytest.raises(ValueError):
            T.log_line(template, {"a": L(1)})


def test_typed_sections(spark):
    from vmlens.functions import options as O

    def typed(section, text):
        return spark.createDataFrame([(text,)], "t string").select(O.typed_section(section, F.col("t")).alias("o")).first().o.asDict(recursive=True)

    def given(section, text):
        return {k: v for k, v in typed(section, text).items() if v is not None and v is not False}

    assert given("cpus", "boot=2,max=4,features=[a,b],affinity=[0@[1,2]],nested=on") == {"boot": 2, "max": 4, "features": ["a", "b"], "affinity": [{"key": "0", "value": "[1,2]"}], "nested": True}
    assert given("memory", "size=512M,hotplug_size=1G,shared=on,thp=off") == {"size": 512 << 20, "hotplug_size": 1 << 30, "shared": True}
    assert given("net", 'tap="t,0",mac=aa:bb:cc:dd:ee:ff,fd=[3,5-7],bw_size=10,iommu=on') == {"tap": "t,0", "mac": "aa:bb:cc:dd:ee:ff", "fd": [3, 5, 6, 7], "bw_size": 10, "iommu": True}
    assert given("console", "pty,file=/x") == {"pty": True, "file": "/x"}
    assert given("numa", "guest_numa_id=1,distances=[0@20,1@10],memory_zones=[m0,m1]") == {"guest_numa_id": 1, "distances": [{"key": "0", "value": "20"}, {"key": "1", "value": "10"}], "memory_zones": ["m0", "m1"]}
    assert given("balloon", "size=x,deflate_on_oom=maybe,pci_segment=1") == {"pci_segment": 1, "problem": "size,deflate_on_oom"}
    assert given("tpm", "nothing=1") == given("tpm", "socket") == {"problem": "syntax"}
    assert all(typed(x, "") is not None for x in O.SECTIONS) and len(O.SECTIONS) == 28


def test_crc32c_against_bit_by_bit(spark):
    import random

    from vmlens.functions.numbers import Crc32c

    def slow(data):
        c = 0xFFFFFFFF
        for b in data:
            c ^= b
            for _ in range(8):
                c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    rng, one = random.Random(1), Crc32c()
    assert one(b"123456789") == 0xE3069283
    for n in [*range(40), 63, 64, 65, 255, 1000, 4097]:
        data = rng.randbytes(n)
        assert one(data) == slow(data)


def test_permutation_is_no_sorting(spark):
    from vmlens.operators.sequences import permutation

    got = [r.id for r in permutation(spark.range(100), "id").collect()]
    assert got == [r.id for r in permutation(spark.range(100), "id").collect()] and sorted(got) == list(range(100)) != got


def test_splitting_against_a_walk(spark):
    """Random texts of commas, quotes, brackets and others, character by character."""
    import random

    def split(text):
        depth, quoted, parts = 0, False, [""]
        for c in text.strip(" "):
            if c == '"':
                quoted = not quoted
            elif not quoted and c in "[]":
                depth += 1 if c == "[" else -1
                if depth < 0:
                    return None
            elif not quoted and not depth and c == ",":
                parts.append("")
                continue
            parts[-1] += c
        return None if quoted or depth else parts

    def dequoted(text):
        quoted, before, out = False, "", ""
        for c in text:
            if c != '"':
                out += c
            else:
                out += '"' if before == '"' and not quoted else ""
                quoted = not quoted
            before = c
        return out

    def paired(text):
        quoted, ats = False, []
        for i, c in enumerate(text.strip(" ")):
            quoted = quoted != (c == '"')
            ats += [i] if c == "@" and not quoted else []
        return (text.strip(" ")[: ats[0]], text.strip(" ")[ats[0] + 1 :]) if len(ats) == 1 and ats[0] else None

    rng = random.Random(5)
    texts = ["".join(rng.choice('ab,,"[] \\\n@é') for _ in range(rng.randint(0, 12))) for _ in range(800)]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    got = df.select("t", O.split_commas(F.col("t")).alias("s"), O.dequote(F.col("t")).alias("d"), O.pair(F.col("t")).alias("p")).collect()
    for r in got:
        assert (r.s, r.d, tuple(r.p) if r.p else None) == (split(r.t), dequoted(r.t), paired(r.t)), r.t

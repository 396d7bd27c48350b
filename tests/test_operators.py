import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from vmlens.operators import aggregates as A
from vmlens.operators import graph as G
from vmlens.operators import lookups as J
from vmlens.operators import ranges as R
from vmlens.operators import rules as V
from vmlens.operators import sequences as S

L = F.lit


def same(got, want):
    if isinstance(got, list) and got and isinstance(got[0], tuple):
        got, want = sorted(got, key=repr), sorted(want, key=repr)
    assert got == want


def test_w1(make):
    b = make([(1, 4096, 4096, [4078, 16])], 'r int, s long, p long, w array<long>')
    same(rows(R.bitmap_ranges(b, ['r'], 'w', 's', 'p')), sorted([(1, 8192, 3 * 4096), (1, 24576, 7 * 4096), (1, 4096 + 68 * 4096, 4096)]))


def test_w5(make):
    c = make([(1, 0, 0, 3)], 'r int, o int, gpa long, length long')
    same(rows(R.chunks(c, ['r'], ['o'], 'gpa', 'length', 2)), [(1, 0, 1, 2), (1, 1, 0, 1)])


def test_j4(make):
    m = make([(1, 4096, 16384, 4096), (1, 8192, 20480, 4096), (1, 12288, 36864, 4096)], 'd int, iova long, gpa long, size long')
    q = make([(1, 1, 4608, 256), (1, 2, 7936, 512), (1, 3, 12032, 512), (1, 4, 256, 1), (1, 5, 4096, 0)], 'd int, id int, addr long, size long')
    for w in (None, 2048):
        same([(r.id, r.translated) for r in R.translate(q, m, ['d'], width=w).orderBy('id').collect()], [(1, 16896), (2, 20224), (3, None), (4, None), (5, None)])


def test_j5(make):
    m = make([(1, 4096, 16384, 4096), (1, 8192, 20480, 4096), (1, 12288, 36864, 4096)], 'd int, iova long, gpa long, size long')
    same([(r.id, r.translated) for r in R.translate_back(make([(1, 1, 16896, 16), (1, 2, 20224, 512)], 'd int,id int,addr long,size long'), m, ['d']).orderBy('id').collect()], [(1, 4608), (2, None)])


def test_a7(make):
    same(rows(A.cumulative_average(make([(1, 1, 10), (1, 2, 3), (1, 3, 8)], 'k int,o int,v long'), ['k'], ['o'], 'v')), [(1, 7)])


def test_u7(make):
    same(rows(R.complement(make([(1, 0, 100)], 'k int,s long,l long'), make([(1, 10, 5), (1, 12, 10), (1, 90, 30)], 'k int,s long,l long'), ['k'], 's', 'l')), [(1, 0, 10), (1, 22, 68)])


def test_j3(make):
    same(rows(R.overlaps(make([(1, 5, 10)], 'k int,s long,l long'), make([(1, 0, 6), (1, 15, 3), (1, 14, 1)], 'k int,s long,l long'), ['k'], 's', 'l', 4)), [(1, 5, 10, 0, 6), (1, 5, 10, 14, 1)])


def test_bench(make):
    same(rows(A.benchmark_summary(make([('a', 0, 9.0), ('a', 1, 1.0), ('a', 2, 3.0), ('b', 1, None)], 'n string,i int,v double'), ['n'], 'i', 'v', 1)), [('a', 2.0, 1.0, 3.0, 1.0, 'PASSED'), ('b', 0.0, 0.0, 0.0, 0.0, 'FAILED')])


def test_split(make):
    same(rows(R.weighted_split(1000, 10, make([(0, 1), (1, 2), (2, 1)], 'o int,w int'), 'o', 'w')), [(0, 1, 0, 250), (1, 2, 250, 500), (2, 1, 750, 250)])


def test_ctr(make):
    same(rows(A.request_counters(make([('d', 'read', 10, 5, 0), ('d', 'read', 20, 7, 0), ('d', 'write', 1, 1, -1)], 'device_id string,direction string,bytes long,latency_us long,result int'), ['device_id'], ['bytes'])), sorted([('d', 'read_bytes', 30), ('d', 'read_ops', 2), ('d', 'read_latency_min', 5), ('d', 'read_latency_max', 7), ('d', 'read_latency_avg', 6), ('d', 'write_bytes', 0), ('d', 'write_ops', 0)]))


def test_pages(make):
    same(rows(A.complete_pages_in_order(make([(1, i, a) for i, a in enumerate([0, 4096, 8192, 8192 + 4096, 0, 16384, 4096])], 'k int,o int,a long'), ['k'], ['o'], 'a', 8192)), [(1, 0), (1, 8192)])


def test_breadth_first_of_a_long_chain(make):
    """Deeper than 64 levels; a cycle raises."""
    import pytest

    n=make([(0,None)]+[(i,i-1) for i in range(1,71)],"id long,parent long")
    e=make([(i-1,0,i) for i in range(1,71)],"parent long,ord int,child long")
    same([(r.id,r.depth) for r in G.breadth_first(n,e).collect()],[(i,i) for i in range(71)])
    with pytest.raises(ValueError): G.breadth_first(n,e.unionByName(make([(3,1,1)],"parent long,ord int,child long")))


def test_bfs(make):
    n = make([('root', None), ('p1', 'root'), ('p2', 'root'), ('c1', 'p1'), ('c2', 'p2'), ('c3', 'p2')], 'id string,parent string')
    e = make([('root', 0, 'p1'), ('root', 1, 'p2'), ('p1', 0, 'c1'), ('p2', 0, 'c2'), ('p2', 1, 'c3'), ('p2', 2, 'zz')], 'parent string,ord int,child string')
    same([r.id for r in G.breadth_first(n, e, 8).collect()], 'root p1 p2 c1 c2 c3'.split())


def test_bfs_rev(make):
    n = make([('root', None), ('p1', 'root'), ('p2', 'root'), ('c1', 'p1'), ('c2', 'p2'), ('c3', 'p2')], 'id string,parent string')
    e = make([('root', 0, 'p1'), ('root', 1, 'p2'), ('p1', 0, 'c1'), ('p2', 0, 'c2'), ('p2', 1, 'c3'), ('p2', 2, 'zz')], 'parent string,ord int,child string')
    same([r.id for r in G.breadth_first(n, e, 8, True).collect()], 'c3 c2 c1 p2 p1 root'.split())


def test_depth(make):
    same(rows(S.span_depths(make([(1, 1, 0, 100), (1, 2, 10, 50), (1, 3, 10, 20), (1, 4, 50, 60), (1, 5, 0, 100)], 't int,id int,s long,e long'), ['t'], 's', 'e', 'id').select('id', 'depth')), [(1, 0), (2, 2), (3, 3), (4, 2), (5, 1)])


def test_w8(make):
    same(rows(S.subsequence_match(make([(1, 1, 'a', 'x'), (1, 2, 'b', 'y'), (1, 3, 'c', 'z'), (2, 1, 'b', 'y'), (2, 2, 'a', 'x')], 'k int,o int,e string,i string'), ['k'], ['o'], 'e', [('a', None), ('c', 'z')], 'i')), [(1, True, 2), (2, False, 1)])


def test_trans(make):
    same(rows(V.transitions(make([('v', 1, 'Created'), ('v', 2, 'Running'), ('v', 3, 'Created')], 'vm string,o int,s string'), ['vm'], 'o', 's')), [('transitions', 'v/3', 'Running->Created')])


def test_layers(make):
    same(rows(J.resolve_layers(make([(1,), (2,), (3,)], 'cluster long'), make([(0, 1, 'empty', 0), (1, 1, 'standard', 77), (0, 2, 'zero', 0)], 'layer int,cluster long,kind string,address long'), 1)), [(1, 1, 'standard', 77), (2, 0, 'zero', 0), (3, None, 'hole', None)])


def test_iommu(make):
    same([(r.id, r.translated, r.problem) for r in J.resolve_endpoints(make([(1, 1, 4608, 16), (2, 2, 5, 1), (3, 3, 5, 1), (4, 9, 5, 1), (5, 1, 5, 1)], 'id int,endpoint int,addr long,size long'), make([(1, 1), (2, 2), (3, 7)], 'endpoint int,domain int'), make([(1, False), (2, True)], 'domain int,bypass boolean'), make([(1, 4096, 16384, 4096)], 'domain int,iova long,gpa long,size long'), False).orderBy('id').collect()], [(1, 16896, None), (2, 5, None), (3, None, 'unknown domain'), (4, None, 'no domain'), (5, None, 'unmapped')])


def test_disjoint(make):
    same(rows(V.disjoint(make([(1, 0, 10), (1, 5, 5), (1, 20, 3)], 'd int,s long,l long'), ['d'], 's', 'l', 5)), [('disjoint', '1/20', 'unaligned'), ('disjoint', '1/5', 'overlap')])


def test_dist(make):
    same(rows(J.distance_matrix(make([(0,), (1,)], 'node int'), make([(0, 1, 15)], 'src int,dst int,distance int'))), [(0, 0, 10), (0, 1, 15), (1, 0, 15), (1, 1, 10)])


def test_chain(make):
    same(rows(G.backing_chain(make([('a', 'b'), ('b', 'c'), ('c', None)], 'image string,backing string'))), [('a', ['b', 'c'], False), ('b', ['c'], False), ('c', [], False)])


def test_last(make):
    same(rows(J.latest_matches(make([(1, 1, 'a'), (1, 2, 'b'), (1, 3, 'c')], 'k int,o int,v string'), ['k'], 'o', 'v', ['b', 'c'])), [(1, True)])


def test_adj(make):
    same(rows(J.adjust_registers(make([(1, 0, 'eax', 255), (2, 0, 'eax', 1)], 'leaf int,sub_leaf int,register string,value long'), make([(1, 1, 0, 5, 'eax', 15, 256)], 'ord int,leaf int,low int,high int,register string,mask long,replacement long'))), [(1, 0, 'eax', 271), (2, 0, 'eax', 0)])


def brute_islands(pairs):
    out = set()
    for k in {k for k, _ in pairs}:
        mine = sorted({p for q, p in pairs if q == k})
        for p in mine:
            if p - 1 not in mine:
                n = 1
                while p + n in mine:
                    n += 1
                out.add((k, p, n))
    return out


@pytest.mark.parametrize("width", [1, 3, 10, 1 << 16])
def test_islands_across_bins(make, width):
    """Runs that end at, cross or fill bins; null keys, null and negative positions."""
    rng = random.Random(width)
    pairs = [(rng.choice([1, 2, None]), rng.randint(-30, 60)) for _ in range(150)]
    got = R.islands(make([*pairs, (1, None)], "k int, p long"), ["k"], "p", width)
    assert {tuple(r) for r in got.collect()} == brute_islands(pairs)


@pytest.mark.parametrize("width", [1, 7, 50, 1 << 24])
def test_translation_islands_across_bins(make, width):
    rng = random.Random(width)
    rows, want, at = [], [], 0
    for _ in range(80):
        size, gap, delta = rng.randint(1, 20), rng.choice([0, 0, 0, 5]), rng.choice([1000, 1000, 1000, 5000])
        at += gap
        rows.append((1, at, at + delta, size))
        if want and want[-1][1] + want[-1][3] == at and want[-1][2] - want[-1][1] == delta:
            want[-1] = (*want[-1][:3], want[-1][3] + size)
        else:
            want.append((1, at, at + delta, size))
        at += size
    got = R.translation_islands(make(rows, "d int, iova long, gpa long, size long"), ["d"], width=width)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_asof_chooses_bins(make, monkeypatch):
    """Bins as for few rows each give what one bin gives."""
    rng = random.Random(3)
    asked = make([(i % 2, i, rng.randint(-500, 500)) for i in range(300)], "k int, id int, at long")
    bases = make([(i % 3, rng.randint(-400, 450), i) for i in range(90)], "k int, base long, v int")
    one = rows(R.asof(asked, bases, ["k"], "at", "base", ["v"], 1 << 40))
    monkeypatch.setattr(R, "BIN_ROWS", 10)
    assert rows(R.asof(asked, bases, ["k"], "at", "base", ["v"])) == one
    assert R.asof(asked.limit(0), bases.limit(0), ["k"], "at", "base", ["v"]).count() == 0


@pytest.mark.parametrize("inclusive", [True, False])
def test_hot_keys_are_spread(make, inclusive):
    """Ranges of a hot key give what one window gives: sums, maxima, last values, nulls among keys and values, descending order."""
    from vmlens.operators.prefix import before_each

    rng = random.Random(9)
    table = [(rng.choice([1, 1, 1, 2, None]), i, rng.choice([None, *range(-9, 9)]), rng.choice("ab")) for i in range(2000)]
    df = make(table, "k int, o int, v long, part string").repartition(5)
    for order in (["o"], [F.col("o").desc()]):
        values = {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.struct("v")), "n": ("last", F.col("v"))}
        spread, plain = (R.before_each(df, ["k"], order, values, inclusive, hot) for hot in (True, False))
        assert spread.columns == plain.columns and rows(spread) == rows(plain)
    assert before_each(df.limit(0), ["k"], ["o"], {"s": ("sum", F.col("v"))}, hot=True).count() == 0


def test_operators_on_hot_keys(make, monkeypatch):
    from vmlens.operators import prefix

    rng = random.Random(4)
    table = [(rng.choice([1, 1, 1, 2]), i, rng.randint(1, 9) * 4, rng.choice("ab")) for i in range(300)]
    df = make(table, "k int, s long, l long, e string")
    apart = df.where("s % 3 = 0").withColumn("s", F.col("s") * 100)
    calls = [
        lambda: R.merge_adjacent(df.withColumn("s", F.col("s") * 4), ["k"], "s", "l"), lambda: R.runs(df, ["k"], ["s"], ["e"], "l"), lambda: R.running_offset(df, ["k"], ["s"], "l"), lambda: R.chunks(df, ["k"], ["s"], "s", "l", 10),
        lambda: V.disjoint(df, ["k"], "s", "l", 2, 40), lambda: V.transitions(df, ["k"], "s", "e", [("a", "b")]), lambda: S.unsorted(df, ["k"], "s", "l"), lambda: R.complement(make([(1, 0, 50000), (2, 50, 9000)], "k int, s long, l long"), apart.drop("e"), ["k"], "s", "l"),
        lambda: S.span_depths(df.withColumn("z", F.col("s") + F.col("l")), ["k"], "s", "z", "s"),
    ]
    plain = [rows(f()) for f in calls]
    monkeypatch.setattr(prefix, "HOT_ROWS", 10)
    assert [rows(f()) for f in calls] == plain and all(plain)

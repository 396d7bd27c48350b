import pytest

from tests.conftest import same_as_duckdb
from vmlens import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_same_as_duckdb(spark, name):
    same_as_duckdb(Q.queries()[name](spark, SF), Q.oracle_sql()[name], SF)


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_runs(spark, name):
    assert Q.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_feature_bits_of_all_keys(spark, tmp_path):
    """Keys beyond the oracle's 20 bits too."""
    keys = [5, (1 << 20) - 1, 1 << 20, (1 << 40) + 8, (1 << 62) + 1]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {tuple(map(str, r)) for r in Q.feature_bits(spark, str(tmp_path)).collect()}
    assert got == {(str(k), str([i for i in range(64) if k >> i & 1]), str(bool(k >> 3 & 1))) for k in keys}


def test_random_chunks_and_islands(make):
    """Closed forms against loops."""
    import random

    from vmlens.operators import ranges as R

    rng = random.Random(4)
    tables, words = [], []
    for k in range(60):
        at = 0
        for o in range(rng.randint(1, 6)):
            at += rng.randint(1, 5)
            n = rng.randint(1, 9)
            tables.append((k, o, at, n))
            at += n
        words.append((k, 0x1000, 0x1000, [rng.getrandbits(64) - (1 << 63) for _ in range(2)]))
    want = set()
    for k in range(60):
        stack, chunk, room = [(g, n) for t, _, g, n in tables if t == k], 0, 4
        while stack:
            g, n = stack.pop()
            take = min(n, room)
            want.add((k, chunk, g + n - take, take))
            if n > take:
                stack.append((g, n - take))
            room -= take
            if not room:
                chunk, room = chunk + 1, 4
    got = R.chunks(make(tables, "k int, o int, gpa long, length long"), ["k"], ["o"], "gpa", "length", 4)
    assert {tuple(r) for r in got.collect()} == want
    got = {tuple(r) for r in R.bitmap_ranges(make(words, "k int, s long, p long, w array<long>"), ["k"], "w", "s", "p").collect()}
    want = set()
    for k, s, p, w in words:
        bits = [i for i in range(128) if w[i // 64] >> (i % 64) & 1]
        for i in bits:
            if i - 1 not in bits:
                n = next(m for m in range(1, 130) if i + m not in bits)
                want.add((k, s + i * p, n * p))
    assert got == want

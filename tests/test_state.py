"""State machines: null keys, exact numbers, and models written another way."""

import random

import pytest
from pyspark.sql import functions as F

from vmlens.operators import aggregates, ranges, sequences, state


def by_order(df, *columns):
    return [tuple(r[c] for c in columns) for r in sorted(df.collect(), key=lambda r: r.seq)]


def test_null_and_nan_keys_are_keys(make):
    rows = [(k, i, 10_000_000 * i, 60) for i, k in enumerate([None, 7.0, float("nan")] * 4)]
    out = state.token_bucket(make(rows, "key double, seq long, ts long, tokens long"), ["key"], ["seq"], "ts", "tokens", 100, 0, 3_600_000)
    got = {}
    for r in sorted(out.collect(), key=lambda r: r.seq):
        got.setdefault(str(r.key), []).append(r.outcome)
    assert got == {k: ["success", "failure", "failure", "failure"] for k in ("None", "7.0", "nan")}


def test_whole_numbers_stay_exact_beside_nulls(make):
    big = (1 << 60) + 1
    rows = [(1, 1, "allocate", None, 16, None), (1, 2, "allocate", big + 15 - big % 16 + 1 - 16, 32, None), (1, 3, "allocate", None, None, 4)]
    out = state.allocate_addresses(make(rows, "k int, seq int, op string, at long, length long, align long"), ["k"], ["seq"], big - big % 16, 1 << 20)
    got = by_order(out, "at", "address")
    assert got[0] == (None, big - big % 16 + (1 << 20) - 16) and got[1][0] == got[1][1] and got[2][1] is None
    total = aggregates.cumulative_average(make([(None, i, big // 10_000 * (i % 2)) for i in range(3)] + [(None, 9, None)], "k int, seq int, v long"), ["k"], ["seq"], "v")
    assert total.count() == 1


def test_extra_columns_stay_as_they_are(make):
    rows = [("a", i, 0, 1, [i, None], {"x": i}, None) for i in range(3)]
    df = make(rows, "key string, seq int, ts long, tokens long, list array<int>, map map<string,int>, nothing string")
    out = state.token_bucket(df, ["key"], ["seq"], "ts", "tokens", 2, 0, 1000)
    assert by_order(out, "list", "map", "nothing", "outcome") == [([i, None], {"x": i}, None, o) for i, o in enumerate(["success", "success", "failure"])]
    assert state.token_bucket(df.limit(0), ["key"], ["seq"], "ts", "tokens", 2, 0, 1000).count() == 0
    assert aggregates.cumulative_average(df.limit(0), ["key"], ["seq"], "ts").count() == 0


class Kills:
    """The expiry queue as a list of arrivals that is walked anew at each poll."""

    def __init__(self, size, life):
        self.size, self.life, self.queue, self.live, self.synced = size, life, [], {}, True

    def __call__(self, op, t, item):
        if op == "arm":
            self.live[item] = t + self.life
            fits = self.synced and len(self.queue) < self.size
            self.queue += [(t + self.life, item)] if fits else []
            self.synced = self.synced and fits
        elif op == "disarm":
            self.live.pop(item, None)
        else:
            return self.poll(t)
        return []

    def poll(self, t):
        late = 0
        while late < len(self.queue) and self.queue[late][0] < t:
            late += 1
        head, self.queue = self.queue[:late], self.queue[late:]
        gone = []
        for _, item in head:
            if self.live.get(item, t) < t:
                gone.append(item)
                self.live.pop(item)
        if self.queue or self.synced:
            return gone
        names = sorted(self.live)
        self.queue, self.synced = sorted((self.live[x], x) for x in names[: self.size]), len(names) <= self.size
        return gone + self.poll(t)


@pytest.mark.parametrize("seed", range(5))
def test_expiry_against_a_model(make, seed):
    rng, t, rows = random.Random(seed), 0, []
    for i in range(400):
        t += rng.randint(0, 4)
        rows.append(("k", i, t, rng.choice(["arm", "arm", "arm", "disarm", "poll"]), rng.choice("abcdefgh")))
    model = Kills(3, 12)
    want = [(model(op, now, item),) for _, _, now, op, item in rows]
    got = by_order(state.expire(make(rows, "k string, seq int, now long, op string, item string"), ["k"], ["seq"], "now", 12, 3), "expired")
    assert got == want and sum(len(x[0]) for x in want) > 20


def test_group_is_told_when_it_unblocks(make):
    rows = [("g", 0, 0, "bytes", 100), ("g", 1, 0, "bytes", 1), ("g", 2, 50_000_000, "bytes", 1), ("g", 3, 100_000_000, "bytes", 1), ("h", 4, 0, "ops", 1)]
    limited = state.limit(make(rows, "grp string, seq int, ts long, kind string, tokens long"), ["grp"], ["seq"], "ts", "kind", "tokens", {"bytes": (100, 0, 1000)})
    assert by_order(limited, "allowed", "blocked_until") == [(True, None), (False, 100_000_000), (False, None), (True, None), (True, None)]
    handles = make([("g", "a"), ("g", "b"), ("h", "c")], "grp string, handle string")
    assert {tuple(r) for r in state.unblocked(limited, handles, ["grp"]).collect()} == {("g", "a", 100_000_000), ("g", "b", 100_000_000)}


def test_read_and_reset(make):
    rows = [(1, 1, "a", 0, 1), (1, 2, "b", 0, 4), (1, 3, "b", 2, 8), (1, 4, "read", None, None), (1, 5, "read", None, None), (1, 6, "a", 0, 2), (1, 7, "read", None, None), (1, 8, "a", 0, 16), (2, 1, "a", 0, 1)]
    got = state.read_and_reset(make(rows, "k int, o int, op string, word int, bits long"), ["k"], "o")
    assert {tuple(r) for r in got.collect()} == {(1, 4, 0, 5), (1, 4, 2, 8), (1, 7, 0, 2)}


def test_long_keys_are_streamed(spark):
    """Many batches of one key, beside others."""
    df = spark.range(60_000).select((F.col("id") % 3 == 0).alias("k"), "id", (F.col("id") % 1000).alias("v"), F.lit("x").alias("e"))
    got = {r.k: r.average for r in aggregates.cumulative_average(df, ["k"], ["id"], "v").collect()}
    want = {}
    for i in range(60_000):
        n, a = want.get(i % 3 == 0, (0, 0))
        x = i % 1000 * 10_000
        want[i % 3 == 0] = (n + 1, x if n == 0 else a + aggregates.truncated(x - a, n + 1))
    assert got == {k: aggregates.truncated(a, 10_000) for k, (_, a) in want.items()}
    found = sequences.subsequence_match(df, ["k"], ["id"], "e", [("x", None)] * 5)
    assert {(r.matched, r.n_matched) for r in found.collect()} == {(True, 5)}


@pytest.mark.parametrize("width", [None, 10])
def test_asof_keeps_rows_without_a_key(make, width):
    asked = make([(None, 1, 5), (1, 2, 25), (2, 3, 5), (1, 4, None), (1, 5, 1)], "k int, id int, at long")
    bases = make([(1, 3), (1, 30), (None, 4)], "k int, base long")
    got = {(r.id, r.base) for r in ranges.asof(asked, bases, ["k"], "at", "base", [], width).collect()}
    assert got == {(1, 4), (2, 3), (3, None), (4, None), (5, None)}

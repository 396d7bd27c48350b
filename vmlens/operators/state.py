"""Operators whose result depends on all earlier rows of a key: limiters, allocators, bounded queues.

A key's rows are dealt to one task and sorted there; the task reads them as a stream and holds one key's state, so no group
is collected. The step is a small Python object: such state machines have no built-in expression. Rows come as Arrow batches.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

COOL_DOWN_NS = 100_000_000


def _keys(row: dict, by: Sequence[str]) -> tuple:
    """A key that is equal to itself, be it null or not a number."""
    return tuple("nan" if x != x else x for x in (row[c] for c in by))


def _arrow_types(ddl: str) -> list:
    from pyspark.sql.pandas.types import to_arrow_type

    return [(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(ddl).fields]


def ordered_fold(df: DataFrame, by: Sequence[str], order: Sequence[str], make: Callable[[dict], Callable[[dict], tuple]], outputs: str, reads: Sequence[str] | None = None) -> DataFrame:
    """`df` with further columns: make(first row of a key) gives a callable that maps every row to their values.

    Values are Python's own: whole numbers stay exact beside nulls, and a null key is a key like any other. reads: the
    columns that are looked at, beside the key's; by default all."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", " + outputs
    types = _arrow_types(outputs)
    used = [c for c in df.columns if reads is None or c in reads or c in by]

    def run(batches):
        key, step = None, None
        for batch in batches:
            rows = []
            for values in zip(*(batch.column(c).to_pylist() for c in used), strict=True):
                row = dict(zip(used, values, strict=True))
                now = _keys(row, by)
                if step is None or now != key:
                    key, step = now, make(row)
                rows.append(step(row))
            new = [pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *(n for n, _ in types)])

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def ordered_reduce(df: DataFrame, by: Sequence[str], order: Sequence[str], make: Callable[[dict], Callable[[dict], None]], finish: Callable[[Callable], tuple], outputs: str, reads: Sequence[str]) -> DataFrame:
    """One row per key: by and the values that finish(step) has after make(first row)'s step has seen all rows in order."""
    keys = df.select(*by).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys) + ", " + outputs
    types = [*_arrow_types(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys)), *_arrow_types(outputs)]
    used = [*by, *(c for c in dict.fromkeys([*reads, *order]) if c not in by)]

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(types)], names=[n for n, _ in types])

    def run(batches):
        key, step, first, done = None, None, (), []
        for batch in batches:
            for values in zip(*(batch.column(c).to_pylist() for c in used), strict=True):
                row = dict(zip(used, values, strict=True))
                now = _keys(row, by)
                if step is None or now != key:
                    if step is not None:
                        done.append((*first, *finish(step)))
                    key, step, first = now, make(row), tuple(row[c] for c in by)
                step(row)
            if len(done) >= 10_000:
                yield table(done)
                done = []
        if step is not None:
            done.append((*first, *finish(step)))
        yield table(done)

    return df.select(*used).repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


class TokenBucket:
    """Burst first, then a budget that refills with time; the clock is the rows' own."""

    def __init__(self, size: int, burst: int, refill_ms: int, now_ns: int):
        self.size, self.burst, self.refill_ns, self.budget, self.last = size, burst, refill_ms * 1_000_000, size, now_ns

    def reduce(self, tokens: int, now_ns: int) -> tuple[str, float]:
        """("success" | "failure" | "over", ratio). What is left of the burst goes even where the rest fails."""
        if self.burst > 0:
            if self.burst >= tokens:
                self.burst -= tokens
                self.last = now_ns
                return "success", 0.0
            tokens -= self.burst
            self.burst = 0
        # the fraction of a token that has come by is lost
        self.budget = min(self.size, self.budget + (now_ns - self.last) * self.size // self.refill_ns)
        self.last = now_ns
        if tokens <= self.budget:
            self.budget -= tokens
            return "success", 0.0
        if tokens <= self.size:
            return "failure", 0.0
        over = (tokens - self.budget) / self.size
        self.budget = 0
        return "over", over

    def replenish(self, tokens: int) -> None:
        if self.burst > 0:
            self.burst += tokens
        else:
            self.budget = min(self.budget + tokens, self.size)


class Limiter:
    """Independent buckets for bytes and operations, and the time until which all is blocked."""

    def __init__(self, buckets: dict[str, tuple[int, int, int]], now_ns: int):
        self.buckets = {k: TokenBucket(*v, now_ns) for k, v in buckets.items() if v[0] and v[2]}
        self.blocked_until = now_ns

    def consume(self, kind: str, tokens: int, now_ns: int) -> bool:
        if now_ns < self.blocked_until:
            return False
        bucket = self.buckets.get(kind)
        if bucket is None:
            return True
        result, ratio = bucket.reduce(tokens, now_ns)
        if result == "failure":
            self.blocked_until = now_ns + COOL_DOWN_NS
        elif result == "over":
            self.blocked_until = now_ns + int(ratio * bucket.refill_ns // 1_000_000) * 1_000_000
        return result != "failure"


def token_bucket(requests: DataFrame, by: Sequence[str], order: Sequence[str], now_ns: str, tokens: str, size: int, burst: int, refill_ms: int) -> DataFrame:
    """Requests with outcome, ratio, budget and burst. Size or refill time 0 limits nothing."""

    def make(first: dict):
        if not size or not refill_ms:
            return lambda row: ("success", 0.0, None, None)
        bucket = TokenBucket(size, burst, refill_ms, int(first[now_ns]))
        return lambda row: (*bucket.reduce(int(row[tokens]), int(row[now_ns])), bucket.budget, bucket.burst)

    return ordered_fold(requests, by, order, make, "outcome string, ratio double, budget long, burst long", [now_ns, tokens])


def limit(requests: DataFrame, by: Sequence[str], order: Sequence[str], now_ns: str, kind: str, tokens: str, buckets: dict[str, tuple[int, int, int]]) -> DataFrame:
    """Requests with `allowed` and blocked_until (null where the request blocks nothing).

    `by` may be a group that many handles share. kind: "bytes" or "ops"; "+bytes" gives back."""

    def make(first: dict):
        limiter = Limiter(buckets, int(first[now_ns]))

        def step(row: dict) -> tuple:
            what = row[kind]
            if what.startswith("+"):
                if what[1:] in limiter.buckets:
                    limiter.buckets[what[1:]].replenish(int(row[tokens]))
                return True, None
            before = limiter.blocked_until
            allowed = limiter.consume(what, int(row[tokens]), int(row[now_ns]))
            return allowed, limiter.blocked_until if limiter.blocked_until != before else None

        return step

    return ordered_fold(requests, by, order, make, "allowed boolean, blocked_until long", [now_ns, kind, tokens])


def unblocked(limited: DataFrame, handles: DataFrame, by: Sequence[str]) -> DataFrame:
    """What a group's handles are told: handles' columns and `at`, a row for each handle of a group whenever its block ends."""
    ends = limited.where("blocked_until IS NOT NULL").select(*by, "blocked_until").distinct().withColumnRenamed("blocked_until", "at")
    return handles.join(ends, list(by))


class AddressSpace:
    """Ranges of [base, base + size), taken from the top, or at a given address."""

    def __init__(self, base: int, size: int):
        self.base, self.end = base, base + size
        self.ranges: dict[int, int] = {base + size: 0}

    def allocate(self, size: int, align: int = 4, at: int | None = None) -> int | None:
        if size <= 0 or align <= 0 or align & (align - 1):
            return None
        if at is not None:
            if at % align or not self.base <= at < self.end:
                return None
            before = [a for a in self.ranges if a < at]
            after = min(a for a in self.ranges if a >= at)
            if (before and max(before) + self.ranges[max(before)] > at) or after - at < size:
                return None
            self.ranges[at] = size
            return at
        starts = sorted(self.ranges, reverse=True)
        for k, start in enumerate(starts):
            low = starts[k + 1] + self.ranges[starts[k + 1]] if k + 1 < len(starts) else self.base
            low = -(-low // align) * align
            if start - low >= size:
                got = -(-(start - size - (align - 1)) // align) * align
                self.ranges[got] = size
                return got
        return None

    def free(self, at: int, size: int) -> bool:
        if at != self.end and self.ranges.get(at) == size:
            del self.ranges[at]
            return True
        return False


def allocate_addresses(requests: DataFrame, by: Sequence[str], order: Sequence[str], base: int, size: int) -> DataFrame:
    """Requests (op allocate or free, at, length, align) with `address`: where, null if it can't be done."""

    def make(first: dict):
        space = AddressSpace(base, size)

        def step(row: dict) -> tuple:
            at, length = row["at"], row["length"] or 0
            if row["op"] == "free":
                return (at if at is not None and space.free(at, length) else None,)
            return (space.allocate(length, row["align"] or 4, at),)

        return step

    return ordered_fold(requests, by, order, make, "address long", ["op", "at", "length", "align"])


def allocate_slots(requests: DataFrame, by: Sequence[str], order: Sequence[str], policy: str, size: int = 1 << 30, first_slot: int = 0) -> DataFrame:
    """Requests (op take or free, slot) with `got`, null where it's refused.

    lowest: the lowest free number (a double free is refused); lifo: the slot freed last, else the next new one; port: the
    next number, round and round, that isn't in use; device: a given slot may be a reserved one (op reserve), automatic ones
    are the lowest that is free."""

    def make(first: dict):
        used: set[int] = set()
        freed: list[int] = []
        reserved: set[int] = set()
        state = {"next": first_slot}

        def step(row: dict) -> tuple:
            op, slot = row["op"], row["slot"]
            if op == "reserve":
                ok = slot not in used and slot not in reserved
                reserved.add(slot)
                return (slot if ok else None,)
            if op == "free":
                if policy != "lifo" and slot not in used:
                    return (None,)
                used.discard(slot)
                freed.append(slot)
                return (slot,)
            if policy == "lifo":
                if freed:
                    return (freed.pop(),)
                state["next"] += 1
                return (state["next"] - 1,)
            if slot is not None:
                if slot in used or not first_slot <= slot < first_slot + size:
                    return (None,)
                reserved.discard(slot)
                used.add(slot)
                return (slot,)
            if policy == "port":
                if len(used) >= size:
                    return (None,)
                while state["next"] in used:
                    state["next"] = first_slot + (state["next"] + 1 - first_slot) % size
                got = state["next"]
                state["next"] = first_slot + (got + 1 - first_slot) % size
            else:
                got = first_slot
                while got in used or got in reserved:
                    got += 1
                if got >= first_slot + size:
                    return (None,)
            used.add(got)
            return (got,)

        return step

    return ordered_fold(requests, by, order, make, "got long", ["op", "slot"])


def expire(events: DataFrame, by: Sequence[str], order: Sequence[str], now: str, lifetime: int, size: int = 128) -> DataFrame:
    """Events (op arm, disarm or poll; item) with `expired` (array), what a poll ends.

    arm gives an item a kill time and queues it; a full queue, or one that has missed an item, takes none and is out of step
    from then on. A poll pops what is past its time from the front; an item that was disarmed or armed anew since isn't
    ended. A queue that is empty and out of step is made anew from the first `size` items (by name) that have a kill time, in
    time order, and polled again."""

    def make(first: dict):
        queue: deque[tuple[int, str]] = deque()
        live: dict[str, int] = {}
        state = {"synced": True}

        def poll(t: int) -> list[str]:
            gone = []
            while True:
                while queue and t > queue[0][0]:
                    item = queue.popleft()[1]
                    if item in live and t > live[item]:
                        del live[item]
                        gone.append(item)
                if queue or state["synced"]:
                    return gone
                queue.extend(sorted((live[x], x) for x in sorted(live)[:size]))
                state["synced"] = len(live) <= size

        def step(row: dict) -> tuple:
            t, item = row[now], row["item"]
            if row["op"] == "poll":
                return (poll(t),)
            if row["op"] == "disarm":
                live.pop(item, None)
            else:
                live[item] = t + lifetime
                if state["synced"] and len(queue) < size:
                    queue.append((t + lifetime, item))
                else:
                    state["synced"] = False
            return ([],)

        return step

    return ordered_fold(events, by, order, make, "expired array<string>", [now, "op", "item"])


def bounded_queue(events: DataFrame, by: Sequence[str], order: Sequence[str], size: int = 256) -> DataFrame:
    """Events (kind: rst, rx or pop; item) with `result`: in a full queue a reset takes the place of the last rx from the back,
    an rx is dropped (and the queue is unsynced from then on); pop gives the oldest."""

    def make(first: dict):
        queue: deque[tuple[str, str]] = deque()
        state = {"synced": True}

        def step(row: dict) -> tuple:
            kind, item = row["kind"], row["item"]
            if kind == "pop":
                return (queue.popleft()[1] if queue else None, state["synced"])
            if len(queue) < size:
                queue.append((kind, item))
                return ("queued", state["synced"])
            if kind == "rst":
                for k in range(len(queue) - 1, -1, -1):
                    if queue[k][0] == "rx":
                        queue[k] = (kind, item)
                        state["synced"] = False
                        return ("replaced", False)
            state["synced"] = False
            return ("dropped", False)

        return step

    return ordered_fold(events, by, order, make, "result string, synced boolean", ["kind", "item"])


def read_and_reset(events: DataFrame, by: Sequence[str], order: str, op: str = "op", word: str = "word", bits: str = "bits") -> DataFrame:
    """What every read of a dirty log gives: by, read (the read's order), word, bits.

    Events mark bits of a word (op: the log's name, of which there may be two) or read (op "read"). A read gives the OR of
    all logs since the read before, and clears them; marks after the last read are still pending and not in the result."""
    w = Window.partitionBy(*by).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)
    marked = events.withColumn("__read", F.min(F.when(F.col(op) == "read", F.col(order))).over(w))
    return marked.where((F.col(op) != "read") & F.col("__read").isNotNull()).groupBy(*by, F.col("__read").alias("read"), word).agg(F.bit_or(bits).alias(bits))

"""Event streams: reading, fan-out, windows, latest values and limiters with state."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.state import Limiter, TokenBucket
from ..sources.telemetry import parse_events


def read_event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Events of the log files that appear in a folder; what can't be parsed is left out."""
    return parse_events(spark.readStream.option("lineSep", "\n\n").text(path))


def fan_out(stream: DataFrame, sinks: Sequence[Callable[[DataFrame, int], None]], checkpoint: str, **trigger):
    """Start a query that gives every batch to every sink; sinks get the batch's number, to skip one they've had."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, number)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_counters(stream: DataFrame, time: str, late: str, width: str, by: Sequence[str], value: str) -> DataFrame:
    """Count, sum, min and max of a value per key and event-time window; rows later than the watermark are dropped."""
    keyed = stream.withWatermark(time, late).groupBy(F.window(time, width), *by)
    return keyed.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))


def latest_values(stream: DataFrame, by: Sequence[str], order: str, columns: Sequence[str], valid: str = "TRUE") -> DataFrame:
    """The latest valid values per key (update mode); invalid rows change nothing."""
    return stream.where(valid).groupBy(*by).agg(F.max(order).alias(order), *(F.max_by(c, order).alias(c) for c in columns))


def limited(stream: DataFrame, key: str, now_ns: str, kind: str, tokens: str, buckets: dict[str, tuple[int, int, int]], order: str) -> DataFrame:
    """Requests with `allowed`: the limiter of a key is kept from batch to batch; the clock is the rows' own."""
    names = sorted(buckets)
    out_schema = f"{key} string, {order} long, allowed boolean"
    state_schema = ", ".join(["blocked long", *(f"{n}_{f} long" for n in names for f in ("budget", "burst", "last"))])

    def step(group, batches, state: GroupState):
        pdf = pd.concat(list(batches)).sort_values(order)
        limiter = Limiter(buckets, int(pdf[now_ns].iloc[0]))
        if state.exists:
            held = iter(state.get)
            limiter.blocked_until = next(held)
            for n in names:
                values = (next(held), next(held), next(held))
                if n in limiter.buckets:
                    b: TokenBucket = limiter.buckets[n]
                    b.budget, b.burst, b.last = values
        allowed = [limiter.consume(k, int(t), int(now)) for k, t, now in zip(pdf[kind], pdf[tokens], pdf[now_ns], strict=True)]
        flat = [limiter.blocked_until]
        for n in names:
            b = limiter.buckets.get(n)
            flat += [b.budget, b.burst, b.last] if b else [0, 0, 0]
        state.update(tuple(int(x) for x in flat))
        own = None if group[0] is None or group[0] != group[0] else str(group[0])
        yield pd.DataFrame({key: [own] * len(pdf), order: pdf[order].to_numpy(), "allowed": allowed})

    return stream.groupBy(key).applyInPandasWithState(step, out_schema, state_schema, "append", GroupStateTimeout.NoTimeout)

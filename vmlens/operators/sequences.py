"""Operators on ordered rows: traces, event sequences, order and monotonicity checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .prefix import before_each
from .state import ordered_reduce


def span_depths(spans: DataFrame, by: Sequence[str], start: str, end: str, ident: str) -> DataFrame:
    """Spans with `depth`, the number of spans of their thread that enclose them.

    One sweep over starts and ends per key: a span that starts opens a level, its end closes it. Spans are nested; of equal
    starts the longer is outside, and of equal spans the smaller id."""
    marks = spans.select(*spans.columns, F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")))).alias("m"))
    longest = F.when(F.col("m.d") == 1, -F.col(end).cast("double")).otherwise(-F.col(start).cast("double"))
    # a span that ends where another starts doesn't enclose it; one without length ends after its own start
    rank = F.when(F.col("m.d") == -1, F.when(F.col(start) == F.col(end), 2).otherwise(0)).otherwise(1)
    order = [F.col("m.t"), rank, longest, F.col("m.d") * F.col(ident)]
    swept = before_each(marks, by, order, {"depth": ("sum", F.col("m.d"))}, inclusive=True).withColumn("depth", F.col("depth") - 1)
    return swept.where("m.d = 1").drop("m")


def span_layout(spans: DataFrame, thread: str, start_ns: str, end_ns: str, total_ns: str, width: float = 1000.0, padding: float = 10.0) -> DataFrame:
    """Spans with x, w and label for drawing: time scaled to the width without padding; spans without an end aren't drawn."""
    scale = F.lit(width - 2 * padding) / F.col(total_ns)
    drawn = spans.where(F.col(end_ns).isNotNull())
    order = F.row_number().over(Window.partitionBy(thread).orderBy(start_ns))
    label = F.floor((F.col(end_ns) - F.col(start_ns)) / 1_000_000).cast("bigint")
    return drawn.withColumns({"x": F.lit(padding) + F.col(start_ns) * scale, "w": (F.col(end_ns) - F.col(start_ns)) * scale, "label_ms": label, "ord": order})


def subsequence_match(df: DataFrame, by: Sequence[str], order: Sequence[str], event: str, expected: Sequence[tuple[str, str | None]], ident: str | None = None) -> DataFrame:
    """by, matched, n_matched: greedy match of the expected events, in order, others between them allowed.

    An expected event is (name, id or None): the id must be equal where it's given. A key's rows are read as a sorted stream;
    the state is one number."""
    wanted = [(e, None if i is None else str(i)) for e, i in expected]
    rows = df.withColumn("__id", F.col(ident).cast("string")) if ident else df.withColumn("__id", F.lit(None).cast("string"))

    def make(first: dict):
        state = [0]

        def step(row: dict) -> None:
            if state[0] < len(wanted):
                name, i = wanted[state[0]]
                state[0] += row[event] == name and (i is None or row["__id"] == i)

        step.state = state
        return step

    out = ordered_reduce(rows, by, order, make, lambda step: (step.state[0],), "n_matched int", [event, "__id"])
    return out.select(*by, (F.col("n_matched") == len(wanted)).alias("matched"), "n_matched")


def _with_previous(df: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """`df` with `previous`, the value of the row before."""
    rows = before_each(df, by, [order], {"__before": ("last", F.struct(F.col(value).alias("v")))})
    return rows.withColumn("previous", F.col("__before.v")).drop("__before")


def unsorted(df: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """Rows whose value is below the one before."""
    return _with_previous(df, by, order, value).where(F.col("previous") > F.col(value))


def not_increasing(snapshots: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Snapshots of counters that aren't above the one before."""
    return _with_previous(snapshots, keys, order, value).where(F.col("previous") >= F.col(value))


def first_to_second(df: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """by, delta between the two rows of a key; null unless there are two."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = df.withColumn("__next", F.lead(value).over(w)).withColumn("__r", F.row_number().over(w)).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    return rows.where("__r = 1").select(*by, F.when(F.col("__n") == 2, F.col("__next") - F.col(value)).alias("delta"))


def permutation(df: DataFrame, key: str) -> DataFrame:
    """A fixed order that looks random: by hash."""
    return df.orderBy(F.xxhash64(key), key)

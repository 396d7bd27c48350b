"""What stands before each row of its key, in order: running sums, running maxima and the row before.

A window per key is one task per key. Where some key has more than HOT_ROWS rows, rows are dealt to ranges of (key, order)
instead; each range has its own window, and what goes over from range to range is one small table: only keys that lie in
several ranges have rows in it, so they're at most twice as many as ranges, and it's broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import durable

#: Rows of a key up to which it's one window.
HOT_ROWS = 5_000_000
#: Ranges, as a multiple of the shuffle partitions.
SPREAD = 2

_MERGE = {
    "sum": lambda before, own: F.when(before.isNull(), own).when(own.isNull(), before).otherwise(before + own),
    "max": lambda before, own: F.greatest(before, own),
    "last": lambda before, own: F.coalesce(own, before),
}
_FOLD = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}


def has_hot_key(df: DataFrame, by: Sequence[str], rows: int | None = None) -> bool:
    """Does some key have so many rows? Reads the key's columns only."""
    return (df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) > (rows or HOT_ROWS)


def before_each(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], values: dict[str, tuple[str, Column]], inclusive: bool = False, hot: bool | None = None) -> DataFrame:
    """`df` with a column for each of `values`, name -> (fold, value): the fold of the values of the rows before (inclusive:
    and the row's own); null where there is none. Folds: sum, max, and last, which gives the last value that isn't null.

    `order` must be total within a key, or rows that are equal in it alike. hot: spread hot keys or don't, instead of
    looking for one."""
    bound = 0 if inclusive else -1
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    over = lambda w: {k: _FOLD[how](v).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, bound)) for k, (how, v) in values.items()}
    if not (has_hot_key(df, by) if hot is None else hot):
        return df.withColumns(over(Window.partitionBy(*by)))
    ranges = SPREAD * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = durable(df.repartitionByRange(ranges, *by, *order).withColumn("__part", F.spark_partition_id()))
    # the last value of a range is that of its last row, so rows are numbered where that's asked for
    at = Window.partitionBy(*by, "__part").orderBy(*order)
    ends = parts.withColumn("__row", F.row_number().over(at)) if any(how == "last" for how, _ in values.values()) else parts
    fold = {"sum": F.sum, "max": F.max, "last": lambda v: F.max_by(v, F.when(v.isNotNull(), F.col("__row")))}
    totals = ends.groupBy(*by, "__part").agg(*(fold[how](v).alias(f"__v{i}") for i, (how, v) in enumerate(values.values())))
    key = Window.partitionBy(*by)
    earlier = key.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.withColumn("__n", F.count(F.lit(1)).over(key)).where("__n > 1")
    carry = carry.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(by)), F.col("__part").alias("__p"), *(_FOLD[how](F.col(f"__v{i}")).over(earlier).alias(f"__c{i}") for i, (how, _) in enumerate(values.values())))
    own = parts.withColumns({f"__o{i}": c for i, c in enumerate(over(Window.partitionBy(*by, "__part")).values())})
    same = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(by)]
    joined = own.join(F.broadcast(carry), [*same, F.col("__part") == F.col("__p")], "left")
    return joined.select(*df.columns, *(_MERGE[how](F.col(f"__c{i}"), F.col(f"__o{i}")).alias(k) for i, (k, (how, _)) in enumerate(values.items())))

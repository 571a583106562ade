"""Dense numbers within a key, without one task for a key that holds most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import stored

#: Bits of a row's place within its range, as ``monotonically_increasing_id`` has them.
PLACE_BITS = 33


def number_balanced(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, after: str | None = None) -> DataFrame:
    """Number the rows of each key from 1 (or from what column ``after`` holds) in the order
    given, which must be total; null keys are a key.

    Rows are dealt in ranges of keys and order whose bounds Spark samples, so ranges are alike
    in size however rows fall on keys, and sorted within.  A row's place in its range and the
    counts of its key in the ranges before, a row a key and range, make its number.  The sorted
    rows are written once (a job), so that places stay as they are."""
    place, range_ = unused(rows, "__place"), unused(rows, "__range")
    sort = [F.col(c) for c in (*keys, *order)]
    dealt = rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn(place, F.monotonically_increasing_id())
    placed = stored(dealt).withColumn(range_, F.shiftright(place, PLACE_BITS))
    sizes = placed.groupBy(*keys, range_).agg(F.min(place).alias("__first"), F.count("*").alias("__size"))
    earlier = F.sum("__size").over(Window.partitionBy(*keys).orderBy(range_)) - F.col("__size")
    shifts = sizes.select(F.col(range_).alias("__r"), *(F.col(k).alias(f"__k{n}") for n, k in enumerate(keys)), (earlier - F.col("__first") + 1).alias("__shift"))
    same = F.col(range_) == F.col("__r")
    for n, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{n}"))
    number = F.col(place) + F.col("__shift") + (F.coalesce(F.col(after), F.lit(0)) if after else F.lit(0))
    kept = [c for c in rows.columns if c != name]
    return placed.join(shifts, same).select(*kept, number.cast("long").alias(name))


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name

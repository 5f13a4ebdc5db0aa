"""Places of rows in an order, within groups of any size: no task holds a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import materialise

#: Rows of one range, on average, that a task sorts and numbers.
RANGE = 100_000
#: A row's number within its range has this many bits (Spark numbers the rows of each partition from a multiple of 2 ** 33).
_BITS = 33


def ranked(rows: DataFrame, order: Sequence[Column], name: str, partition: Sequence[str] = (), range_rows: int | None = None) -> DataFrame:
    """``rows`` with their place, from 1, in ascending ``order`` within each group of ``partition`` (null is a group), or over all rows.

    Ranges of (group, order) of about ``range_rows`` rows are sorted and written with the rows' numbers in them. A group's first number in each range and its rows there come from a
    partial aggregate, are summed over the ranges that the group spans, and shift the numbers. So a group of any size is spread, and the window holds a row for a range.
    Rows that are equal in the order get different places, in a way that isn't fixed: make the order total where that matters.
    """
    n = max(1, -(-rows.count() // (range_rows or RANGE)))
    keys = [f"_by{i}" for i in range(len(order))]
    keyed = rows.withColumns(dict(zip(keys, order)))
    by = [*(F.col(f"`{c}`") for c in partition), *map(F.col, keys)]
    sorted_ = keyed.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_no", F.monotonically_increasing_id()).drop(*keys)
    written = materialise(sorted_, "ranked").withColumn("_range", F.shiftright("_no", _BITS))
    groups = [F.col(f"`{c}`") for c in partition]
    counts = written.groupBy("_range", *groups).agg(F.min("_no").alias("_first"), F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("_range")
    starts = counts.withColumn("_before", F.sum("_n").over(upto) - F.col("_n")).select(F.col("_range").alias("_r"), *(g.alias(f"_g{i}") for i, g in enumerate(groups)), "_first", "_before")
    met = F.col("_range") == F.col("_r")
    for i, g in enumerate(groups):
        met = met & g.eqNullSafe(F.col(f"_g{i}"))
    place = F.col("_no") - F.col("_first") + F.col("_before") + 1
    return written.join(starts, met).withColumn(name, place.cast("long")).select(*(F.col(f"`{c}`") for c in rows.columns if c != name), name)

"""Positions 1..n within a group, without one task per group.

A window ``row_number`` sorts a whole group in one task, which a site holding a third of all rows
would not survive.  Here rows are range-partitioned over all groups at once, each range is
numbered on its own, and the number of earlier rows of the same group is added per range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagecensus.session import materialised


def in_ranges(
    df: DataFrame, group: list[str], order: list[Column], ranges: int | None = None
) -> tuple[DataFrame, list[str]]:
    """The rows, written once, with ``__range``, the range over group and order each is in, and the names
    of the order's columns.  A group may go on in the next range."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"__order_{i}" for i in range(len(order))]
    ranged = df.withColumns(dict(zip(keys, order)))
    ranged = ranged.repartitionByRange(n, *group, *keys).withColumn(
        "__range", F.spark_partition_id()
    )
    # Range bounds come from a sample: every use must see the same ones, on a retry as well.
    return materialised(ranged), keys


def with_position(
    df: DataFrame, group: list[str], order: list[Column], out: str, ranges: int | None = None
) -> DataFrame:
    """Adds ``out``: the position of each row within its group, by ``order`` (a total order)."""
    ranged, keys = in_ranges(df, group, order, ranges)
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        ranged.groupBy(*group, "__range")
        .count()
        .withColumn("__offset", F.coalesce(F.sum("count").over(before), F.lit(0)))
        .drop("count")
    )
    local = Window.partitionBy("__range", *group).orderBy(*keys)
    return (
        ranged.withColumn("__local", F.row_number().over(local))
        .join(offsets, [*group, "__range"])
        .withColumn(out, (F.col("__local") + F.col("__offset")).cast("bigint"))
        .drop("__range", "__local", "__offset", *keys)
    )

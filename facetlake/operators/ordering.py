"""Positions and running sums inside groups of any size.

A plain window puts one whole group in one task. Here rows are range-partitioned on
(keys, order), so a group spanning many partitions stays spread out: each partition
works on its own rows and adds the totals of the earlier partitions of the same group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetlake.session import materialize


def _ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    columns = [*keys, *order]
    if taken := {"_pid", "_row"} & set(df.columns):
        raise ValueError(f"columns used for the ordering itself: {sorted(taken)}")
    return materialize(
        df.repartitionByRange(*columns)
        .sortWithinPartitions(*columns)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id()),
        "ranged",
    )


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "pos") -> DataFrame:
    """Add the 0-based position of every row in its group under the (ascending) order."""
    ranged = _ranged(df, keys, order)
    blocks = ranged.groupBy(*keys, "_pid").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return (
        ranged.join(offsets, [*keys, "_pid"])
        .withColumn(name, F.col("_row") - F.col("_first") + F.col("_before"))
        .select(*df.columns, name)
    )


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str = "running"
) -> DataFrame:
    """Add the sum of ``value`` over this row and all earlier rows of its group."""
    ranged = _ranged(df.withColumn("_v", value), keys, order)
    blocks = ranged.groupBy(*keys, "_pid").agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.withColumn("_before", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    inside = Window.partitionBy(*keys, "_pid").orderBy("_row")
    return (
        ranged.withColumn("_inside", F.sum("_v").over(inside))
        .join(offsets, [*keys, "_pid"])
        .withColumn(name, F.col("_inside") + F.col("_before"))
        .select(*df.columns, name)
    )

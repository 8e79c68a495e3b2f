"""Ranks and running totals over groups of any size.

A window over one big group sorts it in a single task.  Here the rows are range
partitioned, each partition is counted by itself, and the totals of the earlier
partitions are added, so no task ever sees more than one partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from hazardgrid.session import cut_lineage


def running_total(df: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` up to and including the row, per group.

    ``order`` must be unique within a group.
    """
    ranged = cut_lineage(
        df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    # One row per (group, partition): bounded by the number of partitions.
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(*group, "_part").agg(F.sum(value).alias("_sum")).withColumn(
        "_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    return (
        ranged.withColumn("_inside", F.sum(value).over(inside))
        .join(offsets, [*group, "_part"])
        .withColumn(out, F.col("_inside") + F.col("_before"))
        .drop("_part", "_inside", "_before")
    )


def dense_rank(df: DataFrame, group: list[str], order: str, out: str) -> DataFrame:
    """Distinct ``group, order`` values with their dense rank."""
    distinct = df.select(*group, order).distinct().withColumn("_one", F.lit(1))
    return running_total(distinct, group, [order], "_one", out).drop("_one")


def average_rank_pct(df: DataFrame, value: str, out: str) -> DataFrame:
    """Add the percentile (0-100) of the average rank; NULL values get none.

    Only the distinct values are ordered, with their multiplicities.
    """
    tally = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    total = tally.agg(F.sum("_n").alias("_total"))
    ranked = running_total(tally, [], [value], "_n", "_upto").withColumn(
        "_rank", F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2)
    pct = ranked.crossJoin(F.broadcast(total)).select(     # total is one row
        value, (F.col("_rank") / F.col("_total") * 100).alias(out))
    return df.join(pct, value, "left")

"""Consecutive numbers in a given order, without a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from steadyseed.config import ensure_checkpoint_dir


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with the position 0, 1, .. of each row in ``order`` (a total order) as bigint.

    Rows are dealt out by ranges, numbered inside each range, and shifted by the
    rows of the ranges before: one shuffle, and a window over one row per range.
    """
    ensure_checkpoint_dir(df.sparkSession)
    ranged = df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()).checkpoint()
    counts = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__range", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order)).cast("bigint")
    # one row per range, so the broadcast is bounded by the number of partitions
    return ranged.withColumn(name, inside).join(F.broadcast(offsets), "__range").withColumn(
        name, F.col(name) + F.col("__before") - F.lit(1)
    ).drop("__range", "__before")

"""Places and running totals over a whole table, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import held


def ranges(df: DataFrame, order: list[Column], part: str) -> DataFrame:
    """The rows in ranges of the order, written once, since the bounds of the ranges are drawn from a sample."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return held(df.repartitionByRange(n, *order).withColumn(part, F.spark_partition_id()), "ranges")


def totals_before(df: DataFrame, order: list[Column], amount: Column, name: str) -> DataFrame:
    """Adds the sum of ``amount`` over all rows before a row in the given order, which should leave no ties.

    Rows are sorted within ranges; only the sums of the ranges, one row for each shuffle partition, meet in one place.
    """
    cut = ranges(df.withColumn("_amount", amount), order, "_part")
    earlier = lambda by: by.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("_amount").over(earlier(Window.partitionBy("_part").orderBy(*order))), F.lit(0))
    sums = cut.groupBy("_part").agg(F.sum("_amount").alias("_sum"))
    starts = sums.select("_part", F.coalesce(F.sum("_sum").over(earlier(Window.orderBy("_part"))), F.lit(0)).alias("_before"))
    out = cut.withColumn("_inside", inside).join(F.broadcast(starts), "_part")  # a row for each shuffle partition
    return out.withColumn(name, F.col("_before") + F.col("_inside")).drop("_part", "_amount", "_before", "_inside")


def placed(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Rows numbered from 1 in the given order, which should leave no ties."""
    return totals_before(df, order, F.lit(1), name).withColumn(name, F.col(name) + 1)

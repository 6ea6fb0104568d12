"""Prefix sums over a whole table without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cragline.session import written

SLICE_ROWS = 100_000
MAX_SLICES = 10_000


def running_total(df: DataFrame, order_col: str, value_col: str, out: str) -> DataFrame:
    """df with out, the inclusive running sum of value_col by order_col (distinct, not null).

    Rows are dealt into slices by ranges of order_col; sums run within slices, and start at the total of the slices below,
    which comes from one row a slice.
    """
    slices = max(1, min(MAX_SLICES, df.count() // SLICE_ROWS))
    placed = written(df.repartitionByRange(slices, order_col).withColumn("_slice", F.spark_partition_id()), "slices")
    up = Window.partitionBy("_slice").orderBy(order_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    below = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_slice").agg(F.sum(value_col).alias("_total"))
    totals = totals.select("_slice", F.coalesce(F.sum("_total").over(below), F.lit(0)).alias("_below"))
    joined = placed.join(F.broadcast(totals), "_slice")  # MAX_SLICES rows at most
    return joined.withColumn(out, F.sum(value_col).over(up) + F.col("_below")).drop("_slice", "_below")

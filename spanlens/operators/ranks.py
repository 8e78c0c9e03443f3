"""Running sums over all rows in an order, without a task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import Staging


def running(rows: DataFrame, order: str, amount: Column, name: str = "before") -> DataFrame:
    """rows with the sum of amount (whole numbers, not null) over the rows that come before in the order; order's values should differ.

    Rows are dealt by ranges of the order and written once, so that ranges stay what they are; sums run inside each
    range, and the ranges' totals, one row for each, are carried on."""
    dealt = Staging(rows.sparkSession, "ranges").write(rows.withColumn("_amount", amount.cast("long")).repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_range").agg(F.sum("_amount").alias("_total"))
    carried = totals.select("_range", F.coalesce(F.sum("_total").over(earlier(Window.orderBy("_range"))), F.lit(0)).alias("_carried"))
    inside = F.coalesce(F.sum("_amount").over(earlier(Window.partitionBy("_range").orderBy(order))), F.lit(0))
    summed = dealt.withColumn("_inside", inside).join(F.broadcast(carried), "_range")
    return summed.select(*rows.columns, (F.col("_carried") + F.col("_inside")).alias(name))

"""Consecutive numbers over all rows, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialised


def numbered(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """df with numbers from 0 in the given order, ties in any; two passes, written in between.

    Rows are dealt by range of the order; a row's number is its place in its range plus the sizes of the ranges before.
    The sum of sizes is over a row a range.
    """
    dealt = materialised(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_place", place).join(before, "_range").withColumn(name, F.col("_before") + F.col("_place") - 1).drop("_range", "_place", "_before")

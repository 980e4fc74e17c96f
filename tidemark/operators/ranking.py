"""Numbering of whole tables without sorting them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


def numbered(rows: DataFrame, *order: Column, name: str) -> DataFrame:
    """A column 1, 2, ... in the order given, which must tell all rows apart.

    Rows are dealt out by ranges of that order and numbered in each range; a range begins
    after the sum of those before it. The ranges come from a sample, so they are
    checkpointed before they are counted.
    """
    dealt = checkpointed(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))  # one row for each partition
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + within).drop("_range", "_start")


def shared_budget(first: DataFrame, second: DataFrame, order: list[Column], most: int) -> DataFrame:
    """Up to ``most`` rows of both: the first table has its rows before the second gets what is left."""
    both = first.withColumn("turn", F.lit(0)).unionByName(second.withColumn("turn", F.lit(1)), allowMissingColumns=True)
    return both.orderBy("turn", *order).limit(most)

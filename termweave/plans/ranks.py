"""Dense ids and running sums in a given order without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored


def _dealt(df: DataFrame, order: list[Column]) -> DataFrame:
    """df by range, each partition sorted, with its number `_pid` and the place `_loc` in it; written, so that both hold.

    Written before, too: ranges are found from a sample, for which df would be computed a second time.
    """
    placed = stored(df, "unranked").repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(placed.withColumn("_pid", F.spark_partition_id()).withColumn("_loc", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ranks")


def _before(sizes: DataFrame) -> DataFrame:
    """_pid, _before of (_pid, _n): one row a partition, so one task is enough."""
    return sizes.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_before"))


def dense_ids(df: DataFrame, order: list[Column], name: str = "term_id") -> DataFrame:
    """df with 0-based ids by `order` (a total order): a range sort, and offsets from one count a partition."""
    placed = _dealt(df, order)
    before = _before(placed.groupBy("_pid").agg(F.count("*").alias("_n")))
    return placed.join(F.broadcast(before), "_pid").withColumn(name, F.col("_before") + F.col("_loc")).drop("_pid", "_loc", "_before")


def running_sum(df: DataFrame, order: Column, value: str, name: str) -> DataFrame:
    """df with the sum of `value` over all rows before, by `order` (a total order)."""
    placed = _dealt(df, [order])
    before = _before(placed.groupBy("_pid").agg(F.sum(value).alias("_n")))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("_pid").orderBy("_loc").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn(name, inside).join(F.broadcast(before), "_pid").withColumn(name, (F.col("_before") + F.col(name)).cast("long")).drop("_pid", "_loc", "_before")

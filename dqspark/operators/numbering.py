"""Consecutive numbers within keys, without one task per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dqspark.session import settle


def number(rows: DataFrame, key: str, order: list[str], name: str, label: str = "numbered") -> DataFrame:
    """Adds ``name``: 1, 2, ... within ``key`` by ``order``, which must tell rows of a key apart.

    Rows are dealt by range and sorted; a partition's first number is the count
    of the key's rows in the partitions before it.  ``rows`` is a stored table.
    """
    by = [key, *order]
    placed = settle(
        rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", 33)), label)
    counts = placed.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_c"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = settle(counts.select(key, "_part", (
        F.coalesce(F.sum("_c").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift")), f"{label}-starts")
    return (placed.join(starts, [key, "_part"]).withColumn(name, F.col("_at") + F.col("_shift"))
            .drop("_at", "_part", "_shift"))

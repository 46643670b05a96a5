"""Global row numbers without a single task that sorts everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

LOCAL = (1 << 33) - 1  # monotonically_increasing_id has the row's place in its partition in the lower 33 bits


def numbered(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """``df`` with the place, from 1, of each row in a total order.

    The rows are range-partitioned and sorted once and kept with their partition and place in it; only the sizes of
    the partitions are added up. ``order`` should end in a key, so that equal rows have one order.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    s = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    s = materialise(s.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit(LOCAL))), "sorted")
    sizes = s.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_b"))
    return s.join(F.broadcast(before), "_p").withColumn(name, F.col("_b") + F.col("_i") + 1).drop("_p", "_i", "_b")


def shuffled(df: DataFrame, key: str, seed: int = 0) -> list[Column]:
    """A random order that a seed repeats, whatever the partitions: by the key's hash with the seed, then the key."""
    return [F.xxhash64(F.lit(seed), F.col(key)), F.col(key)]

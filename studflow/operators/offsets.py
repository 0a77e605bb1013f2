"""Running totals over a whole table and the packing of lists by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import checkpointed


def running_total(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """df with the total of value over all rows before and with each row, in a total order.

    Rows are range-partitioned by the order; each range is summed, and only the ranges' sums are put in sequence, so no
    task sees all rows. Null values count 0.
    """
    x = checkpointed(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()).withColumn("__v", F.coalesce(value, F.lit(0))))
    w = W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    sums = x.groupBy("__p").agg(F.sum("__v").alias("__s")).withColumn("__before", F.coalesce(F.sum("__s").over(w), F.lit(0))).select("__p", "__before")
    own = W.partitionBy("__p").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return x.join(F.broadcast(sums), "__p").withColumn(name, F.col("__before") + F.sum("__v").over(own)).drop("__p", "__v", "__before")


def packed(counts: DataFrame, key: str, n: str) -> DataFrame:
    """counts with lo and hi: the range of each key's entries when all lists are laid end to end in key order."""
    x = running_total(counts, [F.col(key)], F.col(n), "hi")
    return x.withColumn("lo", F.col("hi") - F.coalesce(F.col(n), F.lit(0)))


def unpacked(ranges: DataFrame, key: str) -> DataFrame:
    """key, at (0-based in its list), entry (in all of them) for each entry of ranges lo to hi."""
    return ranges.where("hi > lo").select(key, "lo", F.posexplode(F.sequence("lo", F.col("hi") - 1)).alias("at", "entry")).drop("lo")

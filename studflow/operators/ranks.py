"""Exact ranks within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Parts of a group's hash range that are ranked apart.
SLOTS = 1024


def ranked(df: DataFrame, by: list[str], key: Column, name: str = "rank") -> DataFrame:
    """df with a number from 0 on within each group, in the order of key's hash.

    Each group is cut into hash ranges that are counted first, so that no group is sorted in one task. Rows with equal
    keys are neighbours, in any order; null groups are a group.
    """
    x = df.withColumn("__h", F.xxhash64(key)).withColumn("__slot", F.pmod("__h", F.lit(SLOTS)).cast("int"))
    counts = x.groupBy(*by, "__slot").agg(F.count("*").alias("__n"))
    w = W.partitionBy(*by).orderBy("__slot").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__slot").alias("__s"), F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))
    on = x["__slot"] == before["__s"]
    for c in by:
        on &= x[c].eqNullSafe(before[f"__by_{c}"])
    at = F.row_number().over(W.partitionBy(*by, "__slot").orderBy("__h", key)) - 1
    return x.join(before, on).withColumn(name, F.col("__before") + at).select(*df.columns, name)

"""Pools of training texts: union without repeats, pairs of captions and paths, and stripes of a numbered list."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def without_repeats(pools: list[DataFrame], key: str, text: str) -> DataFrame:
    """text, key (the smallest), n: the texts of all pools, each once. Null texts are dropped."""
    both = reduce(DataFrame.unionByName, [p.where(F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(key).alias("key")) for p in pools])
    return both.groupBy("text").agg(F.min("key").alias("key"), F.count("*").alias("n"))


def counted_pairs(captions: DataFrame, paths: DataFrame) -> DataFrame:
    """id, n_captions, n_paths of the models (id) that have both; each side (key, id) is counted before they meet."""
    count = lambda df, name: df.where("id is not null").groupBy("id").agg(F.countDistinct("key").alias(name))
    return count(captions, "n_captions").join(count(paths, "n_paths"), "id")


def paired(captions: DataFrame, paths: DataFrame, most: int = 5) -> DataFrame:
    """caption_key, path_key, id, text, masked: one path for each caption of its model, as caption, line end and path;
    masked is the number of its first bytes that bear no loss.

    captions: key, id, caption; paths: key, id, path. A model's captions, in the order of their keys, take its first
    `most` paths in turn, so that only those of a model with many are kept before the join. Captions or paths that are
    null take no part.
    """
    first = W.partitionBy("id").orderBy("key")
    c = captions.where(F.col("id").isNotNull() & F.col("caption").isNotNull()).withColumn("at", F.row_number().over(first) - 1)
    p = paths.where(F.col("id").isNotNull() & F.col("path").isNotNull()).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most)
    per = p.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "key", "path"))).alias("all"))
    x = c.join(per, "id").withColumn("p", F.get("all", F.col("at") % F.size("all")))
    head = F.concat("caption", F.lit("\n"))
    return x.select(F.col("key").alias("caption_key"), F.col("p.key").alias("path_key"), "id", F.concat(head, F.col("p.path")).alias("text"), F.octet_length(head).alias("masked"))


def stripe(index: Column, n: int) -> tuple[Column, Column]:
    """(stripe, place in it) of each index of a list that is dealt out to n stripes in turn."""
    return F.pmod(index, F.lit(n)).cast("int"), F.floor(index / n).cast("bigint")


def unstriped(stripe_: Column, place: Column, n: int) -> Column:
    """The index again."""
    return place * n + stripe_

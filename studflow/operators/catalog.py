"""Part vocabulary, colours, connector labels and aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import affine


def color_names(colors: DataFrame) -> DataFrame:
    """code, name: of several names of a code the last in file order."""
    return colors.where(F.col("code").isNotNull()).groupBy("code").agg(F.max_by("name", "ord").alias("name"))


def connector_counts(connectors: DataFrame) -> DataFrame:
    """part_id, sub, pol, n: how many connectors each part has of a subtype and polarity."""
    return connectors.groupBy("part_id", "sub", "pol").agg(F.count("*").alias("n"))


def ordered(labels: DataFrame, row: str = "row") -> DataFrame:
    """Connector rows in canonical order, with conn_idx (within the part) and subgroup_idx (within subtype and
    polarity): by kind, subtype, polarity, then row order. Null polarity comes first."""
    part = W.partitionBy("part_id").orderBy("kind", "sub", F.asc_nulls_first("pol"), row)
    group = W.partitionBy("part_id", "sub", "pol").orderBy("kind", row)
    return labels.withColumn("conn_idx", (F.row_number().over(part) - 1).cast("int")).withColumn("subgroup_idx", (F.row_number().over(group) - 1).cast("int"))


def connectors_from_labels(labels: DataFrame, parts: DataFrame) -> DataFrame:
    """The connector table from rows (stem, kind, sub, pol, row, v array<double>): v is x, y, z, pitch, roll and the
    yaw of fixed or the length of axle connectors; what is missing is 0."""
    v = lambda i: F.coalesce(F.get("v", F.lit(i)), F.lit(0.0))
    x = labels.join(F.broadcast(parts.select("stem", "part_id")), "stem")
    x = x.select("part_id", "kind", "sub", "pol", "row", F.when(F.col("kind") == "axle", v(5)).alias("length"), affine.frame(v(0), v(1), v(2), v(3), v(4), F.when(F.col("kind") == "fixed", v(5)).otherwise(0.0)).alias("frame"))
    return ordered(x).select("part_id", "conn_idx", "kind", "sub", "pol", "subgroup_idx", "length", "frame")


def resolved_stems(stems: DataFrame, aliases: DataFrame, parts: DataFrame) -> DataFrame:
    """stems with dst (the canonical stem), wrap (null without alias) and part_id (null if the stem is unknown)."""
    a = aliases.select(F.col("src").alias("__src"), F.col("dst").alias("__dst"), "wrap")
    out = stems.join(F.broadcast(a), F.col("stem") == F.col("__src"), "left").withColumn("dst", F.coalesce("__dst", "stem"))
    p = parts.select(F.col("stem").alias("__stem"), F.col("part_id"))
    return out.join(F.broadcast(p), F.col("dst") == F.col("__stem"), "left").drop("__src", "__dst", "__stem")

"""Joins by distance and by box overlap, as equi-joins on grid cells with an exact filter behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("bigint")


def near(left: DataFrame, right: DataFrame, on: list[str], reach: float, coarse: float = 8.0, point: str = "p") -> DataFrame:
    """All pairs of rows that agree in `on` and whose points (arrays of three) may lie within reach; the caller filters
    by distance. The columns of right get the prefix r_; no pair comes twice.

    A row of right lies in one cell of side coarse * reach; a row of left goes to the cells that its cube of reach
    touches: about two on average with the default, where neighbouring cells would be 27. Null points or keys pair with
    nothing.
    """
    size = coarse * reach
    x = left.where(F.col(point).isNotNull())
    for k, c in enumerate("xyz"):
        v = F.get(point, F.lit(k))
        x = x.withColumn(f"__{c}", F.explode(F.sequence(cell(v - reach, size), cell(v + reach, size))))
    y = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).where(F.col(f"r_{point}").isNotNull())
    for k, c in enumerate("xyz"):
        y = y.withColumn(f"__r{c}", cell(F.get(f"r_{point}", F.lit(k)), size))
    cond = (F.col("__x") == F.col("__rx")) & (F.col("__y") == F.col("__ry")) & (F.col("__z") == F.col("__rz"))
    for c in on:
        cond &= F.col(c) == F.col(f"r_{c}")
    return x.join(y, cond).drop("__x", "__y", "__z", "__rx", "__ry", "__rz")


def squared_distance(a: Column, b: Column) -> Column:
    return sum((F.pow(F.get(a, F.lit(i)) - F.get(b, F.lit(i)), F.lit(2)) for i in range(1, 3)), F.pow(F.get(a, F.lit(0)) - F.get(b, F.lit(0)), F.lit(2)))


def radius_pairs(points: DataFrame, group: list[str], key: str, r: float, point: str = "p") -> DataFrame:
    """group, a < b, distance: pairs of one group within r (inclusive)."""
    both = near(points.select(*group, key, point), points.select(*group, key, point), group, r, point=point)
    d2 = squared_distance(F.col(point), F.col(f"r_{point}"))
    return both.where(F.col(key) < F.col(f"r_{key}")).where(d2 <= r * r).select(*group, F.col(key).alias("a"), F.col(f"r_{key}").alias("b"), F.sqrt(d2).alias("distance"))


def overlapping_boxes(boxes: DataFrame, group: list[str], key: str, size: float = 40.0, lo: str = "lo", hi: str = "hi", keep: tuple[str, ...] = ()) -> DataFrame:
    """group, a < b: pairs of one group whose closed boxes (arrays of three) overlap, with the columns `keep` of both
    (as a_... and b_...).

    A box goes to every cell it touches; of the cells that two boxes share only the one with the lower corner of their
    intersection reports them, so no pair has to be made distinct. Null boxes or groups pair with nothing.
    """
    x = boxes.select(*group, F.col(key).alias("k"), F.col(lo).alias("lo"), F.col(hi).alias("hi"), *[F.col(c).alias(f"keep_{c}") for c in keep])
    for i, c in enumerate("xyz"):
        x = x.withColumn(f"c{c}", F.explode(F.sequence(cell(F.get("lo", F.lit(i)), size), cell(F.get("hi", F.lit(i)), size))))
    a, b = x.alias("a"), x.alias("b")
    cond = F.col("a.k") < F.col("b.k")
    for c in (*group, "cx", "cy", "cz"):
        cond &= F.col(f"a.{c}") == F.col(f"b.{c}")
    for i, c in enumerate("xyz"):
        la, ha, lb, hb = (F.get(f"{s}.{e}", F.lit(i)) for s in "ab" for e in ("lo", "hi"))
        cond &= (la <= hb) & (lb <= ha) & (F.col(f"a.c{c}") == cell(F.greatest(la, lb), size))
    return a.join(b, cond).select(*[F.col(f"a.{g}").alias(g) for g in group], F.col("a.k").alias("a"), F.col("b.k").alias("b"), *[F.col(f"{s}.keep_{c}").alias(f"{s}_{c}") for s in "ab" for c in keep])

"""Connected components of an edge table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import checkpointed


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """node, component: each node with the smallest node of its component.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): the number of rounds grows with the logarithm
    of the component's size, no star is gathered in one task (only minima per node are aggregated), and each round's
    result is cut off at the shared checkpoint folder. Edges with a null end are dropped; a self-loop makes its node
    a component of its own if it has no other edge.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    nodes = checkpointed(e.select(F.col("u").alias("node")).unionByName(e.select(F.col("v").alias("node"))).distinct())
    cur = checkpointed(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of u is linked to u's smallest neighbour (or itself)
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours are linked to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        cur = checkpointed(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        state = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("h")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    label = cur.groupBy("u").agg(F.min("v").alias("m"))
    return nodes.join(label, nodes["node"] == label["u"], "left").select("node", F.coalesce("m", "node").alias("component"))

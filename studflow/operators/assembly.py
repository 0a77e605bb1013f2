"""Connectivity graphs of placed parts: connectors placed, mated and measured."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import affine
from ..functions.scalar import AXLE_MATES, FAMILY_RANK, STUD_MATES, lookup, quantized_degrees, quantized_slide, stem
from ..tables import spread
from .catalog import resolved_stems
from .components import connected_components
from .spatial import near, squared_distance

#: Search radius and thresholds of mating (fixed values).
REACH, AXIS, AXLE_AXIS, AXLE_RADIUS, OVERLAP, FIXED_AXIS, FIXED_TRACE, SLACK = 3.0, 0.95, 0.9, 4.0, 4.0, 0.9999, 2.99, 1e-4
#: Subtypes of fixed connectors that must agree in orientation, and axle subtypes that hold the other (fixed values).
ORIENTED, HOLDING = ("0", "1", "2", "3"), ("socket", "cross", "clip")


def placements(models: DataFrame, graph: str, text: str) -> DataFrame:
    """graph_id, node, stem, color, xf: the part lines of model texts, in order; other lines are passed over.

    A colour that isn't an integer is null; lines with too few fields are dropped. Null texts have no parts.
    """
    x = models.where(F.col(text).isNotNull()).select(F.col(graph).alias("graph_id"), F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    t = F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")
    x = x.where(F.startswith("line", F.lit("1 "))).withColumn("t", t).where(F.size("t") > 14)
    n = lambda i: F.get("t", F.lit(i)).try_cast("double")
    rows = [F.array(n(5 + 3 * i), n(6 + 3 * i), n(7 + 3 * i), n(2 + i)) for i in range(3)]
    xf = F.concat(*rows, F.array(*[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)]))
    node = F.row_number().over(W.partitionBy("graph_id").orderBy("line_no")) - 1
    return x.select("graph_id", node.cast("int").alias("node"), stem(F.get("t", F.lit(14))).alias("stem"), F.get("t", F.lit(1)).try_cast("int").alias("color"), xf.alias("xf"))


def orthonormal(df: DataFrame, xf: str = "xf") -> DataFrame:
    """df with each matrix's rotation replaced by the nearest orthogonal one (a reflection stays one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(xf)
            m = b.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, 4, 4).copy()
            u, _, vt = np.linalg.svd(m[:, :3, :3])
            m[:, :3, :3] = u @ vt
            yield b.set_column(at, b.schema.field(at), pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * 16, pa.int32()), pa.array(m.reshape(-1))).cast(b.schema.field(at).type))

    return df.mapInArrow(run, df.schema)


def nodes_of(placed: DataFrame, aliases: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, unknown): nodes graph_id, node, part_id, color, xf of the graphs whose parts are all known; unknown
    graph_id, stem of the others."""
    x = resolved_stems(placed, aliases, parts)
    x = x.withColumn("xf", F.when(F.col("wrap").isNotNull(), affine.product(F.col("xf"), F.col("wrap"))).otherwise(F.col("xf"))).drop("wrap")
    unknown = x.where("part_id is null").select("graph_id", F.col("dst").alias("stem")).distinct()
    known = x.join(unknown.select("graph_id").distinct(), "graph_id", "left_anti")
    return orthonormal(spread(known.select("graph_id", "node", "part_id", "color", "xf"))), unknown


def placed_connectors(nodes: DataFrame, connectors: DataFrame) -> DataFrame:
    """Each node's connectors with their world frame (wf), place (p) and axis (ax)."""
    c = connectors.select("part_id", "conn_idx", "kind", "sub", "pol", "length", "frame")
    x = nodes.select("graph_id", "node", "part_id", "xf").join(c, "part_id")
    x = x.withColumn("wf", affine.product(F.col("xf"), F.col("frame"))).drop("xf", "frame", "part_id")
    return x.withColumn("p", affine.column(F.col("wf"), 3)).withColumn("ax", affine.axis(F.col("wf")))


def mated(placed: DataFrame, longest: float) -> DataFrame:
    """graph_id, family, a, a_conn, b, b_conn, a_wf, b_wf: all mating pairs, a being the stud, the side with polarity
    in, or the holding side of an axle. longest: the greatest axle half-length in the catalogue.

    A connector may mate with several others. The final predicates decide; the grid only brings candidates together.
    """
    other = F.col("node") != F.col("r_node")
    close = squared_distance(F.col("p"), F.col("r_p")) <= REACH**2
    along = affine.dot(F.col("ax"), F.col("r_ax"))
    cols = ["graph_id", "node", "conn_idx", "sub", "pol", "length", "wf", "p", "ax", "kind"]
    x = placed.select(*cols)
    fits = lambda pairs: F.concat_ws("+", F.least("sub", "r_sub"), F.greatest("sub", "r_sub")).isin(*["+".join(q) for q in pairs])
    stud = near(x.where("kind = 'stud'"), x.where("kind = 'hole'"), ["graph_id"], REACH).where(other & close & fits(STUD_MATES) & (along >= AXIS)).withColumn("family", F.lit("stud"))
    sided = x.where(F.col("kind").isin("hinge", "ball", "fixed"))
    both = near(sided.where("pol = 'in'"), sided.where("pol = 'on'"), ["graph_id", "kind", "sub"], REACH).where(other & close)
    straight = (~F.col("sub").isin(*ORIENTED)) | ((along >= FIXED_AXIS) & (affine.frame_trace(F.col("wf"), F.col("r_wf")) >= FIXED_TRACE))
    sides = both.where(F.when(F.col("kind") == "hinge", F.abs(along) >= AXIS).when(F.col("kind") == "fixed", straight).otherwise(True)).withColumn("family", F.col("kind"))
    axle = x.where("kind = 'axle'").withColumn("r", F.greatest(F.coalesce("length", F.lit(0.0)), F.lit(AXLE_RADIUS)))
    reach = 2 * max(longest, AXLE_RADIUS) + REACH
    held = near(axle.where(F.col("sub").isin(*HOLDING)), axle.where(~F.col("sub").isin(*HOLDING)), ["graph_id"], reach, coarse=2.0)
    held = held.where(other & fits(AXLE_MATES) & (F.abs(along) >= AXLE_AXIS)).withColumn("proj", affine.dot(affine.minus(F.col("r_p"), F.col("p")), F.col("r_ax")))
    off2 = squared_distance(F.col("p"), F.col("r_p")) - F.col("proj") * F.col("proj")
    over = F.col("r") + F.col("r_r") - F.abs("proj")
    room = F.sqrt(F.greatest(F.lit(0.0), F.lit(REACH**2) - F.greatest(off2, F.lit(0.0))))
    held = held.where(off2 <= REACH**2).where((over >= OVERLAP) | (room >= OVERLAP - over - SLACK)).withColumn("family", F.lit("axle"))
    out = [df.select("graph_id", "family", F.col("node").alias("a"), F.col("conn_idx").alias("a_conn"), F.col("r_node").alias("b"), F.col("r_conn_idx").alias("b_conn"), F.col("wf").alias("a_wf"), F.col("r_wf").alias("b_wf")) for df in (stud, sides, held)]
    return out[0].unionByName(out[1]).unionByName(out[2])


def measured(pairs: DataFrame) -> DataFrame:
    """graph_id, family, a, a_conn, b, b_conn, yaw, flip, rot: the joint parameters. Of an axle, yaw is the slide and
    rot[0] the rotation; of a ball, rot has the angles; of a fixed joint all is zero."""
    wa, wb = F.col("a_wf"), F.col("b_wf")
    xa, za, xb = affine.column(wa, 0), affine.column(wa, 2), affine.column(wb, 0)
    turned = F.atan2(-affine.dot(za, xb), affine.dot(xa, xb))
    x = pairs.withColumn("turn", turned).withColumn("ax", affine.axis(wa)).withColumn("against", affine.dot(affine.column(wa, 1), affine.column(wb, 1)) < 0)
    slide = affine.dot(affine.minus(affine.column(wb, 3), affine.column(wa, 3)), F.col("ax"))
    zero = F.lit(0.0)
    return x.select(
        "graph_id", "family", "a", "a_conn", "b", "b_conn",
        F.when(F.col("family") == "axle", slide).when(F.col("family").isin("fixed", "ball"), zero).otherwise(F.col("turn")).alias("yaw"),
        F.when(F.col("family").isin("hinge", "axle"), F.col("against")).otherwise(False).alias("flip"),
        F.when(F.col("family") == "axle", F.array(F.col("turn"), zero, zero)).when(F.col("family") == "ball", affine.euler_xyz(wa, wb)).otherwise(F.array(zero, zero, zero)).alias("rot"),
    )


def graph_edges(nodes: DataFrame, connectors: DataFrame) -> DataFrame:
    """The measured edges of all graphs. Empty where nothing mates."""
    longest = connectors.agg(F.max("length")).first()[0] or 0.0
    return measured(mated(placed_connectors(nodes, connectors), longest))


#: Graphs of up to so many nodes are taken apart by one task each.
WHOLE_GRAPH = 200_000


def _low_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, node, low: the lowest node of each node's component, a graph at a time."""
    n = nodes.groupBy("graph_id").agg(F.sort_array(F.collect_set("node")).alias("nodes"))
    e = edges.groupBy("graph_id").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    x = n.join(e, "graph_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low_all, counts = [], []
            for ns, a, b in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                low = {v: v for v in ns}

                def find(v, low=low):
                    while low[v] != v:
                        low[v] = low[low[v]]
                        v = low[v]
                    return v

                for u, v in zip(a or (), b or ()):
                    u, v = find(u), find(v)
                    low[max(u, v)] = min(u, v)
                low_all += [(v, find(v)) for v in ns]
                counts.append(len(ns))
            at = pa.array(np.repeat(np.arange(len(counts)), counts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([v for v, _ in low_all], pa.int32()), pa.array([v for _, v in low_all], pa.int32())], names=["graph_id", "node", "low"])

    return x.mapInArrow(run, f"graph_id {x.schema['graph_id'].dataType.simpleString()}, node int, low int")


def graph_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, node, component_index, size: components by size, largest first, ties by their lowest node.

    Graphs too large for one task are taken apart by rounds over all edges; the result is the same.
    """
    largest = nodes.groupBy("graph_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= WHOLE_GRAPH:
        comp = _low_nodes(nodes, edges)
    else:
        key = lambda n: F.struct("graph_id", F.col(n).alias("node"))
        own = nodes.select(key("node").alias("u"), key("node").alias("v"))
        comp = connected_components(edges.select(key("a").alias("u"), key("b").alias("v")).unionByName(own), "u", "v")
        comp = comp.select("node.graph_id", "node.node", F.col("component.node").alias("low"))
    size = comp.groupBy("graph_id", "low").agg(F.count("*").alias("size"))
    order = size.withColumn("component_index", (F.row_number().over(W.partitionBy("graph_id").orderBy(F.desc("size"), "low")) - 1).cast("int"))
    return comp.join(order, ["graph_id", "low"]).select("graph_id", "node", "component_index", "size")


def adjacency(edges: DataFrame) -> DataFrame:
    """graph_id, node, at, neighbour, edge fields, forward: both directions of each edge, in canonical order."""
    keep = ["graph_id", "family", "a_conn", "b_conn"]
    there = edges.select(*keep, F.col("a").alias("node"), F.col("b").alias("neighbour"), F.lit(True).alias("forward"))
    back = edges.select(*keep, F.col("b").alias("node"), F.col("a").alias("neighbour"), F.lit(False).alias("forward"))
    w = W.partitionBy("graph_id", "node").orderBy("neighbour", lookup(FAMILY_RANK, F.col("family")), "a_conn", "b_conn")
    return there.unionByName(back).withColumn("at", (F.row_number().over(w) - 1).cast("int"))


def tree_edge(family: Column, forward: Column, yaw: Column, flip: Column, rot: Column) -> dict[str, Column]:
    """The whole-number parameters of an edge walked in a direction. Against its direction, angle and slide change
    sign unless it's flipped; the angles of a ball never do."""
    sign = F.when(forward | (family.isin("hinge", "axle") & flip), 1.0).otherwise(-1.0)
    r = lambda i: F.get(rot, F.lit(i))
    return {
        "flip": F.when(family.isin("hinge", "axle"), flip),
        "yaw": F.when(family.isin("stud", "hinge"), quantized_degrees(sign * yaw)).when(family == "axle", quantized_degrees(sign * r(0))),
        "slide": F.when(family == "axle", quantized_slide(sign * yaw)),
        "rx": F.when(family == "ball", quantized_degrees(r(0))), "ry": F.when(family == "ball", quantized_degrees(r(1))), "rz": F.when(family == "ball", quantized_degrees(r(2))),
    }

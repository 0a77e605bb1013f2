"""Walks over graphs and the poses of trees: the few kernels that are sequential by nature, run once a graph.

Each graph is small (about 150 parts on average), so a group of rows is a graph, never more.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import FAMILY_RANK
from .collision import HELD_BYTES, MESH, Scene, mesh_bytes, mesh_of

HALF_TURN = np.diag([1.0, -1.0, -1.0, 1.0])


def matrices(m: np.ndarray) -> pa.Array:
    """4x4 matrices as lists of 16."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * 16, pa.int32()), pa.array(m.reshape(-1)))


def turns(radians: np.ndarray) -> np.ndarray:
    """Rotations about y."""
    out = np.tile(np.eye(4), (len(radians), 1, 1))
    c, s = np.cos(radians), np.sin(radians)
    out[:, 0, 0], out[:, 0, 2], out[:, 2, 0], out[:, 2, 2] = c, s, -s, c
    return out


def balls(rot: np.ndarray) -> np.ndarray:
    """Rz Ry Rx of rows (x, y, z)."""
    out = turns(rot[:, 1])
    (cx, cz), (sx, sz) = (np.cos(rot[:, k]) for k in (0, 2)), (np.sin(rot[:, k]) for k in (0, 2))
    x, z = np.tile(np.eye(4), (len(rot), 1, 1)), np.tile(np.eye(4), (len(rot), 1, 1))
    x[:, 1, 1], x[:, 1, 2], x[:, 2, 1], x[:, 2, 2] = cx, -sx, sx, cx
    z[:, 0, 0], z[:, 0, 1], z[:, 1, 0], z[:, 1, 1] = cz, -sz, sz, cz
    return z @ out @ x


def joints(family: np.ndarray, yaw: np.ndarray, flip: np.ndarray, rot: np.ndarray) -> np.ndarray:
    """The transform across each joint, from a's connector to b's."""
    out = np.tile(np.eye(4), (len(family), 1, 1))
    for f, angle in (("stud", yaw), ("hinge", yaw), ("axle", rot[:, 0])):
        w = family == f
        out[w] = turns(angle[w])
    w = np.isin(family, ("hinge", "axle")) & flip.astype(bool)
    out[w] = out[w] @ HALF_TURN
    w = family == "axle"
    out[w, 1, 3] = -yaw[w]
    w = family == "ball"
    out[w] = balls(rot[w])
    return out


def relative(family, yaw, flip, rot, frame_a: np.ndarray, frame_b: np.ndarray) -> np.ndarray:
    """b's pose in a's frame for each edge."""
    return frame_a.reshape(-1, 4, 4) @ joints(family, yaw, flip, rot) @ np.linalg.inv(frame_b.reshape(-1, 4, 4))


class Graph:
    """One graph's edges, by node in canonical order."""

    def __init__(self, edges: pd.DataFrame):
        e = edges.reset_index(drop=True)
        n = len(e)
        node = np.concatenate((e["a"].to_numpy(), e["b"].to_numpy()))
        other = np.concatenate((e["b"].to_numpy(), e["a"].to_numpy()))
        rank = np.tile(e["family"].map(FAMILY_RANK).to_numpy(), 2)
        order = np.lexsort((np.tile(e["b_conn"].to_numpy(), 2), np.tile(e["a_conn"].to_numpy(), 2), rank, other, node))
        self.edges, self.by_node = e, {}
        for k in order.tolist():
            self.by_node.setdefault(int(node[k]), []).append((int(other[k]), k % n if n else k, k < n))

    def out(self, node: int) -> list[tuple[int, int, bool]]:
        return self.by_node.get(node, [])


class Visit(NamedTuple):
    """A node as a walk reaches it; the root has no parent (-1) and no edge (-1)."""

    node: int
    parent: int = -1
    edge: int = -1
    forward: bool = True


class Queue:
    """Ways on, the oldest first: breadth first."""

    def __init__(self, _=None):
        self.ways: deque[Visit] = deque()

    def offer(self, ways: list[Visit]) -> None:
        self.ways.extend(ways)

    def pick(self, seen: dict) -> Visit | None:
        return self.ways.popleft() if self.ways else None


class Trail:
    """Ways on from the last node that has any left, drawn among those: depth first at random."""

    def __init__(self, draw: Callable[[int], int]):
        self.draw, self.nodes = draw, []

    def offer(self, ways: list[Visit]) -> None:
        self.nodes.append(ways)

    def pick(self, seen: dict) -> Visit | None:
        while self.nodes:
            self.nodes[-1] = [w for w in self.nodes[-1] if w.node not in seen]
            if self.nodes[-1]:
                return self.nodes[-1][int(self.draw(len(self.nodes[-1])))]
            del self.nodes[-1]
        return None


class Bag:
    """All ways on, each drawn once."""

    def __init__(self, draw: Callable[[int], int]):
        self.draw, self.ways = draw, []

    def offer(self, ways: list[Visit]) -> None:
        self.ways += ways

    def pick(self, seen: dict) -> Visit | None:
        return self.ways.pop(int(self.draw(len(self.ways)))) if self.ways else None


def walk(g: Graph, root: int, ways: Queue | Trail | Bag, fits: Callable[[Visit, dict[int, int]], bool] = lambda way, at: True, most: float = np.inf) -> list[Visit]:
    """The visits from a root on, in the order that `ways` picks them; a node that doesn't fit isn't placed. fits gets
    the way and the numbers of the nodes placed so far."""
    visits, at = [], {}
    way: Visit | None = Visit(root)
    while way is not None and len(visits) < most:
        if not visits or way.node not in at and fits(way, at):
            at[way.node] = len(visits)
            visits.append(way)
            # ways to nodes that are already there aren't offered
            ways.offer([Visit(v, way.node, e, forward) for v, e, forward in g.out(way.node) if v not in at])
        if len(visits) < most:
            way = ways.pick(at)
    return visits


def breadth_first(g: Graph, nodes: list[int], seed: int | None) -> list[Visit]:
    """From the seed, a node, or from the lowest node."""
    if seed is not None and seed not in nodes:
        raise ValueError(f"node {seed} is not in the component")
    return walk(g, min(nodes) if seed is None else seed, Queue())


def drawn(nodes: list[int], seed: int | None) -> tuple[int, Callable[[int], int]]:
    """A root and the generator it was drawn with, whose further draws are the walk's picks."""
    draw = np.random.default_rng(seed).integers
    return sorted(nodes)[int(draw(len(nodes)))], draw


def depth_first(g: Graph, nodes: list[int], seed: int | None) -> list[Visit]:
    """From a drawn root on, depth first at random."""
    root, draw = drawn(nodes, seed)
    return walk(g, root, Trail(draw))


def component_edges(edges: DataFrame, components: DataFrame, columns: list[str]) -> DataFrame:
    """graph_id, component_index, edges: each component's own edges, however many components its graph has."""
    own = components.select("graph_id", F.col("node").alias("a"), "component_index")
    return edges.join(own, ["graph_id", "a"]).groupBy("graph_id", "component_index").agg(F.collect_list(F.struct(*columns)).alias("edges"))


EDGE = ["family", "a", "a_conn", "b", "b_conn", "yaw", "flip", "rot"]
WALK = "component_index int, seed bigint, pos int, node int, parent_pos int, forward boolean, family string, a int, a_conn int, b int, b_conn int, yaw double, flip boolean, rot array<double>"


def _rows(r, visits: list[Visit], own: pd.DataFrame) -> Iterator[dict]:
    at = {v.node: i for i, v in enumerate(visits)}
    for i, v in enumerate(visits):
        edge = own.loc[v.edge, EDGE].to_dict() if v.edge >= 0 else dict.fromkeys(EDGE)
        yield {"graph_id": r.graph_id, "component_index": r.component_index, "seed": r.seed, "pos": i, "node": v.node, "parent_pos": at.get(v.parent), "forward": v.forward if v.edge >= 0 else None, **edge}


def _frame(rows: list[dict]) -> pd.DataFrame:
    d = pd.DataFrame(rows, columns=["graph_id", "component_index", "seed", "pos", "node", "parent_pos", "forward", *EDGE])
    for n in ("seed", "parent_pos", "a", "a_conn", "b", "b_conn"):
        d[n] = d[n].astype("Int64")
    return d


def _there(r) -> None:
    if r.nodes is None:
        raise ValueError(f"graph {r.graph_id} has no component {r.component_index}")


def walked(edges: DataFrame, components: DataFrame, seeds: DataFrame, method: str = "random") -> DataFrame:
    """graph_id, component_index, seed, pos, node, parent_pos, family, a, a_conn, b, b_conn, forward, yaw, flip, rot:
    a walk over each component for each of its seeds (graph_id, component_index, seed; a null seed is the lowest node
    for bfs). A graph without edges has its one node. Only the component's own edges travel with it. A seed of a component
    that its graph lacks fails the job."""
    go = breadth_first if method == "bfs" else depth_first
    e = component_edges(edges, components, EDGE)
    c = components.groupBy("graph_id", "component_index").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    x = seeds.join(c, ["graph_id", "component_index"], "left").join(e, ["graph_id", "component_index"], "left")
    kind = x.schema["graph_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples():
                _there(r)
                own = pd.DataFrame(list(r.edges) if r.edges is not None else [], columns=EDGE)
                out += _rows(r, go(Graph(own), np.asarray(r.nodes).tolist(), None if pd.isna(r.seed) else int(r.seed)), own)
            yield _frame(out)

    return x.mapInPandas(run, f"graph_id {kind}, {WALK}")


def poses(nodes: DataFrame, edges: DataFrame, connectors: DataFrame) -> DataFrame:
    """key, pos, part_id, color, xf of trees (nodes key, pos, part_id, color; edges as the grammar gives them): the
    root lies at the origin, each child where its edge puts it relative to its parent."""
    x = edges
    # connectors are a table of the catalogue; a part's frames of a subtype and polarity are one row
    c = connectors.groupBy("part_id", "sub", F.coalesce("pol", F.lit("")).alias("p")).agg(F.map_from_entries(F.collect_list(F.struct("subgroup_idx", "frame"))).alias("frames"))
    for s in ("parent", "child"):
        d = c.select(F.col("part_id").alias(f"{s}_part"), F.col("sub").alias(f"{s}_sub"), F.col("p").alias(f"{s}_p"), F.col("frames").alias(f"{s}_frames"))
        x = x.withColumn(f"{s}_p", F.coalesce(f"{s}_pol", F.lit(""))).join(d, [f"{s}_part", f"{s}_sub", f"{s}_p"])
        x = x.withColumn(f"{s}_frame", F.try_element_at(f"{s}_frames", F.col(f"{s}_conn"))).where(F.col(f"{s}_frame").isNotNull()).drop(f"{s}_frames")
    e = x.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "parent", "family", "parent_pol", "flip", "yaw", "slide", "rx", "ry", "rz", "parent_frame", "child_frame"))).alias("edges"))
    t = nodes.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "part_id", "color"))).alias("nodes")).join(e, "key", "left")
    kind = t.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pa.compute.list_value_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            all_nodes = b.column(1).flatten()
            first = np.cumsum(sizes) - sizes
            rows = b.column(2)
            count = np.array([0 if r is None else r for r in pa.compute.list_value_length(rows).to_pylist()], dtype=np.int64)
            f = {n: v for n, v in zip([x.name for x in rows.type.value_type], rows.flatten().flatten())}
            out = np.tile(np.eye(4), (len(all_nodes), 1, 1))
            if count.sum():
                get = lambda n, empty=0: pa.compute.fill_null(f[n], empty).to_numpy(zero_copy_only=False)
                family = get("family", "").astype(str)
                yaw = np.where(family == "axle", get("slide").astype(float), np.radians(get("yaw").astype(float)))
                rot = np.radians(np.stack([get(n).astype(float) for n in ("rx", "ry", "rz")], axis=1))
                rot[family == "axle", 0] = np.radians(get("yaw").astype(float)[family == "axle"])
                fa, fb = (f[n].flatten().to_numpy(zero_copy_only=False).reshape(-1, 16).copy() for n in ("parent_frame", "child_frame"))
                # a ball's edge runs from the side with polarity in
                back = (family == "ball") & (get("parent_pol", "").astype(str) == "on")
                fa[back], fb[back] = fb[back].copy(), fa[back].copy()
                m = relative(family, yaw, get("flip", False).astype(bool), rot, fa, fb)
                m[back] = np.linalg.inv(m[back])
                base = np.repeat(first, count)
                pos, parent = base + get("pos").astype(np.int64), base + get("parent").astype(np.int64)
                # all trees at once, one level of depth after the other
                depth = [0] * len(out)
                for p, q in zip(pos.tolist(), parent.tolist()):
                    depth[p] = depth[q] + 1
                deep = np.array(depth)[pos]
                order = np.argsort(deep, kind="stable")
                cuts = np.searchsorted(deep[order], np.arange(1, int(deep.max()) + 2))
                for lo, hi in zip(cuts[:-1], cuts[1:]):
                    w = order[lo:hi]
                    out[pos[w]] = out[parent[w]] @ m[w]
            pos_, part, color = all_nodes.flatten()
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), pos_, part, color, matrices(out)], names=["key", "pos", "part_id", "color", "xf"])

    return t.select("key", "nodes", "edges").mapInArrow(run, f"key {kind}, pos int, part_id int, color int, xf array<double>")


def decoded(edges: DataFrame, components: DataFrame, nodes: DataFrame, connectors: DataFrame) -> DataFrame:
    """graph_id, node, xf: a pose for each node of graphs, from the continuous parameters along the breadth-first walk
    of each component from its lowest node, which lies at the origin."""
    one = components.select("graph_id", "component_index").distinct().withColumn("seed", F.lit(None).cast("bigint"))
    w = walked(edges, components, one, "bfs")
    p = nodes.select("graph_id", "node", "part_id")
    f = connectors.select("part_id", F.col("conn_idx"), "frame")
    for s in "ab":
        side = p.select("graph_id", F.col("node").alias(s), F.col("part_id").alias(f"{s}_part"))
        conn = f.select(F.col("part_id").alias(f"{s}_part"), F.col("conn_idx").alias(f"{s}_conn"), F.col("frame").alias(f"{s}_frame"))
        w = w.join(side, ["graph_id", s], "left").join(conn, [f"{s}_part", f"{s}_conn"], "left")
    kind = w.schema["graph_id"].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values("pos").reset_index(drop=True)
        out = np.tile(np.eye(4), (len(f), 1, 1))
        e = f.iloc[1:]
        if len(e):
            m = relative(e["family"].to_numpy(), e["yaw"].to_numpy(float), e["flip"].to_numpy(bool), np.stack(e["rot"].to_list()), np.stack(e["a_frame"].to_list()), np.stack(e["b_frame"].to_list()))
            back = ~e["forward"].to_numpy(bool)
            m[back] = np.linalg.inv(m[back])
            for k, parent in enumerate(e["parent_pos"].astype(int)):
                out[k + 1] = out[parent] @ m[k]
        return pd.DataFrame({"graph_id": f["graph_id"], "node": f["node"], "xf": out.reshape(-1, 16).tolist()})

    return w.groupBy("graph_id", "component_index").applyInPandas(run, f"graph_id {kind}, node int, xf array<double>")


def whole_number_steps(family: np.ndarray, forward: np.ndarray, yaw: np.ndarray, flip: np.ndarray, rot: np.ndarray, frame_a: np.ndarray, frame_b: np.ndarray) -> np.ndarray:
    """The child's pose in its parent's frame for each walked edge, from its parameters rounded to whole degrees and
    units, as the written tree has them; so a tree realises to just what was walked."""
    ball, axle = family == "ball", family == "axle"
    sign = np.where(forward | (np.isin(family, ("hinge", "axle")) & flip), 1.0, -1.0)
    degrees = lambda x: np.radians(np.mod(np.rint(np.degrees(x)), 360))
    angle = np.where(axle, rot[:, 0], yaw) * np.where(ball, 1.0, sign)
    q_rot = degrees(rot)
    q_rot[axle, 0] = degrees(angle[axle])
    q_yaw = np.where(axle, np.rint(sign * yaw), degrees(angle))
    fa, fb = frame_a.reshape(-1, 4, 4).copy(), frame_b.reshape(-1, 4, 4).copy()
    turned = ~forward & ~ball  # the parent's connector comes first, except of balls, whose side with polarity in does
    fa[turned], fb[turned] = fb[turned].copy(), fa[turned].copy()
    m = relative(family, q_yaw, flip, q_rot, fa, fb)
    back = ball & ~forward
    m[back] = np.linalg.inv(m[back])
    return m


def sampled(edges: DataFrame, components: DataFrame, nodes: DataFrame, connectors: DataFrame, meshes: DataFrame, seeds: DataFrame, most: int = 100) -> DataFrame:
    """Collision-free random walks, in the columns of walked(): of each component for each of its seeds, up to `most`
    parts. A part that would collide with one that is placed is passed over; the child of a fixed joint may overlap its
    parent. Meshes (part_id, vertices, faces, local_lo, local_hi) are held by each task up to HELD_BYTES in all; beyond
    that each component brings those of its own parts."""
    f = connectors.select("part_id", "conn_idx", "frame")
    e = edges
    for s in "ab":
        side = nodes.select("graph_id", F.col("node").alias(s), F.col("part_id").alias(f"{s}_part"))
        conn = f.select(F.col("part_id").alias(f"{s}_part"), F.col("conn_idx").alias(f"{s}_conn"), F.col("frame").alias(f"{s}_frame"))
        e = e.join(side, ["graph_id", s]).join(conn, [f"{s}_part", f"{s}_conn"])
    names = [*EDGE, "a_frame", "b_frame"]
    own_parts = components.select("graph_id", "component_index", "node").join(nodes.select("graph_id", "node", "part_id"), ["graph_id", "node"])
    c = own_parts.groupBy("graph_id", "component_index").agg(F.sort_array(F.collect_list(F.struct("node", "part_id"))).alias("nodes"))
    x = seeds.join(c, ["graph_id", "component_index"], "left").join(component_edges(e, components, names), ["graph_id", "component_index"], "left")
    held = None
    if mesh_bytes(meshes) <= HELD_BYTES:
        held = edges.sparkSession.sparkContext.broadcast({r["part_id"]: mesh_of(r) for r in meshes.toLocalIterator()})
    else:
        brought = own_parts.select("graph_id", "component_index", "part_id").distinct().join(meshes.select("part_id", F.struct("part_id", *MESH).alias("mesh")), "part_id")
        x = x.join(brought.groupBy("graph_id", "component_index").agg(F.collect_list("mesh").alias("meshes")), ["graph_id", "component_index"], "left")
    kind = x.schema["graph_id"].dataType.simpleString()

    def one(r, own: pd.DataFrame) -> list[Visit]:
        part = {n["node"]: n["part_id"] for n in r.nodes}
        mesh = held.value if held else {m["part_id"]: mesh_of(m) for m in (r.meshes if r.meshes is not None else ())}
        steps: list[np.ndarray] = []
        if len(own):
            stack = lambda col: np.stack([np.asarray(v, dtype=float) for v in own[col]])
            args = own["yaw"].to_numpy(float), own["flip"].to_numpy(bool), stack("rot"), stack("a_frame"), stack("b_frame")
            steps = [whole_number_steps(own["family"].to_numpy(), np.full(len(own), way), *args) for way in (False, True)]
        scene, poses_ = Scene(), []
        fixed = (own["family"] == "fixed").to_numpy()

        def place(node: int, pose: np.ndarray) -> bool:
            scene.add(mesh[part[node]], pose)
            poses_.append(pose)
            return True

        def fits(way: Visit, at: dict[int, int]) -> bool:
            pose = poses_[at[way.parent]] @ steps[way.forward][way.edge]
            struck = scene.hits(mesh[part[way.node]], pose)
            if fixed[way.edge]:
                struck = [k for k in struck if k != at[way.parent]]
            return not struck and place(way.node, pose)

        root, draw = drawn(list(part), None if pd.isna(r.seed) else int(r.seed))
        place(root, np.eye(4))
        return walk(Graph(own[EDGE]), root, Bag(draw), fits, most)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples():
                _there(r)
                own = pd.DataFrame(list(r.edges) if r.edges is not None else [], columns=names)
                out += _rows(r, one(r, own), own)
            yield _frame(out)

    return x.mapInPandas(run, f"graph_id {kind}, {WALK}")


def trees_of(walk: DataFrame, nodes: DataFrame, connectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of walks, as the grammar has them; the key is a struct of graph_id, component_index and seed."""
    from .assembly import tree_edge

    key = F.struct("graph_id", "component_index", "seed").alias("key")
    w = walk.join(nodes.select("graph_id", "node", "part_id", "color"), ["graph_id", "node"])
    n = w.select(key, "pos", "part_id", "color")
    e = w.where("forward is not null")
    parent = nodes.select("graph_id", F.col("node").alias("parent_node"), F.col("part_id").alias("parent_part"))
    way = F.col("forward")
    e = e.withColumn("parent_node", F.when(way, F.col("a")).otherwise(F.col("b"))).withColumn("pc", F.when(way, F.col("a_conn")).otherwise(F.col("b_conn"))).withColumn("cc", F.when(way, F.col("b_conn")).otherwise(F.col("a_conn")))
    e = e.join(parent, ["graph_id", "parent_node"])
    for s, part, conn in (("parent", "parent_part", "pc"), ("child", "part_id", "cc")):
        c = connectors.select(F.col("part_id").alias(part), F.col("conn_idx").alias(conn), F.col("sub").alias(f"{s}_sub"), F.col("pol").alias(f"{s}_pol"), F.col("subgroup_idx").alias(f"{s}_conn"))
        e = e.join(c, [part, conn])
    q = tree_edge(F.col("family"), way, F.col("yaw"), F.col("flip"), F.col("rot"))
    return n, e.select(key, "pos", F.col("parent_pos").alias("parent"), "parent_part", F.col("part_id").alias("child_part"), "family", "parent_sub", "child_sub", "parent_pol", "child_pol", "parent_conn", "child_conn", *[v.alias(k) for k, v in q.items()])


def graphs_of(nodes: DataFrame, edges: DataFrame, connectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the graphs that trees are, as assembly has them but without poses: nodes graph_id, node,
    part_id, color; edges graph_id, family, a, a_conn, b, b_conn, yaw, flip, rot. The tree's whole numbers become
    continuous ones; an edge runs from parent to child, except a ball's, which runs from the side with polarity in."""
    c = connectors.select("part_id", "sub", F.coalesce("pol", F.lit("")).alias("p"), "subgroup_idx", "conn_idx")
    e = edges
    for s in ("parent", "child"):
        d = c.select(F.col("part_id").alias(f"{s}_part"), F.col("sub").alias(f"{s}_sub"), F.col("p").alias(f"{s}_p"), F.col("subgroup_idx").alias(f"{s}_conn"), F.col("conn_idx").alias(f"{s}_at"))
        e = e.withColumn(f"{s}_p", F.coalesce(f"{s}_pol", F.lit(""))).join(d, [f"{s}_part", f"{s}_sub", f"{s}_p", f"{s}_conn"])
    back = (F.col("family") == "ball") & F.coalesce(F.col("parent_pol") == "on", F.lit(False))
    either = lambda x, y: F.when(back, y).otherwise(x)
    zero, angle = F.lit(0.0), lambda n: F.radians(F.col(n).cast("double"))
    family = F.col("family")
    e = e.select(
        F.col("key").alias("graph_id"), "family",
        either(F.col("parent"), F.col("pos")).alias("a"), either(F.col("parent_at"), F.col("child_at")).alias("a_conn"),
        either(F.col("pos"), F.col("parent")).alias("b"), either(F.col("child_at"), F.col("parent_at")).alias("b_conn"),
        F.when(family.isin("stud", "hinge"), angle("yaw")).when(family == "axle", F.col("slide").cast("double")).otherwise(zero).alias("yaw"),
        F.when(family.isin("hinge", "axle"), F.col("flip")).otherwise(False).alias("flip"),
        F.when(family == "axle", F.array(angle("yaw"), zero, zero)).when(family == "ball", F.array(angle("rx"), angle("ry"), angle("rz"))).otherwise(F.array(zero, zero, zero)).alias("rot"),
    )
    return nodes.select(F.col("key").alias("graph_id"), F.col("pos").alias("node"), "part_id", "color"), e


def realised(nodes: DataFrame, edges: DataFrame, components: DataFrame, connectors: DataFrame) -> DataFrame:
    """key, pos, part_id, color, xf of graphs without poses, as model texts want them. A graph of several components has
    no frame that they share, and fails the job."""
    several = components.where("component_index > 0").select("graph_id", "component_index")
    kind = nodes.schema["graph_id"].dataType.simpleString()

    def fail(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raise ValueError(f"graph {batch.column(0)[0]} has no poses and more than one component, which share no frame")
        yield from ()

    lost = several.mapInArrow(fail, f"key {kind}, pos int, part_id int, color int, xf array<double>")
    placed = decoded(edges, components, nodes, connectors).join(nodes.select("graph_id", "node", "part_id", "color"), ["graph_id", "node"])
    return placed.select(F.col("graph_id").alias("key"), F.col("node").alias("pos"), "part_id", "color", "xf").unionByName(lost)

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from studflow.functions.scalar import AXLE_MATES, STUD_MATES
from studflow.operators import assembly, catalog, collision, grammar, offsets, spatial, walks
from studflow.operators.components import connected_components
from studflow.plans.catalogue import box_meshes
from studflow.tables import checkpointed

from .test_grammar import CONNS, GOOD, PARTS, catalogue  # noqa: F401

EYE = np.eye(4)


def at(x, y, z, turn=0.0):
    m = walks.turns(np.array([np.radians(turn)]))[0]
    m[:3, 3] = x, y, z
    return m


def graph(spark, catalogue, rows):  # noqa: F811
    nodes = spark.createDataFrame([(g, n, p, 4, m.ravel().tolist()) for g, n, p, m in rows], "graph_id int, node int, part_id int, color int, xf array<double>")
    return nodes, checkpointed(assembly.graph_edges(nodes, catalogue[2]))


@pytest.mark.parametrize("rows,want", [
    ([(0, EYE), (0, at(0, -24, 0))], [("stud", 0, 1, 1, 0, 0)]),
    ([(0, EYE), (0, at(0, -24, 0, 90))], [("stud", 0, 1, 1, 0, 90)]),
    ([(0, EYE), (0, at(0, -27, 0))], [("stud", 0, 1, 1, 0, 0)]),
    ([(0, EYE), (0, at(0, -27.01, 0))], []),
    ([(2, at(0, 5, 0)), (1, EYE)], [("axle", 0, 0, 1, 0, 0)]),
    ([(3, EYE), (3, EYE)], []),
    ([(3, EYE), (4, at(0, 0, 0) @ walks.HALF_TURN)], [("hinge", 0, 0, 1, 0, 0)]),
    ([(0, EYE), (0, at(0, -24, 0) @ walks.HALF_TURN)], []),
    ([(7, EYE), (8, at(0, 0, 0, 90))], []),
    ([(7, EYE), (8, EYE)], [("fixed", 0, 0, 1, 0, None)]),
])
def test_mating(spark, catalogue, rows, want):  # noqa: F811
    _, e = graph(spark, catalogue, [(1, n, p, m) for n, (p, m) in enumerate(rows)])
    q = assembly.tree_edge(F.col("family"), F.lit(True), F.col("yaw"), F.col("flip"), F.col("rot"))
    got = [tuple(r) for r in e.select("family", "a", "a_conn", "b", "b_conn", q["yaw"].alias("yaw")).collect()]
    assert got == want
    if rows[0][0] == 2:
        assert e.first()["yaw"] == pytest.approx(5.0)


def test_mating_like_all_pairs(spark, catalogue):  # noqa: F811
    r = np.random.default_rng(1)
    rows = []
    for g in range(6):
        for n in range(40):
            m = at(*(r.integers(-1, 2, 3) * [2.0, 8.0, 2.0] + r.normal(0, 0.6, 3)), r.choice([0, 90, 10]))
            if r.random() < 0.3:
                m = m @ walks.HALF_TURN
            rows.append((g, n, int(r.integers(0, 9)), m))
    _, e = graph(spark, catalogue, rows)
    got = {(x["graph_id"], x["a"], x["a_conn"], x["b"], x["b_conn"]) for x in e.collect()}
    conns = {}
    for p, k, s, q in CONNS:
        f = np.eye(4)
        f[1, 3] = 24.0 if (p, k) == (0, "hole") else 0.0
        conns.setdefault(p, []).append((len(conns.get(p, [])), k, s, q, f))
    want = set()
    for g, n, p, m in rows:
        for h, o, p2, m2 in rows:
            if g != h or n == o:
                continue
            for i, k, s, q, f in conns[p]:
                for j, k2, s2, q2, f2 in conns[p2]:
                    wa, wb = m @ f, m2 @ f2
                    d, dot = wb[:3, 3] - wa[:3, 3], wa[:3, 1] @ wb[:3, 1]
                    close = d @ d <= 9
                    if k == "stud" and k2 == "hole":
                        ok = close and tuple(sorted((s, s2))) in STUD_MATES and dot >= 0.95
                    elif k == k2 != "axle" and s == s2 and (q, q2) == ("in", "on"):
                        ok = close and (abs(dot) >= 0.95 if k == "hinge" else k == "ball" or dot >= 0.9999 and np.trace(wa[:3, :3].T @ wb[:3, :3]) >= 2.99)
                    elif k == k2 == "axle" and s == "socket" and tuple(sorted((s, s2))) in AXLE_MATES and abs(dot) >= 0.9:
                        along = d @ wb[:3, 1]
                        off2, over = d @ d - along**2, 20 - abs(along)
                        ok = off2 <= 9 and (over >= 4 or np.sqrt(9 - off2) >= 4 - over - 1e-4)
                    else:
                        ok = False
                    if ok:
                        want.add((g, n, i, o, j))
    assert got == want and len(want) > 20


def test_poses_and_walks_agree(spark, catalogue):  # noqa: F811
    df = spark.createDataFrame(list(enumerate(GOOD)), "id bigint, body string")
    nodes, edges = grammar.trees(df, "id", "body", *catalogue)
    placed = walks.poses(nodes, edges, catalogue[2])
    got = {(r["key"], r["pos"]): np.reshape(r["xf"], (4, 4)) for r in placed.collect()}
    assert np.allclose(got[0, 1], at(0, -24, 0, 90)) and np.allclose(got[1, 1], at(0, 5, 0)) and np.allclose(got[0, 0], EYE)
    # joints found in the placed models, walked and decoded, give the same geometry again
    n = checkpointed(placed.select(F.col("key").alias("graph_id"), F.col("pos").alias("node"), "part_id", "color", "xf"))
    e = checkpointed(assembly.graph_edges(n, catalogue[2]))
    c = assembly.graph_components(n, e)
    assert c.select("graph_id", "component_index").distinct().count() == len(GOOD)
    again = {(r["graph_id"], r["node"]): np.reshape(r["xf"], (4, 4)) for r in walks.decoded(e, c, n, catalogue[2]).collect()}
    assert all(np.allclose(again[k], got[k], atol=1e-6) for k in got)


def edges_frame(pairs):
    return pd.DataFrame([{"family": "stud", "a": a, "b": b, "a_conn": 0, "b_conn": 0, "yaw": 0.0, "flip": False, "rot": [0.0] * 3} for a, b in pairs])


def test_walks():
    g = walks.Graph(edges_frame([(0, 3), (3, 1), (1, 2), (0, 2), (2, 4)]))
    assert [v[0] for v in walks.breadth_first(g, [0, 1, 2, 3, 4], None)] == [0, 2, 3, 1, 4]
    with pytest.raises(ValueError):
        walks.breadth_first(g, [0, 1], 9)
    for seed in range(5):
        v = walks.depth_first(g, [0, 1, 2, 3, 4], seed)
        assert sorted(x[0] for x in v) == [0, 1, 2, 3, 4] and v == walks.depth_first(g, [0, 1, 2, 3, 4], seed)
    for seed in range(5):
        root, draw = walks.drawn([4, 3, 2, 1, 0], seed)
        free = walks.walk(g, root, walks.Bag(draw), most=3)
        assert len(free) == 3 and len({v.node for v in free}) == 3
        root, draw = walks.drawn([0, 1, 2, 3, 4], seed)
        assert walks.walk(g, root, walks.Bag(draw), lambda way, at: False) == [walks.Visit(root)]
        # the draws: one for the root, one for each way taken out of the bag
        rng = np.random.default_rng(seed)
        order, bag = [int(rng.integers(5))], []
        bag += [(order[0], v) for v, _, _ in g.out(order[0])]
        while bag:
            parent, v = bag.pop(int(rng.integers(len(bag))))
            if v not in order:
                order.append(v)
                bag += [(v, w) for w, _, _ in g.out(v) if w not in order]
        root, draw = walks.drawn([0, 1, 2, 3, 4], seed)
        assert [v.node for v in walks.walk(g, root, walks.Bag(draw))] == order


def test_collisions(spark, catalogue, monkeypatch):  # noqa: F811
    meshes = box_meshes(catalogue[2], 5.0)
    rows = [(1, 0, 0, EYE), (1, 1, 0, at(0, -40, 0)), (1, 2, 0, at(4, -40, 0)), (1, 3, 0, at(0, -40, 0)), (2, 0, 3, EYE), (2, 1, 3, at(100, 0, 0)), (3, 0, 7, EYE), (3, 1, 8, at(1, 0, 0))]
    placed = spark.createDataFrame([(k, p, i, m.ravel().tolist()) for k, p, i, m in rows], "key int, pos int, part_id int, xf array<double>")
    pairs = collision.colliding_pairs(placed, meshes)
    # the part of 34 by 10 units at 0 and the one 40 above it are 6 apart; the others cross
    want = {(1, 1, 2), (1, 1, 3), (1, 2, 3), (3, 0, 1)}
    assert {tuple(r) for r in pairs.collect()} == want
    monkeypatch.setattr(collision, "HELD_BYTES", -1)  # meshes joined to the pairs
    assert {tuple(r) for r in collision.colliding_pairs(placed, meshes).collect()} == want
    fixed = spark.createDataFrame([(3, 1, 0)], "key int, pos int, parent int")
    got = {r["key"]: (r["collisions"], r["first"]) for r in collision.collisions(placed, pairs, fixed).collect()}
    assert got[2] == ([], 2) and got[3] == ([], 2) and got[1][0][-2:] == [2, 3]
    with pytest.raises(Exception, match="no mesh for part 77"):
        collision.colliding_pairs(placed.withColumn("part_id", F.lit(77)), meshes).collect()


def test_scene():
    box = collision.Mesh([[x, y, z] for x in (0.0, 1.0) for y in (0.0, 1.0) for z in (0.0, 1.0)], [[0, 1, 3], [0, 3, 2], [4, 6, 7], [4, 7, 5], [0, 4, 5], [0, 5, 1], [2, 3, 7], [2, 7, 6], [0, 2, 6], [0, 6, 4], [1, 5, 7], [1, 7, 3]], np.zeros(3), np.ones(3))
    scene = collision.Scene()
    assert scene.hits(box, EYE) == []
    for m in (EYE, at(3, 0, 0), at(0.5, 0.5, 0.5)):
        scene.add(box, m)
    assert scene.hits(box, at(0.9, 0.2, 0.1)) == [0, 2] and scene.hits(box, at(9, 0, 0)) == [] and scene.hits(box, at(3.2, 0.1, 0.1, 45)) == [1]


def test_turned_boxes_apart_only_if_no_point_is_in_both():
    r = np.random.default_rng(9)
    n = 300
    turn = np.linalg.qr(r.normal(size=(2 * n, 3, 3)))[0]
    m = np.tile(np.eye(4), (2 * n, 1, 1))
    m[:, :3, :3], m[:, :3, 3] = turn, r.normal(0, 1.5, (2 * n, 3))
    lo, hi = -r.random((2 * n, 3)) - 0.1, r.random((2 * n, 3)) + 0.1
    lo[5], hi[5] = [0, -1, -1], [0, 1, 1]  # a flat one
    a, b = collision.Boxes(lo[:n], hi[:n], m[:n]), collision.Boxes(lo[n:], hi[n:], m[n:])
    apart = collision.parted(a, b)
    assert 20 < apart.sum() < n - 20
    grid = np.stack(np.meshgrid(*[np.linspace(0, 1, 12)] * 3), axis=-1).reshape(-1, 3)
    for k in range(n):
        p = (lo[k] + grid * (hi[k] - lo[k])) @ m[k, :3, :3].T + m[k, :3, 3]
        q = (p - m[n + k, :3, 3]) @ m[n + k, :3, :3]
        inside = ((q >= lo[n + k]) & (q <= hi[n + k])).all(axis=1).any()
        assert not (inside and apart[k])


def test_boxes_apart_like_corners():
    # boxes with parallel axes: the test must agree with plain interval overlap
    r = np.random.default_rng(3)
    lo, hi = -r.random((200, 3)) * 3, r.random((200, 3)) * 3
    m = np.tile(np.eye(4), (200, 1, 1))
    m[:, :3, 3] = r.normal(0, 3, (200, 3))
    a, b = collision.Boxes(lo[:100], hi[:100], m[:100]), collision.Boxes(lo[100:], hi[100:], m[100:])
    want = ((lo[:100] + m[:100, :3, 3] > hi[100:] + m[100:, :3, 3]) | (lo[100:] + m[100:, :3, 3] > hi[:100] + m[:100, :3, 3])).any(axis=1)
    assert (collision.parted(a, b) == want).all()


def test_joins_by_distance_and_box(spark):
    r = np.random.default_rng(4)
    p = r.normal(0, 6, (150, 3))
    g = r.integers(0, 3, 150)
    df = spark.createDataFrame([(int(g[k]), k, p[k].tolist()) for k in range(150)] + [(0, 999, None)], "g int, id int, p array<double>")
    got = {(x["g"], x["a"], x["b"]) for x in spatial.radius_pairs(df, ["g"], "id", 3.0).collect()}
    assert got == {(int(g[i]), i, j) for i in range(150) for j in range(i + 1, 150) if g[i] == g[j] and ((p[i] - p[j]) ** 2).sum() <= 9}
    boxes = df.where("p is not null").select("g", "id", "p", F.transform("p", lambda v: v + 2.5).alias("q"))
    rows = spatial.overlapping_boxes(boxes, ["g"], "id", 2.0, "p", "q").collect()
    assert len(rows) == len(set(rows))
    assert {(x["g"], x["a"], x["b"]) for x in rows} == {(int(g[i]), i, j) for i in range(150) for j in range(i + 1, 150) if g[i] == g[j] and (np.abs(p[i] - p[j]) <= 2.5).all()}


def test_components(spark):
    r = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in r.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(1000, 1400)] + [(2000, 2000), (2000, 2000)]
    df = spark.createDataFrame([*pairs, (None, 3)], "a bigint, b bigint")
    low = {}

    def find(x):
        while low.setdefault(x, x) != x:
            x = low[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        low[b] = a
    assert {x["node"]: x["component"] for x in connected_components(df, "a", "b").collect()} == {k: find(k) for k in list(low)}
    assert connected_components(df.limit(0), "a", "b").count() == 0


def test_graph_components(spark, monkeypatch):
    nodes = spark.createDataFrame([(g, n) for g in (1, 2) for n in range(7)], "graph_id int, node int")
    edges = spark.createDataFrame([(1, 0, 6), (1, 6, 3), (1, 1, 2), (2, 5, 4)], "graph_id int, a int, b int")
    want = None
    for most in (100, 1):
        monkeypatch.setattr(assembly, "WHOLE_GRAPH", most)
        got = {(r["graph_id"], r["node"]): (r["component_index"], r["size"]) for r in assembly.graph_components(nodes, edges).collect()}
        assert got[1, 3] == (0, 3) and got[1, 2] == (1, 2) and got[1, 4] == (2, 1) and got[2, 4] == (0, 2) and got[2, 0] == (1, 1)
        assert want is None or got == want
        want = got


def test_offsets(spark):
    df = spark.createDataFrame([(k, k % 4) for k in range(200)] + [(500, None)], "k int, n bigint")
    rows = offsets.packed(df, "k", "n").orderBy("k").collect()
    total = 0
    for x in rows:
        assert x["lo"] == total
        total = x["hi"]
    assert total == sum(k % 4 for k in range(200))
    back = offsets.unpacked(offsets.packed(df, "k", "n"), "k").collect()
    assert sorted(x["entry"] for x in back) == list(range(total))


def test_catalogue_tables(spark, catalogue):  # noqa: F811
    labels = spark.createDataFrame([("brick1", "stud", "stud", None, 0, [0.0, 0.0, 0.0]), ("brick1", "hole", "hole", None, 0, [0.0, 24.0]), ("axle2", "axle", "axle", None, 0, [0.0, 0.0, 0.0, 0.0, 0.0, 20.0])], "stem string, kind string, sub string, pol string, row int, v array<double>")
    got = {(r["part_id"], r["kind"]): r for r in catalog.connectors_from_labels(labels, catalogue[0]).collect()}
    assert got[0, "hole"]["conn_idx"] == 0 and got[0, "stud"]["conn_idx"] == 1 and got[0, "hole"]["frame"][7] == 24.0
    assert got[1, "axle"]["length"] == 20.0 and got[0, "stud"]["length"] is None
    assert {r["code"]: r["name"] for r in catalog.color_names(catalogue[1]).collect()}[72] == "dark gray"
    assert len(PARTS) == catalogue[0].count()


def test_sampled_trees_realise_to_what_was_walked(spark, catalogue):  # noqa: F811
    rows = [(1, n, 0, at(0, -24.0 * n, 0, 30.0 * n)) for n in range(6)] + [(2, 0, 2, at(0, 5, 0)), (2, 1, 1, EYE), (3, 0, 6, EYE), (3, 1, 5, EYE), (4, 0, 3, EYE), (4, 1, 4, EYE @ walks.HALF_TURN)]
    nodes, e = graph(spark, catalogue, rows)
    c = assembly.graph_components(nodes, e)
    seeds = c.select("graph_id", "component_index").distinct().withColumn("seed", F.lit(7).cast("bigint"))
    # tiny meshes far from touching: nothing collides
    meshes = spark.createDataFrame([(p, [[0.0, 0.0, 0.0], [0.1, 0.0, 0.0], [0.0, 0.1, 0.0]], [[0, 1, 2]], [0.0] * 3, [0.1, 0.1, 0.0]) for p in range(9)], "part_id int, vertices array<array<double>>, faces array<array<int>>, local_lo array<double>, local_hi array<double>")
    for walk in (walks.sampled(e, c, nodes, catalogue[2], meshes.where("part_id < 3 or part_id > 8"), seeds.where("graph_id < 3")), walks.walked(e, c, seeds, "random"), walks.walked(e, c, seeds.withColumn("seed", F.lit(None).cast("bigint")), "bfs")):
        n, t = walks.trees_of(walk, nodes, catalogue[2])
        text = grammar.serialized(n, t, *catalogue[:2])
        again = grammar.scores(text.select(F.col("key.graph_id").alias("g"), "text"), "g", "text", *catalogue)
        assert all(r["invalid"] is None for r in again.collect())
        placed = {(r["key"]["graph_id"], r["pos"]): np.reshape(r["xf"], (4, 4)) for r in walks.poses(n, t, catalogue[2]).collect()}
        world = {(g, k): m for g, k, _, m in rows}
        order = {(r["graph_id"], r["pos"]): r["node"] for r in walk.collect()}
        for (g, k), m in placed.items():
            root = world[g, order[g, 0]]
            assert np.allclose(root @ m, world[g, order[g, k]], atol=1e-6), (g, k)


def test_trees_as_graphs(spark, catalogue):  # noqa: F811
    df = spark.createDataFrame(list(enumerate(GOOD)), "id bigint, body string")
    nodes, edges = grammar.trees(df, "id", "body", *catalogue)
    n, e = walks.graphs_of(nodes, edges, catalogue[2])
    n, e = checkpointed(n), checkpointed(e)
    got = {r["graph_id"]: tuple(r)[1:6] + (round(r["yaw"], 6), r["flip"], [round(v, 6) for v in r["rot"]]) for r in e.collect()}
    turn = round(np.pi / 2, 6)
    assert got[0] == ("stud", 0, 1, 1, 0, turn, False, [0.0] * 3) and got[1] == ("axle", 0, 0, 1, 0, -5.0, False, [0.0] * 3)
    # a ball's edge runs from the side with polarity in, here the child
    assert got[3][:5] == ("ball", 1, 0, 0, 0) and got[3][7] == [round(np.radians(v), 6) for v in (1, 2, 3)]
    # what the graph realises to is what the tree does
    c = checkpointed(assembly.graph_components(n, e))
    again = {(r["key"], r["pos"]): np.reshape(r["xf"], (4, 4)) for r in walks.realised(n, e, c, catalogue[2]).collect()}
    want = {(r["key"], r["pos"]): np.reshape(r["xf"], (4, 4)) for r in walks.poses(nodes, edges, catalogue[2]).collect()}
    assert set(again) == set(want) and all(np.allclose(again[k], want[k], atol=1e-9) for k in want)
    # two components share no frame
    loose = n.unionByName(spark.createDataFrame([(0, 7, 0, 4)], "graph_id bigint, node int, part_id int, color int"))
    with pytest.raises(Exception, match="more than one component"):
        walks.realised(loose, e, assembly.graph_components(loose, e), catalogue[2]).collect()
    seeds = spark.createDataFrame([(0, 3, 1)], "graph_id bigint, component_index int, seed bigint")
    with pytest.raises(Exception, match="has no component 3"):
        walks.walked(e, c, seeds).collect()

"""The one-task kernels against the operators that work on tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from studflow.operators import assembly, collision, grammar, walks, whole_texts
from studflow.plans.catalogue import box_meshes
from studflow.tables import checkpointed

from .test_grammar import GOOD, broken, catalogue  # noqa: F401

#: Right texts, texts cut at a wrong pair, at a dangling node, by a parent that is none, a long label and far slides.
TEXTS = [
    *GOOD, GOOD[0][:-1], GOOD[0] + "c Brick 1 x 1 | red", "", "\n", "a Brick 1 x 1 | red", "a | red\n", None,
    "a Brick 1 x 1 | red\n" + "".join(f"{x} Brick 1 x 1 | blue\n{y} stud stud a hole a {90 * (i % 4)}\n" for i, (x, y) in enumerate(zip("bcdefg", "aaabcb"))),
    "a Brick 1 x 1 | red\nb Brick 1 x 1 | red\na stud stud a hole a 90\nc Brick 1 x 1 | red\nc stud stud a hole a 0\nd Brick 1 x 1 | red\na stud stud a hole a 0\n",
    "a Axle 2 | red\nb Bush | red\na axle axle a socket a regular 10 999999999999999999\nc Bush | blue\na axle axle a socket a flip 350 -7\n",
    f"{'z' * 20} Brick 1 x 1 | red\nb Brick 1 x 1 | dark gray\na stud hole a stud a 359\n",
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([*enumerate(TEXTS), (None, GOOD[0])], "id bigint, body string")


@pytest.fixture(scope="module")
def graph(texts, catalogue):  # noqa: F811
    nodes = checkpointed(walks.poses(*grammar.trees(texts, "id", "body", *catalogue), catalogue[2]))
    nodes = nodes.select(F.col("key").alias("graph_id"), F.col("pos").alias("node"), "part_id", "color", "xf")
    return nodes, checkpointed(assembly.graph_edges(nodes, catalogue[2]))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("name", ["path_joints", "path_collisions", "rewalked_breadth_first", "rewalked_at_random"])
def test_nothing_of_a_model_is_shuffled(spark, name):
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning" not in plan


def test_trees_like_tables(spark, catalogue):  # noqa: F811
    got, reader = [], whole_texts.Reader(whole_texts.held(*catalogue).value)
    bodies = [t for seed in range(4) for t in broken(seed)]
    t = reader.read(bodies)
    for k, (i, pos, part, color) in enumerate(zip(*(v.tolist() for v in (t.text, t.pos, t.part, t.color)))):
        got.append((i, pos, part, color, int(t.pos[t.parent[k]]) if pos else None))
    nodes, edges = grammar.trees(spark.createDataFrame(list(enumerate(bodies)), "id bigint, body string"), "id", "body", *catalogue)
    want = rows(nodes.join(edges.select("key", "pos", "parent"), ["key", "pos"], "left").select("key", "pos", "part_id", "color", "parent"))
    assert len(want) > 100 and sorted(got, key=repr) == want


@pytest.mark.parametrize("size", [1, whole_texts.SLICE])
def test_joints_like_tables(texts, graph, catalogue, monkeypatch, size):  # noqa: F811
    monkeypatch.setattr(whole_texts, "SLICE", size)
    q = assembly.tree_edge(F.col("family"), F.lit(True), F.col("yaw"), F.col("flip"), F.col("rot"))
    want = rows(graph[1].select("graph_id", "family", "a", "a_conn", "b", "b_conn", q["yaw"], q["flip"], q["slide"]))
    assert len(want) > 20 and rows(whole_texts.text_joints(texts, "id", "body", *catalogue)) == want


def test_collisions_like_tables(texts, graph, catalogue):  # noqa: F811
    nodes, edges = grammar.trees(texts, "id", "body", *catalogue)
    placed = graph[0].select(F.col("graph_id").alias("key"), F.col("node").alias("pos"), "part_id", "color", "xf")
    meshes = box_meshes(catalogue[2])
    want = rows(collision.collisions(placed, collision.colliding_pairs(placed, meshes), edges.where("family = 'fixed'").select("key", "pos", "parent")))
    assert any(r[1] for r in want) and rows(whole_texts.text_collisions(texts, "id", "body", *catalogue, meshes)) == want
    with pytest.raises(Exception, match="no mesh for part 1"):
        whole_texts.text_collisions(texts, "id", "body", *catalogue, meshes.where("part_id <> 1")).collect()


@pytest.mark.parametrize("method,seed", [("bfs", None), ("bfs", 0), ("random", 0), ("random", 7)])
def test_walks_like_tables(texts, graph, catalogue, method, seed):  # noqa: F811
    nodes, edges = graph
    comps = assembly.graph_components(nodes, edges)
    seeds = comps.where("size >= 2").select("graph_id", "component_index").distinct().withColumn("seed", F.lit(seed).cast("bigint"))
    text = grammar.serialized(*walks.trees_of(walks.walked(edges, comps, seeds, method), nodes, catalogue[2]), *catalogue[:2])
    want = rows(text.select("key.graph_id", "key.component_index", "text"))
    assert len(want) > 8 and rows(whole_texts.text_walks(texts, "id", "body", *catalogue, method, seed)) == want


def test_close_pairs_like_all_pairs(monkeypatch):
    r = np.random.default_rng(2)
    monkeypatch.setattr(whole_texts, "CHUNK", 50)
    for scale in (10.0, 1e3, 1e17):
        g, p = [r.integers(0, 5, n) for n in (60, 80)], [r.normal(0, scale, (n, 3)) for n in (60, 80)]
        p[1][:40] = p[0][:40] + r.normal(0, 1, (40, 3))
        d = np.sqrt(((p[0][:, None] - p[1][None]) ** 2).sum(axis=2))
        got = [(i, j) for x, y in whole_texts.close_pairs(g[0], p[0], g[1], p[1], 3.0) for i, j in zip(x.tolist(), y.tolist())]
        want = {(i, j) for i, j in zip(*np.nonzero((d <= 3) & (g[0][:, None] == g[1][None])))}
        assert len(got) == len(set(got)) and want and want <= set(got)


def test_overlaps_like_all_pairs(monkeypatch):
    r = np.random.default_rng(3)
    monkeypatch.setattr(whole_texts, "CHUNK", 30)
    text = np.sort(r.integers(0, 4, 60))
    lo = r.integers(0, 30, (60, 3)).astype(float)
    hi = lo + r.integers(0, 8, (60, 3))
    got = [(i, j) for x, y in whole_texts.overlaps(text, lo, hi) for i, j in zip(x.tolist(), y.tolist())]
    want = [(i, j) for i in range(60) for j in range(i + 1, 60) if text[i] == text[j] and (lo[i] <= hi[j]).all() and (lo[j] <= hi[i]).all()]
    assert want and sorted(got) == want

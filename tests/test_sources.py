import io
import json
import lzma
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from studflow.operators import assembly, evaluation, grammar
from studflow.sources import files
from studflow.streaming.scoring import score_stream

from .test_grammar import GOOD, catalogue  # noqa: F401


def test_model_texts(spark, catalogue, tmp_path):  # noqa: F811
    text = "0 A model\n1 4 0 0 0 1 0 0 0 1 0 0 0 1 brick1.dat\n0 STEP\n1 1 0 -24 0 0 0 1 0 1 0 -1 0 0 BRICK1.DAT\n1 4 0\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/one.ldr").write_text(text)
    (tmp_path / "in/two.ldr").write_text("1 4 0 0 0 1 0 0 0 1 0 0 0 1 alias.dat\n1 4 0 0 0 1 0 0 0 1 0 0 0 1 nothing.dat\n")
    (tmp_path / "in/three.ldr").write_text("1 4 1 2 3 1 0 0 0 1 0 0 0 1 alias.dat\n")
    x = assembly.placements(files.read_texts(spark, f"{tmp_path}/in/*.ldr"), "name", "text")
    aliases = spark.createDataFrame([("alias", "bush", [float(v) for v in (1, 0, 0, 10, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)])], "src string, dst string, wrap array<double>")
    nodes, unknown = assembly.nodes_of(x, aliases, catalogue[0])
    assert [tuple(r) for r in unknown.collect()] == [("two", "nothing")]
    got = {(r["graph_id"], r["node"]): (r["part_id"], r["xf"][3], r["xf"][7]) for r in nodes.collect()}
    assert got == {("one", 0): (0, 0.0, 0.0), ("one", 1): (0, 0.0, -24.0), ("three", 0): (2, 11.0, 2.0)}
    out = files.model_texts(nodes.select(F.col("graph_id").alias("key"), F.col("node").alias("pos"), "part_id", "color", "xf"), catalogue[0])
    written = {r["key"]: r["text"] for r in out.collect()}
    assert written["one"] == "1 4 0 0 0 1 0 0 0 1 0 0 0 1 brick1.dat\n1 1 0 -24 0 0 0 1 0 1 0 -1 0 0 brick1.dat\n"
    files.write_text_files(out, f"{tmp_path}/out", "key", "text")
    assert (tmp_path / "out/one.ldr").read_text() == written["one"]
    assert files.number(-1e-9) == "0" and files.number(1 / 3) == "0.333333"


def test_catalogue_files(spark, tmp_path):
    (tmp_path / "names.json").write_text(json.dumps({"z": "Z", "a": "A", "m": "M"}))
    assert [tuple(r) for r in files.read_names(spark, f"{tmp_path}/names.json", "stem", "name").orderBy("ord").collect()] == [(0, "z", "Z"), (1, "a", "A"), (2, "m", "M")]
    (tmp_path / "labels.json.xz").write_bytes(lzma.compress(json.dumps({"p.dat": {"stud": {"stud": [[1, 2, 3], [4, 5, 6]]}, "hinge": {"0": {"on": [[0, 0, 0, 90]]}}}}).encode()))
    got = {(r["stem"], r["kind"], r["sub"], r["pol"], r["row"]): r["v"] for r in files.read_labels(spark, f"{tmp_path}/labels.json.xz").collect()}
    assert got == {("p", "stud", "stud", None, 0): [1, 2, 3], ("p", "stud", "stud", None, 1): [4, 5, 6], ("p", "hinge", "0", "on", 0): [0, 0, 0, 90]}
    (tmp_path / "al.json.xz").write_bytes(lzma.compress(json.dumps({"rows": [{"src": "s", "dst": "d", "final_matrix_3x4": [1, 2, 3, *range(10, 19)]}]}).encode()))
    assert files.read_aliases(spark, f"{tmp_path}/al.json.xz").first()["wrap"] == [10, 11, 12, 1, 13, 14, 15, 2, 16, 17, 18, 3, 0, 0, 0, 1]


def test_meshes(spark, catalogue, tmp_path):  # noqa: F811
    (tmp_path / "brick1.ply").write_text("ply\nformat ascii 1.0\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n0 0 0\n1 0 0\n1 1 -2\n0 1 0\n4 0 1 2 3\n")
    v = np.array([[0, 0, 0], [2, 0, 0], [0, 2, 4]], dtype="<f4")
    face = b"\x03" + np.array([0, 1, 2], dtype="<i4").tobytes()
    (tmp_path / "bush.ply").write_bytes(b"ply\nformat binary_little_endian 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n" + v.tobytes() + face)
    got = {r["part_id"]: r for r in files.read_meshes(spark, f"{tmp_path}/*.ply", catalogue[0]).collect()}
    assert got[0]["faces"] == [[0, 1, 2], [0, 2, 3]] and got[0]["local_hi"] == [1, 1, 2]
    assert got[2]["vertices"][2] == [0, 2, -4] and got[2]["faces"] == [[0, 1, 2]]


def test_graph_archives(spark, tmp_path):
    spark.dataSource.register(files.GraphArchive)
    edge = (0, 1, 1, 0, "stud", 0.5, False, [0.0, 0.0, 0.0])
    eye = np.eye(4).ravel().tolist()
    rows = [(k, [1] * (k + 1), [4] * (k + 1), [eye] * (k + 1), [edge] * k) for k in range(5)]
    df = spark.createDataFrame(rows, files.GRAPH_SCHEMA).coalesce(1)
    files.write_graph_archives(df, f"{tmp_path}/g")
    path = next((tmp_path / "g").iterdir())
    back = spark.read.format("graph_archive").option("graphs_per_task", 2).load(str(path))
    assert back.rdd.getNumPartitions() == 3
    assert [(r[0], r[1], r[2], r[3], [tuple(e) for e in r[4]]) for r in back.orderBy("graph").collect()] == rows
    files.write_graph_archives(df.withColumn("transforms", F.lit(None).cast("array<array<double>>")), f"{tmp_path}/h")
    bare = spark.read.format("graph_archive").load(str(next((tmp_path / "h").iterdir())))
    assert all(r["transforms"] is None for r in bare.collect())


def test_render_archives(spark, tmp_path):
    def archive(name, members):
        with tarfile.open(tmp_path / name, "w") as t:
            for m in members:
                i = tarfile.TarInfo(m)
                i.size = 1
                t.addfile(i, io.BytesIO(b"x"))

    archive("a.tar", ["prompt_0000/prompt_0000_1.png", "prompt_0000/prompt_0000_0.png", "k/k_3.jpg", "k/other_3.jpg", "unknown/unknown_0.png"])
    archive("b.tar", ["k/k_10.png", "k/k_9.png"])
    p = evaluation.prompts(spark.createDataFrame([(1, None, " one "), (2, "k", "two"), (3, "k", "three"), (4, "z", None), (5, "y", "five")], "line_no bigint, id string, caption string"))
    assert {r["prompt_index"]: (r["prompt_key"], r["caption"]) for r in p.collect()} == {0: ("prompt_0000", "one"), 1: ("k", "two"), 2: ("k", "three"), 3: ("y", "five")}
    v = evaluation.views(files.read_members(spark, f"{tmp_path}/*.tar"), p)
    assert {r["prompt_index"]: (r["archive"], r["views"]) for r in v.collect()} == {0: ("a.tar", ["prompt_0000/prompt_0000_0.png", "prompt_0000/prompt_0000_1.png"]), 2: ("b.tar", ["k/k_9.png", "k/k_10.png"])}
    assert {r["prompt_index"] for r in evaluation.missing(p, v).collect()} == {1, 3}


def test_json_lines(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (3, None)], "k int, t string")
    files.write_json_lines(df.coalesce(1), f"{tmp_path}/j", ["k"])
    assert [tuple(r) for r in files.read_json_lines(spark, f"{tmp_path}/j", "k int, t string").collect()] == [(1, "a"), (2, "b"), (3, None)]


def test_stream(spark, catalogue, tmp_path):  # noqa: F811
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text("".join(json.dumps({"id": str(k), "sample": k, "text": t}) + "\n" for k, t in enumerate(GOOD)))
    (tmp_path / "in/2.json").write_text(json.dumps({"id": "x", "sample": 0, "path": GOOD[0][:-3], "text": "never"}) + "\n" + json.dumps({"id": "y", "sample": 0}) + "\n")
    score_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", *catalogue).awaitTermination()
    got = {(r["id"], r["sample"]): (r["n_actions"], r["invalid"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(str(k), k): (2, None) for k in range(len(GOOD))} | {("x", 0): (2, 1), ("y", 0): (None, None)}
    assert got == want
    assert grammar.scores(spark.createDataFrame([(1, GOOD[0])], "k int, t string"), "k", "t", *catalogue).count() == 1


def test_ranges_of_packed_arrays(spark, tmp_path):
    import zipfile

    a = np.arange(3000, dtype=np.int32).reshape(1000, 3)
    np.savez_compressed(tmp_path / "a.npz", a=a, b=np.zeros((0, 2)))
    with zipfile.ZipFile(tmp_path / "a.npz") as z:
        assert (files.Member(z, "a").rows(10, 13) == a[10:13]).all() and files.Member(z, "a").rows(1000, 1000).shape == (0, 3)
        assert files.Member(z, "b").shape == (0, 2)


def test_large_archives_of_renders(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar", "w") as t:
        for k in range(12_000):
            t.addfile(tarfile.TarInfo(f"k{k}/k{k}_0.png"))
    assert files.read_members(spark, f"{tmp_path}/a.tar").selectExpr("count(distinct name)").first()[0] == 12_000


def test_prompts_and_evaluation_rows(spark):
    p = spark.createDataFrame([(0, "a", "one"), (1, "b", "two")], "prompt_index bigint, prompt_key string, caption string")
    v = spark.createDataFrame([(0, "x.tar", ["a_0"]), (1, "x.tar", ["b_0"])], "prompt_index bigint, archive string, views array<string>")
    assert evaluation.required(p, v).count() == 2
    with pytest.raises(Exception, match="1 prompts have no rendered views"):
        evaluation.required(p, v.where("prompt_index = 0")).collect()
    assert evaluation.checked_prompts(p).count() == 2
    with pytest.raises(Exception, match="no prompts found"):
        evaluation.checked_prompts(p.limit(0)).collect()
    s = spark.createDataFrame([(0, "a", "one", 1, 0.5), (0, "a", "one", 0, 0.25)], "prompt_index bigint, prompt_key string, caption string, view int, score double")
    assert tuple(evaluation.rows_of(s).first()) == (0, "a", "one", [0.25, 0.5], 0.5, 0.375)


def test_shards_and_folders(spark, tmp_path, monkeypatch):
    for k, rows in enumerate(([("b", 0), ("a", 1)], [("a", 0)])):
        (tmp_path / f"out.jsonl.shard{k}").write_text("".join(json.dumps({"id": i, "sample": s, "text": "t"}) + "\n" for i, s in rows))
    files.merge_shards(spark, f"{tmp_path}/out.jsonl.shard*", f"{tmp_path}/merged", "id string, sample int, text string")
    got = [json.loads(x) for f in sorted((tmp_path / "merged").glob("part-*")) for x in f.read_text().splitlines()]
    assert [(r["id"], r["sample"]) for r in got] == [("a", 0), ("a", 1), ("b", 0)]
    monkeypatch.setenv("STUDFLOW_CATALOG", "v2")
    monkeypatch.setenv("STUDFLOW_DATA", "/data")
    assert files.catalogue_folder("/c/") == "/c/v2" and files.catalogue_folder("/c", "v3") == "/c/v3"
    assert files.data_folder() == "/data" and files.data_folder("/x") == "/x"

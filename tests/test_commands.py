import io
import json

import numpy as np
import pytest

from studflow import __main__ as commands
from studflow.sources import files

from .test_grammar import GOOD, catalogue  # noqa: F401


@pytest.fixture
def folder(spark, catalogue, tmp_path):  # noqa: F811
    for name, df in zip(("parts", "colors", "connectors"), catalogue):
        df.write.parquet(f"{tmp_path}/cat/{name}.parquet")
    spark.createDataFrame([], "src string, dst string, wrap array<double>").write.parquet(f"{tmp_path}/cat/aliases.parquet")
    (tmp_path / "mesh").mkdir()
    for stem in ("brick1", "axle2", "bush", "hin", "hon", "bin", "bon", "fin", "fon"):
        (tmp_path / f"mesh/{stem}.ply").write_text("ply\nformat ascii 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n0 0 0\n1 0 0\n0 1 0\n3 0 1 2\n")
    return tmp_path


def lines(path):
    return [json.loads(x) for f in sorted(path.glob("part-*")) for x in f.read_text().splitlines()]


def test_score(folder):
    (folder / "in.jsonl").write_text("".join(json.dumps(r) + "\n" for r in ({"id": "a", "text": GOOD[0], "invalid": 9}, {"id": "b", "text": GOOD[0][:-4]})))
    commands.main(["score", f"{folder}/in.jsonl", f"{folder}/out", "--catalog", f"{folder}/cat", "--no-collision"])
    got = lines(folder / "out")
    assert [(r["id"], r["n_actions"], r["invalid"], r["collisions"]) for r in got] == [("a", 2, None, None), ("b", 2, 1, None)]
    commands.main(["score", f"{folder}/in.jsonl", f"{folder}/out2", "--catalog", f"{folder}/cat", "--meshes", f"{folder}/mesh/*.ply"])
    assert [r["collisions"] for r in lines(folder / "out2")] == [[], []]
    with pytest.raises(SystemExit):
        commands.main(["score", f"{folder}/in.jsonl", f"{folder}/out3", "--catalog", f"{folder}/cat"])


def test_path2ldr(folder, capsys, monkeypatch):
    (folder / "t.jsonl").write_text("".join(json.dumps(r) + "\n" for r in ({"id": "a", "path": GOOD[0]}, {"id": "b", "text": GOOD[0][:-1]}, {"id": "c", "text": GOOD[1]})))
    commands.main(["path2ldr", f"{folder}/t.jsonl", f"{folder}/ldr", "--catalog", f"{folder}/cat"])
    assert sorted(p.name for p in (folder / "ldr").glob("*.ldr")) == ["a.ldr", "c.ldr"]
    err = capsys.readouterr().err
    assert "skip b: parse error: missing trailing newline" in err and "2 converted, 1 skipped" in err
    monkeypatch.setattr("sys.stdin", io.StringIO(GOOD[0]))
    commands.main(["path2ldr", "-", "--catalog", f"{folder}/cat"])
    assert capsys.readouterr().out.startswith("1 4 0 0 0 1 0 0 0 1 0 0 0 1 brick1.dat\n1 72 0 -24 0")


def test_sample(spark, folder, capsys):
    (folder / "models").mkdir()
    (folder / "models/one.ldr").write_text("1 4 0 0 0 1 0 0 0 1 0 0 0 1 brick1.dat\n1 1 0 -24 0 1 0 0 0 1 0 0 0 1 brick1.dat\n")
    (folder / "models/two.ldr").write_text("1 4 0 0 0 1 0 0 0 1 0 0 0 1 nothing.dat\n")
    commands.main(["sample", f"{folder}/models", f"{folder}/s", "--catalog", f"{folder}/cat", "--meshes", f"{folder}/mesh/*.ply", "--n", "2", "--seed", "5"])
    got = lines(folder / "s")
    assert [(r["source"], r["sample_index"], r["nodes"], r["complete_npz"]) for r in got] == [("one", 0, 2, True), ("one", 1, 2, True)]
    assert "skip two: unknown part 'nothing'" in capsys.readouterr().err
    eye = np.eye(4).ravel().tolist()
    up = np.eye(4)
    up[1, 3] = -24.0
    rows = [(0, [0, 0], [4, 1], [eye, up.ravel().tolist()], [(0, 1, 1, 0, "stud", 0.0, False, [0.0, 0.0, 0.0])])]
    files.write_graph_archives(spark.createDataFrame(rows, files.GRAPH_SCHEMA).coalesce(1), f"{folder}/g")
    commands.main(["sample", str(next((folder / "g").iterdir())), "--catalog", f"{folder}/cat", "--meshes", f"{folder}/mesh/*.ply"])
    assert json.loads(capsys.readouterr().out)["nodes"] == 2

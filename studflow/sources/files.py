"""Readers and writers of model texts, JSON lines, graph archives, label archives, meshes and render archives."""

from __future__ import annotations

import io
import json
import lzma
import os
import re
import tarfile
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.scalar import stem

KINDS = ("stud", "hole", "hinge", "fixed", "ball", "axle")  # codes of edge kinds in archives, in order (fixed values)


# --- texts -----------------------------------------------------------------------------------------------------


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """name (of the file, without folder and ending), text: whole files, such as a folder's *.ldr or *.txt."""
    x = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_name").alias("file"))
    return x.select(F.regexp_replace("file", r"\.[^.]*\z", "").alias("name"), "text")


def read_json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines; with a schema no pass is needed to infer one. Blank lines are passed over."""
    r = spark.read.option("mode", "FAILFAST")
    return (r.schema(schema) if schema else r).json(path)


def write_json_lines(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """JSON lines, in the order of these columns across the numbered part files."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def merge_shards(spark: SparkSession, shards: str, path: str, schema: str | None = None) -> None:
    """The rows of generation shards (JSON lines with id and sample) as one folder of JSON lines, by id and sample."""
    write_json_lines(read_json_lines(spark, shards, schema), path, ["id", "sample"])


def number(v: float) -> str:
    """Rounded to six places, without a negative zero, in at most twelve digits."""
    return f"{round(v, 6) + 0.0:.12g}"


def model_texts(placed: DataFrame, parts: DataFrame) -> DataFrame:
    """key, text: each model (key, pos, part_id, color, xf) as part lines in order, each with its line end."""
    x = placed.join(F.broadcast(parts.select("part_id", "stem")), "part_id").select("key", "pos", "color", "stem", "xf")
    kind = x.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for c, s, m in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                out.append(" ".join(("1", str(c), *(number(m[k]) for k in (3, 7, 11, 0, 1, 2, 4, 5, 6, 8, 9, 10)), f"{s}.dat")))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["key", "pos", "line"])

    lines = x.mapInArrow(run, f"key {kind}, pos int, line string")
    return lines.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l")).select("key", F.concat(F.array_join(F.transform("l", lambda s: s["line"]), "\n"), F.lit("\n")).alias("text"))


def _folder(path: str):
    """The file system of a folder, which is made if need be, and the folder's path in it."""
    import pyarrow.fs as pafs

    fs, inner = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))
    fs.create_dir(inner, recursive=True)
    return fs, inner.rstrip("/")


def write_text_files(df: DataFrame, folder: str, name: str, text: str, ending: str = ".ldr") -> None:
    """One file a row, named by a column, in a folder that all executors share (local or of any file system that
    pyarrow knows); of equal names the last one written stays."""

    def write(rows) -> None:
        fs, inner = _folder(folder)
        for r in rows:
            with fs.open_output_stream(f"{inner}/{r[0]}{ending}") as f:
                f.write(r[1].encode("utf-8"))

    _folder(folder)
    df.select(F.col(name).cast("string"), text).where(F.col(text).isNotNull()).foreachPartition(write)


# --- catalogue files -------------------------------------------------------------------------------------------


def catalogue_folder(root: str, version: str | None = None) -> str:
    """The folder of a catalogue's version: the one named, or by STUDFLOW_CATALOG, or v1."""
    return f"{root.rstrip('/')}/{version or os.environ.get('STUDFLOW_CATALOG', 'v1')}"


def data_folder(path: str | None = None) -> str:
    """Where large data (meshes) lie: the folder named, or by STUDFLOW_DATA, or one of the user's."""
    return path or os.environ.get("STUDFLOW_DATA") or os.path.join(os.environ.get("XDG_DATA_HOME") or os.path.expanduser("~/.local/share"), "studflow")


def read_names(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """ord, key, value: a JSON object's entries in file order."""
    x = spark.read.text(path, wholetext=True)
    pairs = F.from_json("value", "map<string,string>")
    return x.select(F.posexplode(F.map_entries(pairs)).alias("ord", "e")).select("ord", F.col("e.key").alias(key), F.col("e.value").alias(value))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """stem, kind, sub, pol, row, v: the connector labels of an xz-packed JSON file, in file order within each list."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                out = []
                for file, kinds in json.loads(lzma.decompress(content)).items():
                    for kind, subs in kinds.items():
                        for sub, val in subs.items():
                            for pol, rows in val.items() if isinstance(val, dict) else [(None, val)]:
                                out += [(re.sub(r"\.dat$", "", file), kind, sub, pol, k, [float(x) for x in v]) for k, v in enumerate(rows)]
                yield pd.DataFrame(out, columns=["stem", "kind", "sub", "pol", "row", "v"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "stem string, kind string, sub string, pol string, row int, v array<double>")


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, wrap: the aliases of an xz-packed JSON file; matrices of 12 numbers come as x y z and nine rows first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                rows = json.loads(lzma.decompress(content))["rows"]
                m = [r["final_matrix_3x4"] for r in rows]
                yield pd.DataFrame({"src": [r["src"] for r in rows], "dst": [r["dst"] for r in rows], "wrap": [[*v[3:6], v[0], *v[6:9], v[1], *v[9:12], v[2], 0.0, 0.0, 0.0, 1.0] for v in m]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "src string, dst string, wrap array<double>")


def parse_ply(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and triangles of a PLY file (ASCII or binary, faces fanned into triangles)."""
    head, _, body = content.partition(b"end_header")
    body = body[body.index(b"\n") + 1 :]
    types = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}
    form, elements = "ascii", []
    for line in head.decode("ascii").splitlines():
        t = line.split()
        if t[:1] == ["format"]:
            form = t[1]
        elif t[:1] == ["element"]:
            elements.append((t[1], int(t[2]), []))
        elif t[:1] == ["property"]:
            elements[-1][2].append(t[1:])
    order = "<" if "little" in form else ">"
    words, at = (body.split(), 0) if form == "ascii" else (None, 0)
    vertices, faces = [], []

    def take(kind: str):
        nonlocal at
        if words is not None:
            at += 1
            return float(words[at - 1])
        d = np.dtype(order + types[kind])
        at += d.itemsize
        return np.frombuffer(body, d, 1, at - d.itemsize)[0]

    for name, n, props in elements:
        plain = all(p[0] != "list" for p in props)
        if plain and words is None:
            d = np.dtype([(p[1], order + types[p[0]]) for p in props])
            a = np.frombuffer(body, d, n, at)
            at += d.itemsize * n
            if name == "vertex":
                vertices = np.stack([a[c] for c in "xyz"], axis=1).astype(float)
            continue
        for _ in range(n):
            row = {}
            for p in props:
                row[p[-1]] = [int(take(p[2])) for _ in range(int(take(p[1])))] if p[0] == "list" else take(p[0])
            if name == "vertex":
                vertices.append([float(row[c]) for c in "xyz"])
            elif name == "face":
                f = next(v for v in row.values() if isinstance(v, list))
                faces += [[f[0], f[k], f[k + 1]] for k in range(1, len(f) - 1)]
    return np.asarray(vertices, dtype=float).reshape(-1, 3), np.asarray(faces, dtype=np.int64).reshape(-1, 3)


def read_meshes(spark: SparkSession, path: str, parts: DataFrame) -> DataFrame:
    """part_id, vertices, faces, local_lo, local_hi of <stem>.ply files, whose z is stored negated."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, content in zip(b["stem"], b["content"]):
                v, f = parse_ply(content)
                v = v * [1.0, 1.0, -1.0]
                rows.append((name, v.tolist(), f.tolist(), v.min(axis=0).tolist(), v.max(axis=0).tolist()))
            yield pd.DataFrame(rows, columns=["stem", "vertices", "faces", "local_lo", "local_hi"])

    x = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)\.ply\z", 1).alias("stem"), "content")
    m = x.mapInPandas(run, "stem string, vertices array<array<double>>, faces array<array<int>>, local_lo array<double>, local_hi array<double>")
    return m.join(F.broadcast(parts.select(stem(F.col("stem")).alias("stem"), "part_id")), "stem").drop("stem")


# --- render archives -------------------------------------------------------------------------------------------


def _opened(path: str):
    """A file of Hadoop's or a local path, to be read in pieces."""
    import pyarrow.fs as pafs

    if "://" not in path and not path.startswith("file:"):
        return open(path, "rb")
    if path.startswith("file:"):
        return open("/" + path[5:].lstrip("/"), "rb")
    fs, inner = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(inner)


def read_members(spark: SparkSession, path: str) -> DataFrame:
    """archive, name of all files in tar archives. A task opens its archives and goes from header to header, so that
    no archive is held in memory, whatever its size; a packed one is read through once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in b["path"]:
                with _opened(p) as f, tarfile.open(fileobj=f) as t:
                    for part in iter(lambda t=t: [m for _ in range(10_000) if (m := t.next()) is not None], []):
                        t.members = []  # what was listed needn't be kept
                        names = [m.name for m in part if m.isfile()]
                        yield pd.DataFrame({"archive": [p.rsplit("/", 1)[-1]] * len(names), "name": names})

    # the content isn't selected, so Spark lists the files without reading them
    return spark.read.format("binaryFile").load(path).select("path").mapInPandas(run, "archive string, name string")


# --- graph archives --------------------------------------------------------------------------------------------

GRAPH_SCHEMA = "graph int, part_ids array<int>, colors array<int>, transforms array<array<double>>, edges array<struct<a:int,a_conn:int,b:int,b_conn:int,family:string,yaw:double,flip:boolean,rot:array<double>>>"


class _Range(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class Member:
    """An array of an npz file that is read in ranges of its first axis: a packed member is inflated up to the range
    and no further, piece by piece, and none of it is kept but the range."""

    def __init__(self, archive: zipfile.ZipFile, name: str):
        self.f = archive.open(f"{name}.npy")
        version = np.lib.format.read_magic(self.f)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        self.shape, fortran, self.dtype = read(self.f)
        if fortran and len(self.shape) > 1:
            raise ValueError(f"{name} isn't stored row by row")
        self.row = int(np.prod(self.shape[1:], dtype=np.int64)) * self.dtype.itemsize

    def rows(self, lo: int, hi: int) -> np.ndarray:
        rest = lo * self.row
        while rest > 0:
            got = len(self.f.read(min(rest, 1 << 20)))
            if not got:
                raise ValueError("array ends before its range")
            rest -= got
        return np.frombuffer(self.f.read((hi - lo) * self.row), self.dtype).reshape(hi - lo, *self.shape[1:])


class GraphArchiveReader(DataSourceReader):
    def __init__(self, path: str, per_task: int):
        self.path, self.per_task = path, per_task

    def partitions(self) -> list[_Range]:
        with _opened(self.path) as f, zipfile.ZipFile(f) as z:
            n = Member(z, "node_ptr").shape[0] - 1
        return [_Range(k, min(k + self.per_task, n)) for k in range(0, n, self.per_task)] or [_Range(0, 0)]

    def read(self, part: _Range) -> Iterator[tuple]:
        if part.hi == part.lo:
            return
        with _opened(self.path) as f, zipfile.ZipFile(f) as z:
            cut = lambda name, at: Member(z, name).rows(int(at[0]), int(at[-1]))
            nodes, edges = (cut(n, (part.lo, part.hi + 1)).tolist() for n in ("node_ptr", "edge_ptr"))
            ids, colors = cut("part_ids", nodes), cut("colors", nodes)
            poses = cut("transforms", nodes).reshape(-1, 16) if "transforms.npy" in z.namelist() else None
            kind, idx, yaw, flip, rot = (cut(n, edges) for n in ("edge_kind", "edge_idx", "edge_yaw", "edge_flip", "edge_rot"))
        for k in range(part.hi - part.lo):
            n, e = slice(nodes[k] - nodes[0], nodes[k + 1] - nodes[0]), slice(edges[k] - edges[0], edges[k + 1] - edges[0])
            rows = [(*map(int, i), "stud" if KINDS[q] == "hole" else KINDS[q], float(y), bool(f), list(map(float, r))) for i, q, y, f, r in zip(idx[e][:, [0, 1, 2, 3]], kind[e], yaw[e], flip[e], rot[e])]
            yield part.lo + k, ids[n].tolist(), colors[n].tolist(), None if poses is None else poses[n].tolist(), rows


class GraphArchive(DataSource):
    """spark.read.format("graph_archive").load(path): one row a graph of a batched npz file, read in ranges."""

    @classmethod
    def name(cls) -> str:
        return "graph_archive"

    def schema(self) -> str:
        return GRAPH_SCHEMA

    def reader(self, schema) -> GraphArchiveReader:
        return GraphArchiveReader(self.options["path"], int(self.options.get("graphs_per_task", "2000")))


def archive_graphs(archive: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of an archive's graphs, as assembly has them; xf is null in archives without poses."""
    n = archive.select(F.col("graph").alias("graph_id"), F.posexplode(F.arrays_zip("part_ids", "colors", F.coalesce("transforms", F.transform("part_ids", lambda _: F.lit(None).cast("array<double>"))).alias("poses"))).alias("node", "p"))
    nodes = n.select("graph_id", "node", F.col("p.part_ids").alias("part_id"), F.col("p.colors").alias("color"), F.col("p.poses").alias("xf"))
    return nodes, archive.select(F.col("graph").alias("graph_id"), F.explode("edges").alias("e")).select("graph_id", "e.*")


def write_graph_archives(graphs: DataFrame, folder: str) -> None:
    """One batched npz file for each partition of graphs (rows of GRAPH_SCHEMA, by graph number), so no task holds more
    than its own. A partition that mixes graphs with and without poses is rejected."""
    _folder(folder)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        f = pd.concat(list(frames), ignore_index=True) if frames else pd.DataFrame()
        if len(f):
            f = f.sort_values("graph")
            rooted = f["transforms"].notna()
            if rooted.any() and not rooted.all():
                raise ValueError("graphs with and without poses in one archive")
            edges = [e for es in f["edges"] for e in es]
            size = lambda col: np.concatenate(([0], np.cumsum([len(x) for x in f[col]]))).astype(np.int64)
            out = {
                "part_ids": np.concatenate([np.asarray(x, dtype=np.int32) for x in f["part_ids"]]), "colors": np.concatenate([np.asarray(x, dtype=np.int32) for x in f["colors"]]),
                "node_ptr": size("part_ids"), "edge_ptr": size("edges"),
                "edge_kind": np.array([KINDS.index(e["family"]) for e in edges], dtype=np.uint8),
                "edge_idx": np.array([[e["a"], e["a_conn"], e["b"], e["b_conn"]] for e in edges], dtype=np.int32).reshape(-1, 4),
                "edge_yaw": np.array([e["yaw"] for e in edges], dtype=float), "edge_flip": np.array([e["flip"] for e in edges], dtype=bool),
                "edge_rot": np.array([np.asarray(e["rot"], dtype=float) for e in edges], dtype=float).reshape(-1, 3),
            }
            if rooted.all():
                out["transforms"] = np.concatenate([np.stack([np.asarray(m, dtype=float).reshape(4, 4) for m in x]) for x in f["transforms"]])
            fs, inner = _folder(folder)
            # zip files are written in one go, so a task's archive is put together in memory first
            whole = io.BytesIO()
            np.savez_compressed(whole, **out)
            with fs.open_output_stream(f"{inner}/graphs-{TaskContext.get().partitionId():05d}.npz") as sink:
                sink.write(whole.getvalue())
        yield pd.DataFrame({"n": [len(f)]})

    graphs.mapInPandas(write, "n bigint").agg(F.sum("n")).collect()

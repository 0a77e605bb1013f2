"""Commands: score, sample and path2ldr, thin layers over the operators. Tables of the catalogue are Parquet files
parts, colors, connectors and aliases in one folder. A dash stands for standard input or output."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalar import first_text
from .operators import assembly, collision, grammar, walks
from .sources import files
from .tables import checkpointed, load


def _catalogue(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(load(spark, args.catalog, t) for t in ("parts", "colors", "connectors"))


def _json_rows(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with path and text, of a file, a folder or standard input, numbered in order."""
    if path == "-":
        rows = spark.read.option("mode", "FAILFAST").json(spark.createDataFrame([(x,) for x in sys.stdin.read().splitlines() if x.strip()], "value string").rdd.map(lambda r: r[0]))
    else:
        rows = files.read_json_lines(spark, path)
    for c in ("path", "text"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    # numbers must be the same for all readings
    return checkpointed(rows.withColumn("__key", F.monotonically_increasing_id()).withColumn("__text", first_text(F.col("path"), F.col("text"))))


def _out(df: DataFrame, path: str | None, order: list[str]) -> None:
    if path in (None, "-"):
        for r in df.orderBy(*order).toJSON().toLocalIterator():
            print(r)
    else:
        files.write_json_lines(df, path, order)


def score(spark: SparkSession, args: argparse.Namespace) -> None:
    """Scores JSON lines (path or text) and writes them with n_actions, invalid and collisions; prints the summary."""
    parts, colors, connectors = _catalogue(spark, args)
    rows = _json_rows(spark, args.input)
    done = rows.drop("n_actions", "invalid", "collisions").join(grammar.scores(rows, "__key", "__text", parts, colors, connectors).withColumnRenamed("key", "__key"), "__key", "left")
    if args.no_collision:
        done = done.withColumn("collisions", F.lit(None).cast("array<int>"))
    elif not args.meshes:
        sys.exit("--meshes or --no-collision is required")
    else:
        nodes, edges = grammar.trees(rows, "__key", "__text", parts, colors, connectors)
        placed = checkpointed(walks.poses(nodes, edges, connectors))
        pairs = collision.colliding_pairs(placed, files.read_meshes(spark, args.meshes, parts))
        hit = collision.collisions(placed, pairs, edges.where("family = 'fixed'").select("key", "pos", "parent"))
        done = done.join(hit.select(F.col("key").alias("__key"), "collisions"), "__key", "left").withColumn("collisions", F.coalesce("collisions", F.array().cast("array<int>")))
    done = checkpointed(done)
    files.write_json_lines(done.orderBy("__key").drop("__key", "__text"), args.output)
    grammar.summary(done).show(truncate=False)


def sample(spark: SparkSession, args: argparse.Namespace) -> None:
    """Collision-free walks over the components of models (a file or folder of them, or a graph archive), as JSON lines."""
    parts, colors, connectors = _catalogue(spark, args)
    if args.input.endswith(".npz"):
        spark.dataSource.register(files.GraphArchive)
        nodes, edges = files.archive_graphs(spark.read.format("graph_archive").load(args.input))
    else:
        path = args.input if args.input.endswith(".ldr") or "*" in args.input else f"{args.input.rstrip('/')}/*.ldr"
        nodes, unknown = assembly.nodes_of(assembly.placements(files.read_texts(spark, path), "name", "text"), load(spark, args.catalog, "aliases"), parts)
        for r in unknown.toLocalIterator():
            print(f"skip {r['graph_id']}: unknown part {r['stem']!r}", file=sys.stderr)
        nodes = checkpointed(nodes)
        edges = assembly.graph_edges(nodes, connectors)
    nodes, edges = checkpointed(nodes), checkpointed(edges)
    comps = checkpointed(assembly.graph_components(nodes, edges))
    index = F.explode(F.sequence(F.lit(0), F.lit(args.n - 1)))
    seeds = comps.where("size >= 2").select("graph_id", "component_index").distinct().withColumn("sample_index", index)
    # without a seed each walk has one of its own, kept by the checkpoint
    seeds = checkpointed(seeds.withColumn("seed", (F.floor(F.rand() * 2**31) if args.seed is None else F.col("sample_index") + args.seed).cast("bigint")))
    walk = checkpointed(walks.sampled(edges, comps, nodes, connectors, files.read_meshes(spark, args.meshes, parts), seeds, 100))
    text = grammar.serialized(*walks.trees_of(walk, nodes, connectors), parts, colors)
    size = comps.groupBy("graph_id", "component_index").agg(F.count("*").alias("component_nodes"))
    total = nodes.groupBy("graph_id").agg(F.count("*").alias("all"))
    got = walk.groupBy("graph_id", "component_index", "seed").agg(F.count("*").alias("nodes"))
    out = got.join(seeds, ["graph_id", "component_index", "seed"]).join(size, ["graph_id", "component_index"]).join(total, "graph_id").join(text.select("key.*", "text"), ["graph_id", "component_index", "seed"])
    _out(out.select(F.col("graph_id").alias("source"), "sample_index", "component_index", "component_nodes", "nodes", (F.col("nodes") == F.col("component_nodes")).alias("complete_component"), (F.col("nodes") == F.col("all")).alias("complete_npz"), F.col("text").alias("path")), args.output, ["source", "component_index", "sample_index"])


def path2ldr(spark: SparkSession, args: argparse.Namespace) -> None:
    """Model files of path texts (a file, a folder of .txt, JSON lines, or -) that parse whole; the others are named."""
    parts, colors, connectors = _catalogue(spark, args)
    if args.input == "-":
        texts = spark.createDataFrame([("-", sys.stdin.read())], "name string, text string")
    elif args.input.endswith(".jsonl"):
        rows = _json_rows(spark, args.input)
        name = F.col("id").cast("string") if "id" in rows.columns else F.lit(None).cast("string")
        texts = rows.select(F.coalesce(name, F.col("__key").cast("string")).alias("name"), F.col("__text").alias("text"))
    else:
        texts = files.read_texts(spark, args.input if args.input.endswith(".txt") or "*" in args.input else f"{args.input.rstrip('/')}/*.txt")
    texts = checkpointed(texts.dropDuplicates(["name"]))
    wrong = checkpointed(grammar.errors(texts, "name", "text", parts, colors, connectors))
    for r in wrong.where("error is not null").orderBy("key").toLocalIterator():
        print(f"skip {r['key']}: parse error: {r['error']}", file=sys.stderr)
    good = texts.join(wrong.where("error is null").select(F.col("key").alias("name")), "name")
    out = checkpointed(files.model_texts(walks.poses(*grammar.trees(good, "name", "text", parts, colors, connectors), connectors), parts))
    if args.output in (None, "-"):
        for r in out.orderBy("key").toLocalIterator():
            sys.stdout.write(r["text"])
    else:
        files.write_text_files(out, args.output, "key", "text")
    n, all_ = out.count(), texts.count()
    print(f"{n} converted, {all_ - n} skipped -> {args.output or '-'}", file=sys.stderr)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="studflow")
    p.add_argument("--workers", type=int, help="threads on this machine; a cluster's own settings hold otherwise")
    sub = p.add_subparsers(required=True)
    for f in (score, sample, path2ldr):
        s = sub.add_parser(f.__name__, help=f.__doc__)
        s.add_argument("input")
        s.add_argument("output", nargs="?" if f is not score else None)
        s.add_argument("--catalog", required=True)
        s.set_defaults(run=f)
        if f is not path2ldr:
            s.add_argument("--meshes", required=f is sample, help="PLY files, such as folder/*.ply")
        if f is score:
            s.add_argument("--no-collision", action="store_true", help="parse metrics only; needs no meshes")
        if f is sample:
            s.add_argument("--n", type=int, default=1)
            s.add_argument("--seed", type=int)
    args = p.parse_args(argv)
    builder = SparkSession.builder.appName("studflow")
    args.run((builder.master(f"local[{args.workers}]") if args.workers else builder).getOrCreate(), args)


if __name__ == "__main__":
    main()

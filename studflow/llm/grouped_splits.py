"""Problem 4: train, validation and test splits that keep the records of one model together.

Sources are resolved to models; a model's records are a component. Components of identical size and label profile are
a bundle; only bundles (as many as there are different sizes and profiles) reach the driver. A min-cost flow gives the
rows that each profile sends to each split, with a cost for each row beyond a quota; the flow is rounded to whole
components, the largest first, and the components of a bundle are dealt out in the order of their hash.
"""

from __future__ import annotations

from collections import defaultdict, deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import ranked
from ..tables import checkpointed

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}
#: Ways of writing one model that meet in one task; more are met block by block.
WAYS = 1000
#: The rows of a source with more of them than this are spread over so many parts of a join. A table of n rows has at
#: most n / LARGE of these sources, so they may be broadcast: some megabytes at ten billion rows.
LARGE, SALTS = 100_000, 64
_WIDE = "".join(chr(0xFF01 + i) for i in range(94))
_PLAIN = "".join(chr(0x21 + i) for i in range(94))


def model_of(source: Column) -> Column:
    """theme-code of a source, whatever folder, ending, case, blanks, dashes or percent signs it is written with.

    A source without a theme word and a five-character code stands for itself, trimmed and in lower case.
    """
    s = F.translate(source, _WIDE, _PLAIN)
    s = F.lower(F.coalesce(F.try_url_decode(F.regexp_replace(s, r"\+", " ")), s))
    s = F.regexp_replace(s, r"[\u00AD\u200B-\u200F\u2060\uFEFF]", "")
    s = F.regexp_replace(s, r"(?U)\s+", " ")
    bare = F.regexp_replace(F.element_at(F.split(s, r"[/\\]"), -1), r"( ?\.(npz|npy|xz|gz|zst|bz2|zip|jsonl?|ldr|mpd|txt|parquet) ?)+$", "")
    named = r"^.*?(?<![a-z0-9])([a-z]+)[^a-z0-9]+([a-z0-9]{5})(?![a-z0-9])[^a-z0-9]*$"
    anywhere = r"^.*(?<![a-z0-9])([a-z]+)[^a-z0-9]+([a-z0-9]{5})(?![a-z0-9]).*$"
    pick = lambda p: F.concat_ws("-", F.regexp_extract(bare, p, 1), F.regexp_extract(bare, p, 2))
    return F.when(source.isNull(), None).when(bare.rlike(named), pick(named)).when(bare.rlike(anywhere), pick(anywhere)).otherwise(F.trim(s))


def min_cost_flow(edges: list[tuple[str, str, float, float]], source: str, sink: str) -> dict[tuple[str, str], float]:
    """The cheapest largest flow, by shortest augmenting paths. Edges are (from, to, capacity, cost); parallel edges
    between the same nodes add up in the result."""
    ends, cap, cost, out = [], [], [], defaultdict(list)
    for u, v, c, w in edges:
        for a, b, x, y in ((u, v, c, w), (v, u, 0.0, -w)):
            out[a].append(len(ends))
            ends.append((a, b))
            cap.append(x)
            cost.append(y)
    eps = 1e-7
    while True:
        dist, via, queue, queued = {source: 0.0}, {}, deque([source]), {source}
        while queue:
            u = queue.popleft()
            queued.discard(u)
            for e in out[u]:
                v = ends[e][1]
                if cap[e] > eps and dist[u] + cost[e] < dist.get(v, float("inf")) - 1e-12:
                    dist[v], via[v] = dist[u] + cost[e], e
                    if v not in queued:
                        queue.append(v)
                        queued.add(v)
        if sink not in dist:
            break
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = ends[via[v]][0]
        push = min(cap[e] for e in path)
        for e in path:
            cap[e] -= push
            cap[e ^ 1] += push
    flow: dict[tuple[str, str], float] = defaultdict(float)
    for e in range(0, len(ends), 2):
        flow[ends[e]] += cap[e ^ 1]
    return flow


def allocate(bundles: list[tuple[int, int, int]], shares: dict[str, float] = SHARES) -> dict[tuple[int, int], dict[str, int]]:
    """For bundles (size, profile, number of components): the number of components that each split gets.

    Every component is allotted. Quotas are the shares of all rows; a component larger than a split's quota can't go
    there while another split has room.
    """
    total = sum(z * n for z, _, n in bundles)
    quota = {s: f * total for s, f in shares.items()}
    of_profile: dict[int, int] = defaultdict(int)
    supply: dict[tuple[int, str], int] = defaultdict(int)
    main = max(shares, key=shares.get)

    def kind(z: int) -> str:
        return ",".join(s for s in shares if z <= quota[s]) or main

    for z, p, n in bundles:
        of_profile[p] += z * n
        supply[p, kind(z)] += z * n
    edges: list[tuple[str, str, float, float]] = []
    for (p, k), rows in supply.items():
        edges.append(("rows", f"{p}|{k}", rows, 0.0))
        edges += [(f"{p}|{k}", f"{p}>{s}", rows, 0.0) for s in k.split(",")]
    for p, rows in of_profile.items():
        for s, f in shares.items():
            # within the profile's own quota free, beyond it at a small cost
            edges += [(f"{p}>{s}", s, f * rows, 0.0), (f"{p}>{s}", s, rows, 1.0)]
    for s in shares:
        edges += [(s, "all", quota[s], 0.0), (s, "all", total, 100.0)]
    flow = min_cost_flow(edges, "rows", "all") if total else {}
    left = {(p, k): {s: flow.get((f"{p}|{k}", f"{p}>{s}"), 0.0) for s in k.split(",")} for p, k in supply}
    room = dict(quota)
    plan: dict[tuple[int, int], dict[str, int]] = {}
    for z, p, n in sorted(bundles, key=lambda b: (-b[0], b[1])):
        target = left[p, kind(z)]
        whole = sum(max(x, 0.0) for x in target.values())
        got = {s: 0 for s in shares}
        for s, x in target.items():
            got[s] = min(int(n * max(x, 0.0) / whole) if whole > 0 else 0, int(max(room[s], 0.0) // z))
        for s in target:
            room[s] -= got[s] * z
            target[s] -= got[s] * z
        for _ in range(n - sum(got.values())):
            # what rounding leaves goes where most room is
            s = max(target, key=lambda s: (room[s] >= z, target[s] + room[s], s))
            got[s] += 1
            room[s] -= z
            target[s] -= z
        plan[z, p] = got
    return plan


def components(df: DataFrame, key: str, source: str, label: str | None) -> tuple[DataFrame, DataFrame]:
    """(ways, comps): ways has each string of source with its part, the component it denotes; comps has each part with
    its size in rows and its label profile, the rows without a source as parts of their own. Both are checkpointed, and
    models are worked out once a string, not once a row."""
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(source).alias("source"), (F.coalesce(F.col(label).cast("int"), F.lit(0)) if label else F.lit(0)).alias("label"))
    ways = rows.where("source is not null").groupBy("source").agg(F.count("*").alias("n"), F.sum("label").alias("labels"))
    ways = checkpointed(ways.withColumn("model", model_of(F.col("source"))).withColumn("part", F.concat(F.lit("m"), "model")))
    lone = rows.where("source is null").select(F.concat(F.lit("r"), F.col("key").cast("string")).alias("part"), F.lit(1).cast("bigint").alias("n"), F.col("label").cast("bigint").alias("labels"))
    both = ways.select("part", "n", "labels").unionByName(lone)
    return ways, checkpointed(both.groupBy("part").agg(F.sum("n").alias("size"), F.floor(F.sum("labels") * 4 / F.sum("n")).cast("int").alias("profile")))


def assigned(comps: DataFrame, shares: dict[str, float]) -> DataFrame:
    """part, size, split of each component."""
    bundles = [(r["size"], r["profile"], r["n"]) for r in comps.groupBy("size", "profile").agg(F.count("*").alias("n")).toLocalIterator()]
    limits = []
    for (z, p), got in allocate(bundles, shares).items():
        at = 0
        for s in shares:
            if got[s]:
                limits.append((z, p, at, at + got[s], s))
                at += got[s]
    # at most three rows a bundle, that is a size and profile; n rows have at most 5 * sqrt(2 n) of them, as different
    # sizes add up, so a broadcast of some megabytes at a billion rows
    table = comps.sparkSession.createDataFrame(limits, "z bigint, p int, lo bigint, hi bigint, split string")
    # the members of a bundle are numbered by hash, whatever the bundle's size
    within = (F.col("size") == F.col("z")) & (F.col("profile") == F.col("p")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    return ranked(comps, ["size", "profile"], F.col("part")).join(F.broadcast(table), within).select("part", "size", "split")


def splits(df: DataFrame, key: str, source: str, label: str | None = None, shares: dict[str, float] = SHARES) -> DataFrame:
    """key, model, split for each row whose key isn't null; all rows of a model are in one split.

    A null source is a model of its own for each row (model is null). label names a boolean column whose share among a
    model's rows, in quarters, is the component's profile. Rows of a repeated key are rows of their own.
    """
    ways, comps = components(df, key, source, label)
    placed = checkpointed(assigned(comps, shares))
    # a source's many rows are spread over the join, and its split repeated as often
    salts = F.when(F.col("n") > LARGE, F.lit(SALTS)).otherwise(1)
    of = ways.join(placed.select("part", "split"), "part").select(F.col("source").alias("way"), "model", "split", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    large = ways.where(F.col("n") > LARGE).select(F.col("source").alias("large"))
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(source).alias("source"))
    own = rows.where("source is not null").join(F.broadcast(large), F.col("source") == F.col("large"), "left")
    own = own.withColumn("salt", F.when(F.col("large").isNotNull(), F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("large")
    named = own.join(of, (own["source"] == of["way"]) & (own["salt"] == of["salt"])).select("key", "model", "split")
    lone = rows.where("source is null").select("key", F.concat(F.lit("r"), F.col("key").cast("string")).alias("part"))
    return named.unionByName(lone.join(placed, "part").select("key", F.lit(None).cast("string").alias("model"), "split"))


def same_model(df: DataFrame, key: str, source: str, label: str | None = None, shares: dict[str, float] = SHARES) -> DataFrame:
    """source_a < source_b: pairs of different strings that denote one model, by the components that are given to the
    splits; so the rows of both are in one split.

    Null sources pair with nothing, and rows without a key are in no split. The strings are reduced to distinct ones,
    and a model's strings to blocks of about WAYS, before they meet.
    """
    ways, comps = components(df, key, source, label)
    s = ways.select("source", "part").join(assigned(comps, shares).select("part", "split"), "part")
    n = ways.groupBy("part").agg(F.ceil(F.count("*") / WAYS).cast("int").alias("n"))
    # a model has few strings, all but always, and they are one block
    x = s.join(n, "part").withColumn("block", F.pmod(F.xxhash64("source"), F.col("n")).cast("int"))
    met = x.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("part", "split", "source", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    a, b = met.where("block = lo").alias("a"), met.where("block = hi").alias("b")
    one = (F.col("a.lo") < F.col("a.hi")) | (F.col("a.source") < F.col("b.source"))
    for c in ("part", "split", "lo", "hi"):
        one &= F.col(f"a.{c}") == F.col(f"b.{c}")
    # UTF-8 bytes have the order of code points
    return a.join(b, one).select(F.least("a.source", "b.source").alias("source_a"), F.greatest("a.source", "b.source").alias("source_b"))

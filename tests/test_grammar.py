import random
import re

import pytest
from pyspark.sql import functions as F

from studflow.functions.scalar import AXLE_MATES, STUD_MATES
from studflow.operators import grammar

PARTS = [(0, "brick1", "Brick 1 x 1"), (1, "axle2", "Axle 2"), (2, "bush", "Bush"), (3, "hin", "Hinge In"), (4, "hon", "Hinge On"), (5, "bin", "Ball In"), (6, "bon", "Ball On"), (7, "fin", "Mount In"), (8, "fon", "Mount On")]
CONNS = [(0, "hole", "hole", None), (0, "stud", "stud", None), (1, "axle", "axle", None), (2, "axle", "socket", None), (3, "hinge", "0", "in"), (4, "hinge", "0", "on"), (5, "ball", "1", "in"), (6, "ball", "1", "on"), (7, "fixed", "0", "in"), (8, "fixed", "0", "on")]
COLORS = [("red", 4, 0), ("blue", 1, 1), ("dark grey", 72, 2), ("dark gray", 72, 3)]


@pytest.fixture(scope="module")
def catalogue(spark):
    eye = [1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0]
    idx = {}
    rows = []
    for p, k, s, q in CONNS:
        f = [float(v) for v in eye]
        if (p, k) == (0, "hole"):
            f[7] = 24.0
        rows.append((p, idx.setdefault(p, 0), k, s, q, 0, 10.0 if k == "axle" else None, f))
        idx[p] += 1
    return (
        spark.createDataFrame(PARTS, "part_id int, stem string, name string"),
        spark.createDataFrame(COLORS, "name string, code int, ord int"),
        spark.createDataFrame(rows, "part_id int, conn_idx int, kind string, sub string, pol string, subgroup_idx int, length double, frame array<double>"),
    )


def number(t):
    return int(t) if re.fullmatch(r"0|-?[1-9]\d*", t) else None


def letters(t):
    if not re.fullmatch("[a-z]+", t):
        return None
    n = 0
    for c in t:
        n = n * 26 + ord(c) - 96
    return n - 1


def plain_score(text):
    """One line after the other, to hold against the relational version."""
    if not text.endswith("\n"):
        text += "\n"
    lines, names = text[:-1].split("\n"), []
    count = {(n, s, q): sum(1 for p2, _, s2, q2 in CONNS if (p2, s2, q2) == (p, s, q)) for p, _, n in PARTS for _, _, s, q in CONNS}

    def node(line):
        left, bar, color = line.partition(" | ")
        label, _, name = left.partition(" ")
        return name if bar and letters(label) is not None and name in {p[2] for p in PARTS} and color in {c[0] for c in COLORS} else None

    def has(name, sub, pol, t):
        k = letters(t)
        return k is not None and k < count.get((name, sub, pol), 0)

    def edge(line, child):
        t = line.split(" ")
        size = {"stud": 7, "hinge": 8, "axle": 9, "ball": 9, "fixed": 6}
        if len(t) < 2 or size.get(t[1]) != len(t) or letters(t[0]) is None or letters(t[0]) >= len(names):
            return False
        parent, deg = names[letters(t[0])], lambda s: number(s) is not None and 0 <= number(s) < 360
        if t[1] in ("stud", "axle"):
            ok = has(parent, t[2], None, t[3]) and has(child, t[4], None, t[5]) and tuple(sorted((t[2], t[4]))) in (STUD_MATES if t[1] == "stud" else AXLE_MATES)
            return ok and (deg(t[6]) if t[1] == "stud" else t[6] in ("flip", "regular") and deg(t[7]) and number(t[8]) is not None)
        if letters(t[2]) is None or t[3] not in ("in", "on"):
            return False
        ok = has(parent, str(letters(t[2])), t[3], t[4]) and has(child, str(letters(t[2])), "on" if t[3] == "in" else "in", t[5])
        return ok and {"hinge": lambda: t[6] in ("flip", "regular") and deg(t[7]), "ball": lambda: all(map(deg, t[6:9])), "fixed": lambda: True}[t[1]]()

    n = (text.count("\n") + 2) // 2
    if node(lines[0]) is None:
        return n, 0
    names.append(node(lines[0]))
    for i in range(1, len(lines) - 1, 2):
        name = node(lines[i])
        if name is None or not edge(lines[i + 1], name):
            return n, len(names)
        names.append(name)
    return n, len(names) if len(lines) % 2 == 0 else None


TREE = "a Brick 1 x 1 | red\nb Brick 1 x 1 | blue\na stud stud a hole a 90\nc Hinge In | red\na hinge a on a a flip 5\n"
GOOD = [
    "a Brick 1 x 1 | red\nb Brick 1 x 1 | dark gray\na stud stud a hole a 90\n",
    "a Bush | red\nb Axle 2 | blue\na axle socket a axle a regular 0 -5\n",
    "a Hinge In | red\nb Hinge On | blue\na hinge a in a a flip 359\n",
    "a Ball On | red\nb Ball In | blue\na ball b on a a 1 2 3\n",
    "a Mount In | red\nb Mount On | blue\na fixed a in a a\n",
]


def broken(seed):
    r = random.Random(seed)
    out = ["", "\n", "\n\n", GOOD[0].rstrip("\n"), GOOD[0] + "\n", "a Brick 1 x 1 | red\nb Brick 1 x 1 | red", TREE, "a  Brick 1 x 1 | red", "a Brick 1 x 1 | red | blue"]
    for g in GOOD * 30:
        # longer trees, then a change anywhere
        lines = g[:-1].split("\n")
        for _ in range(r.randrange(4)):
            lines += r.choice(GOOD)[:-1].split("\n")[1:]
        k = r.randrange(len(lines))
        w = lines[k].split(" ")
        i = r.randrange(len(w))
        w[i : i + 1] = [r.choice(["", "a", "b", "zz", "007", "360", "-1", "5", "stud", "in", "|", w[i]])] * r.choice([1, 1, 1, 0, 2])
        lines[k] = " ".join(w)
        out.append("\n".join(lines) + r.choice(["\n", "\n", "", "\n\n"]))
    return out


def test_scores_like_a_sequential_parser(spark, catalogue):
    texts = GOOD + broken(1)
    df = spark.createDataFrame([*enumerate(texts), (9999, None), (None, "x")], "id bigint, body string").selectExpr("*", "1 as line", "2 as name")
    got = {r["key"]: (r["n_actions"], r["invalid"]) for r in grammar.scores(df, "id", "body", *catalogue).collect()}
    assert got == {k: plain_score(t) for k, t in enumerate(texts)}
    assert all(got[k][1] is None for k in range(len(GOOD)))
    assert grammar.scores(df.limit(0), "id", "body", *catalogue).count() == 0


def test_round_trip(spark, catalogue):
    df = spark.createDataFrame(list(enumerate(GOOD)), "id bigint, body string")
    nodes, edges = grammar.trees(df, "id", "body", *catalogue)
    out = {r["key"]: r["text"] for r in grammar.serialized(nodes, edges, *catalogue[:2]).collect()}
    assert out == dict(enumerate(GOOD))
    lost = grammar.serialized(nodes.withColumn("color", F.lit(999)), edges, *catalogue[:2])
    assert all(r["text"] is None for r in lost.collect())


def test_summary(spark):
    df = spark.createDataFrame([(3, None, []), (4, 2, [1]), (5, None, [3, 4])], "n_actions int, invalid int, collisions array<int>")
    assert tuple(grammar.summary(df).first()) == (3, 2, 1, pytest.approx((3 + 1 + 3) / 3))
    assert tuple(grammar.summary(df.withColumn("collisions", F.when(F.col("n_actions") > 3, F.col("collisions")))).first()) == (3, 2, None, None)
    assert tuple(grammar.summary(df.limit(0)).first()) == (0, 0, None, None)


N, M = "a Brick 1 x 1 | red\n", "b Brick 1 x 1 | blue\n"
REASONS = [
    ("", 0, "empty"),
    ("\n", 0, "node line missing ' | ': ''"),
    (GOOD[0], 2, None),
    (GOOD[0][:-1], 2, "missing trailing newline"),
    ("A Brick 1 x 1 | red\n", 0, "invalid letter ID: 'A'"),
    ("a | red\n", 0, "bad node: 'a | red'"),
    ("a Brick's | red\n", 0, "unknown part: \"Brick's\""),
    ("a Brick 1 x 1 | rot\n", 0, "unknown color: 'rot'"),
    (N + M, 1, "dangling node without edge: 'b Brick 1 x 1 | blue'"),
    (N + M + "a\n", 1, "bad edge: 'a'"),
    (N + M + "a glue x\n", 1, "unknown edge family: 'glue'"),
    (N + M + "a stud stud a hole a\n", 1, "stud edge expected 7 tokens, got 6"),
    (N + M + "7 stud stud a hole a 0\n", 1, "invalid letter ID: '7'"),
    (N + M + "b stud stud a hole a 0\n", 1, "bad parent ref: 'b'"),
    (N + M + "a stud tube a hole a 0\n", 1, "part 0 has no tube/None connectors"),
    (N + M + "a stud stud b hole a 0\n", 1, "stud/None[1] out of range for part 0 (has 1)"),
    (N + M + "a stud stud a stud a 0\n", 1, "cannot mate subtypes stud+stud"),
    (N + M + "a stud stud a hole a x\n", 1, "degree is not an integer: 'x'"),
    (N + M + "a stud stud a hole a 007\n", 1, "degree has non-canonical form: '007'"),
    (N + M + "a stud stud a hole a 360\n", 1, "degree 360 not in [0, 360)"),
    ("a Bush | red\nb Axle 2 | blue\na axle socket a axle a turned 0 -5\n", 1, "expected regular/flip, got 'turned'"),
    ("a Bush | red\nb Axle 2 | blue\na axle socket a axle a flip 0 1.5\n", 1, "slide is not an integer: '1.5'"),
    ("a Hinge In | red\nb Hinge On | blue\na hinge a up a a flip 359\n", 1, "bad polarity: 'up'"),
    ("a Hinge In | red\nb Hinge On | blue\na hinge b in a a flip 359\n", 1, "part 3 has no 1/in connectors"),
    (N + "b Brick | blue\na glue x\n", 1, "unknown part: 'Brick'"),
]


def test_what_is_wrong(spark, catalogue):
    df = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(REASONS)] + [(99, None)], "id int, body string").selectExpr("*", "1 as t", "2 as bad")
    got = {r["key"]: (r["n_parsed"], r["error"]) for r in grammar.errors(df, "id", "body", *catalogue).collect()}
    assert got == {k: (n, e) for k, (_, n, e) in enumerate(REASONS)}
    texts = broken(3)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    for r in grammar.errors(df, "id", "body", *catalogue).collect():
        invalid = plain_score(texts[r["key"]])[1]
        assert (r["error"] in (None, "missing trailing newline")) == (invalid is None) and r["error"] != "wrong line"
        assert invalid is None or r["n_parsed"] == invalid

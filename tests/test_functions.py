import math

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from studflow.functions import affine
from studflow.functions import scalar as S

quick = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])
    return df.select(expr).first()[0]


@quick
@given(st.lists(st.integers(0, 300_000_000), min_size=1, max_size=50))
def test_letter_ids_are_inverse(spark, ns):
    df = spark.createDataFrame([(n,) for n in ns], "n bigint").select("n", S.i2id(F.col("n")).alias("t"))
    assert all(r["n"] == r["b"] for r in df.select("n", S.id2i(F.col("t")).alias("b")).collect())


def test_letter_ids(spark):
    want = {0: "a", 25: "z", 26: "aa", 701: "zz", 702: "aaa", -1: None}
    df = spark.createDataFrame([(k,) for k in want], "n bigint")
    assert {r[0]: r[1] for r in df.select("n", S.i2id(F.col("n"))).collect()} == want
    bad = spark.createDataFrame([("",), ("A",), ("a1",), ("a\n",), (None,), ("a" * 14,)], "t string")
    assert all(r[0] is None for r in bad.select(S.id2i(F.col("t"))).collect())


def test_canonical_numbers(spark):
    want = {"0": 0, "-5": -5, "12": 12, "007": None, "-0": None, "+1": None, " 1": None, "1\n": None, "": None, "9" * 19: None}
    df = spark.createDataFrame([(k,) for k in want], "t string")
    assert {r[0]: r[1] for r in df.select("t", S.canonical_int(F.col("t"))).collect()} == want
    assert [r[0] for r in spark.createDataFrame([("359",), ("360",), ("-1",), (None,)], "t string").select(S.degree(F.col("t"))).collect()] == [359, None, None, None]


def test_quantised(spark):
    degrees = [0.5, 1.5, 359.6, -1e-7, -90.0, 725.0]
    df = spark.createDataFrame([(math.radians(x), x) for x in degrees], "r double, x double")
    assert [r[0] for r in df.select(S.quantized_degrees(F.col("r"))).collect()] == [round(math.degrees(math.radians(x))) % 360 for x in degrees]
    assert [r[0] for r in df.select(S.quantized_slide(F.col("x"))).collect()] == [round(x) for x in degrees]


def test_texts(spark):
    rows = ["", "a", "a\n", "a\nb\n", "a\nb\nc", None]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    want = [None if t is None else ((t if t.endswith("\n") else t + "\n").count("\n") + 2) // 2 for t in rows]
    assert [r[0] for r in df.select(S.n_actions(F.col("t"))).collect()] == want
    assert [r[0] for r in df.select(S.first_lines(F.col("t"), 1)).collect()] == ["", "a", "a\n", "a\n", "a\n", None]
    assert one(spark, S.question(F.col("c")), c=" A red  Tower!?. ") == "Is this LEGO set a red tower?"
    assert one(spark, S.first_text(F.col("p"), F.col("t")), p="", t="x") == "x"
    assert one(spark, S.stem(F.col("f")), f="ABC.DAT.dat") == "abc.dat"


def test_scores(spark):
    x = [1.0, 3.0, -2.0]
    assert abs(one(spark, S.softmax_pick(F.col("x"), F.lit(1)), x=x) - np.exp(3) / np.exp(x).sum()) < 1e-12
    assert one(spark, S.softmax_pick(F.col("x"), F.lit(7)), x=x) is None
    assert abs(one(spark, S.cosine(F.col("x"), F.col("y")), x=x, y=[2.0, 6.0, -4.0]) - 1) < 1e-12
    assert one(spark, S.cosine(F.col("x"), F.col("y")), x=x, y=[0.0, 0.0, 0.0]) is None
    assert one(spark, S.left_padded(F.col("x"), F.lit(5), F.lit(0.0)), x=x) == [0.0, 0.0, *x]


def test_matrices(spark):
    r = np.random.default_rng(0)

    def rot():
        u, _, v = np.linalg.svd(r.standard_normal((3, 3)))
        m = np.eye(4)
        m[:3, :3], m[:3, 3] = u @ v, r.standard_normal(3) * 9
        if np.linalg.det(m[:3, :3]) < 0:
            m[:3, 0] *= -1
        return m

    rows = [(rot(), rot()) for _ in range(20)]
    df = spark.createDataFrame([(a.ravel().tolist(), b.ravel().tolist()) for a, b in rows], "a array<double>, b array<double>")
    got = df.select(affine.product(F.col("a"), F.col("b")).alias("p"), affine.inverse(F.col("a")).alias("i"), affine.euler_xyz(F.col("a"), F.col("b")).alias("e"), affine.axis(F.col("a")).alias("x")).collect()
    for (a, b), g in zip(rows, got):
        assert np.allclose(np.reshape(g["p"], (4, 4)), a @ b) and np.allclose(np.reshape(g["i"], (4, 4)), np.linalg.inv(a))
        x, y, z = g["e"]
        rx, ry, rz = np.eye(3), np.eye(3), np.eye(3)
        rx[1:, 1:] = [[math.cos(x), -math.sin(x)], [math.sin(x), math.cos(x)]]
        ry[0, 0], ry[0, 2], ry[2, 0], ry[2, 2] = math.cos(y), math.sin(y), -math.sin(y), math.cos(y)
        rz[:2, :2] = [[math.cos(z), -math.sin(z)], [math.sin(z), math.cos(z)]]
        assert np.allclose(rz @ ry @ rx, a[:3, :3].T @ b[:3, :3])
        assert np.allclose(g["x"], -a[:3, 1])
    flat = one(spark, affine.inverse(F.col("m")), m=[0.0] * 16)
    assert flat is None

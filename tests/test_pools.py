from pyspark.sql import functions as F

from studflow.operators import pools


def test_pools(spark):
    a = spark.createDataFrame([(1, "x", 0), (2, None, 0), (3, "y", 0)], "id int, body string, text int")
    b = spark.createDataFrame([(7, "x", 1), (8, "", 1)], "id int, body string, n int")
    got = {tuple(r) for r in pools.without_repeats([a.select("id", "body"), b.select("id", "body")], "id", "body").collect()}
    assert got == {("x", 1, 2), ("y", 3, 1), ("", 8, 1)}
    assert pools.without_repeats([a.limit(0)], "id", "body").count() == 0


def test_pairs(spark):
    c = spark.createDataFrame([(1, "m", "one"), (2, "m", "zwei é"), (3, "m", "three"), (4, "q", "none"), (5, None, "no"), (6, "m", None)], "key int, id string, caption string")
    p = spark.createDataFrame([(30, "m", "P\n"), (10, "m", "Q\n"), (20, "m", None), (40, None, "R\n")], "key int, id string, path string")
    got = [tuple(r) for r in pools.paired(c, p).orderBy("caption_key").collect()]
    assert got == [(1, 10, "m", "one\nQ\n", 4), (2, 30, "m", "zwei é\nP\n", 8), (3, 10, "m", "three\nQ\n", 6)]
    assert all(t[3].encode()[t[4] :].decode() in ("P\n", "Q\n") for t in got)
    assert [tuple(r)[:2] for r in pools.paired(c, p, 1).orderBy("caption_key").collect()] == [(1, 10), (2, 10), (3, 10)]
    assert [tuple(r) for r in pools.counted_pairs(c, p).collect()] == [("m", 4, 3)]
    assert pools.paired(c.limit(0), p).count() == 0


def test_stripes(spark):
    at, place = pools.stripe(F.col("id"), 3)
    x = spark.range(11).select("id", at.alias("s"), place.alias("p")).withColumn("back", pools.unstriped(F.col("s"), F.col("p"), 3))
    rows = x.collect()
    assert all(r["back"] == r["id"] for r in rows)
    assert [r["id"] for r in rows if r["s"] == 1] == list(range(11))[1::3]

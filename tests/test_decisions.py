from pyspark.sql import functions as F

from warpweft.operators import decisions as D


def test_cascade_and_slots(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    got = D.cascade(df, [("first", F.col("k") == 1, F.lit("x")), ("any", F.col("v").isNotNull(), F.col("v"))], "out").orderBy("k").collect()
    assert [(r["out"], r["reason"]) for r in got] == [("x", "first"), ("b", "any"), (None, "none")]
    one = spark.createDataFrame([(["p", "f", "t"], {1: "b", 9: "z"})], "a array<string>, m map<int,string>")
    assert one.select(D.substitute_slots(F.col("a"), F.col("m"))).first()[0] == ["p", "b", "t"]


def test_elide_and_zip(spark):
    df = spark.createDataFrame([(["a", "bb", "c"], [False, True, None]), ([], []), (["a"], [])], "w array<string>, d array<boolean>")
    assert [r[0] for r in df.select(D.elide(F.col("w"), F.col("d"))).collect()] == ["a c", "", None]
    pairs = spark.createDataFrame([(["a"], ["x"]), (["a"], []), (None, ["x"])], "a array<string>, b array<string>")
    assert [len(r[0]) for r in pairs.select(D.zip_equal(F.col("a"), F.col("b"))).collect()] == [1, 0, 0]


def test_line_policy_on_its_bounds(spark):
    tokens = [("strict", False)] * 2 + [("partial", False)] * 9 + [("partial", True)] * 2 + [("share", False)] * 4 + [("share", True)] + [("few", False)] * 3 + [("few", True)]
    df = spark.createDataFrame(tokens, "line string, bad boolean")
    got = {r["line"]: r["policy"] for r in D.line_policy(df, ["line"], F.col("bad")).collect()}
    assert got == {"strict": "strict", "partial": "partial", "share": "drop", "few": "drop"}


def test_reasons_union(spark):
    a, b = spark.createDataFrame([("x", 1), ("y", 5)], "w string, n int"), spark.createDataFrame([("x", 3)], "w string, n int")
    assert sorted(tuple(r) for r in D.reasons_union([("b", a), ("a", b)], "w", "n").collect()) == [("x", 3, "a,b"), ("y", 5, "b")]

import numpy as np
import pytest
from pyspark.sql import functions as F

from warpweft.functions import text as T
from warpweft.operators import sampling as S
from warpweft.operators import scoring
from warpweft.operators import tagging as G

CLASSES = [["ָ", "ַ"], ["ּ"], ["ֿ"]]
VOCABULARY = {c: k for k, c in enumerate("אבגד ", 2)}


def factory():
    """What makes a model that points each א with the first mark, each ב with a dot, and nothing else. It is made here so that workers get it by value."""
    first, second = VOCABULARY["א"], VOCABULARY["ב"]

    def stub():
        def run(ids):
            heads = [np.zeros((*ids.shape, n)) for n in (3, 2, 2)]
            heads[0][ids == first, 1] = 1
            heads[1][ids == second, 1] = 1
            return heads

        return run

    return stub


def test_tag_joins_pieces_of_their_owner(spark):
    df = spark.createDataFrame([(1, "אב גא"), (2, None), (3, ""), (4, "גגגגגגגגאב x"), (5, "אב גא")], "k int, t string")
    for limit, batch in ((400, 32), (3, 1), (5, 2)):
        got = {r["k"]: r["pointed"] for r in G.tag(df, "k", "t", VOCABULARY, factory(), CLASSES, limit, batch).collect()}
        assert got == {1: "אָבּ גאָ", 2: None, 3: "", 4: "גגגגגגגגאָבּ x", 5: "אָבּ גאָ"}


def test_labels_and_back(spark):
    df = spark.createDataFrame([("ָּ",), ("",), (None,), ("ֿ",)], "m string")
    ids = G.label_ids(F.col("m"), CLASSES)
    assert [r[0] for r in df.select(ids).collect()] == [[1, 1, 0], [0, 0, 0], [G.IGNORE] * 3, [0, 0, 1]]
    assert [r[0] for r in df.select(G.marks_of(ids, CLASSES)).collect()] == ["ָּ", "", "", "ֿ"]
    a = spark.createDataFrame([([1, 2, 3],), ([],)], "v array<int>")
    assert [r[0] for r in a.select(G.padded(F.col("v"), 2)).collect()] == [[1, 2], [G.IGNORE, G.IGNORE]]


def test_scores(spark):
    df = spark.createDataFrame([("a", ["x", None, ""], ["x", "q", ""]), ("a", ["x", "y"], ["x", None]), ("a", ["x"], None), ("b", [None], [""])], "g string, t array<string>, p array<string>")
    got = [tuple(r) for r in G.scored_letters(df, ["g"], "t", "p").collect()]
    assert got == [("a", 5, 3, 4, 2, 3, 1)]
    c = G.confusions(df, ["g"], "t", "p", lambda x: x)
    assert sorted((r["truth"], r["guess"], r["n"]) for r in c.collect()) == [("", "", 1), ("x", "x", 2), ("y", "", 1)]
    rows = spark.createDataFrame([("ab cd", ["1", "2", None, "3", "4"]), ("ab", ["1"])], "t string, m array<string>")
    assert [(r["word"], r["labels"]) for r in G.labelled_words(rows, [], "t", "m").collect()] == [("ab", ["1", "2"]), ("cd", ["3", "4"])]


def test_guards(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "k int"), spark.createDataFrame([(1,), (3,)], "k int")
    assert {r["side"]: r["n"] for r in scoring.differences(a, b).collect()} == {"made only": 2, "wanted only": 1}
    read = spark.createDataFrame([("a", "x")], "k string, v string")
    want = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, v string")
    got = {r["check"]: r["passed"] for r in scoring.canaries(read, "k", "v", want, {"t": (read, 2)}).collect()}
    assert got == {"t": False, "canary a": True, "canary b": False}
    s = spark.createDataFrame([("ab", "ab", 1, 1), ("ab", "ab", 1, 2), ("ab", "ac", 1, 2), ("ab", "ab", None, None)], "r string, h string, x int, y int")
    assert tuple(scoring.readings_scored(s, F.col("r"), F.col("h"), F.col("x"), F.col("y"), []).first()) == (4, 1, 8, 0.125, 3, 1)


def test_sampling(spark):
    words = spark.createDataFrame([("אַב", 3), ("אב", 2), ("גד", 1)], "w string, n int")
    known = spark.createDataFrame([("אב",)], "w string")
    assert [r["w"] for r in S.unknown_under(words, known, "w", [lambda w: w, T.strip_marks]).collect()] == ["גד"]
    assert [(r["w"], r["place"]) for r in S.numbered(words, ["n desc"], 2).collect()] == [("אַב", 1), ("אב", 2)]
    rows = spark.createDataFrame([("g", 1), ("g", 2), ("h", 3), (None, 4)], "g string, k int")
    assert S.one_per_group(rows, "g", "k").count() == 3
    split = {r["k"]: r["split_name"] for r in S.held_out_group(rows, "g", ["g"], 1.0).collect()}
    assert split == {1: "test", 2: "test", 3: "val", 4: "val"}
    lists = spark.createDataFrame([("g", "val"), ("g", "train")], "g string, split_name string")
    assert {r["k"]: r["split_name"] for r in S.listed_split(rows, "g", lists).collect()} == {1: "train", 2: "train", 3: "rejected", 4: "rejected"}
    lines = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, "b"), (4, "cc")], "k int, t string")
    picked = S.picked_lines(lines, "k", "t", F.length("t") == 2, 5)
    assert sorted(r["k"] for r in picked.collect()) == [1, 4]
    assert [r["w"] for r in S.first_covered(words, known, "w", ["n desc"], 5).collect()] == ["אב"]


@pytest.mark.parametrize("n,rare,unread,low,tier", [(7, 0, 0, 0, "A"), (6, 0, 0, 0, None), (17, 0, 0, 0, None), (8, 1, 0, 0, None), (8, 0, 1, 0, None), (10, 0, 0, 3, "C"), (20 // 2, 0, 0, 2, "A")])
def test_sentence_tiers_on_each_bound(spark, n, rare, unread, low, tier):
    rows = [("s", True, 1 if k < rare else 9, k < unread, k < low) for k in range(n)]
    df = spark.createDataFrame(rows, "s string, w boolean, f int, u boolean, l boolean")
    got = S.sentence_tiers(df, "s", F.col("w"), F.col("f"), F.col("u"), {"low": F.col("l")}, [("C", "low", ">=", 0.3), ("A", "low", "<=", 0.35)]).collect()
    assert [r["tier"] for r in got] == ([tier] if tier else [])

import pytest
from pyspark.sql import functions as F

from warpweft.functions import phones as P
from warpweft.functions import predicates as C
from warpweft.functions import readings as R
from warpweft.operators import verdicts as V


def rows(df, *by):
    return sorted((tuple(r) for r in df.select(*by).collect()), key=str)


def test_agreement_on_each_threshold(spark):
    clips = [("thin", 1.0), ("ok", 0.65), ("ok", 0.65), ("low", 0.4), ("low", 0.4), ("mid", 0.41), ("mid", 0.41)]
    got = V.agreement_verdicts(spark.createDataFrame(clips, "k string, s double"), "k", "s")
    assert dict(rows(got, "k", "verdict")) == {"thin": "thin", "ok": "OK", "low": "SUSPECT", "mid": "mid"}


def test_variant_votes(spark):
    data = [("w", c, v, s) for c, (x, y) in enumerate([(0.5, 0.4), (0.9, 0.1), (0.3, 0.3), (0.0, 0.0)]) for v, s in (("x", x), ("y", y))] + [("few", 1, "x", 1.0), ("few", 2, "x", 1.0)]
    got = V.variant_votes(spark.createDataFrame(data, "k string, c int, v string, s double"), "k", "c", "v", "s")
    assert rows(got, "k", "clips", "decided", "winner", "winner_votes") == [("w", 4, 2, "x", 2)]


def test_flips_fold_only_when_all_slots_are_sure(spark):
    data = [("fold", 0, 0, 3, "FLIP"), ("fold", 1, 3, 3, "CONFIRMED"), ("weak", 0, 1, 2, "FLIP"), ("ratio", 0, 2, 5, "FLIP"), ("open", 0, 0, 3, "FLIP"), ("open", 1, 1, 1, "thin"), ("kept", 0, 3, 3, "CONFIRMED"), ("done", 0, 0, 9, "FLIP")]
    df = spark.createDataFrame(data, "k string, slot int, same int, top int, v string")
    got = V.fold_flips(df, "k", "slot", "same", "top", "v", F.col("k") != "done")
    assert dict(rows(got, "k", "outcome")) == {"fold": "folded", "weak": "queued: weak flip", "ratio": "queued: weak flip", "open": "queued: slot undecided", "kept": "kept", "done": "queued: key settled"}
    assert rows(got.where("k = 'fold'"), "flips") == [([0],)]


def test_corrections_and_harvest(spark):
    s = spark.createDataFrame([("a", 0, "x", "y", 3, 2), ("b", 0, "x", "y", 3, 1), ("c", 0, "x", "x", 9, 9), ("d", 0, "x", "y", 2, 2), ("e", 0, "x", "z", 3, 3), ("f", 0, "x", "y", 3, 3)], "k string, slot int, e string, m string, votes int, top int")
    got = V.fold_corrections(s, "k", "slot", "e", "m", "votes", "top", F.col("m") == "y", F.col("k") == "f")
    assert dict(rows(got, "k", "outcome")) == {"a": "folded", "e": "queued", "f": "queued"}
    h = V.harvest(spark.createDataFrame([("a", 1), ("a", 1), ("a", 0), ("b", 2), ("c", None)], "k string, c int"), "k", "c")
    assert rows(h, "k", "correction", "n", "outcome") == [("a", 1, 2, "override"), ("b", 2, 1, "review")]
    j = spark.createDataFrame([(True, 0, None, 2, 0.5), (True, 0, None, 2, 0.4), (False, 0, 1, 2, 0.9), (False, 0, 2, 2, 0.9), (False, 0, 0, 2, 0.9), (False, 0, None, 2, 0.9), (False, 0, 1, 2, None)], "ok boolean, ours int, c int, n int, conf double")
    kept = V.usable_judgments(j, F.col("ok"), F.col("ours"), F.col("c"), F.col("n"), F.col("conf"))
    assert rows(kept, "ok", "place") == [(False, 1), (True, 0)]


def test_canonical_form_by_source(spark):
    f = spark.createDataFrame([("a", "a1", 1), ("b", "b0", 9), ("b", "b1", 2), ("c", "c0", 5), ("c", "c2", 5), ("d", "d0", 1), ("d", "e0", 1), ("x", "x1", 3)], "k string, form string, n int")
    judged, out = spark.createDataFrame([("c", "c9")], "k string, form string"), spark.createDataFrame([("x",)], "k string")
    assert rows(V.canonical_by_source(f, "k", "form", "n", judged, out, F.col("form").endswith("0")), "k", "form", "source") == [("a", "a1", "single"), ("b", "b1", "majority"), ("c", "c9", "judged")]


def test_arbitration_band(spark):
    s = [("tie", 0.5, 0.41)] * 2 + [("one", 0.5, 0.4)] * 2 + [("two", 0.1, 0.4)] * 2 + [("few", 1.0, 0.0)]
    assert dict(rows(V.arbitrate(spark.createDataFrame(s, "k string, x double, y double"), "k", "x", "y", ("a", "b")), "k", "winner")) == {"tie": "tie", "one": "a", "two": "b"}


def test_register_decision_takes_the_first_rule(spark):
    data = [
        ("1", True, True, "", None, None), ("2", False, True, "", "first", 0.0), ("3", True, False, "x", "second", 0.9), ("4", True, True, "lost", "first", 0.0), ("5", True, True, "", "second", 0.0),
        ("6", True, True, "", "first", 0.9), ("7", True, True, "", "tie", 0.5), ("8", False, False, "", None, None),
    ]
    df = spark.createDataFrame([(k, f"a{k}", f"b{k}", *r) for k, *r in data], "k string, a string, b string, oka boolean, okb boolean, d string, w string, q double")
    got = V.decide_register(df, "a", "b", F.col("oka"), F.col("okb"), F.col("d"), F.col("w"), F.col("q"))
    assert rows(got, "k", "register", "why", "variant") == [
        ("1", "first", "default", "b1"), ("2", "second", "first rejected", None), ("3", "first", "second rejected", None), ("4", "second", "lost", None),
        ("5", "second", "observed second", "a5"), ("6", "first", "observed first", "b6"), ("7", "second", "share of use", "a7"),
    ]


DEFECTS = [("ratˈi", "raptˈi", "consonant lost"), ("ʧˈima", "tʃˈima", ""), ("smal", "sˈimal", "nucleus lost"), ("səmal", "sˈimal", ""), ("ˈoʊma", "ˈɔma", "default over a point"), ("phˈini", "pəhˈini", "stranded h"), ("mˈatila", "matˈila", "stress retracted"), ("matilˈa", "matˈila", "")]


@pytest.mark.parametrize("a,b,want", DEFECTS)
def test_defects(spark, a, b, want):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(R.defect(F.col("a"), F.col("b"))).first()[0] == want


def test_readings(spark):
    df = spark.createDataFrame([("tˈaːma", "tamə"), ("tami", "tama"), ("ta", "tama")], "a string, b string")
    assert [r[0] for r in df.select(R.vowels_agree(F.col("a"), F.col("b"))).collect()] == [True, False, False]
    one = spark.createDataFrame([("pˈaːm-ejt", {1: "i", 4: "k"})], "v string, m map<int,string>").select(R.substitute_phones(F.col("v"), F.col("m")), R.skeleton(F.col("v"))).first()
    assert tuple(one) == ("pˈim-ejk", "paːm ejt")


ORIGIN = C.Origin("[חת]", ("ות",), "אויע")


def test_predicates_on_each_branch(spark):
    v = F.col("v")
    df = spark.createDataFrame([("חבר",), ("רבנות",), ("שטל",), ("שטאל",), ("ל",), ("שְטל",), ("שתְל",)], "v string")
    got = [tuple(r) for r in df.select(C.of_origin(v, ORIGIN), C.own_points(v), C.root_of_origin(v, ORIGIN)).collect()]
    assert got == [(True, False, True), (True, False, True), (True, False, True), (False, False, False), (False, False, False), (True, True, False), (True, True, True)]
    df = spark.createDataFrame([("אב",), ("אַב",), ("אּב",), ("אַא",)], "v string")
    assert [r[0] for r in df.select(C.lacks_mark(v, "א", C.POINTS)).collect()] == [True, False, True, True]
    df = spark.createDataFrame([("פּאר", "far"), ("פּאר", "par"), ("פֿאר", "par"), ("פאר", "par")], "v string, i string")
    assert [r[0] for r in df.select(C.contradicted(v, F.col("i"), [("פף", "\u05bc", "p"), ("פף", "\u05bf", "f")])).collect()] == [True, False, True, False]


def test_validators_on_each_branch(spark):
    df = spark.createDataFrame([("", "x"), (None, "x"), ("א ב", "א"), ("אב גד", "אַב דד"), ("a b", "a b"), ("אבגד הוזח", "אבגד הוזח"), ("אב", "אַב")], "t string, p string")
    assert [r[0] for r in df.select(C.row_reason(F.col("t"), F.col("p"))).collect()] == ["empty", "empty", "token_count", "word_mismatch", "no_letters", "no_marks", "ok"]
    df = spark.createDataFrame([("א", None), ("אב", "אג"), ("אבגד", "אבגד"), ("אב", "אַב")], "t string, p string")
    assert [r[0] for r in df.select(C.pointed_problems(F.col("t"), F.col("p"))).collect()] == [["empty"], ["letters", "no_marks"], ["no_marks", "bare:אבגד"], []]
    df = spark.createDataFrame([("א", "אַ", ""), ("א", "בַ", "ba na"), ("א", "אַ", "qא"), ("א", "אַ", "ˈama"), ("א", "אַ", "ama"), ("א", "אַ", "mˈˈa"), ("א", "אַ", "ˈama-ˈani.")], "t string, p string, i string")
    got = [r[0] for r in df.select(C.reading_problems(F.col("t"), F.col("p"), F.col("i"))).collect()]
    assert got == [["empty"], ["letters", "token_count"], ["script", "inventory"], [], ["stress"], ["stress"], []]
    score = C.additive_score(F.col("v"), [(0.6, F.col("v").contains("a")), (-0.9, F.col("v").contains("b"))], F.col("v") == "z")
    df = spark.createDataFrame([("a",), ("ab",), ("z",)], "v string")
    assert [r[0] for r in df.select(score).collect()] == [0.6, 0.0, 1.0] and P.STRESS

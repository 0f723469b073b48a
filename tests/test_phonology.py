import pytest
from pyspark.sql import functions as F

from warpweft.functions import phonology as G


def col():
    return F.col("v")


# Invented strings, one for each branch of a rewrite.
CASES = [
    (G.assimilate, "tasdi", "tazdi"), (G.assimilate, "tidditt", "tidit"), (G.assimilate, "isʃɡo", "izʒɡo"), (G.assimilate, "ʦvim", "ʦvim"), (G.assimilate, "miɡt", "miɡt"), (G.assimilate, "isˈdo", "isˈdo"),
    (G.reduce_unstressed, "lɛmˈɔp nɛm ˈɛlɛ", "ləmˈɔp nɛm ˈɛlə"), (G.devoiced_final, "naz-miɡ lab", "nas-mik lap"), (G.devoiced_final, "lulu", None),
    (G.ensure_stress, "pəlitn", "pˈəlitn"), (G.ensure_stress, "nˈu", "nˈu"), (G.ensure_stress, "pejl", "pˈejl"), (G.penult_stress, "banəlu", "bˈanəlu"), (G.penult_stress, "tɔjləmin", "tˈɔjləmin"), (G.penult_stress, "pejl", "pejl"),
    (G.penult_stress, "natulip", "natˈulip"), (G.penult_stress, "nətə", "nˈətə"), (G.penult_stress, "nətaːlə", "nətˈaːlə"), (G.penult_stress, "oʊmaːnej", "oʊmˈaːnej"), (G.respell, "mɛlnˈux təpˈejtn", "melnUkh tepEYtn"), (G.spacing, " k  l , m .", "k l, m."),
    (G.repair_marks, "פֿֿ", "פֿ"), (G.repair_marks, "\u05d0\u05b8\u05b7\u05d1", "\u05d0\u05b8\u05d1"), (G.repair_marks, "שׁ", "שׁ"),
]


@pytest.mark.parametrize("function,value,want", CASES)
def test_rewrites(spark, function, value, want):
    assert spark.createDataFrame([(value,)], "v string").select(function(col())).first()[0] == want


def test_null_stays_null(spark):
    df = spark.createDataFrame([(None,)], "v string")
    assert all(df.select(f(col())).first()[0] is None for f in {c[0] for c in CASES})


def test_seams_and_variants(spark):
    df = spark.createDataFrame([("mu", "n"), ("nejlə", "n"), ("lˈapər", "rn"), ("paˈalɛ", "s"), ("", "n"), ("mis", "s")], "r string, s string")
    assert [r[0] for r in df.select(G.join_seam(F.col("r"), F.col("s"))).collect()] == ["muən", "nejlən", None, "paˈalɛs", None, None]
    v = spark.createDataFrame([(["a"], "p", "b"), (["a"], "p", "a"), (["a"], "p", "p"), (["a"], "p", None)], "v array<string>, p string, m string")
    assert [r[0] for r in v.select(G.with_variant(col(), F.col("p"), F.col("m"))).collect()] == [["a", "b"], ["a"], ["a"], ["a"]]
    m = spark.createDataFrame([("ulmɛt", 0), ("ulmɛt", 9), ("ping", 0)], "v string, i int")
    assert [r[0] for r in m.select(G.mark_nucleus(col(), F.col("i"))).collect()] == ["ˈulmɛt", "ulmˈɛt", "ping"]


RULES = G.StressRules(nuclei=("ey", "a", "e", "i", "o", "u"), separable={"oru": 1, "mit": 0}, seams=("kg",), tonic=("ent", "tor"), neutral=("ung", "n"), unstressed=("ge", "be"), endings={"be": ("t",)}, clitics=("mino",))
PLACES = [
    ("orumalo", 1), ("oru", 0), ("mitlopa", 0), ("akgima", 0), ("kgima", 0), ("lopatent", 2), ("leyent", 0), ("lopatorung", 0), ("lopatentung", 2), ("gelopa", 1), ("geyen", 0), ("gegelo", 2), ("belot", 1), ("belo", 0), ("ge", 0), ("lmp", None), ("lopa", 0),
]


@pytest.mark.parametrize("word,place", PLACES)
def test_stress_places(spark, word, place):
    assert spark.createDataFrame([(word,)], "v string").select(G.stress_place(col(), RULES)).first()[0] == place


def test_stress_marks(spark):
    df = spark.createDataFrame([("gelopa mino pim lopinon",)], "v string")
    over = F.create_map(F.lit("lopinon"), F.lit(2))
    assert df.select(G.add_stress(col(), RULES)).first()[0] == "gelˈopa mino pim lˈopinon"
    assert df.select(G.add_stress(col(), RULES, over)).first()[0] == "gelˈopa mino pim lopinˈon"
    assert df.select(G.add_stress(col(), RULES, penult=True)).first()[0] == "gelˈopa mino pim lopˈinon"


def test_syllables_and_spans(spark):
    cases = {"lopalta": "lo pal ta", "lostrana": "lo stra na", "aopa": "a o pa", "meyshli": "mey shli", "anksta": "ank sta", "pst": "pst", "olla": "ol la"}
    df = spark.createDataFrame([(w,) for w in cases], "v string")
    cut = df.select("v", F.array_join(G.syllables(col(), "ey|[aeiou]", ["str", "st", "shl"], ["sh"]), " ").alias("s"))
    assert {r["v"]: r["s"] for r in cut.collect()} == cases
    assert [tuple(x) for x in spark.createDataFrame([("meylo",)], "v string").select(G.nuclei_spans(col(), "ey|[aeiou]")).first()[0]] == [(1, 3), (4, 5)]

from warpweft.llm import canonical as C
from warpweft.llm.lookalike import bare_form, bare_word_list, look_form, plain_form

from pyspark.sql import functions as F

SAME = [
    ("אָפֿן", "אָפֿן"), ("ﬡ ב", "א  ב"), ("ℵבג", "אבג"), ("ײַ", "ייַ"), ("װאס", "וואס"), ("PC", "РС"), ("P１", "Р1"), ("ס'איז", "ס׳איז"), ("ד\"ר", "ד״ר"), ("א-ב", "א־ב"),
    ("גוט‏ מאָרגן ", "גוט מאָרגן"), ("שּׁ", "שּׁ"), ("וואָס?", "וואָס？"),
]
DIFFERENT = [("אָ", "אַ"), ("אָ", "א"), ("PC", "pc"), ("א.", "א"), ("א ב", "אב"), ("צ", "ץ"), ("מир", "миp0"), ("א֑", "א")]


def test_look(spark):
    values = [v for pair in SAME + DIFFERENT for v in pair]
    df = spark.createDataFrame(list(enumerate(values)), "k int, v string")
    f = [r["f"] for r in df.select("k", look_form(F.col("v")).alias("f")).orderBy("k").collect()]
    pairs = list(zip(f[::2], f[1::2]))
    assert [a == b for a, b in pairs] == [True] * len(SAME) + [False] * len(DIFFERENT)


def test_python_and_column_forms_agree(spark):
    values = [v for pair in SAME + DIFFERENT for v in pair] + ["", "Schön GRÖSSE ẞ", "мир РС", "áb c1·d", "ˈaltɛr ɡut"]
    df = spark.createDataFrame(list(enumerate(values)), "k int, v string")
    rows = df.select("v", bare_form(F.col("v")).alias("b"), plain_form(F.col("v")).alias("p")).collect()
    assert [(r["v"], r["b"].split()) for r in rows] == [(r["v"], bare_word_list(r["v"])) for r in rows]
    assert all("'" not in r["p"] for r in rows)


def pairs(spark, rows, numeric=False):
    df = spark.createDataFrame([("w", k, v, "clash", 1) for k, v in rows], "field string, id string, value string, canonical string, n bigint").select("field", "id", "value")
    return {(r["id_a"], r["id_b"]) for r in C.lookalike_pairs(df, numeric).collect()}


def test_pairs(spark):
    rows = [("2", "ﬡבג"), ("10", "אבג"), ("3", "אבג"), ("4", None), ("5", "  "), ("6", " "), ("7", "אָבג"), ("8", "אבג" * 4000), ("9", "אבג" * 3999 + "ﬡבג")]
    assert pairs(spark, rows, True) == {("2", "10"), ("2", "3"), ("8", "9")}
    assert pairs(spark, rows) == {("10", "2"), ("2", "3"), ("8", "9")}
    assert pairs(spark, []) == set()


def test_canonical_member(spark):
    rows = [("1", "ﬡ"), ("2", "א"), ("3", "א"), ("4", None), ("5", ""), ("6", "ב")]
    df = spark.createDataFrame([("w", k, v) for k, v in rows], "field string, id string, value string")
    got = {r["id"]: (r["form"], r["canonical"], r["n_values"]) for r in C.canonical_values(df).collect()}
    assert got == {"1": ("א", "א", 2), "2": ("א", "א", 2), "3": ("א", "א", 2), "4": (None, None, 1), "5": ("", "", 1), "6": ("ב", "ב", 1)}


def test_latin_letters_in_cyrillic_and_greek_words(spark):
    """One word typed with a Cyrillic or Greek letter and with its Latin look-alike; another letter stays a difference."""
    rows = [("1", "привет"), ("2", "привeт"), ("3", "λογος"), ("4", "λoγoς"), ("5", "приват"), ("6", "гут привет"), ("7", "гут пpивет")]
    assert pairs(spark, rows) == {("1", "2"), ("3", "4"), ("6", "7")}
    assert not spark.sql("SELECT 'привeт' AS a, 'привет' AS b").where(look_form(F.col("a")) == look_form(F.col("b"))).count()


def test_two_code_points_of_one_drawn_point(spark):
    rows = [("1", "קׇל"), ("2", "קָל"), ("3", "קַל"), ("4", "קל"), ("5", "קָ֑ל")]
    assert pairs(spark, rows) == {("1", "2")}
    df = spark.createDataFrame([("w", k, v) for k, v in rows], "field string, id string, value string")
    forms = [r["form"] for r in C.canonical_values(df).orderBy("id").collect()]
    assert forms[0] == forms[1] and len(set(forms)) == 4

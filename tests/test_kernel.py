from pyspark.sql import functions as F

from warpweft.functions import phonology as G
from warpweft.operators import kernel as K

# An invented script: א is silent at the beginning and a vowel elsewhere; a doubled ב is one sound; ג takes the value of its mark; ה repeats the vowel before it.
RULES = [
    K.Rule(1, "א", before="^", out="", to_state="open"), K.Rule(2, "א", marks="\u05b8", out="o", to_state="o"), K.Rule(3, "א", out="a", to_state="a"), K.Rule(4, "בב", out="v", to_state=None), K.Rule(5, "ב", after="$", out="p"), K.Rule(6, "ב", out="b"),
    K.Rule(7, "ג", marks="\u05bc", out="g"), K.Rule(8, "ג", tail="[ao]", out="kh"), K.Rule(9, "ג", out="k"), K.Rule(10, "ה", state="o", out="o"), K.Rule(11, "ה", state="a", out="a"), K.Rule(12, "ה", out="h"),
]
READ = {"אבאה": "baa", "אבאָה": "boo", "בבה": "vh", "אאבב": "av", "אאב": "ap", "גאג": "kakh", "גּא": "ga", "אגה": "kh", "xא": "xa", "": "", "באבבה": "bava"}


def test_automaton():
    read = K.Automaton(RULES)
    assert {w: read(w) for w in READ} == READ


def test_rules_as_rows(spark):
    rules = spark.createDataFrame([(r.rank, r.letters, r.marks, r.before, None, r.tail, r.state, r.out, r.to_state) if not r.after else (r.rank, r.letters, r.marks, r.before, r.after, r.tail, r.state, r.out, r.to_state) for r in RULES], K.RULE_SCHEMA)
    df = spark.createDataFrame([(w,) for w in READ] + [(None,)], "w string")
    got = {r["w"]: r["latin"] for r in K.transliterate(df, "w", rules).collect()}
    assert got == READ | {None: None}


def test_whole_path(spark):
    stress = G.StressRules(nuclei=("a", "o"), unstressed=("ba",))
    reader = K.Reader(RULES, {"kh": "x", "o": "ɔ", "k": "k", "g": "ɡ"}, stress, stems=[("גגג", "גא")], latin=[("aa", "a")])
    df = spark.createDataFrame([("אבאגאָ",), ("אבאה",), ("גּגָגאָ",), (None,), ("held",)], "w string")
    lex = spark.createDataFrame([("held", "oga"), ("held", "zz")], "word string, latin string")
    got = {r["w"]: r["ipa"] for r in K.read(df, "w", reader, lex).collect()}
    assert got == {"אבאגאָ": "baxˈɔ", "אבאה": "ba", "גּגָגאָ": "kaɔ".replace("kaɔ", "kˈaɔ"), None: None, "held": "ˈɔɡa"}


def test_names_and_matches(spark):
    v = F.col("v")
    df = spark.createDataFrame([('אב"ג',), ("אx",), ("",)], "v string")
    names = K.letter_names(v, {"א": "alef", "ב": "bejs", "ג": "giml"})
    assert [r[0] for r in df.select(names).collect()] == ["alef bejs giml", None, None]
    df = spark.createDataFrame([("tshtsht.",)], "v string")
    assert df.select(K.longest_match(v, {"t": "T", "sh": "S", "tsh": "C"})).first()[0] == "CCT."
    assert spark.createDataFrame([("שָׁלֹם",)], "v string").select(K.substitute_stems(v, [("שלם", "x")])).first()[0] == "x"

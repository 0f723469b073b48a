from pyspark.sql import functions as F

from warpweft.functions import phones as P
from warpweft.functions import text as T


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("x")).first()["x"]


def test_keys_ignore_spelling_form(spark):
    v = F.col("v")
    assert {one(spark, w, T.lookup_key(v)) for w in ("זײַן", "זיין", "זײן", "זײַן")} == {"זיינ"}
    assert one(spark, "שּׁלום", T.strip_marks(v)) == "שלום" and one(spark, None, T.lookup_key(v)) is None
    assert one(spark, "ד״ר־א’", T.normal_surface(v)) == "ד\"ר-א'"


def test_edges_tokens_chunks(spark):
    lead, core, trail = T.edges(F.col("v"))
    row = spark.createDataFrame([("„וואָס?!",), ("...",), ("a-b",)], "v string").select(lead.alias("l"), core.alias("c"), trail.alias("t")).collect()
    assert [tuple(r) for r in row] == [("„", "וואָס", "?!"), ("...", "", ""), ("", "a-b", "")]
    assert one(spark, "(ר'.", lead) == "(" and one(spark, "(ר'.", core) == "ר'"
    assert one(spark, " Ab,  c. --\n", T.words(F.col("v"))) == ["ab", "c"] and one(spark, None, T.words(F.col("v"))) == []
    assert one(spark, "aa bb  cc dddddddddd e", T.budget_chunks(F.col("v"), 6)) == ["aa bb ", " cc ", "dddddddddd ", "e"]
    assert one(spark, "aaaaaaaa b", T.budget_chunks(F.col("v"), 5, cut_words=True)) == ["aaaaa", "aaa b"]
    assert one(spark, "", T.budget_chunks(F.col("v"), 5)) == [] and one(spark, None, T.budget_chunks(F.col("v"), 5)) == []
    assert [tuple(x) for x in one(spark, " ab\n c ", T.word_spans(F.col("v")))] == [("ab", 1, 3), ("c", 5, 6)]
    assert one(spark, "ר' – 'אַ' b, c", T.words_or_null(F.col("v"))) == ["ר'", None, "'אַ'", "b", "c"]
    assert one(spark, "a b, c (d e", T.following_words(F.col("v"))) == ["a", "b", None, None, "e"]
    long = " ".join(["w"] * 9) + ", " + " ".join(["x"] * 30)
    assert [len(p.split()) for p in one(spark, "Ja. " + long + "!", T.cut_sentences(F.col("v")))] == [1, 9, 25, 5]
    assert one(spark, "One. Two!\nThree", T.sentences(F.col("v"))) == ["One.", "Two!", "Three"]
    assert one(spark, "a <b>c</b> [00:12] &amp; d ", T.clean_markup(F.col("v"))) == "a c & d"


def test_units_and_marks(spark):
    assert [tuple(u) for u in one(spark, "אָב", T.letter_units(F.col("v")))] == [("א", "ָ"), ("ב", "")]
    df = spark.createDataFrame([("אב", ["ָ", None]), ("אב", ["ָ"])], "t string, m array<string>")
    assert [r[0] for r in df.select(T.join_marks(F.col("t"), F.col("m"))).collect()] == ["אָב", None]


def test_reasons_are_ordered(spark):
    v = F.col("v")
    checks = [("empty", v.isNull() | (v == "")), ("short", F.length(v) < 3)]
    df = spark.createDataFrame([(None,), ("",), ("ab",), ("abc",)], "v string")
    assert [r[0] for r in df.select(T.first_reason(checks)).collect()] == ["empty", "empty", "short", "ok"]
    assert [r[0] for r in df.select(T.problem_codes(checks)).collect()] == [["empty"], ["empty", "short"], ["short"], []]


def test_phones(spark):
    v = F.col("v")
    assert one(spark, "ʃnˈaːdɛr ej", P.phones(v)) == ["ʃ", "n", "aː", "d", "ɛ", "r", "ej"]
    assert one(spark, "aːe q ej", P.violations(v)) == ["e", "q"]
    assert one(spark, "mlx sfr", P.ill_shaped(v)) and not one(spark, "dˈarfsti", P.ill_shaped(v)) and one(spark, "abstrkta", P.ill_shaped(v))
    assert one(spark, "bamˈɛrkt", P.stressed_nucleus(v)) == 2 and one(spark, "bam", P.stressed_nucleus(v)) is None
    assert one(spark, "a b | c [note] |a b|", P.variants(v)) == ["a b", "c"]
    assert one(spark, "aːj", P.one_char_each(v)) == "Aj" and one(spark, "ʃtrip", P.longest_consonant_run(v)) == 3


def test_letter_units_keep_all_marks(spark):
    (base, marks), after = [tuple(u) for u in one(spark, "א" + "ָ" * 150 + "ב", T.letter_units(F.col("v")))]
    assert base == "א" and marks == "ָ" * 150 and after == ("ב", "")


def test_folds_and_points(spark):
    v = F.col("v")
    assert one(spark, "װ\u200fאַ֑ ", T.corpus_fold(v)) == "וואַ֑ " and one(spark, "װ\u200fאַ֑ ", T.corpus_fold(v, cantillation=False)) == "וואַ"
    assert one(spark, "אַ֔ב–ג", T.convention(v)) == "אַב-ג" and one(spark, "\u05bc\u05b7", T.first_point(v)) == "\u05b7" and one(spark, "", T.first_point(v)) == ""
    assert one(spark, "שָׁלוֹם", v.rlike("^" + T.tolerant_pattern("שלום") + "$")) and not one(spark, "שלם", v.rlike(T.tolerant_pattern("שלום")))
    folded = {one(spark, w, T.edition_fold(v)) for w in ("כֹּהֵן", "כֹהֵן")}
    assert len(folded) == 1 and one(spark, "סַפָּר", T.edition_fold(v)) != one(spark, "סַפָר", T.edition_fold(v)) and one(spark, "קׇל", T.edition_fold(v)) == one(spark, "קָל", T.edition_fold(v))
    assert one(spark, "<b>הַמֶּ֔לֶךְ־בָּא׀ גַם:</b> 12", T.book_tokens(v)) == ["הַמֶּלֶךְ", "בָּא", "גַם"]


def test_strings_and_blocks_of_markup(spark):
    v = F.col("v")
    assert one(spark, '{"a": ["x", {"b:": "y\\"z", "c": 1}], "d": {"e": " ", "f": "u:"}}', T.json_strings(v)) == ["x", 'y"z', "u:"]
    assert one(spark, "{broken", T.json_strings(v)) is None and one(spark, "[]", T.json_strings(v)) == []
    page = "<p id=1>x <i>2:30</i> <p id=2> <p id=3><i>4:00</i><i>5</i>"
    assert [tuple(x) for x in one(spark, page, T.first_captures(v, r"<p id=(\d+)>", "<i>([^<]*)</i>"))] == [("1", "2:30"), ("3", "4:00")]


def test_marked_chunks_keep_their_marks(spark):
    df = spark.createDataFrame([("ab cd", ["1", None, None, "2", "3"]), ("ab", ["1"])], "t string, m array<string>")
    got = [[tuple(x) for x in r[0]] for r in df.select(T.marked_chunks(F.col("t"), F.col("m"), 3)).collect()]
    assert got == [[("ab ", ["1", None, None]), ("cd", ["2", "3"])], []]

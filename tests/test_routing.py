from pyspark.sql import functions as F

from warpweft.functions.text import strip_marks
from warpweft.operators import routing as X


def rows(df, *by):
    return sorted((tuple(r) for r in df.select(*by).collect()), key=str)


def lexicon(spark, *pairs):
    return spark.createDataFrame(list(pairs), "key string, ipa string") if pairs else spark.createDataFrame([], "key string, ipa string")


def test_route_names_tiers_and_rejections(spark):
    tiers = [
        X.Tier("top", lexicon(spark, ("a", "fa"), ("b", "ba"), (None, "x"))), X.Tier("mid", lexicon(spark, ("a", "pa"), ("c", "kx"), ("c", "ka")), "MED", guard=lambda w, i: w != "c!"),
        X.Tier("low", lexicon(spark, ("a", "ta"), ("c", "za")), "LOW", "rule"),
    ]
    strict = [X.Tier("top", tiers[0].entries, guard=lambda w, i: ~(w.contains("P") & i.contains("f"))), *tiers[1:]]
    types = spark.createDataFrame([("a", "a"), ("aP", "a"), ("b", "b"), ("c!", "c"), ("c", "c"), ("d", "d"), ("n", None)], "w string, key string")
    for bound in (100, 1):
        got = X.route(types, "w", "key", strict, bound)
        assert rows(got, "w", "ipa", "tier", "route", "confidence", F.array_join("rejected", "+").alias("r")) == [
            ("a", "fa", "top", "lexicon", "HIGH", ""), ("aP", "pa", "mid", "lexicon", "MED", "top"), ("b", "ba", "top", "lexicon", "HIGH", ""), ("c!", "za", "low", "rule", "LOW", "mid"),
            ("c", "ka", "mid", "lexicon", "MED", ""), ("d", None, None, "miss", "LOW", ""), ("n", None, None, "miss", "LOW", ""),
        ]


def test_check_and_rescue(spark):
    types = spark.createDataFrame([("a", "a"), ("b", "b"), ("c", "c"), ("d", "d")], "w string, key string")
    routed = X.route(types, "w", "key", [X.Tier("top", lexicon(spark, ("a", "ma"), ("b", "mlk"), ("c", "qa")))])
    checked = X.post_check(routed, X.shape_checks())
    assert rows(checked, "w", "route", "reason") == [("a", "lexicon", ""), ("b", "fallback", "shape"), ("c", "fallback", "inventory"), ("d", "miss", "")]
    saved = X.rescue(checked, "w", "key", [X.Tier("r1", lexicon(spark, ("b", "malk"), ("a", "zz"))), X.Tier("r2", lexicon(spark, ("b", "no"), ("d", "da")))])
    assert rows(saved, "w", "ipa", "tier", "route", "reason") == [("a", "ma", "top", "lexicon", ""), ("b", "malk", "r1", "rule", "r1"), ("c", "qa", "top", "fallback", "inventory"), ("d", "da", "r2", "rule", "r2")]
    repaired = X.post_check(routed, X.shape_checks(), F.when(F.col("w") == "b", "malk"))
    assert rows(repaired.where("w = 'b'"), "ipa", "route") == [("malk", "lexicon")]


def test_affixes_with_guards(spark):
    words = spark.createDataFrame([("lomim",), ("lomn",), ("lon",), ("stopn",), ("unlom",), ("ununlom",), (None,)], "w string")
    roots = lexicon(spark, ("lom", "lˈɔma"), ("lo", "lɔ"), ("stop", "stɔp"), ("unlom", "inlɔm"))
    suf = spark.createDataFrame([("im", 0, "im"), ("n", 1, "n")], "affix string, rank int, affix_ipa string")
    got = X.affix_readings(words, "w", roots, suf, False, X.suffix_joined, stop=["stop"])
    assert rows(got, "w", "affix", "root", "ipa") == [("lomim", "im", "lom", "lˈɔmaim"), ("lomn", "n", "lom", "lˈɔmaən")]
    assert rows(X.affix_readings(words, "w", roots, suf, False, X.suffix_joined, stop=["stop"], guard=lambda w, i: i.contains("ə")), "w") == [("lomn",)]
    pre = spark.createDataFrame([("un", 0, "ˈin"), ("unun", 1, "ˈinin")], "affix string, rank int, affix_ipa string")
    assert rows(X.affix_readings(words, "w", roots, pre, True, X.prefix_joined(True)), "w", "affix", "ipa") == [("unlom", "un", "ˈinlɔma"), ("ununlom", "unun", "ˈininlɔma")]


def test_proclitics_clitics_and_hyphens(spark):
    routed = spark.createDataFrame([("habsl", "hbsl", "hbˈisl"), ("h2", "hbsl", "habˈisl"), ("x", "xbsl", "xbisl"), ("hq", "hqqq", "hqu")], "w string, key string, ipa string")
    fixed = X.proclitic_repairs(routed, "w", "key", {"h": ("h", "ha")}, lexicon(spark, ("bsl", "bˈisl")), F.lit(True))
    assert rows(fixed, "w", "repaired") == [("habsl", "habˈisl")]
    df = spark.createDataFrame([("ס'איז",), ("סאיז",), ("ס'",)], "v string")
    assert [tuple(r[0]) for r in df.select(X.split_clitic(F.col("v"), ["ס", "מ"])).collect()] == [("ס", "איז"), ("", "סאיז"), ("", "ס'")]
    parts = spark.createDataFrame([("a-b", 0, "x", "lexicon", "HIGH"), ("a-b", 1, "y", "lexicon", "MED"), ("c-d", 0, "x", "rule", "LOW"), ("c-d", 1, "y", "lexicon", "HIGH"), ("e-f", 0, None, "miss", "LOW"), ("e-f", 1, "y", "lexicon", "HIGH")], "w string, part_no int, ipa string, route string, confidence string")
    assert rows(X.combine_parts(parts, "w"), "w", "ipa", "route", "confidence") == [("a-b", "x-y", "lexicon", "MED"), ("c-d", "x-y", "rule", "LOW"), ("e-f", None, "fallback", "LOW")]
    assert rows(X.hyphen_parts(spark.createDataFrame([("a--b",), ("c",)], "w string"), "w"), "part_no", "part") == [(0, "a"), (1, "b")]


def test_fusion_stops_at_signs(spark):
    lines = spark.createDataFrame([(1, ["a", "b", None, "a", "b"], ["a", "b", None, "a", None])], "k int, w array<string>, f array<string>")
    got = X.fused_tokens(lines, "k", "w", "f", spark.createDataFrame([("a b",)], "gram string"), 3)
    assert rows(got, "pos", "n", F.coalesce("unit", F.lit("-")).alias("u")) == [(1, 2, "a b"), (3, 1, "-"), (4, 1, "a"), (5, 1, "b")]


def test_maps_stamps_and_masks(spark):
    tokens = spark.createDataFrame([("a", "אב"), ("b", "אב"), ("c", "אב"), ("d", "אַב")], "k string, form string")
    table = spark.createDataFrame([("a", "אַב"), ("b", "אג"), ("d", "אַב")], "k string, target string")
    got = X.applied_map(tokens, "k", "form", table, lambda x, y: strip_marks(x) == strip_marks(y))
    assert rows(got, "k", "mapped", "outcome") == [("a", "אַב", "changed"), ("b", "אב", "letters differ"), ("c", "אב", "unmapped"), ("d", "אַב", "same")]
    s = spark.createDataFrame([(1, True, True, "o", "t"), (2, False, True, "o", "t"), (3, False, False, "o", "t"), (4, False, False, None, "t"), (5, False, False, None, None)], "k int, s boolean, m boolean, o string, t string")
    assert rows(X.stamp(s, F.col("s"), F.col("m"), F.col("o"), F.col("t")), "k", "target", "reason") == [(1, None, "suspect"), (2, None, "supervised"), (3, "o", "observed"), (4, "t", "type"), (5, None, "none")]
    forms = spark.createDataFrame([("a", "אב", 9), ("a", "אַב", 1), ("a", "אָב", 1)], "k string, form string, n int")
    assert rows(X.canonical_target(forms, "k", "form", "n", F.length("form") - F.length(strip_marks(F.col("form")))), "target", "rivals") == [("אָב", 2)]
    one = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (1, "b", "y"), (1, "b", "z")], "row int, k string, form string")
    assert rows(X.only_spelling(one, "row", "k", "form"), "row", "k", "form") == [(1, "a", "x")]
    t = spark.createDataFrame([(k, "אב", k == 2) for k in range(1, 7)], "p int, w string, supervised boolean")
    v = spark.createDataFrame([(1, "אב", "אַב", 0.08), (2, "אב", "אַב", 0.9), (3, "אב", "אַב", 0.07), (4, "אג", "אַב", 0.9), (5, "אב", "אַד", 0.9)], "p int, w string, winner string, margin double")
    assert dict(rows(X.unmasked(t, v, ["p"], "w", strip_marks), "p", "why")) == {1: "unmasked", 2: "supervised", 3: "margin", 4: "other word", 5: "letters", 6: "no verdict"}

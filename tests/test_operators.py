import math
import random
from math import comb

import pytest
from pyspark.sql import functions as F

from warpweft.functions import stats
from warpweft.operators import align, cover, evidence, rewrite, scoring, sequences


def rows(df, *by):
    return sorted(tuple(r) for r in df.select(*by).collect())


@pytest.mark.parametrize("k,n,p", [(0, 5, 0.3), (3, 10, 0.2), (10, 10, 0.5), (1, 400, 0.001), (390, 400, 0.9), (6, 5, 0.5), (2, 5, 0.0), (2, 5, 1.0), (5, 400, 0.05), (3000, 100000, 0.03), (2900, 100000, 0.03)])
def test_binomial_tail(spark, k, n, p):
    want = 0.0 if k > n else math.fsum(math.exp(math.log(comb(n, i)) + i * math.log(p) + (n - i) * math.log(1 - p)) for i in range(k, min(n, k + 2000) + 1)) if 0 < p < 1 else float(p)
    got = spark.createDataFrame([(k, n, p)], "k long, n long, p double").select(stats.binomial_tail(F.col("k"), F.col("n"), F.col("p"))).first()[0]
    assert got == pytest.approx(want, abs=1e-9)


def test_slot_verdicts_on_each_branch_and_threshold(spark):
    votes = [("thin", "p", "p")] * 2 + [("ok", "p", "p")] * 2 + [("ok", "p", "f")] + [("flip", "p", "f")] * 2 + [("flip", "p", "p")] + [("torn", "p", h) for h in "pfbd"]
    df = spark.createDataFrame(votes, "slot string, expected string, heard string")
    got = {r["slot"]: r["verdict"] for r in evidence.slot_verdicts(df, ["slot"], "expected", "heard").collect()}
    assert got == {"thin": "thin", "ok": "CONFIRMED", "flip": "FLIP", "torn": "contested"}


def test_promotion(spark):
    votes = [("a", "x")] * 3 + [("a", "y")] + [("b", "x")] * 2 + [("c", "x")] * 2 + [("c", "y")] * 2 + [("a", None)]
    got = {r["k"]: (r["winner"], r["reason"]) for r in evidence.promote(spark.createDataFrame(votes, "k string, c string"), "k", "c").collect()}
    assert got == {"a": ("x", "promoted"), "b": ("x", "few votes"), "c": ("x", "no majority")}


def test_lookup_takes_the_first_tier(spark):
    tiers = spark.createDataFrame([("a", 2, "z"), ("a", 1, "y"), ("a", 1, "x"), ("b", 2, "w")], "key string, tier int, ipa string")
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    for bound in (10, 1):
        assert rows(evidence.first_hit(keys, tiers, "key", "tier", "ipa", bound), "key", "ipa", F.coalesce("tier", F.lit(-1)).alias("t"))[:2] == [("a", "x", 1), ("b", "w", 2)]


def test_modal_and_consistency(spark):
    counts = spark.createDataFrame([("a", "x", 4), ("a", "y", 1), ("b", "x", 2), ("b", "w", 2), ("c", "x", 1)], "k string, f string, n long")
    assert rows(evidence.modal(counts, "k", "f"), "k", "modal", "bucket") == [("a", "x", "dominant"), ("b", "w", "conflict"), ("c", "x", "single")]
    assert tuple(evidence.consistency(counts, "k").first()) == (3, 1, 0.333333, 0.7, 1.666667)


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_runs_and_repeats_in_blocks_of_any_size(spark, size):
    df = spark.createDataFrame([("u", k, f) for k, f in enumerate("aabbbacc")] + [(None, 1, "a"), (None, 2, "a"), ("v", 5, "c"), ("v", 6, None), ("v", 7, None)], "u string, t int, f string")
    block = F.floor(F.col("t") / size)
    kept = sequences.collapse_repeats(df, ["u"], ["t"], "f", block)
    assert rows(kept, F.coalesce("u", F.lit("-")).alias("u"), "t") == [("-", 1), ("u", 0), ("u", 2), ("u", 5), ("u", 6), ("v", 5), ("v", 6)]
    runs = sequences.islands(df, ["u"], ["t"], F.col("f") != "c", block)
    assert rows(runs, F.coalesce("u", F.lit("-")).alias("u"), "first_pos", "last_pos", "n") == [("-", 1, 2, 2), ("u", 1, 6, 6)]


def test_picks(spark):
    places = spark.createDataFrame([("w", g, k) for k, g in enumerate("aaabc")], "w string, g string, k int")
    assert rows(sequences.round_robin(places, "w", "g", ["k"], 4), "g", "k", "pick") == [("a", 0, 1), ("a", 1, 4), ("b", 3, 2), ("c", 4, 3)]


def test_phrases_are_longest_first_and_disjoint(spark):
    lines = spark.createDataFrame([(1, "a b c a b".split()), (2, ["x"]), (3, [])], "id int, w array<string>")
    phrases = spark.createDataFrame([("a b",), ("b c",), ("a b c",), ("c a",)], "gram string")
    for bound in (10, 1):
        assert rows(sequences.longest_matches(lines, "id", "w", phrases, 3, bound), "id", "start", "gram") == [(1, 1, "a b c"), (1, 4, "a b")]
    mined = sequences.mine_ngrams(lines, "w", (2, 3), 2)
    assert rows(mined, "n", "gram", "count") == [(2, "a b", 2)]


def test_ngrams_stop_at_nulls(spark):
    df = spark.createDataFrame([(["a", None, "b", "c"],), (["a"],), ([],)], "w array<string>")
    assert [r[0] for r in df.select(sequences.ngrams(F.col("w"), 2)).collect()] == [["b c"], [], []]


def slow_alignment(a, b, vowels):
    """Cell by cell, with the same preferences."""

    def alike(x, y):
        return 2.0 if x == y else -1.5 if (x in vowels) != (y in vowels) else 0.5 if x in vowels else 0.0

    best = {(0, 0): (0.0, [])}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            ways = []
            if i and j:
                ways.append((best[i - 1, j - 1][0] + alike(a[i - 1], b[j - 1]), best[i - 1, j - 1][1] + [(i - 1, j - 1)]))
            if i:
                ways.append((best[i - 1, j][0] - 1, best[i - 1, j][1] + [(i - 1, -1)]))
            if j:
                ways.append((best[i, j - 1][0] - 1, best[i, j - 1][1] + [(-1, j - 1)]))
            if ways:
                best[i, j] = max(ways, key=lambda w: w[0])
    return best[len(a), len(b)]


def test_alignment_equals_cell_by_cell():
    rng = random.Random(3)
    pairs = [("".join(rng.choice("aokptm") for _ in range(rng.randrange(9))), "".join(rng.choice("aokptm") for _ in range(rng.randrange(9)))) for _ in range(400)]
    score, paths = align.align_many([(list(a), list(b)) for a, b in pairs], frozenset("ao"))
    for (a, b), s, (left, right) in zip(pairs, score, paths):
        want, path = slow_alignment(a, b, "ao")
        assert s == want and list(zip(left.tolist(), right.tolist())) == path, (a, b)


def test_alignment_of_rows(spark):
    df = spark.createDataFrame([(1, list("kat"), list("at")), (2, list("kat"), list("at")), (3, None, ["a"])], "id int, x array<string>, y array<string>")
    done = align.align_distinct(df, "x", "y", ["a"])
    assert done.count() == 3 and rows(align.heard_at(done.where("id < 3"), ["id"], "x", "y").where("id = 1"), "slot", "expected", F.coalesce("heard", F.lit("-")).alias("h")) == [(0, "k", "-"), (1, "a", "a"), (2, "t", "t")]
    assert rows(done.where("id = 1").select(align.fraction_matched(F.col("path"), F.col("x"), F.col("y")).alias("f")), F.round("f", 3)) == [(0.667,)]


def test_words_own_what_they_got(spark):
    df = spark.createDataFrame([(1, [list("kat"), list("um"), []], list("katxxum")), (2, [list("po")], [])], "id int, w array<array<string>>, h array<string>")
    own = align.word_ownership(df, ["id"], "w", "h", ["a", "u", "o"])
    got = {(r["id"], r["word"]): ("".join(r["heard_word"]), r["n_match"], r["first_heard"], r["last_heard"]) for r in own.collect()}
    assert got == {(1, 0): ("kat", 3, 0, 2), (1, 1): ("um", 2, 5, 6), (1, 2): ("", 0, None, None), (2, 0): ("", 0, None, None)}
    cut = spark.createDataFrame([(list("abcdefg"), 3, 3), (list("abcdefg"), 0, 6), (list("abc"), None, None)], "h array<string>, a int, b int")
    assert ["".join(r[0]) if r[0] else None for r in cut.select(align.window(F.col("h"), F.col("a"), F.col("b"))).collect()] == ["bcdef", "abcdefg", None]


def test_choice_in_windows_on_its_threshold(spark):
    hits = spark.createDataFrame([(1, "w", list("kat")), (2, "w", list("xyz")), (3, "v", list("ka"))], "occ int, word string, win array<string>")
    cands = spark.createDataFrame([("w", "kat", list("kat")), ("w", "kot", list("kot")), ("v", "ka", list("ka"))], "word string, reading string, phones array<string>")
    got = {r["occ"]: (r["winner"], r["decision"], r["margin"]) for r in align.choose_in_windows(hits, ["occ"], "word", "win", cands, ["a", "o"]).collect()}
    assert got[1] == ("kat", "decided", 0.25) and got[2][:2] == (None, "undecided") and got[3] == ("ka", "decided", 2.0)
    m = spark.createDataFrame([([0.5, 0.4],), ([1.0],), ([-0.2, -0.9],), ([0.3, 0.3],)], "s array<double>")
    assert [round(r[0], 6) for r in m.select(align.margin(F.col("s"))).collect()] == [0.05, 2.0, 0.0, 0.0]
    f = spark.createDataFrame([("z", "s"), ("s", "z"), ("z", "t"), ("z", None), ("a", "a")], "a string, b string")
    assert [r[0] for r in f.select(align.forgiven(F.col("a"), F.col("b"), [("z", "s")])).collect()] == [True, True, False, False, True]


def test_rules_take_the_first_that_fits(spark):
    stages = [[("sch", "ʃ"), ("s", "z")], [("z$", "s")]]
    df = spark.createDataFrame([("sschs",), (None,), ("sschs",)], "v string")
    assert [r["rewritten"] for r in rewrite.rewrite_distinct(df, "v", stages).orderBy(F.col("v").desc_nulls_last()).collect()] == ["zʃs", "zʃs", None]


def test_lists_sent_whole_are_bounded(spark):
    from warpweft.plans.session import sent_whole

    assert sent_whole(spark.range(3), 3).count() == 3
    with pytest.raises(ValueError):
        sent_whole(spark.range(4), 3)


def test_affixes(spark):
    words = spark.createDataFrame([("ungut",), ("gut",), ("ungutes",), ("gutes",)], "w string")
    pre = spark.createDataFrame([("un", 0), ("u", 1)], "affix string, rank int")
    assert rows(rewrite.affix_join(words, words, pre, "w", "w", True), "w", "affix", "stem") == [("ungut", "un", "gut"), ("ungutes", "un", "gutes")]
    suf = spark.createDataFrame([("s", 0), ("es", 1)], "affix string, rank int")
    assert rows(rewrite.affix_join(words, words, suf, "w", "w", False), "w", "affix", "stem") == [("gutes", "es", "gut"), ("ungutes", "es", "ungut")]


def test_scores_and_cover(spark):
    df = spark.createDataFrame([("a", True), ("a", False), (None, False)], "g string, bad boolean")
    assert rows(scoring.rates_by(df, F.col("bad"), ["g"]), "dimension", "value", "n", "n_wrong") == [("all", "", 3, 1), ("g", "", 1, 0), ("g", "a", 2, 1)]
    assert scoring.fingerprint(df, ["g", "bad"]).first() == scoring.fingerprint(df.orderBy("bad"), ["g", "bad"]).first()
    sets = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "c", "c"]), (3, ["c"])], "k int, v array<string>")
    weights = spark.createDataFrame([("a", 1.0), ("b", 5.0), ("c", 2.0)], "value string, weight double")
    for held in (1, 2, 9):
        assert rows(cover.greedy_cover(sets, "k", "v", weights, 9, held=held), "step", "k", "gain") == [(1, 2, 7.0), (2, 1, 1.0)]


def slow_cover(sets, weights, steps, need):
    seen, left, out = {}, dict(sets), []
    while len(out) < steps and left:
        gain = {k: sum(weights[v] for v in vs if seen.get(v, 0) < need) for k, vs in left.items()}
        k = min(left, key=lambda k: (-gain[k], k))
        if gain[k] <= 0:
            break
        out.append((len(out) + 1, k, gain[k]))
        for v in left.pop(k):
            seen[v] = seen.get(v, 0) + 1
    return out


def test_cover_equals_step_by_step(spark):
    rng = random.Random(7)
    sets = {k: sorted(rng.sample("abcdefghijklmnop", rng.randrange(1, 6))) for k in range(40)}
    weights = {v: float(rng.randrange(1, 9)) for v in "abcdefghijklmnop"}
    df = spark.createDataFrame(list(sets.items()), "k int, v array<string>")
    w = spark.createDataFrame(list(weights.items()), "value string, weight double")
    for need, held in ((1, 3), (2, 5), (3, 64)):
        assert rows(cover.greedy_cover(df, "k", "v", w, 15, need, held), "step", "k", "gain") == slow_cover(sets, weights, 15, need)
    order = sorted(sets, key=lambda k: (-len(sets[k]), k))
    seen, want = {}, []
    for k in order:
        gain = sum(1.0 for v in sets[k] if seen.get(v, 0) < 2)
        if gain and len(want) < 12:
            want.append((len(want) + 1, k, gain))
            for v in sets[k]:
                seen[v] = seen.get(v, 0) + 1
    for held in (3, 100):
        assert rows(cover.one_pass_cover(df, "k", "v", w.select("value"), 12, 2, held), "step", "k", "gain") == want


def test_groups_first_and_latest(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "w string"), spark.createDataFrame([("y",), ("z",)], "w string")
    assert rows(evidence.first_group([("a", a), ("b", b)], "w"), "w", "group_name") == [("x", "a"), ("y", "a"), ("z", "b")]
    df = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new")], "k string, t int, v string")
    assert rows(evidence.latest(df, ["k"], [F.col("t")]), "k", "v") == [("k", "new")]

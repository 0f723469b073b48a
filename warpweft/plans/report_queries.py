"""Queries that score labels and readings, follow a corpus through corrections, and guard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from warpweft.functions import phones as P
from warpweft.functions import text as T
from warpweft.functions.text import MARKS, POINTS
from warpweft.operators import evidence, routing, scoring, tagging
from warpweft.operators import sampling as S
from warpweft.operators import verdicts as V
from warpweft.plans.registry import duck_bare, duck_key, duck_words, query
from warpweft.sources.tables import table

# ---- labels of letters, guessed by the commonest labels of the word in the training rows
_BEGIN = "CAST(coalesce(list_sum(list_transform(l[1:i - 1], lambda x: length(x) + 1)), 0) AS BIGINT)"
_TOKENS = f"""(SELECT row_id, split, word, marks[b + 1:b + length(word)] AS labels FROM (SELECT row_id, split, marks, l[i] AS word, {_BEGIN} AS b FROM (SELECT row_id, split, marks, l, unnest(range(1, len(l) + 1)) AS i
    FROM (SELECT row_id, split, marks, regexp_split_to_array(text, '[ \\t\\n\\r]') AS l FROM yiexample WHERE length(text) = len(marks)))) WHERE word <> '')"""
_CODE = "array_to_string(list_transform(labels, lambda m: coalesce(m, '~')), '|')"
_DICT = f"(SELECT word, arg_min(labels, struct_pack(m := -n, c := code)) AS guess FROM (SELECT word, labels, {_CODE} AS code, count(*) AS n FROM {_TOKENS} WHERE split = 'train' GROUP BY ALL) GROUP BY word)"
_GUESSED = f"(SELECT t.split, t.word, t.labels, CASE WHEN len(g.guess) = len(t.labels) THEN g.guess ELSE list_transform(t.labels, lambda x: '') END AS guess, CASE WHEN g.guess IS NULL THEN 'new' ELSE 'known' END AS kind FROM {_TOKENS} t LEFT JOIN {_DICT} g USING (word) WHERE t.split <> 'train')"


def _tokens(spark, d):
    return tagging.labelled_words(table(spark, d, "yiexample").select("row_id", "split", "text", "marks"), ["row_id", "split"], "text", "marks")


def _guessed(spark, d):
    t = _tokens(spark, d)
    code = F.array_join(F.transform("labels", lambda m: F.coalesce(m, F.lit("~"))), "|")
    counted = t.where("split = 'train'").select("word", "labels", code.alias("code")).groupBy("word", "labels", "code").agg(F.count("*").alias("n"))
    held = counted.groupBy("word").agg(F.min_by("labels", F.struct(-F.col("n"), F.col("code"))).alias("guess"))
    j = t.where("split <> 'train'").join(held, "word", "left")
    return j.withColumn("kind", F.when(F.col("guess").isNull(), "new").otherwise("known"))


_SC = "list_filter(range(1, len(labels) + 1), lambda i: labels[i] IS NOT NULL{x})"


@query(
    "label_scores",
    f"""SELECT split, kind, CAST(sum(n) AS BIGINT) AS letters, CAST(sum(r) AS BIGINT) AS letters_right, CAST(sum(m) AS BIGINT) AS marked, CAST(sum(mr) AS BIGINT) AS marked_right, count(*) AS words, count(*) FILTER (n = r) AS words_right FROM (
    SELECT split, kind, len({_SC.format(x='')}) AS n, len({_SC.format(x=" AND labels[i] = coalesce(guess[i], '')")}) AS r, len({_SC.format(x=" AND labels[i] <> ''")}) AS m, len({_SC.format(x=" AND labels[i] <> '' AND labels[i] = coalesce(guess[i], '')")}) AS mr FROM {_GUESSED}) WHERE n > 0 GROUP BY split, kind""",
)
def label_scores(spark, d):
    """Letters, marked letters and words whose labels a dictionary of the training rows guesses, for words it knows and new ones."""
    return tagging.scored_letters(_guessed(spark, d), ["split", "kind"], "labels", "guess")


@query("label_confusions", f"SELECT truth, guess, count(*) AS n FROM (SELECT regexp_extract(t, '[{POINTS}]', 0) AS truth, regexp_extract(coalesce(g, ''), '[{POINTS}]', 0) AS guess FROM (SELECT unnest(labels) AS t, unnest(guess) AS g FROM {_GUESSED} WHERE kind = 'known') WHERE t IS NOT NULL) GROUP BY truth, guess")
def label_confusions(spark, d):
    """Vowel points and what a dictionary guesses for them, over known words of the held-out rows."""
    known = _guessed(spark, d).where("kind = 'known'")
    fit = known.withColumn("guess", F.when(F.size("guess") == F.size("labels"), F.col("guess")).otherwise(F.transform("labels", lambda _: F.lit(""))))
    return tagging.confusions(fit, [], "labels", "guess", T.first_point)


_CLASSES = [["ָ", "ַ", "ֶ", "ִ", "ֵ", "ֹ"], ["ּ"], ["ֿ", "ׂ", "ׁ"]]


def _id_sql(kind) -> str:
    return "CASE WHEN m IS NULL THEN -100 " + " ".join(f"WHEN contains(m, '{c}') THEN {k}" for k, c in enumerate(kind, 1)) + " ELSE 0 END"


@query("label_ids", f"SELECT a, b, c, count(*) AS n FROM (SELECT CAST({_id_sql(_CLASSES[0])} AS INTEGER) AS a, CAST({_id_sql(_CLASSES[1])} AS INTEGER) AS b, CAST({_id_sql(_CLASSES[2])} AS INTEGER) AS c FROM (SELECT unnest(marks) AS m FROM yiexample)) GROUP BY ALL")
def label_ids(spark, d):
    """Labels of letters as one number per class of marks, and how often each triple occurs."""
    ids = table(spark, d, "yiexample").select(F.explode("marks").alias("m")).select(tagging.label_ids(F.col("m"), _CLASSES).alias("i"))
    return ids.groupBy(F.col("i")[0].alias("a"), F.col("i")[1].alias("b"), F.col("i")[2].alias("c")).agg(F.count("*").alias("n"))


@query("head_accuracy", f"SELECT head, count(*) AS n, count(*) FILTER (t = g) AS n_right FROM (SELECT unnest(['dot', 'line']) AS head, unnest([contains(t, 'ּ'), contains(t, 'ֿ')]) AS t, unnest([contains(coalesce(g, ''), 'ּ'), contains(coalesce(g, ''), 'ֿ')]) AS g FROM (SELECT unnest(labels) AS t, unnest(guess) AS g FROM {_GUESSED} WHERE kind = 'known') WHERE t IS NOT NULL) GROUP BY head")
def head_accuracy(spark, d):
    """Accuracy of two single marks, as of two heads of a model, over labelled letters of known words."""
    known = _guessed(spark, d).where("kind = 'known'")
    fit = known.withColumn("guess", F.when(F.size("guess") == F.size("labels"), F.col("guess")).otherwise(F.transform("labels", lambda _: F.lit(""))))
    each = fit.select(F.explode(F.arrays_zip(F.col("labels").alias("t"), F.col("guess").alias("g"))).alias("z")).where("z.t IS NOT NULL")
    has = lambda c, m: F.contains(F.coalesce(c, F.lit("")), F.lit(m))
    heads = each.select(F.explode(F.array(*[F.struct(F.lit(n).alias("head"), (has(F.col("z.t"), m) == has(F.col("z.g"), m)).alias("r")) for n, m in (("dot", "ּ"), ("line", "ֿ"))])).alias("h"))
    return heads.groupBy("h.head").agg(F.count("*").alias("n"), F.count_if("h.r").alias("n_right"))


@query("supervision_change", f"SELECT t.split, count(*) AS words, count(*) FILTER (NOT list_contains(list_transform(labels, lambda x: x IS NULL), true)) AS before, count(*) FILTER (NOT list_contains(list_transform(labels, lambda x: x IS NULL), true) OR len(g.guess) = len(labels)) AS after FROM {_TOKENS} t LEFT JOIN (SELECT * FROM {_DICT} WHERE NOT list_contains(list_transform(guess, lambda x: x IS NULL), true)) g USING (word) GROUP BY t.split")
def supervision_change(spark, d):
    """Words wholly labelled before and after a dictionary of the training rows fills in the others."""
    j = _tokens(spark, d)
    held = _guessed_dictionary(spark, d)
    full = ~F.exists("labels", lambda m: m.isNull())
    j = j.join(held, "word", "left")
    return j.groupBy("split").agg(F.count("*").alias("words"), F.count_if(full).alias("before"), F.count_if(full | (F.size("guess") == F.size("labels"))).alias("after"))


def _guessed_dictionary(spark, d):
    t = _tokens(spark, d).where("split = 'train'")
    code = F.array_join(F.transform("labels", lambda m: F.coalesce(m, F.lit("~"))), "|")
    counted = t.select("word", "labels", code.alias("code")).groupBy("word", "labels", "code").agg(F.count("*").alias("n"))
    return counted.groupBy("word").agg(F.min_by("labels", F.struct(-F.col("n"), F.col("code"))).alias("guess")).where(~F.exists("guess", lambda m: m.isNull()))


# ---- a corpus followed through corrections
_FORMS = f"(SELECT nfc_normalize(w) AS form, {duck_bare('w')} AS bare FROM (SELECT unnest({duck_words('text_yi_pointed')}) AS w FROM annotations_gold))"
_COUNTS = f"(SELECT bare, form, count(*) AS n FROM {_FORMS} GROUP BY ALL)"
_NM = f"length(regexp_replace(form, '[^{MARKS}]', '', 'g'))"
_CHOSEN = f"""(SELECT bare, CASE WHEN many = 1 THEN sole ELSE most END AS form, CASE WHEN many = 1 THEN 'single' ELSE 'majority' END AS source FROM (SELECT bare, count(*) AS many, min(form) AS sole, arg_min(form, struct_pack(m := -n, f := form)) FILTER (form <> bare) AS most FROM {_COUNTS} GROUP BY bare)
    WHERE (many = 1 OR most IS NOT NULL) AND bare NOT IN (SELECT word FROM (SELECT DISTINCT word, ipa FROM eval_meta_2026_08_14 WHERE word IS NOT NULL AND ipa IS NOT NULL) GROUP BY word HAVING count(*) > 1))"""


def _pointed(spark, d):
    each = table(spark, d, "annotations_gold").select(F.explode(T.words(F.col("text_yi_pointed"))).alias("w"))
    counted = each.groupBy("w").agg(F.count("*").alias("n"))
    return counted.select(T.strip_marks(F.col("w")).alias("bare"), T.composed(F.col("w")).alias("form"), "n").groupBy("bare", "form").agg(F.sum("n").alias("n"))


def _canonical(spark, d):
    contested = table(spark, d, "eval_meta_2026_08_14").where("word IS NOT NULL AND ipa IS NOT NULL").select(F.col("word").alias("bare"), "ipa").distinct().groupBy("bare").count().where("count > 1")
    none = spark.createDataFrame([], "bare string, form string")
    return V.canonical_by_source(_pointed(spark, d), "bare", "form", "n", none, contested, F.col("form") == F.col("bare"))


@query("canonical_forms", f"SELECT * FROM {_CHOSEN}")
def canonical_forms(spark, d):
    """One pointed form for each word: its only one, else the commonest that is pointed; contested words have none."""
    return _canonical(spark, d)


@query("modal_folded", f"""WITH f AS (SELECT bare, form, n, replace(form, 'ּ', '') AS fold FROM {_COUNTS}), g AS (SELECT bare, fold, sum(n) AS n, arg_min(form, struct_pack(m := -{_NM}, n := -n, f := form)) AS rep FROM f GROUP BY bare, fold)
    SELECT bare, modal, round(top / n, 6) AS share, CASE WHEN forms = 1 THEN 'single' WHEN top / n >= 0.8 THEN 'dominant' ELSE 'conflict' END AS bucket, CAST(x.n AS BIGINT) AS n, g.rep AS representative FROM (SELECT bare, arg_min(fold, struct_pack(m := -n, f := fold)) AS modal, max(n) AS top, sum(n) AS n, count(*) AS forms FROM g GROUP BY bare) x JOIN (SELECT bare, fold, rep FROM g) g USING (bare) WHERE g.fold = modal""")
def modal_folded(spark, d):
    """Commonest form of each word when one mark doesn't count, with the most marked printed form as its representative."""
    counts = _pointed(spark, d).withColumn("fold", F.replace("form", F.lit("ּ"), F.lit("")))
    marks = F.length(F.regexp_replace("form", f"[^{MARKS}]", ""))
    return evidence.modal_folded(counts, "bare", "form", "fold", marks)


_CONS = "SELECT '{name}' AS stage, count(*) AS n_types, count(*) FILTER (forms = 1) AS n_single, round(sum(top) / sum(n), 6) AS token_consistency FROM (SELECT bare, sum(n) AS n, max(n) AS top, count(*) AS forms FROM {counts} GROUP BY bare)"
_MECH = f"(SELECT bare, form, sum(n) AS n FROM (SELECT bare, replace(form, 'ּ', '') AS form, n FROM {_COUNTS}) GROUP BY ALL)"
_PROJ = f"(SELECT bare, form, sum(n) AS n FROM (SELECT c.bare, coalesce(h.form, c.form) AS form, c.n FROM {_COUNTS} c LEFT JOIN {_CHOSEN} h USING (bare)) GROUP BY ALL)"


@query("consistency_stages", f"{_CONS.format(name='before', counts=_COUNTS)} UNION ALL {_CONS.format(name='mechanical', counts=_MECH)} UNION ALL {_CONS.format(name='projected', counts=_PROJ)}")
def consistency_stages(spark, d):
    """Consistency of pointing before, after a mechanical fold, and if every word took its canonical form."""
    counts = _pointed(spark, d)
    mechanical = counts.select("bare", F.replace("form", F.lit("ּ"), F.lit("")).alias("form"), "n").groupBy("bare", "form").agg(F.sum("n").alias("n"))
    held = _canonical(spark, d).select("bare", F.col("form").alias("to"))
    projected = counts.join(held, "bare", "left").select("bare", F.coalesce("to", "form").alias("form"), "n").groupBy("bare", "form").agg(F.sum("n").alias("n"))
    stages = [evidence.consistency(c, "bare").select(F.lit(name).alias("stage"), "n_types", "n_single", "token_consistency") for name, c in (("before", counts), ("mechanical", mechanical), ("projected", projected))]
    return stages[0].unionByName(stages[1]).unionByName(stages[2])


@query("applied_map", f"SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN h.form IS NULL THEN 'unmapped' WHEN {duck_bare('h.form')} <> {duck_bare('f.form')} THEN 'letters differ' WHEN h.form = f.form THEN 'same' ELSE 'changed' END AS outcome FROM {_FORMS} f LEFT JOIN {_CHOSEN} h USING (bare)) GROUP BY outcome")
def applied_map(spark, d):
    """Tokens that the canonical forms change, leave, or don't know. Decided once per form, counted by its tokens."""
    forms = _pointed(spark, d)
    done = routing.applied_map(forms, "bare", "form", _canonical(spark, d).select("bare", F.col("form").alias("target")), lambda x, y: T.strip_marks(x) == T.strip_marks(y))
    return done.groupBy("outcome").agg(F.sum("n").alias("n"))


@query("canonical_target", f"SELECT bare, arg_max(form, struct_pack(m := {_NM}, n := n, f := form)) AS target, count(*) - 1 AS rivals FROM {_COUNTS} GROUP BY bare")
def canonical_target(spark, d):
    """The most marked form of each word, of these the commonest, and how many others there are."""
    return routing.canonical_target(_pointed(spark, d), "bare", "form", "n", F.length(F.regexp_replace("form", f"[^{MARKS}]", "")))


_BOOK = f"(SELECT {duck_bare('word')} AS key, count(DISTINCT trim(split_part(gold_ipa, '|', 1))) AS n_ipa, bool_or(gold_ipa IS NULL) AS unread FROM g2p_gold_v3 WHERE word IS NOT NULL GROUP BY 1)"


@query("lexicon_coverage", f"SELECT kind, count(*) AS n_types, CAST(sum(n) AS BIGINT) AS n_tokens FROM (SELECT t.w, t.n, CASE WHEN b.key IS NULL AND regexp_matches(t.w, '[0-9]') THEN 'number' WHEN b.key IS NULL AND regexp_matches(t.w, '[a-z]') THEN 'latin' WHEN b.key IS NULL THEN 'missing' WHEN n_ipa = 0 THEN 'rejected' WHEN n_ipa > 1 THEN 'ambiguous' ELSE 'usable' END AS kind FROM (SELECT w, count(*) AS n FROM (SELECT unnest({duck_words('text_yi')}) AS w FROM annotations_gold) GROUP BY w) t LEFT JOIN {_BOOK} b ON b.key = {duck_bare('t.w')}) GROUP BY kind")
def lexicon_coverage(spark, d):
    """Types and tokens that the entries read, read in several ways, can't read, or miss, misses by kind."""
    g = table(spark, d, "g2p_gold_v3").where("word IS NOT NULL").groupBy(T.strip_marks(F.col("word")).alias("key")).agg(F.countDistinct(F.trim(F.split("gold_ipa", r"\|")[0])).alias("n_ipa"))
    t = table(spark, d, "annotations_gold").select(F.explode(T.words(F.col("text_yi"))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).withColumn("key", T.strip_marks(F.col("w")))
    miss = F.col("n_ipa").isNull()
    kind = T.first_reason([("number", miss & F.col("w").rlike("[0-9]")), ("latin", miss & F.col("w").rlike("[a-z]")), ("missing", miss), ("rejected", F.col("n_ipa") == 0), ("ambiguous", F.col("n_ipa") > 1)], "usable")
    return t.join(g, "key", "left").groupBy(kind.alias("kind")).agg(F.count("*").alias("n_types"), F.sum("n").alias("n_tokens"))


@query("thin_shares", "SELECT word, ipa, n, round(n / total, 6) AS share FROM (SELECT word, ipa, n, sum(n) OVER (PARTITION BY word) AS total FROM (SELECT word, ipa, count(*) AS n FROM eval_meta_2026_08_14 WHERE word IS NOT NULL AND ipa IS NOT NULL GROUP BY word, ipa)) WHERE n >= 2 AND n / total >= 0.05")
def thin_shares(spark, d):
    """Readings of each word with their share, thin ones left out."""
    cells = table(spark, d, "eval_meta_2026_08_14").where("word IS NOT NULL AND ipa IS NOT NULL").groupBy("word", "ipa").agg(F.count("*").alias("n"))
    return evidence.shares(cells, ["word", "ipa"], ["word"], least=2, least_share=0.05)


@query("compiled_entries", f"SELECT key, arg_max(ipa, rank) AS ipa, count(*) AS n_rows, count(DISTINCT ipa) > 1 AS collision, max(bad) AS n_bad FROM (SELECT {duck_key('word')} AS key, trim(split_part(regexp_replace(gold_ipa, '\\[[^\\]]*\\]', '', 'g'), '|', 1)) AS ipa, rank, length(regexp_replace(regexp_replace(gold_ipa, '\\[[^\\]]*\\]|\\|', '', 'g'), '{P.SYMBOL}|[ˈ -]', '', 'g')) AS bad FROM g2p_gold_v3 WHERE word IS NOT NULL AND gold_ipa IS NOT NULL) GROUP BY key")
def compiled_entries(spark, d):
    """One entry per key, the one written last, with whether rows of the key disagree and how many characters lie outside the inventory."""
    g = table(spark, d, "g2p_gold_v3").where("word IS NOT NULL AND gold_ipa IS NOT NULL")
    cell = F.regexp_replace("gold_ipa", r"\[[^\]]*\]", "")
    bad = F.length(F.regexp_replace(F.regexp_replace(cell, r"\|", ""), f"{P.SYMBOL}|[ˈ -]", ""))
    rows = g.select(T.lookup_key(F.col("word")).alias("key"), F.trim(F.split(cell, r"\|")[0]).alias("ipa"), "rank", bad.alias("bad"))
    return rows.groupBy("key").agg(F.max_by("ipa", "rank").alias("ipa"), F.count("*").alias("n_rows"), (F.countDistinct("ipa") > 1).alias("collision"), F.max("bad").cast("bigint").alias("n_bad"))


@query("mined_readings", f"SELECT word, arg_min(reading, struct_pack(m := -n, r := reading)) AS reading, max(n) AS n FROM (SELECT a AS word, b AS reading, count(*) AS n FROM (SELECT unnest(p) AS a, unnest(i) AS b FROM (SELECT {duck_words('pointed_yi')} AS p, string_split(regexp_replace(ipa, '[.,!?/;:]', '', 'g'), ' ') AS i FROM (SELECT DISTINCT id, pointed_yi, ipa FROM stress_tts)) WHERE len(p) = len(i)) GROUP BY a, b) WHERE word NOT IN (SELECT word FROM g2p_gold_v3 WHERE word IS NOT NULL) GROUP BY word")
def mined_readings(spark, d):
    """The commonest reading of each pointed word that is no entry, mined from sentences with equally many words and readings."""
    from warpweft.operators.decisions import zip_equal

    s = table(spark, d, "stress_tts").select("id", "pointed_yi", "ipa").distinct()
    pairs = s.select(F.explode(zip_equal(T.words(F.col("pointed_yi")), F.split(F.regexp_replace("ipa", "[.,!?/;:]", ""), " "))).alias("z")).groupBy(F.col("z.a").alias("word"), F.col("z.b").alias("reading")).agg(F.count("*").alias("n"))
    known = table(spark, d, "g2p_gold_v3").where("word IS NOT NULL").select("word")
    return pairs.join(known.distinct(), "word", "left_anti").groupBy("word").agg(F.min_by("reading", F.struct(-F.col("n"), F.col("reading"))).alias("reading"), F.max("n").alias("n"))


# ---- guards
@query("stress_agreement", "SELECT count(*) AS n_items, count(*) FILTER (same) AS n_same_phones, count(*) FILTER (same AND a = b) AS n_agree FROM (SELECT a, b, replace(a, 'ˈ', '') = replace(b, 'ˈ', '') AS same FROM (SELECT DISTINCT id, ipa_flash AS a, ipa_pro AS b FROM stress_tts WHERE ipa_flash IS NOT NULL AND ipa_pro IS NOT NULL))")
def stress_agreement(spark, d):
    """Items on whose stress two annotators agree, of those whose phones they give byte for byte alike."""
    s = table(spark, d, "stress_tts").where("ipa_flash IS NOT NULL AND ipa_pro IS NOT NULL").select("id", F.col("ipa_flash").alias("a"), F.col("ipa_pro").alias("b")).distinct()
    bare = lambda c: F.replace(c, F.lit(P.STRESS), F.lit(""))
    same = bare("a") == bare("b")
    return s.agg(F.count("*").alias("n_items"), F.count_if(same).alias("n_same_phones"), F.count_if(same & (F.col("a") == F.col("b"))).alias("n_agree"))


@query("derived_table", "SELECT 'made only' AS side, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'wanted only', 0")
def derived_table(spark, d):
    """Rows in which the type counts differ from those derived again from n-grams of one word: none."""
    docs = table(spark, d, "held_out_items").select(T.words(F.col("text")).alias("w"))
    made = docs.select(F.explode("w").alias("type")).groupBy("type").agg(F.count("*").alias("n"))
    from warpweft.operators.sequences import mine_ngrams

    return scoring.differences(made, mine_ngrams(docs, "w", (1,), 1).select(F.col("gram").alias("type"), F.col("count").alias("n")))


@query("canaries", "SELECT 'entries' AS \"check\", CAST(count(*) AS VARCHAR) AS found, count(*) >= 10 AS passed FROM g2p_gold_v3 UNION ALL SELECT 'canary ' || k, (SELECT min(gold) FROM g2p_gold_v3 WHERE word = k), coalesce((SELECT min(gold) FROM g2p_gold_v3 WHERE word = k) = v, false) FROM (VALUES ('דער', 'der'), ('זיי', 'zey'), ('ניטא', 'x')) t(k, v)")
def canaries(spark, d):
    """Whether the entry table is large enough and known words read as they must; the last canary is meant to fail."""
    g = table(spark, d, "g2p_gold_v3")
    want = spark.createDataFrame([("דער", "der"), ("זיי", "zey"), ("ניטא", "x")], "word string, gold_want string").withColumnRenamed("gold_want", "gold")
    return scoring.canaries(g.where("word IS NOT NULL"), "word", "gold", want, {"entries": (g, 10)})


@query("lexicon_sanity", f"SELECT layer, count(*) AS n, count(*) FILTER (bad) AS n_bad FROM (SELECT coalesce(layer, '') AS layer, regexp_replace(ipa, '{P.SYMBOL}|[ˈ -]', '', 'g') <> '' OR len(regexp_extract_all(ipa, '{P.VOWEL}')) = 0 AS bad FROM (SELECT layer, trim(split_part(gold_ipa, '|', 1)) AS ipa FROM g2p_gold_v3 WHERE gold_ipa IS NOT NULL)) GROUP BY layer")
def lexicon_sanity(spark, d):
    """Entries by layer, and those whose first reading has a symbol outside the inventory or no vowel."""
    g = table(spark, d, "g2p_gold_v3").where("gold_ipa IS NOT NULL").select(F.coalesce("layer", F.lit("")).alias("layer"), F.trim(F.split("gold_ipa", r"\|")[0]).alias("ipa"))
    bad = (F.size(P.violations(F.col("ipa"))) > 0) | (P.vowel_count(F.col("ipa")) == 0)
    return g.groupBy("layer").agg(F.count("*").alias("n"), F.count_if(bad).alias("n_bad"))


@query("cache_key", "SELECT bit_xor(x) AS cache_key, CAST(sum(n) AS BIGINT) AS n_rows FROM (SELECT bit_xor(CAST('0x' || substring(md5(concat_ws(chr(31), coalesce(word, chr(1)), coalesce(ipa, chr(1)))), 1, 15) AS BIGINT)) AS x, count(*) AS n FROM eval_meta_2026_08_14 UNION ALL SELECT bit_xor(CAST('0x' || substring(md5(concat_ws(chr(31), coalesce(word, chr(1)), coalesce(gold_ipa, chr(1)))), 1, 15) AS BIGINT)), count(*) FROM g2p_gold_v3)")
def cache_key(spark, d):
    """One key of two tables on which a cached result depends."""
    parts = [scoring.fingerprint(table(spark, d, t), c) for t, c in (("eval_meta_2026_08_14", ["word", "ipa"]), ("g2p_gold_v3", ["word", "gold_ipa"]))]
    return parts[0].unionByName(parts[1]).agg(F.bit_xor("fingerprint").alias("cache_key"), F.sum("n_rows").alias("n_rows"))


# ---- samples
@query("one_per_episode", "SELECT episode, ann_id, CASE WHEN CAST('0x' || substring(md5('7' || episode), 1, 4) AS INTEGER) < 45875 THEN 'harvest' ELSE 'test' END AS split_name FROM (SELECT episode, arg_min(ann_id, struct_pack(h := md5('42' || ann_id), k := ann_id)) AS ann_id FROM annotations_gold WHERE episode IS NOT NULL GROUP BY episode)")
def one_per_episode(spark, d):
    """One chunk of each episode, the first in hash order, seven in ten of them to be harvested and the others for a test."""
    from warpweft.operators.sequences import group_split

    one = S.one_per_group(table(spark, d, "annotations_gold").where("episode IS NOT NULL").select("episode", "ann_id"), "episode", "ann_id")
    return group_split(one, "episode", [("harvest", 45875), ("test", 65536)], "7")


@query("held_out_split", "SELECT split_name, count(*) AS n FROM (SELECT CASE WHEN episode = '1000000' THEN 'test' WHEN CAST('0x' || substring(md5('42' || coalesce(episode, '')), 1, 4) AS INTEGER) < 1310 THEN 'val' ELSE 'train' END AS split_name FROM yiexample) GROUP BY split_name")
def held_out_split(spark, d):
    """Rows by split when one episode is held out and two in a hundred of the others go to validation."""
    y = S.held_out_group(table(spark, d, "yiexample").select("episode"), "episode", ["1000000"])
    return y.groupBy("split_name").agg(F.count("*").alias("n"))


@query("listed_split", "SELECT coalesce(l.split, 'rejected') AS split_name, count(*) AS n FROM annotations_gold a LEFT JOIN (SELECT episode, min(split) AS split FROM yiexample WHERE episode IS NOT NULL GROUP BY episode) l USING (episode) GROUP BY 1")
def listed_split(spark, d):
    """Gold chunks by the split that a list of episodes gives them, and those in no list."""
    lists = table(spark, d, "yiexample").where("episode IS NOT NULL").select("episode", F.col("split").alias("split_name")).distinct()
    return S.listed_split(table(spark, d, "annotations_gold").select("episode"), "episode", lists).groupBy("split_name").agg(F.count("*").alias("n"))


@query("picked_lines", "SELECT row_id, text FROM (SELECT text, min(row_id) AS row_id FROM yiexample WHERE length(text) BETWEEN 30 AND 120 AND NOT regexp_matches(text, '[0-9A-Za-z]') GROUP BY text) ORDER BY md5('42' || row_id), row_id LIMIT 20")
def picked_lines(spark, d):
    """Twenty clean lines of middling length in hash order, each text once."""
    y = table(spark, d, "yiexample").select("row_id", "text")
    fit = F.length("text").between(30, 120) & ~F.col("text").rlike("[0-9A-Za-z]")
    return S.picked_lines(y, "row_id", "text", fit, 20).select("row_id", "text")


@query("first_covered", f"SELECT word, n FROM (SELECT word, count(*) AS n FROM eval_meta_2026_08_14 WHERE confidence = 'LOW' AND word IS NOT NULL GROUP BY word) WHERE word IN (SELECT unnest({duck_words('text_yi')}) FROM annotations_gold) ORDER BY n DESC, word LIMIT 30")
def first_covered(spark, d):
    """The thirty commonest words of low confidence that the gold chunks have."""
    low = table(spark, d, "eval_meta_2026_08_14").where("confidence = 'LOW' AND word IS NOT NULL").groupBy("word").agg(F.count("*").alias("n"))
    index = table(spark, d, "annotations_gold").select(F.explode(T.words(F.col("text_yi"))).alias("word"))
    return S.first_covered(low, index, "word", ["n desc", "word"], 30).select("word", "n")


@query("only_spelling", f"SELECT count(*) AS n FROM (SELECT ann_id, k FROM (SELECT ann_id, {duck_bare('w')} AS k, nfc_normalize(w) AS w FROM (SELECT ann_id, unnest({duck_words('text_yi_pointed')}) AS w FROM annotations_gold)) GROUP BY ann_id, k HAVING count(DISTINCT w) = 1)")
def only_spelling(spark, d):
    """Words that a chunk spells one way only."""
    each = table(spark, d, "annotations_gold").select("ann_id", F.explode(T.words(F.col("text_yi_pointed"))).alias("w")).distinct()
    each = each.select("ann_id", T.strip_marks(F.col("w")).alias("k"), T.composed(F.col("w")).alias("form"))
    return routing.only_spelling(each, "ann_id", "k", "form").agg(F.count("*").alias("n"))

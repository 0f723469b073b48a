"""Queries that compare readings and turn votes on them into verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from warpweft.functions import phones as P
from warpweft.functions import readings as R
from warpweft.functions import text as T
from warpweft.operators import align, evidence
from warpweft.operators import verdicts as V
from warpweft.plans.registry import query
from warpweft.sources.tables import table

_SYM = P.SYMBOL
# Phones that are forgiven when they are confused, in either order.
FORGIVEN = [("ej", "ɛ"), ("aː", "a"), ("ɔ", "a"), ("ə", "ɛ"), ("ə", "a"), ("ə", "i"), ("u", "ɔ"), ("z", "s"), ("ɡ", "k"), ("d", "t"), ("b", "p"), ("v", "f"), ("ʒ", "ʃ"), ("ʤ", "ʧ")]

_CLEAN = "regexp_replace({c}, '[.,!?/;:]', '', 'g')"
_ITEMS = f"(SELECT DISTINCT id, {_CLEAN.format(c='ipa')} AS ipa FROM stress_tts WHERE ipa IS NOT NULL)"
#: Words of the published reading beside those of each vote with as many words: key, clip, expected and heard.
_CLIPS = f"""(SELECT id, slot, vote_id AS clip, e[slot] AS expected, h[slot] AS heard FROM (SELECT s.id, v.vote_id, string_split(s.ipa, ' ') AS e, string_split(v.ipa, ' ') AS h, unnest(range(1, len(string_split(s.ipa, ' ')) + 1)) AS slot
    FROM {_ITEMS} s JOIN (SELECT id, vote_id, {_CLEAN.format(c='ipa')} AS ipa FROM stress_votes WHERE ipa IS NOT NULL) v USING (id)) WHERE len(e) = len(h))"""
_PHONED = f"(SELECT *, regexp_extract_all(expected, '{_SYM}') AS a, regexp_extract_all(heard, '{_SYM}') AS b FROM {_CLIPS})"


def _clean(c: str):
    return F.regexp_replace(c, "[.,!?/;:]", "")


def _items(spark, d):
    return table(spark, d, "stress_tts").where("ipa IS NOT NULL").select("id", _clean("ipa").alias("ipa")).distinct()


def _clips(spark, d):
    s = _items(spark, d).select("id", F.split("ipa", " ").alias("e"))
    v = table(spark, d, "stress_votes").where("ipa IS NOT NULL").select("id", F.col("vote_id").alias("clip"), F.split(_clean("ipa"), " ").alias("h"))
    met = s.join(v, "id").where("size(e) = size(h)")
    return met.select("id", "clip", F.posexplode(F.arrays_zip("e", "h")).alias("p", "z")).select("id", (F.col("p") + 1).alias("slot"), "clip", F.col("z.e").alias("expected"), F.col("z.h").alias("heard"))


def _phoned(spark, d):
    return _clips(spark, d).withColumn("a", P.phones(F.col("expected"))).withColumn("b", P.phones(F.col("heard")))


_PAIRS = ", ".join(f"'{x}|{y}', '{y}|{x}'" for x, y in FORGIVEN)
_SCORED = f"(SELECT expected AS word, len(list_filter(range(1, len(a) + 1), lambda i: a[i] = b[i] OR (a[i] || '|' || b[i]) IN ({_PAIRS}))) / len(a) AS score FROM {_PHONED} WHERE len(a) = len(b) AND len(a) > 0)"


@query("agreement_verdicts", f"SELECT word, clips, round(m, 6) AS agree, CASE WHEN clips < 2 THEN 'thin' WHEN round(m, 9) >= 0.65 THEN 'OK' WHEN round(m, 9) <= 0.4 THEN 'SUSPECT' ELSE 'mid' END AS verdict FROM (SELECT word, count(*) AS clips, avg(score) AS m FROM {_SCORED} GROUP BY word)")
def agreement_verdicts(spark, d):
    """Words by how far their votes agree with the published reading, habitual confusions forgiven."""
    c = _phoned(spark, d).where("size(a) = size(b) AND size(a) > 0")
    hits = F.size(F.filter(F.zip_with("a", "b", lambda x, y: align.forgiven(x, y, FORGIVEN)), lambda z: z))
    return V.agreement_verdicts(c.select(F.col("expected").alias("word"), (hits / F.size("a")).alias("score")), "word", "score")


_VARIANTS = f"(SELECT id, slot, unnest(['flash', 'pro']) AS variant, unnest([f[slot], p[slot]]) AS ipa FROM (SELECT id, f, p, unnest(range(1, len(f) + 1)) AS slot FROM (SELECT DISTINCT id, string_split({_CLEAN.format(c='ipa_flash')}, ' ') AS f, string_split({_CLEAN.format(c='ipa_pro')}, ' ') AS p FROM stress_tts WHERE ipa_flash IS NOT NULL AND ipa_pro IS NOT NULL) WHERE len(f) = len(p)) WHERE f[slot] <> p[slot])"
_VSCORES = f"""(SELECT v.id || '.' || v.slot AS word, clip, variant, min(len(list_filter(range(1, length(v.ipa) + 1), lambda i: substring(v.ipa, i, 1) = substring(c.heard, i, 1))) / length(v.ipa)) AS score
    FROM {_VARIANTS} v JOIN {_CLIPS} c ON c.id = v.id AND c.slot = v.slot WHERE length(v.ipa) > 0 GROUP BY ALL)"""


def _variants(spark, d):
    s = table(spark, d, "stress_tts").where("ipa_flash IS NOT NULL AND ipa_pro IS NOT NULL").select("id", F.split(_clean("ipa_flash"), " ").alias("flash"), F.split(_clean("ipa_pro"), " ").alias("pro")).distinct()
    return s.where("size(flash) = size(pro)").select("id", F.posexplode(F.arrays_zip("flash", "pro")).alias("slot", "z")).where("z.flash <> z.pro").select("id", (F.col("slot") + 1).alias("slot"), F.col("z.flash").alias("flash"), F.col("z.pro").alias("pro"))


@query(
    "best_variant_votes",
    f"""WITH best AS (SELECT word, clip, max(score) AS top FROM {_VSCORES} GROUP BY word, clip), won AS (SELECT b.word, b.clip, CASE WHEN count(*) = 1 AND max(s.score) > 0 THEN min(s.variant) END AS choice
    FROM best b JOIN {_VSCORES} s ON s.word = b.word AND s.clip = b.clip AND s.score = b.top GROUP BY b.word, b.clip), cells AS (SELECT word, choice, count(*) AS n FROM won GROUP BY word, choice)
    SELECT word, CAST(sum(n) AS BIGINT) AS clips, CAST(sum(n) FILTER (choice IS NOT NULL) AS BIGINT) AS decided, arg_min(choice, struct_pack(m := -n, c := choice)) FILTER (choice IS NOT NULL) AS winner, max(n) FILTER (choice IS NOT NULL) AS winner_votes
    FROM cells GROUP BY word HAVING sum(n) >= 3 AND sum(n) FILTER (choice IS NOT NULL) > 0""",
)
def best_variant_votes(spark, d):
    """Which model's reading of a contested word the votes are nearer to; a vote counts only for a single best above nothing."""
    v = _variants(spark, d)
    each = v.select("id", "slot", F.explode(F.array(F.struct(F.lit("flash").alias("variant"), F.col("flash").alias("ipa")), F.struct(F.lit("pro").alias("variant"), F.col("pro").alias("ipa")))).alias("x")).where("length(x.ipa) > 0")
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    hit = F.size(F.filter(F.zip_with(letters(F.col("x.ipa")), letters(F.col("heard")), lambda p, q: p == q), lambda z: z))
    scored = each.join(_clips(spark, d), ["id", "slot"]).select(F.concat_ws(".", "id", "slot").alias("word"), "clip", F.col("x.variant").alias("variant"), (hit / F.length("x.ipa")).alias("score"))
    return V.variant_votes(scored.groupBy("word", "clip", "variant").agg(F.min("score").alias("score")), "word", "clip", "variant", "score")


_SLOTS = f"(SELECT expected AS word, i - 1 AS pos, a[i] AS phone, b[i] AS heard FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM {_PHONED} WHERE len(a) = len(b)))"


def _slots(spark, d):
    c = _phoned(spark, d).where("size(a) = size(b)")
    return c.select(F.col("expected").alias("word"), F.posexplode(F.arrays_zip("a", "b")).alias("pos", "z")).select("word", "pos", F.col("z.a").alias("phone"), F.col("z.b").alias("heard"))


_FULL = ", ".join(f"'{v}'" for v in P.VOWELS if v != "ə")


@query(
    "vowel_votes",
    f"""SELECT word, CAST(pos AS INTEGER) AS pos, phone, modal, votes, round(top / votes, 6) AS steadiness FROM (SELECT word, pos, phone, CAST(sum(n) AS BIGINT) AS votes, arg_min(heard, struct_pack(m := -n, h := heard)) AS modal, max(n) AS top
    FROM (SELECT word, pos, phone, heard, count(*) AS n FROM {_SLOTS} WHERE phone IN ({_FULL}, 'ə') GROUP BY ALL) GROUP BY word, pos, phone) WHERE modal <> phone AND votes >= 3 AND top >= 0.6 * votes AND modal IN ({_FULL})""",
)
def vowel_votes(spark, d):
    """Vowels that voters steadily hear as another full vowel."""
    votes = _slots(spark, d).where(F.col("phone").isin(P.VOWELS))
    return V.slot_disagreements(votes, ["word", "pos"], "phone", "heard", F.col("modal").isin([v for v in P.VOWELS if v != "ə"]))


_WORDS = f"(SELECT id, slot, expected, heard FROM {_CLIPS})"
_CELLS = f"(SELECT id, slot, expected, CAST(sum(n) AS BIGINT) AS votes, CAST(coalesce(sum(n) FILTER (heard = expected), 0) AS BIGINT) AS same, arg_min(heard, struct_pack(m := -n, h := heard)) AS modal, max(n) AS top FROM (SELECT id, slot, expected, heard, count(*) AS n FROM {_WORDS} GROUP BY ALL) GROUP BY ALL)"
_VERDICT = "CASE WHEN votes < 3 THEN 'thin' WHEN same >= 2 / 3 * votes THEN 'CONFIRMED' WHEN top >= 2 / 3 * votes AND modal <> expected THEN 'FLIP' ELSE 'contested' END"


def _word_slots(spark, d):
    c = _clips(spark, d)
    cells = c.groupBy("id", "slot", "expected", "heard").agg(F.count("*").alias("n")).groupBy("id", "slot", "expected")
    top = cells.agg(F.max("n").alias("top"))
    return evidence.slot_verdicts(c, ["id", "slot"], "expected", "heard").join(top, ["id", "slot", "expected"])


@query(
    "fold_flips",
    f"""SELECT id, n_slots, flips, CASE WHEN n_flips = 0 THEN 'kept' WHEN n_open > 0 THEN 'queued: slot undecided' WHEN n_weak > 0 THEN 'queued: weak flip' ELSE 'folded' END AS outcome FROM (SELECT id, count(*) AS n_slots, count(*) FILTER (v = 'FLIP') AS n_flips,
    count(*) FILTER (v = 'FLIP' AND NOT (top >= 3 AND top >= 3 * same)) AS n_weak, count(*) FILTER (v NOT IN ('FLIP', 'CONFIRMED')) AS n_open, coalesce(array_to_string(list(slot ORDER BY slot) FILTER (v = 'FLIP'), ','), '') AS flips FROM (SELECT *, {_VERDICT} AS v FROM {_CELLS}) GROUP BY id)""",
)
def fold_flips(spark, d):
    """Items whose flipped words may be written into the published reading, and those that wait, with the reason."""
    out = V.fold_flips(_word_slots(spark, d).withColumn("slot", F.col("slot").cast("bigint")), "id", "slot", "same", "top", "verdict")
    return out.withColumn("flips", F.array_join("flips", ","))


@query(
    "fold_corrections",
    f"""SELECT id, slot, expected, modal, top || '/' || votes AS votes, CASE WHEN modal IN (SELECT trim(split_part(gold_ipa, '|', 1)) FROM g2p_gold_v3 WHERE layer = 'G' AND gold_ipa IS NOT NULL) AND NOT coalesce(id IN (SELECT id FROM stress_tts WHERE agreement = 'both models'), false)
    THEN 'folded' ELSE 'queued' END AS outcome FROM {_CELLS} WHERE modal <> expected AND votes >= 3 AND top >= 2 / 3 * votes""",
)
def fold_corrections(spark, d):
    """Words steadily heard as another: folded where the heard one is a common reading and the item isn't settled, else queued."""
    common = table(spark, d, "g2p_gold_v3").where("layer = 'G'").select(F.trim(F.split("gold_ipa", r"\|")[0]).alias("modal")).distinct().withColumn("known", F.lit(True))
    settled = table(spark, d, "stress_tts").where("agreement = 'both models'").select("id").distinct().withColumn("settled", F.lit(True))
    s = _word_slots(spark, d).withColumn("slot", F.col("slot").cast("bigint")).join(common, "modal", "left").join(settled, "id", "left")
    return V.fold_corrections(s, "id", "slot", "expected", "modal", "votes", "top", F.col("known").isNotNull(), F.col("settled").isNotNull())


@query("consensus_reading", f"SELECT id, arg_min(ipa, struct_pack(m := -n, i := ipa)) AS reading, CAST(sum(n) AS BIGINT) AS heard, round(max(n) / sum(n), 6) AS agreement FROM (SELECT id, lower(regexp_replace(ipa, '[^a-z]', '', 'g')) AS ipa, count(*) AS n FROM stress_votes WHERE ipa IS NOT NULL GROUP BY 1, 2) GROUP BY id")
def consensus_reading(spark, d):
    """The commonest reading of each item, only its plain letters compared, and how far votes agree on it."""
    v = table(spark, d, "stress_votes").select("id", F.lower(F.regexp_replace("ipa", "[^a-z]", "")).alias("reading"))
    return V.consensus_reading(v, "id", "reading")


@query("context_agreement", """SELECT word, arg_min(ipa, struct_pack(m := -n, i := ipa)) AS reading, max(n) AS contexts, CASE WHEN max(n) >= 2 THEN 'multi' ELSE 'single' END AS kind
    FROM (SELECT word, ipa, count(DISTINCT sentence) AS n FROM eval_meta_2026_08_14 WHERE word IS NOT NULL AND ipa IS NOT NULL AND word_no IS NOT NULL GROUP BY word, ipa) GROUP BY word""")
def context_agreement(spark, d):
    """The reading that most sentences give a word, and whether more than one does."""
    e = table(spark, d, "eval_meta_2026_08_14").where("word IS NOT NULL AND word_no IS NOT NULL")
    return V.context_agreement(e, "word", "sentence", "ipa")


_JUDGED = f"""(SELECT word, ours, corrected, n_syl, conf FROM (SELECT expected AS word, CAST(len(regexp_extract_all(split_part(expected, 'ˈ', 1), '{P.VOWEL}')) AS INTEGER) AS ours, CAST(len(regexp_extract_all(split_part(heard, 'ˈ', 1), '{P.VOWEL}')) AS INTEGER) AS corrected,
    CAST(len(regexp_extract_all(expected, '{P.VOWEL}')) AS INTEGER) AS n_syl, CASE WHEN contains(heard, 'ˈ') THEN 0.9 ELSE 0.2 END AS conf FROM {_CLIPS} WHERE contains(expected, 'ˈ')))"""


def _judged(spark, d):
    """Votes on the stressed nucleus of each word: ours, the voted one, and how many there are."""
    c = _clips(spark, d).where(F.contains("expected", F.lit(P.STRESS)))
    at = lambda w: F.regexp_count(F.substring_index(w, P.STRESS, 1), F.lit(f"({P.VOWEL})"))
    return c.select(F.col("expected").alias("word"), at("expected").alias("ours"), at("heard").alias("corrected"), F.regexp_count("expected", F.lit(f"({P.VOWEL})")).alias("n_syl"), F.when(F.contains("heard", F.lit(P.STRESS)), 0.9).otherwise(0.2).alias("conf"))


_USABLE = f"(SELECT word, ours, n_syl, CASE WHEN ours = corrected THEN ours ELSE corrected END AS place FROM {_JUDGED} WHERE conf >= 0.5 AND (ours = corrected OR (corrected >= 0 AND corrected < n_syl)))"


def _usable(spark, d):
    j = _judged(spark, d)
    return V.usable_judgments(j, F.col("ours") == F.col("corrected"), F.col("ours"), F.col("corrected"), F.col("n_syl"), F.col("conf"))


@query("usable_judgments", f"SELECT word, place, count(*) AS n FROM {_USABLE} GROUP BY word, place")
def usable_judgments(spark, d):
    """Votes on stress that are sure and make sense, by word and place."""
    return _usable(spark, d).groupBy("word", "place").agg(F.count("*").alias("n"))


@query("harvest", f"SELECT word, arg_min(place, struct_pack(m := -n, p := place)) AS correction, max(n) AS n, CASE WHEN max(n) >= 2 THEN 'override' ELSE 'review' END AS outcome FROM (SELECT word, place, count(*) AS n FROM {_USABLE} WHERE place <> ours GROUP BY word, place) GROUP BY word")
def harvest(spark, d):
    """Corrections of stress on which two votes agree, and those left for review."""
    return V.harvest(_usable(spark, d).where("place <> ours"), "word", "place")


@query(
    "stress_buckets",
    f"""SELECT bucket, count(*) AS n, count(*) FILTER (place = ours) AS n_right, round(count(*) FILTER (place = ours) / count(*), 6) AS accuracy FROM (SELECT place, ours, unnest(['all', least(n_syl, 5) || '-syl', CASE WHEN regexp_matches(word, '^(ɡɛ|bɛ|far)') THEN 'prefixed' ELSE 'no prefix' END]) AS bucket FROM {_USABLE}) GROUP BY bucket""",
)
def stress_buckets(spark, d):
    """Accuracy of stress in buckets that overlap: all, by number of nuclei, with and without a prefix."""
    u = _usable(spark, d)
    labels = F.array(F.lit("all"), F.concat(F.least("n_syl", F.lit(5)).cast("string"), F.lit("-syl")), F.when(F.col("word").rlike("^(ɡɛ|bɛ|far)"), "prefixed").otherwise("no prefix"))
    hit = F.count_if(F.col("place") == F.col("ours"))
    return u.select("place", "ours", F.explode(labels).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"), hit.alias("n_right"), F.round(hit / F.count("*"), 6).alias("accuracy"))


_TWO = f"(SELECT DISTINCT f AS a, p AS b FROM (SELECT unnest(f) AS f, unnest(p) AS p FROM (SELECT string_split({_CLEAN.format(c='ipa_flash')}, ' ') AS f, string_split({_CLEAN.format(c='ipa_pro')}, ' ') AS p FROM stress_tts WHERE ipa_flash IS NOT NULL AND ipa_pro IS NOT NULL) WHERE len(f) = len(p)))"


def _two(spark, d):
    """Pairs of readings of one word by the two models."""
    s = table(spark, d, "stress_tts").where("ipa_flash IS NOT NULL AND ipa_pro IS NOT NULL").select(F.split(_clean("ipa_flash"), " ").alias("a"), F.split(_clean("ipa_pro"), " ").alias("b"))
    return s.where("size(a) = size(b)").select(F.explode(F.arrays_zip("a", "b")).alias("z")).select("z.a", "z.b").distinct()


_N = lambda x: f"len(regexp_extract_all({x}, '{P.VOWEL}'))"
_DECOMP = lambda x: f"replace(replace(replace({x}, 'ʧ', 'tʃ'), 'ʦ', 'ts'), 'ʤ', 'dʒ')"
_LOST = " OR ".join(f"length({_DECOMP('b')}) - length(replace({_DECOMP('b')}, '{c}', '')) > length({_DECOMP('a')}) - length(replace({_DECOMP('a')}, '{c}', ''))" for c in P.CONSONANTS if c not in "ʧʦʤ")
_STRAND = lambda x: f"regexp_matches(regexp_replace(regexp_replace({x}, '[ˈ -]', '', 'g'), '{P.VOWEL}', 'V', 'g'), '[^V]h')"
_END = lambda x: f"(CASE WHEN contains({x}, 'ˈ') THEN nullif(-len(regexp_extract_all(list_last(string_split({x}, 'ˈ')), '{P.VOWEL}')), 0) END)"
_DEFECT = f"""CASE WHEN {_LOST} THEN 'consonant lost' WHEN {_N('a')} < {_N('b')} - len(regexp_extract_all(b, 'ə')) THEN 'nucleus lost' WHEN contains(a, 'oʊ') AND NOT contains(b, 'oʊ') THEN 'default over a point'
    WHEN {_STRAND('a')} AND NOT {_STRAND('b')} THEN 'stranded h' WHEN coalesce({_N('a')} = {_N('b')} AND {_END('b')} = -2 AND {_END('a')} = -3, false) THEN 'stress retracted' ELSE '' END"""


@query("reading_defects", f"SELECT a, b, {_DEFECT} AS defect, CAST({_END('a')} AS INTEGER) AS from_end FROM {_TWO}")
def reading_defects(spark, d):
    """Pairs of readings with the first defect of the one in the light of the other, and its stress from the end."""
    return _two(spark, d).select("a", "b", R.defect(F.col("a"), F.col("b")).alias("defect"), R.stress_from_end(F.col("a")).alias("from_end"))


_SK = lambda x: f"trim(regexp_replace(regexp_replace(replace({x}, '-', ' '), '[ˈˌ]', '', 'g'), ' +', ' ', 'g'))"
_VS = lambda x: f"list_transform(regexp_extract_all({_SK(x)}, '{P.VOWEL}'), lambda v: replace(v, 'ː', ''))"


@query(
    "vowel_agreement",
    f"SELECT a, b, len(x) = len(y) AND len(list_filter(range(1, len(x) + 1), lambda i: x[i] <> y[i] AND x[i] <> 'ə' AND y[i] <> 'ə')) = 0 AS agree, skeleton FROM (SELECT a, b, {_VS('a')} AS x, {_VS('b')} AS y, {_SK('a')} AS skeleton FROM {_TWO})",
)
def vowel_agreement(spark, d):
    """Pairs of readings and whether their vowels agree up to reduction and length."""
    return _two(spark, d).select("a", "b", R.vowels_agree(F.col("a"), F.col("b")).alias("agree"), R.skeleton(F.col("a")).alias("skeleton"))


_SHARE = "(SELECT a, count(*) / sum(count(*)) OVER () AS q FROM (SELECT expected AS a FROM {c} WHERE expected = heard) GROUP BY a)".replace("{c}", _CLIPS)
_OK = lambda x: f"({x} <> '' AND regexp_replace({x}, '{_SYM}|[ˈ -]', '', 'g') = '' AND {_N(x)} > 0)"
_AUDIO = f"""(SELECT a, b, avg(CASE WHEN heard = a THEN 1.0 ELSE 0.0 END) AS x, avg(CASE WHEN heard = b THEN 1.0 ELSE 0.0 END) AS y, count(*) AS clips FROM {_TWO} t JOIN (SELECT expected, heard FROM {_CLIPS}) c ON c.expected = t.b WHERE a <> b GROUP BY a, b HAVING count(*) >= 2)"""
_WIN = "CASE WHEN abs(round(x - y, 9)) < 0.1 THEN 'tie' WHEN round(x - y, 9) > 0 THEN 'first' ELSE 'second' END"


def _arbitrated(spark, d):
    two = _two(spark, d).where("a <> b").withColumn("pair", F.concat_ws("|", "a", "b"))
    clips = _clips(spark, d).select(F.col("expected").alias("b"), "heard")
    scored = two.join(clips, "b").select("pair", (F.col("heard") == F.col("a")).cast("double").alias("first"), (F.col("heard") == F.col("b")).cast("double").alias("second"))
    return V.arbitrate(scored, "pair", "first", "second", ("first", "second"))


@query("audio_arbitration", f"SELECT a || '|' || b AS pair, clips, {_WIN} AS winner, round(x, 3) AS first, round(y, 3) AS second FROM {_AUDIO}")
def audio_arbitration(spark, d):
    """Pairs of readings and which one the votes on the word are, on average; a tie within a tenth."""
    return _arbitrated(spark, d)


@query(
    "register_decision",
    f"""SELECT a, b, CASE r WHEN 0 THEN a ELSE b END AS "primary", CASE WHEN (CASE r WHEN 0 THEN okb ELSE oka END) AND a <> b AND dd = '' THEN CASE r WHEN 0 THEN b ELSE a END END AS variant, CASE r WHEN 0 THEN 'first' ELSE 'second' END AS register, why FROM (
    SELECT *, CASE WHEN NOT oka THEN 1 WHEN NOT okb THEN 0 WHEN dd <> '' THEN 1 WHEN w = 'second' THEN 1 WHEN w = 'first' THEN 0 WHEN q >= 0.01 THEN 1 ELSE 0 END AS r, CASE WHEN NOT oka THEN 'first rejected' WHEN NOT okb THEN 'second rejected' WHEN dd <> '' THEN dd
    WHEN w = 'second' THEN 'observed second' WHEN w = 'first' THEN 'observed first' WHEN q >= 0.01 THEN 'share of use' ELSE 'default' END AS why FROM (
    SELECT t.a, t.b, {_OK('t.a')} AS oka, {_OK('t.b')} AS okb, CASE WHEN {_OK('t.a')} AND {_OK('t.b')} THEN d.defect ELSE '' END AS dd, CASE WHEN {_OK('t.a')} AND {_OK('t.b')} THEN {_WIN} END AS w, s.q FROM {_TWO} t LEFT JOIN (SELECT a, b, {_DEFECT} AS defect FROM {_TWO}) d USING (a, b) LEFT JOIN {_AUDIO} USING (a, b) LEFT JOIN {_SHARE} s ON s.a = t.b) WHERE oka OR okb)""".replace(_WIN + " END AS w", "CASE WHEN x IS NOT NULL THEN " + _WIN + " END END AS w"),
)
def register_decision(spark, d):
    """The reading of each word and the rule that chose it: validity, defects, votes, use, default."""
    two = _two(spark, d)
    won = _arbitrated(spark, d).select("pair", "winner")
    used = _clips(spark, d).where("expected = heard").groupBy(F.col("expected").alias("b")).agg(F.count("*").alias("n"))
    use = used.select("b", (F.col("n") / used.agg(F.sum("n")).scalar()).alias("q"))
    rows = two.withColumn("pair", F.concat_ws("|", "a", "b")).join(won, "pair", "left").join(use, "b", "left")
    ok = lambda c: (F.col(c) != "") & (F.size(P.violations(F.col(c))) == 0) & (P.vowel_count(F.col(c)) > 0)
    out = V.decide_register(rows, "a", "b", ok("a"), ok("b"), R.defect(F.col("a"), F.col("b")), F.col("winner"), F.col("q"), least=0.01)
    return out.select("a", "b", "primary", "variant", "register", "why")


@query(
    "slot_substitution",
    f"SELECT DISTINCT b AS ipa, array_to_string(list_transform(string_split(b, ' '), lambda w: CASE WHEN w = '' THEN '' ELSE regexp_replace(w, '^(ˈ?)({P.VOWEL}|[^ˈ])', '\\1ɔ') END), ' ') AS changed FROM {_TWO} WHERE b <> ''",
)
def slot_substitution(spark, d):
    """Readings with the first phone replaced, marks of stress kept in place."""
    return _two(spark, d).where("b <> ''").select(F.col("b").alias("ipa")).distinct().select("ipa", R.substitute_phones(F.col("ipa"), F.create_map(F.lit(0), F.lit("ɔ"))).alias("changed"))


@query(
    "collapse_or_split",
    f"SELECT word, CAST(sum(n) AS BIGINT) AS n_forms, count(*) AS n_readings, CASE WHEN count(*) = 1 THEN 'collapsed' ELSE 'split' END AS kind FROM (SELECT word, regexp_replace(ipa, 'ˈ', '', 'g') AS sound, count(*) AS n FROM (SELECT DISTINCT word, ipa FROM eval_meta_2026_08_14 WHERE word IS NOT NULL AND ipa IS NOT NULL) GROUP BY 1, 2) GROUP BY word HAVING sum(n) > 1",
)
def collapse_or_split(spark, d):
    """Words with several readings: those that differ in stress only, and those that differ in sound."""
    e = table(spark, d, "eval_meta_2026_08_14").where("word IS NOT NULL AND ipa IS NOT NULL").select("word", "ipa").distinct()
    return V.collapse_or_split(e.withColumn("sound", F.replace("ipa", F.lit(P.STRESS), F.lit(""))), "word", "sound").where("n_forms > 1")


_FIRSTS = "trim(split_part(regexp_replace(gold_ipa, '\\[[^\\]]*\\]', '', 'g'), '|', 1))"


@query(
    "pooled_evidence",
    f"SELECT word, count(*) AS n, count(DISTINCT ipa) AS n_readings, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM (SELECT word, {_FIRSTS} AS ipa, 'entries' AS source FROM g2p_gold_v3 UNION ALL SELECT word, ipa, 'sheet' FROM eval_meta_2026_08_14 WHERE word IS NOT NULL) WHERE ipa IS NOT NULL GROUP BY word",
)
def pooled_evidence(spark, d):
    """Readings of each word in the entries and the sheet, in one pool."""
    g = table(spark, d, "g2p_gold_v3").select("word", F.trim(F.split(F.regexp_replace("gold_ipa", r"\[[^\]]*\]", ""), r"\|")[0]).alias("ipa"))
    pool = V.pooled_evidence([("entries", g), ("sheet", table(spark, d, "eval_meta_2026_08_14").where("word IS NOT NULL"))], "word", "ipa")
    return pool.groupBy("word").agg(F.count("*").alias("n"), F.countDistinct("ipa").alias("n_readings"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))

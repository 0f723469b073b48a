"""Queries that route tokens to readings, repair them, and look around them."""

from __future__ import annotations

from pyspark.sql import functions as F

from warpweft.functions import phones as P
from warpweft.functions import predicates as C
from warpweft.functions import text as T
from warpweft.operators import align, evidence, routing, sequences
from warpweft.plans import text_queries, verdict_queries
from warpweft.plans.predicate_queries import _PROMISES
from warpweft.plans.registry import ORACLES, duck_bare, duck_core, duck_key, duck_tokens, duck_words, query
from warpweft.sources.tables import table

_FIRST = "trim(split_part(regexp_replace(gold_ipa, '\\[[^\\]]*\\]', '', 'g'), '|', 1))"
_ENTRY = f"(SELECT {duck_key('word')} AS key, {_FIRST} AS ipa, CASE source WHEN 'native-verified' THEN 0 WHEN 'native-approved' THEN 1 ELSE 2 END AS rank FROM g2p_gold_v3 WHERE word IS NOT NULL AND gold_ipa IS NOT NULL)"
_TYPES = f"(SELECT word, {duck_key('word')} AS key, count(*) AS n FROM (SELECT nfc_normalize(w) AS word FROM (SELECT unnest({duck_words('text_yi_pointed')}) AS w FROM annotations_gold)) GROUP BY word)"
_AGAINST = " OR ".join(f"(regexp_matches(word, '[{l}][{T.MARKS}]*{m}') AND NOT contains(ipa, '{p}'))" for l, m, p in _PROMISES)


def _types(spark, d):
    each = table(spark, d, "annotations_gold").select(F.explode(T.words(F.col("text_yi_pointed"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    typed = each.select(T.composed(F.col("w")).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))
    return typed.withColumn("key", T.lookup_key(F.col("word")))


def _entries(spark, d):
    g = table(spark, d, "g2p_gold_v3").where("word IS NOT NULL AND gold_ipa IS NOT NULL")
    first = F.trim(F.split(F.regexp_replace("gold_ipa", r"\[[^\]]*\]", ""), r"\|")[0])
    return g.select(T.lookup_key(F.col("word")).alias("key"), first.alias("ipa"), "source")


def _tiers(spark, d):
    e = _entries(spark, d)
    unbroken = lambda word, ipa: ~C.contradicted(word, ipa, _PROMISES)
    return [
        routing.Tier("verified", e.where("source = 'native-verified'"), guard=unbroken), routing.Tier("approved", e.where("source = 'native-approved'"), guard=unbroken),
        routing.Tier("other", e.where("source IS NULL OR source NOT IN ('native-verified', 'native-approved')"), "MED", "rule"),
    ]


_ROUTED = f"""(SELECT word, n, key, CASE WHEN hit IS NULL THEN NULL ELSE hit.ipa END AS ipa, CASE hit.rank WHEN 0 THEN 'verified' WHEN 1 THEN 'approved' WHEN 2 THEN 'other' END AS tier, CASE WHEN hit.rank IS NULL THEN 'miss' WHEN hit.rank < 2 THEN 'lexicon' ELSE 'rule' END AS route,
    CASE WHEN hit.rank < 2 THEN 'HIGH' WHEN hit.rank = 2 THEN 'MED' ELSE 'LOW' END AS confidence, coalesce(array_to_string(list_transform(list_sort(list_filter(ranks, lambda r: hit.rank IS NULL OR r < hit.rank)), lambda r: ['verified', 'approved', 'other'][r + 1]), '+'), '') AS rejected FROM (
    SELECT word, n, key, arg_min(struct_pack(ipa := ipa, rank := rank), rank) FILTER (rank IS NOT NULL AND NOT broken) AS hit, list(rank) FILTER (rank IS NOT NULL) AS ranks FROM (SELECT t.word, t.n, t.key, e.rank, e.ipa, e.rank < 2 AND ({_AGAINST}) AS broken FROM {_TYPES} t LEFT JOIN (SELECT key, rank, min(ipa) AS ipa FROM {_ENTRY} GROUP BY key, rank) e USING (key)) GROUP BY word, n, key))"""


@query("routed_types", f"SELECT word, n, ipa, tier, route, confidence, rejected FROM {_ROUTED}")
def routed_types(spark, d):
    """Pointed types with the reading of the first tier whose entry their marks don't rule out, and the tiers passed over."""
    return routing.route(_types(spark, d), "word", "key", _tiers(spark, d)).select("word", "n", "ipa", "tier", "route", "confidence", F.array_join("rejected", "+").alias("rejected"))


_CODES = lambda x: f"regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace({x}, '[V C]', ' ', 'g'), '{P.VOWEL}', 'V', 'g'), '[{P.CONSONANTS}]', 'C', 'g'), '-', ' '), '[^VC ]', '', 'g')"
_SHAPE = f"(regexp_matches({_CODES('ipa')}, 'C{{3,}}') OR len(list_filter(regexp_split_to_array({_CODES('ipa')}, ' +'), lambda w: contains(w, 'C') AND NOT contains(w, 'V'))) > 0)"
_INVENTORY = f"(regexp_replace(ipa, '{P.SYMBOL}|[ˈ -]', '', 'g') <> '')"
_CHECKED = f"""(SELECT *, CASE WHEN ipa IS NULL THEN '' ELSE array_to_string(list_filter([CASE WHEN {_SHAPE} THEN 'shape' END, CASE WHEN {_INVENTORY} THEN 'inventory' END], lambda x: x IS NOT NULL), ',') END AS reason FROM {_ROUTED})"""
_SHEET = f"(SELECT {duck_key('word')} AS key, min(ipa) AS ipa FROM eval_meta_2026_08_14 WHERE word IS NOT NULL AND ipa IS NOT NULL AND tier <> 'question' GROUP BY 1)"
_MODEL = f"(SELECT {duck_key('b')} AS key, min(a) AS ipa FROM (SELECT unnest(i) AS a, unnest(p) AS b FROM (SELECT {duck_words('pointed_yi')} AS p, string_split(regexp_replace(ipa, '[.,!?/;:]', '', 'g'), ' ') AS i FROM stress_tts WHERE ipa IS NOT NULL) WHERE len(p) = len(i)) GROUP BY 1)"


@query(
    "rescued_types",
    f"""SELECT word, CASE WHEN saved THEN coalesce(s.ipa, m.ipa) ELSE x.ipa END AS ipa, CASE WHEN saved THEN 'rule' ELSE bad END AS route, CASE WHEN saved OR bad = 'fallback' THEN 'LOW' ELSE confidence END AS confidence, CASE WHEN saved THEN CASE WHEN s.ipa IS NOT NULL THEN 'sheet' ELSE 'sentences' END ELSE reason END AS reason FROM (
    SELECT c.*, CASE WHEN reason <> '' THEN 'fallback' ELSE route END AS bad, (reason <> '' OR route = 'miss') AND (key IN (SELECT key FROM {_SHEET}) OR key IN (SELECT key FROM {_MODEL})) AS saved FROM {_CHECKED} c) x LEFT JOIN {_SHEET} s USING (key) LEFT JOIN {_MODEL} m USING (key)""",
)
def rescued_types(spark, d):
    """Types after the checks of shape and inventory, and those rescued by readings of the sheet, then of the sentences."""
    from warpweft.operators.decisions import zip_equal

    routed = routing.route(_types(spark, d), "word", "key", _tiers(spark, d))
    checks = [("shape", P.ill_shaped(F.col("ipa"), 2)), ("inventory", F.size(P.violations(F.col("ipa"))) > 0)]
    sheet = table(spark, d, "eval_meta_2026_08_14").where("word IS NOT NULL AND ipa IS NOT NULL AND tier <> 'question'").select(T.lookup_key(F.col("word")).alias("key"), "ipa")
    s = table(spark, d, "stress_tts").where("ipa IS NOT NULL")
    pairs = s.select(F.explode(zip_equal(T.words(F.col("pointed_yi")), F.split(F.regexp_replace("ipa", "[.,!?/;:]", ""), " "))).alias("z")).select(F.col("z.a").alias("w"), F.col("z.b").alias("ipa")).distinct()
    sentences = pairs.select(T.lookup_key(F.col("w")).alias("key"), "ipa")
    out = routing.rescue(routing.post_check(routed, checks), "word", "key", [routing.Tier("sheet", sheet), routing.Tier("sentences", sentences)])
    return out.select("word", "ipa", "route", "confidence", "reason")


@query("fused_tokens", f"SELECT a.ann_id, a.n_tokens - coalesce(m.saved, 0) AS n_units, coalesce(m.n, 0) AS n_phrases FROM (SELECT ann_id, len({duck_tokens('text_yi')}) AS n_tokens FROM annotations_gold) a LEFT JOIN (SELECT ann_id, CAST(sum(n - 1) AS BIGINT) AS saved, count(*) AS n FROM ({ORACLES['phrase_match']}) GROUP BY ann_id) m USING (ann_id) WHERE a.n_tokens > 0")
def fused_tokens(spark, d):
    """Units of each chunk when mined phrases are one unit each, and how many phrases there are."""
    lines = table(spark, d, "annotations_gold").select("ann_id", T.words_or_null(F.col("text_yi")).alias("w"), T.following_words(F.col("text_yi")).alias("f"))
    fused = routing.fused_tokens(lines, "ann_id", "w", "f", text_queries.ngram_mine(spark, d).select("gram"), 3)
    return fused.groupBy("ann_id").agg(F.count("*").alias("n_units"), F.count_if(F.col("n") > 1).alias("n_phrases"))


_SUFFIXES = [("ער", "ɛr"), ("עס", "ɛs"), ("ן", "n"), ("ט", "t"), ("ס", "s")]
_DOUBLE = " OR ".join(f"contains(regexp_replace(ipa, '[ˈ -]', '', 'g'), '{c}{c}')" for c in P.CONSONANTS)


@query(
    "suffix_readings",
    f"""SELECT word, arg_min(affix, rank) AS affix, arg_min(root, rank) AS root, arg_min(ipa, rank) AS ipa FROM (SELECT w.word, a.affix, a.rank, r.key AS root, r.ipa || CASE WHEN a.ipa = 'n' AND regexp_matches(r.ipa, '(?:{P.VOWEL})$') AND NOT ends_with(r.ipa, 'ə') THEN 'ə' ELSE '' END || a.ipa AS ipa
    FROM (SELECT DISTINCT {duck_bare('w')} AS word FROM (SELECT unnest({duck_words('text_yi')}) AS w FROM annotations_gold)) w JOIN (VALUES {', '.join(f"('{a}', {k}, '{i}')" for k, (a, i) in enumerate(_SUFFIXES))}) a(affix, rank, ipa) ON ends_with(w.word, a.affix)
    JOIN (SELECT {duck_bare('word')} AS key, min({_FIRST}) AS ipa FROM g2p_gold_v3 WHERE word IS NOT NULL AND gold_ipa IS NOT NULL GROUP BY 1) r ON r.key = left(w.word, CAST(length(w.word) - length(a.affix) AS BIGINT)) WHERE length(r.key) >= 3 AND regexp_matches(r.ipa, '{P.SYMBOL}')) WHERE NOT ({_DOUBLE}) GROUP BY word""",
)
def suffix_readings(spark, d):
    """Readings of words that are an entry with a suffix: the first in list order whose seam can be spoken."""
    words = table(spark, d, "annotations_gold").select(F.explode(T.words(F.col("text_yi"))).alias("w")).distinct().select(T.strip_marks(F.col("w")).alias("word")).distinct()
    g = table(spark, d, "g2p_gold_v3").where("word IS NOT NULL AND gold_ipa IS NOT NULL")
    roots = g.select(T.strip_marks(F.col("word")).alias("key"), F.trim(F.split(F.regexp_replace("gold_ipa", r"\[[^\]]*\]", ""), r"\|")[0]).alias("ipa"))
    affixes = spark.createDataFrame([(a, k, i) for k, (a, i) in enumerate(_SUFFIXES)], "affix string, rank int, affix_ipa string")
    return routing.affix_readings(words, "word", roots, affixes, False, routing.suffix_joined)


@query("stripped_hits", f"SELECT word, min(n) AS n_stripped FROM (SELECT word, 0 AS n, word AS k FROM v UNION ALL SELECT word, 1, substring(word, 2) FROM v WHERE regexp_matches(word, '^[אבדהולמש]..') UNION ALL SELECT word, 2, substring(word, 3) FROM v WHERE regexp_matches(word, '^[אבדהולמש]{{2}}..')) WHERE k IN (SELECT {duck_bare('word')} FROM g2p_gold_v3 WHERE word IS NOT NULL) GROUP BY word".replace(" v ", f" (SELECT DISTINCT {duck_bare('w')} AS word FROM (SELECT unnest({duck_words('text')}) AS w FROM held_out_items)) v "))
def stripped_hits(spark, d):
    """Words of the held-out texts that are entries as they are or without one or two leading letters, and how many were taken off."""
    words = table(spark, d, "held_out_items").select(F.explode(T.words(F.col("text"))).alias("w")).distinct().select(T.strip_marks(F.col("w")).alias("word")).distinct()
    known = table(spark, d, "g2p_gold_v3").where("word IS NOT NULL").select(T.strip_marks(F.col("word")).alias("k")).distinct()
    each = words.select("word", F.explode(routing.stripped_keys(F.col("word"), list("אבדהולמש"))).alias("k")).withColumn("n", F.length("word") - F.length("k"))
    return each.join(known, "k", "left_semi").groupBy("word").agg(F.min("n").alias("n_stripped"))


@query("clitic_split", f"SELECT clitic, count(*) AS n, count(DISTINCT rest) AS n_rests FROM (SELECT regexp_extract(w, '^([סמכ])[''׳’].+$', 1) AS clitic, regexp_extract(w, '^[סמכ][''׳’](.+)$', 1) AS rest FROM (SELECT unnest({duck_words('text')}) AS w FROM documents)) WHERE clitic <> '' GROUP BY clitic")
def clitic_split(spark, d):
    """Clitics before an apostrophe, how often they occur and before how many words. Split once per type."""
    t = text_queries.corpus_types(spark, d).withColumn("x", routing.split_clitic(F.col("type"), ["ס", "מ", "כ"])).where("x.clitic <> ''")
    return t.groupBy("x.clitic").agg(F.sum("freq").alias("n"), F.countDistinct("x.rest").alias("n_rests"))


_HYPH = f"(SELECT DISTINCT w AS word FROM (SELECT unnest({duck_words('text')}) AS w FROM documents) WHERE contains(w, '-'))"
_PIECES = "(SELECT word, unnest(list_filter(string_split(word, '-'), lambda p: p <> '')) AS part, generate_subscripts(list_filter(string_split(word, '-'), lambda p: p <> ''), 1) AS i FROM h)"


@query(
    "hyphen_readings",
    f"""WITH h AS {_HYPH}, e AS (SELECT key, min(rank) AS rank, arg_min(ipa, (rank, ipa)) AS ipa FROM {_ENTRY} GROUP BY key) SELECT word, CASE WHEN count(*) FILTER (e.ipa IS NULL) = 0 THEN string_agg(e.ipa, '-' ORDER BY i) END AS ipa, CASE WHEN count(*) FILTER (e.ipa IS NULL) > 0 THEN 'fallback' WHEN max(e.rank) < 2 THEN 'lexicon' ELSE 'rule' END AS route,
    CASE WHEN count(*) FILTER (e.ipa IS NULL) > 0 THEN 'LOW' WHEN max(e.rank) = 2 THEN 'MED' ELSE 'HIGH' END AS confidence FROM {_PIECES} p LEFT JOIN e ON e.key = {duck_key('p.part')} GROUP BY word""",
)
def hyphen_readings(spark, d):
    """Words with a hyphen read part by part: the readings joined, the weakest route and confidence."""
    types = text_queries.corpus_types(spark, d).select(F.col("type").alias("word"))
    parts = routing.hyphen_parts(types, "word").withColumn("key", T.lookup_key(F.col("part")))
    e = _entries(spark, d)
    tiers = [routing.Tier("verified", e.where("source = 'native-verified'")), routing.Tier("approved", e.where("source = 'native-approved'")), routing.Tier("other", e.where("source IS NULL OR source NOT IN ('native-verified', 'native-approved')"), "MED", "rule")]
    return routing.combine_parts(routing.route(parts, "part", "key", tiers), "word")


@query(
    "stamp_policy",
    f"""SELECT reason, count(*) AS n, count(DISTINCT target) AS n_targets FROM (SELECT CASE WHEN s THEN NULL WHEN m THEN NULL ELSE coalesce(o, t) END AS target, CASE WHEN s THEN 'suspect' WHEN m THEN 'supervised' WHEN o IS NOT NULL THEN 'observed' WHEN t IS NOT NULL THEN 'type' ELSE 'none' END AS reason
    FROM (SELECT coalesce(e.reason = 'alef-guess', false) AS s, coalesce(route = 'lexicon', false) AS m, CASE WHEN route = 'audio' THEN e.ipa END AS o, g.ipa AS t FROM eval_meta_2026_08_14 e LEFT JOIN (SELECT word, min({_FIRST}) AS ipa FROM g2p_gold_v3 WHERE word IS NOT NULL AND gold_ipa IS NOT NULL GROUP BY word) g USING (word) WHERE e.word_no IS NOT NULL)) GROUP BY reason""",
)
def stamp_policy(spark, d):
    """Words of the sheet by what may be stamped on them: nothing on suspects and on supervised ones, else what was heard, else the entry."""
    g = table(spark, d, "g2p_gold_v3").where("word IS NOT NULL AND gold_ipa IS NOT NULL").groupBy("word").agg(F.min(F.trim(F.split(F.regexp_replace("gold_ipa", r"\[[^\]]*\]", ""), r"\|")[0])).alias("t"))
    e = table(spark, d, "eval_meta_2026_08_14").where("word_no IS NOT NULL").join(g, "word", "left").select("ipa", "route", F.col("reason").alias("why"), "t")
    is_ = lambda c, v: F.coalesce(F.col(c) == v, F.lit(False))
    done = routing.stamp(e, is_("why", "alef-guess"), is_("route", "lexicon"), F.when(F.col("route") == "audio", F.col("ipa")), F.col("t"))
    return done.groupBy("reason").agg(F.count("*").alias("n"), F.countDistinct("target").alias("n_targets"))


_VOTED = f"(SELECT id, slot, CAST(sum(n) AS BIGINT) AS votes, arg_min(heard, struct_pack(m := -n, h := heard)) AS winner, max(n) / sum(n) AS margin FROM (SELECT id, slot, heard, count(*) AS n FROM {verdict_queries._CLIPS} GROUP BY ALL) GROUP BY id, slot)"


@query("unmasked_words", f"SELECT why, count(*) AS n FROM (SELECT CASE WHEN v.winner IS NULL THEN 'no verdict' WHEN w.supervised THEN 'supervised' WHEN v.margin < 0.6 THEN 'margin' WHEN replace(v.winner, 'ˈ', '') <> replace(w.word, 'ˈ', '') THEN 'letters' ELSE 'unmasked' END AS why FROM (SELECT id, i AS slot, l[i] AS word, contains(l[i], 'ˈ') AND i % 2 = 0 AS supervised FROM (SELECT id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT id, string_split(ipa, ' ') AS l FROM {verdict_queries._ITEMS}))) w LEFT JOIN {_VOTED} v USING (id, slot)) GROUP BY why")
def unmasked_words(spark, d):
    """Words of the published readings by whether the votes on that very place may lift their mask."""
    items = verdict_queries._items(spark, d).select("id", F.posexplode(F.split("ipa", " ")).alias("p", "word")).select("id", (F.col("p") + 1).alias("slot"), "word")
    tokens = items.withColumn("supervised", F.contains("word", F.lit(P.STRESS)) & (F.col("slot") % 2 == 0))
    cells = verdict_queries._clips(spark, d).groupBy("id", "slot", "heard").agg(F.count("*").alias("n"))
    per = cells.groupBy("id", "slot").agg(F.min_by("heard", F.struct(-F.col("n"), F.col("heard"))).alias("winner"), (F.max("n") / F.sum("n")).alias("margin"))
    verdicts = per.join(items, ["id", "slot"])
    done = routing.unmasked(tokens, verdicts, ["id", "slot"], "word", lambda c: F.replace(c, F.lit(P.STRESS), F.lit("")), 0.6)
    return done.groupBy("why").agg(F.count("*").alias("n"))


@query("retagged_lines", f"SELECT reverted, count(*) AS n_lines, CAST(sum(n_changed) AS BIGINT) AS n_changed FROM (SELECT ann_id, bool_or({duck_bare('new')} <> {duck_bare('old')}) AS reverted, CASE WHEN bool_or({duck_bare('new')} <> {duck_bare('old')}) THEN 0 ELSE count(*) FILTER (new <> old) END AS n_changed FROM (SELECT ann_id, w AS old, coalesce(t.target, w) AS new FROM (SELECT ann_id, unnest({duck_words('text_yi')}) AS w FROM annotations_gold) x LEFT JOIN (SELECT {duck_bare('f')} AS k, min(f) AS target FROM (SELECT unnest({duck_words('text_yi_pointed')}) AS f FROM annotations_gold) WHERE length(f) < 12 GROUP BY 1) t ON t.k = {duck_bare('x.w')}) GROUP BY ann_id) GROUP BY reverted")
def retagged_lines(spark, d):
    """Chunks pointed anew by a table of forms: how many words change, and how many chunks keep their own because letters would change."""
    forms = table(spark, d, "annotations_gold").select(F.explode(T.words(F.col("text_yi_pointed"))).alias("target")).distinct().where(F.length("target") < 12)
    held = forms.withColumn("k", T.strip_marks(F.col("target")))
    tokens = table(spark, d, "annotations_gold").select("ann_id", F.posexplode(T.words(F.col("text_yi"))).alias("pos", "w")).withColumn("k", T.strip_marks(F.col("w")))
    done = routing.retagged_lines(tokens, "ann_id", "pos", "k", "w", held, T.strip_marks)
    return done.groupBy("reverted").agg(F.count("*").alias("n_lines"), F.sum("n_changed").alias("n_changed"))


_CTX = f"(SELECT ann_id, generate_subscripts(w, 1) AS p, w, unnest(w) AS word FROM (SELECT ann_id, {duck_words('text_yi')} AS w FROM annotations_gold))"


@query("hit_contexts", f"SELECT ann_id, CAST(p AS INTEGER) AS ordinal, array_to_string(w[greatest(p - 5, 1):p - 1], ' ') AS before, array_to_string(w[p + 1:p + 5], ' ') AS after FROM {_CTX} WHERE word IN (SELECT word FROM g2p_gold_v3 WHERE layer = 'L')")
def hit_contexts(spark, d):
    """Five words on either side of each word of a layer, with its ordinal among words, tokens of signs only not counted."""
    a = table(spark, d, "annotations_gold").select("ann_id", T.words(F.col("text_yi")).alias("w"))
    each = a.select("ann_id", "w", F.posexplode("w").alias("p", "word"))
    wanted = table(spark, d, "g2p_gold_v3").where("layer = 'L' AND word IS NOT NULL").select("word").distinct()
    hit = each.join(wanted, "word", "left_semi")
    before, after = sequences.around(F.col("w"), F.col("p"), 5)
    return hit.select("ann_id", (F.col("p") + 1).alias("ordinal"), F.array_join(before, " ").alias("before"), F.array_join(after, " ").alias("after"))


@query("target_and_control", f"SELECT CASE WHEN expected IN (SELECT {_FIRST} FROM g2p_gold_v3 WHERE layer = 'L') THEN 'target' ELSE 'control' END AS part, count(*) AS n_words, CAST(sum(len(a)) AS BIGINT) AS n_phones, CAST(sum(len(list_filter(range(1, len(a) + 1), lambda i: a[i] = b[i]))) AS BIGINT) AS n_equal FROM {verdict_queries._PHONED} WHERE len(a) = len(b) GROUP BY 1")
def target_and_control(spark, d):
    """Phones on which votes and published readings agree, for words of one layer and for all others beside them."""
    target = table(spark, d, "g2p_gold_v3").where("layer = 'L' AND gold_ipa IS NOT NULL").select(F.trim(F.split(F.regexp_replace("gold_ipa", r"\[[^\]]*\]", ""), r"\|")[0]).alias("expected"), F.lit("target").alias("t")).distinct()
    c = verdict_queries._phoned(spark, d).where("size(a) = size(b)").join(target, "expected", "left")
    equal = F.size(F.filter(F.zip_with("a", "b", lambda x, y: x == y), lambda z: z))
    return c.groupBy(F.coalesce("t", F.lit("control")).alias("part")).agg(F.count("*").alias("n_words"), F.sum(F.size("a")).alias("n_phones"), F.sum(equal).alias("n_equal"))


@query("first_shape", "SELECT count(*) AS n_kept, count(DISTINCT id) AS n_ids FROM (SELECT v.id, len(string_split(v.ipa, ' ')) AS shape, f.shape AS first FROM stress_votes v JOIN (SELECT id, arg_min(len(string_split(ipa, ' ')), (voted_at, vote_id)) AS shape FROM stress_votes WHERE ipa IS NOT NULL GROUP BY id) f USING (id) WHERE ipa IS NOT NULL) WHERE shape = first")
def first_shape(spark, d):
    """Votes with as many words as the first vote on their item; later ones of another shape are left out."""
    v = table(spark, d, "stress_votes").where("ipa IS NOT NULL").select("id", "voted_at", "vote_id", F.size(F.split("ipa", " ")).alias("shape"))
    return routing.first_shape(v, "id", "shape", ["voted_at", "vote_id"]).agg(F.count("*").alias("n_kept"), F.countDistinct("id").alias("n_ids"))


@query("first_lines", "SELECT split, count(*) AS n FROM (SELECT arg_min(split, row_id) AS split FROM yiexample WHERE text IS NOT NULL GROUP BY text) GROUP BY split")
def first_lines(spark, d):
    """Lines of each split when equal lines are kept once, the first by id."""
    y = table(spark, d, "yiexample").where("text IS NOT NULL").groupBy("text").agg(F.min_by("split", "row_id").alias("split"))
    return y.groupBy("split").agg(F.count("*").alias("n"))


@query("tagged_cache", "SELECT source, episode, arg_max(row_id, (built_at, row_id)) AS row_id FROM yiexample WHERE split = 'train' AND episode IS NOT NULL GROUP BY source, episode")
def tagged_cache(spark, d):
    """The record written last for each key of a cache, of one tag."""
    y = table(spark, d, "yiexample").where("split = 'train' AND episode IS NOT NULL").select("source", "episode", "row_id", "built_at")
    return evidence.latest(y, ["source", "episode"], [F.col("built_at"), F.col("row_id")]).select("source", "episode", "row_id")


@query("wanted_jobs", "SELECT count(*) AS n FROM runpod_whisper_sample r WHERE EXISTS (SELECT 1 FROM annotations_gold a WHERE a.episode = r.episode AND a.chunk_idx = r.chunk_idx)")
def wanted_jobs(spark, d):
    """Transcripts of chunks that are wanted, those with a gold annotation: a semi-join, so no annotation multiplies them."""
    wanted = table(spark, d, "annotations_gold").select("episode", "chunk_idx")
    return table(spark, d, "runpod_whisper_sample").join(wanted, ["episode", "chunk_idx"], "left_semi").agg(F.count("*").alias("n"))


@query("index_scan", f"SELECT key, total FROM ({ORACLES['ngram_index']}) WHERE n = 1 AND total >= 5")
def index_scan(spark, d):
    """Single keys of the index that occur five times or more."""
    return text_queries.ngram_index(spark, d).where("n = 1 AND total >= 5").select("key", "total")


_PRE = "translate(nfc_normalize(text_yi), '\"', '')"


@query("preprocessed_lines", f"SELECT ann_id, regexp_replace(regexp_replace(regexp_replace({_PRE.replace('nfc_normalize(text_yi)', 'translate(nfc_normalize(text_yi), ' + chr(39) + T.DASHES + T.APOSTROPHES + T.QUOTES + chr(39) + ', ' + chr(39) + '-' * len(T.DASHES) + chr(39) * 2 * len(T.APOSTROPHES) + chr(34) * len(T.QUOTES) + chr(39) + ')')}, '(^|[^\\p{{L}}\\p{{M}}''])ס''איז([^\\p{{L}}\\p{{M}}'']|$)', '\\1עס איז\\2', 'g'), '[0-9]+', '#', 'g'), 'קג', 'ק-ג', 'g') AS line FROM annotations_gold WHERE text_yi IS NOT NULL")
def preprocessed_lines(spark, d):
    """Chunks made ready for reading: quotes dropped, a contraction written out, numbers and a cluster replaced."""
    a = table(spark, d, "annotations_gold").where("text_yi IS NOT NULL")
    return a.select("ann_id", T.preprocessed(F.col("text_yi"), [("ס'איז", "עס איז")], [], [("[0-9]+", "#"), ("קג", "ק-ג")]).alias("line"))


@query("spelling_candidates", "SELECT word, array_to_string(list_filter(list_distinct([replace(word, 'יי', 'ײַ'), replace(word, 'וו', 'װ')]), lambda x: x <> word), ',') AS candidates FROM (SELECT DISTINCT word FROM g2p_gold_v3 WHERE regexp_matches(word, 'יי') <> regexp_matches(word, 'וו'))")
def spelling_candidates(spark, d):
    """Other spellings to be asked about, for entries that one of two swaps changes."""
    g = table(spark, d, "g2p_gold_v3").where(F.contains("word", F.lit("יי")) != F.contains("word", F.lit("וו"))).select("word").distinct()
    return g.select("word", F.array_join(T.spelling_candidates(F.col("word"), [("יי", "ײַ"), ("וו", "װ")]), ",").alias("candidates"))


@query("word_ownership", None)
def word_ownership(spark, d):
    """How much of each word of the published readings the votes have, when lines are aligned as a whole: words by share of matched phones, in tenths."""
    s = verdict_queries._items(spark, d).select("id", F.transform(F.split("ipa", " "), P.phones).alias("w"))
    v = table(spark, d, "stress_votes").where("ipa IS NOT NULL").select("id", "vote_id", P.phones(F.col("ipa")).alias("h")).where("size(h) > 0")
    own = align.word_ownership(s.join(v, "id").select("vote_id", "w", "h"), ["vote_id"], "w", "h", P.VOWELS).where("size(expected) > 0")
    return own.groupBy(F.floor(10 * F.col("n_match") / F.size("expected")).cast("int").alias("tenths")).agg(F.count("*").alias("n"))


@query("window_choice", None)
def window_choice(spark, d):
    """Which of two models' readings fits the window of each vote around a contested word, and how many are decided."""
    pairs = verdict_queries._variants(spark, d)
    s = verdict_queries._items(spark, d).select("id", F.transform(F.split("ipa", " "), P.phones).alias("w"))
    v = table(spark, d, "stress_votes").where("ipa IS NOT NULL").select("id", "vote_id", P.phones(F.col("ipa")).alias("h")).where("size(h) > 0")
    own = align.word_ownership(s.join(v, "id").select("id", "vote_id", "w", "h"), ["id", "vote_id"], "w", "h", P.VOWELS)
    hits = own.withColumn("slot", F.col("word") + 1).drop("word").join(pairs.select("id", "slot"), ["id", "slot"]).join(v.select("vote_id", "h"), "vote_id")
    hits = hits.select("vote_id", F.concat_ws(".", "id", "slot").alias("word"), align.window(F.col("h"), F.col("first_heard"), F.col("last_heard")).alias("win")).where("win IS NOT NULL")
    cands = pairs.select(F.concat_ws(".", "id", "slot").alias("word"), F.explode(F.array("flash", "pro")).alias("reading")).withColumn("phones", P.phones(F.col("reading"))).distinct()
    done = align.choose_in_windows(hits, ["vote_id"], "word", "win", cands, P.VOWELS)
    return done.groupBy("decision").agg(F.count("*").alias("n"))


@query("matching_blocks", None)
def matching_blocks(spark, d):
    """Words of each transcript that its second version has in the same order, found by longest blocks first, summed by model."""
    r = table(spark, d, "runpod_whisper_sample").select("asr_id", "model", T.words(F.col("text_whisper")).alias("a"), T.words(F.col("text_whisper_novad")).alias("b"))
    done = align.matching_blocks(r, "a", "b")
    same = F.aggregate("blocks", F.lit(0), lambda acc, x: acc + x["size"])
    return done.groupBy("model").agg(F.count("*").alias("n"), F.sum(same).alias("n_same"), F.sum(F.size("a")).alias("n_words"))

"""Queries over votes, tiers, confusions, sequences, samples and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from warpweft.functions import phones as P
from warpweft.functions import text as T
from warpweft.operators import align, cover, evidence, scoring, sequences
from warpweft.plans.registry import duck_key, duck_words, query
from warpweft.sources.tables import table

#: Tiers of the entry table by who vouches for an entry, best first; any other source comes last.
TIERS = ["native-verified", "native-approved"]
_TIER = "CASE source WHEN 'native-verified' THEN 0 WHEN 'native-approved' THEN 1 ELSE 2 END"
_FIRST = "list_filter(list_transform(string_split(regexp_replace(gold_ipa, '\\[[^\\]]*\\]', '', 'g'), '|'), lambda x: trim(x)), lambda x: x <> '')[1]"


def _tiers(spark, d):
    g = table(spark, d, "g2p_gold_v3").where("gold_ipa IS NOT NULL AND word IS NOT NULL")
    tier = F.when(F.col("source") == TIERS[0], 0).when(F.col("source") == TIERS[1], 1).otherwise(2)
    return g.select(T.lookup_key(F.col("word")).alias("key"), tier.alias("tier"), F.get(P.variants(F.col("gold_ipa")), F.lit(0)).alias("ipa"), "rank")


@query(
    "authority_lookup",
    f"""WITH t AS (SELECT w AS type, count(*) AS freq FROM (SELECT unnest({duck_words('text')}) AS w FROM documents) GROUP BY w), g AS (SELECT {duck_key('word')} AS key, min(struct_pack(tier := {_TIER}, ipa := {_FIRST})) AS hit
    FROM g2p_gold_v3 WHERE gold_ipa IS NOT NULL AND word IS NOT NULL GROUP BY 1)
    SELECT t.type, t.freq, {duck_key('t.type')} AS key, g.hit.ipa AS ipa, CAST(g.hit.tier AS INTEGER) AS tier FROM t LEFT JOIN g ON g.key = {duck_key('t.type')}""",
)
def authority_lookup(spark, d):
    """Each corpus type with the reading of the first tier that has its key. Keys are made once per type."""
    from warpweft.plans.text_queries import corpus_types

    types = corpus_types(spark, d).withColumn("key", T.lookup_key(F.col("type")))
    return evidence.first_hit(types, _tiers(spark, d), "key", "tier", "ipa").select("type", "freq", "key", "ipa", "tier")


@query(
    "authority_invariant",
    f"""SELECT count(*) AS n_changed FROM (SELECT {duck_key('word')} AS key, min(struct_pack(tier := {_TIER}, ipa := {_FIRST})) AS every FROM g2p_gold_v3 WHERE gold_ipa IS NOT NULL AND word IS NOT NULL GROUP BY 1) a
    JOIN (SELECT {duck_key('word')} AS key, min(struct_pack(tier := {_TIER}, ipa := {_FIRST})) AS top FROM g2p_gold_v3 WHERE gold_ipa IS NOT NULL AND word IS NOT NULL AND {_TIER} < 2 GROUP BY 1) b USING (key) WHERE every <> top""",
)
def authority_invariant(spark, d):
    """Keys whose answer from the upper tiers changes when the lowest is added: none."""
    tiers = _tiers(spark, d)
    upper = tiers.where("tier < 2").groupBy("key").agg(F.min(F.struct("tier", "ipa")).alias("top"))
    every = tiers.groupBy("key").agg(F.min(F.struct("tier", "ipa")).alias("every"))
    return upper.join(every, "key").agg(F.count_if(F.col("top") != F.col("every")).alias("n_changed"))


@query("gold_conflicts", f"SELECT key, count(DISTINCT ipa) AS n_readings, count(*) AS n_rows, arg_max(ipa, rank) AS last_ipa FROM (SELECT {duck_key('word')} AS key, {_FIRST} AS ipa, rank FROM g2p_gold_v3 WHERE gold_ipa IS NOT NULL AND word IS NOT NULL) WHERE ipa IS NOT NULL GROUP BY key HAVING count(DISTINCT ipa) > 1")
def gold_conflicts(spark, d):
    """Keys with more than one primary reading, and the one written last."""
    g = _tiers(spark, d).where("ipa IS NOT NULL").groupBy("key").agg(F.countDistinct("ipa").alias("n_readings"), F.count("*").alias("n_rows"), F.max_by("ipa", "rank").alias("last_ipa"))
    return g.where("n_readings > 1")


_DAY = "CAST(ts AS DATE)"


def _day():
    """Pieces into which a user's events are cut, so that no task sorts all events of a busy user."""
    return F.to_date("ts")


@query("resume_antijoin", f"SELECT event_id, user_id, {_DAY} AS day FROM events e WHERE NOT EXISTS (SELECT 1 FROM events x WHERE x.event_type = 'error' AND x.user_id = e.user_id AND CAST(x.ts AS DATE) = CAST(e.ts AS DATE))")
def resume_antijoin(spark, d):
    """Events of users and days that aren't done; done are the days on which a user met an error."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"))
    return evidence.not_yet(e, e.where("event_type = 'error'"), ["user_id", "day"]).select("event_id", "user_id", "day")


@query(
    "latest_record",
    "SELECT episode, chunk_idx, arg_max(ann_id, struct_pack(t := loaded_at, i := ann_id)) AS ann_id, max(loaded_at) AS loaded_at FROM annotations_gold WHERE episode IS NOT NULL GROUP BY episode, chunk_idx",
)
def latest_record(spark, d):
    """The annotation of each chunk that was loaded last."""
    a = table(spark, d, "annotations_gold").where("episode IS NOT NULL").select("episode", "chunk_idx", "ann_id", "loaded_at")
    return evidence.latest(a, ["episode", "chunk_idx"], [F.col("loaded_at"), F.col("ann_id")])


@query(
    "target_union",
    f"""SELECT word, CASE min(r) WHEN 0 THEN 'entries' WHEN 1 THEN 'gold' ELSE 'held out' END AS group_name FROM (SELECT word, 0 AS r FROM g2p_gold_v3 WHERE word IS NOT NULL UNION ALL
    SELECT unnest({duck_words('text_yi')}), 1 FROM annotations_gold UNION ALL SELECT unnest({duck_words('text')}), 2 FROM held_out_items) GROUP BY word""",
)
def target_union(spark, d):
    """Words of three lists, each in the first that has it."""
    listed = lambda t, c: table(spark, d, t).select(F.explode(T.words(F.col(c))).alias("word")).distinct()
    return evidence.first_group([("entries", table(spark, d, "g2p_gold_v3").where("word IS NOT NULL").select("word")), ("gold", listed("annotations_gold", "text_yi")), ("held out", listed("held_out_items", "text"))], "word")


_STEPS = "(SELECT user_id, event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)"


def _steps(spark, d):
    """Each event with the next of the same user: an expected and an observed symbol."""
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    placed = sequences.in_blocks(e, ["user_id"], ["ts", "event_id"], _day(), value="event_type").where("before IS NOT NULL")
    return placed.select("user_id", F.col("before.v").alias("a"), F.col("event_type").alias("b"))


@query("share_of_total", f"SELECT a, b, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY a), 6) AS share FROM {_STEPS} WHERE b IS NOT NULL GROUP BY a, b")
def share_of_total(spark, d):
    """How often each event follows each other, and its share."""
    return evidence.shares(_steps(spark, d).groupBy("a", "b").agg(F.count("*").alias("n")), ["a", "b"], ["a"])


@query("base_rate", f"SELECT a, b, n, round((n + 0.5) / (sum(n) OVER (PARTITION BY a) + 0.5 * count(*) OVER (PARTITION BY a)), 6) AS rate FROM (SELECT a, b, count(*) AS n FROM {_STEPS} WHERE b IS NOT NULL GROUP BY a, b)")
def base_rate(spark, d):
    """Smoothed rate of each confusion."""
    from warpweft.functions import stats

    cells = _steps(spark, d).groupBy("a", "b").agg(F.count("*").alias("n"))
    total = cells.groupBy("a").agg(F.sum("n").alias("t"), F.count("*").alias("m"))
    return cells.join(total, "a").select("a", "b", "n", F.round(stats.smoothed_rate(F.col("n"), F.col("t"), F.col("m")), 6).alias("rate"))


_CELLS = f"(SELECT user_id, a, b, count(*) AS n FROM {_STEPS} WHERE b IS NOT NULL GROUP BY ALL)"
_VERDICTS = f"""(WITH c AS {_CELLS}, pool AS (SELECT a, b, sum(n) AS k_all FROM c GROUP BY a, b), base AS (SELECT a, b, (k_all + 0.5) / (sum(k_all) OVER (PARTITION BY a) + 0.5 * count(*) OVER (PARTITION BY a)) AS base FROM pool),
    per AS (SELECT user_id, a, CAST(sum(n) AS BIGINT) AS n, arg_min(b, struct_pack(m := -n, b := b)) AS modal, max(n) AS k FROM c GROUP BY user_id, a)
    SELECT user_id, per.a AS a, modal, k, n, base, (SELECT least(1.0, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(base) + (n - i) * ln(1 - base)))) FROM (SELECT unnest(range(k, n + 1)) AS i)) AS p
    FROM per JOIN base ON base.a = per.a AND base.b = per.modal WHERE n >= 4 AND modal <> per.a)"""


@query("calibrated_verdicts", f"SELECT user_id, a, modal, k, n, round(base, 6) AS base, round(p, 6) AS p, CASE WHEN round(p, 6) < 0.002 THEN 'FOLD' ELSE 'bias-explained' END AS verdict FROM {_VERDICTS}")
def calibrated_verdicts(spark, d):
    """Users whose usual next event is more than the general habit."""
    cells = _steps(spark, d).groupBy("user_id", "a", "b").agg(F.count("*").alias("n"))
    return evidence.calibrated(cells, "user_id", "a", "b")


@query("binomial_tail", f"SELECT user_id, a, round(p, 6) AS p FROM {_VERDICTS}")
def binomial_tail(spark, d):
    return calibrated_verdicts(spark, d).select("user_id", "a", "p")


_LAST = "(SELECT id, rater, arg_max(ipa, struct_pack(t := voted_at, v := vote_id)) AS ipa FROM stress_votes WHERE rater IS NOT NULL GROUP BY id, rater)"


def _last_votes(spark, d):
    v = table(spark, d, "stress_votes").where("rater IS NOT NULL AND ipa IS NOT NULL").select("id", "rater", "ipa", "voted_at", "vote_id")
    return evidence.latest(v, ["id", "rater"], [F.col("voted_at"), F.col("vote_id")]).select("id", "rater", "ipa")


_LASTN = _LAST.replace("rater IS NOT NULL", "rater IS NOT NULL AND ipa IS NOT NULL")


@query(
    "promotion_rule",
    f"""SELECT id, decided, winner, round(top / decided, 6) AS share, CASE WHEN decided < 3 THEN 'few votes' WHEN top / decided < 0.75 THEN 'no majority' ELSE 'promoted' END AS reason FROM
    (SELECT id, CAST(sum(n) AS BIGINT) AS decided, arg_min(ipa, struct_pack(m := -n, i := ipa)) AS winner, max(n) AS top FROM (SELECT id, ipa, count(*) AS n FROM {_LASTN} GROUP BY id, ipa) GROUP BY id)""",
)
def promotion_rule(spark, d):
    """Readings promoted by three decided votes and a share of three quarters."""
    return evidence.promote(_last_votes(spark, d), "id", "ipa")


@query(
    "slot_votes",
    f"""WITH s AS (SELECT DISTINCT id, ipa FROM stress_tts), v AS (SELECT id, ipa AS heard FROM {_LASTN}), x AS (SELECT v.id, generate_subscripts(e, 1) - 1 AS slot, unnest(e) AS expected, unnest(h) AS heard FROM
    (SELECT v.id, string_split(s.ipa, ' ') AS e, string_split(v.heard, ' ') AS h FROM v JOIN s USING (id)) v WHERE len(e) = len(h)), c AS (SELECT id, slot, expected, heard, count(*) AS n FROM x GROUP BY ALL)
    SELECT id, CAST(slot AS INTEGER) AS slot, expected, CAST(sum(n) AS BIGINT) AS votes, CAST(coalesce(sum(n) FILTER (heard = expected), 0) AS BIGINT) AS same, arg_min(heard, struct_pack(m := -n, h := heard)) AS modal,
    CASE WHEN sum(n) < 3 THEN 'thin' WHEN coalesce(sum(n) FILTER (heard = expected), 0) >= 2 / 3 * sum(n) THEN 'CONFIRMED' WHEN max(n) >= 2 / 3 * sum(n) AND arg_min(heard, struct_pack(m := -n, h := heard)) <> expected THEN 'FLIP' ELSE 'contested' END AS verdict
    FROM c GROUP BY id, slot, expected""",
)
def slot_votes(spark, d):
    """Verdict on each word of a published reading, from readings with equally many words."""
    s = table(spark, d, "stress_tts").select("id", F.split("ipa", " ").alias("e")).distinct()
    v = _last_votes(spark, d).select("id", F.split("ipa", " ").alias("h"))
    each = s.join(v, "id").where("size(e) = size(h)").select("id", F.posexplode(F.arrays_zip("e", "h")).alias("slot", "z")).select("id", "slot", F.col("z.e").alias("expected"), F.col("z.h").alias("heard"))
    return evidence.slot_verdicts(each, ["id", "slot"], "expected", "heard")


@query("collapse_repeats", "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type")
def collapse_repeats(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    return sequences.collapse_repeats(e, ["user_id"], ["ts", "event_id"], "event_type", _day()).select("user_id", "event_id", "event_type")


def _runs(flag: str, least: int) -> str:
    return f"""(SELECT user_id, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n FROM (SELECT user_id, pos, pos - row_number() OVER (PARTITION BY user_id ORDER BY pos) AS run FROM
    (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events) WHERE {flag}) GROUP BY user_id, run HAVING count(*) >= {least})"""


@query("clean_spans", f"SELECT user_id, CAST(first_pos AS INTEGER) AS first_pos, CAST(last_pos AS INTEGER) AS last_pos, n FROM {_runs('event_type <> ' + chr(39) + 'error' + chr(39), 4)}")
def clean_spans(spark, d):
    """Longest runs without an error, of four events or more."""
    e = table(spark, d, "events")
    return sequences.islands(e, ["user_id"], ["ts", "event_id"], F.col("event_type") != "error", _day()).where("n >= 4")


@query(
    "islands_quoted_share",
    f"SELECT u.user_id, CAST(coalesce(sum(r.n), 0) AS BIGINT) AS n_inside, u.n AS n_all, round(coalesce(sum(r.n), 0) / u.n, 6) AS share FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) u LEFT JOIN {_runs('event_type = ' + chr(39) + 'click' + chr(39), 3)} r USING (user_id) GROUP BY u.user_id, u.n",
)
def islands_quoted_share(spark, d):
    """Share of a user's events inside runs of three clicks or more."""
    e = table(spark, d, "events")
    inside = sequences.islands(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "click", _day()).where("n >= 3").groupBy("user_id").agg(F.sum("n").alias("n_inside"))
    every = e.groupBy("user_id").agg(F.count("*").alias("n_all")).join(inside, "user_id", "left")
    n = F.coalesce("n_inside", F.lit(0))
    return every.select("user_id", n.alias("n_inside"), "n_all", F.round(n / F.col("n_all"), 6).alias("share"))


@query(
    "round_robin_pick",
    """SELECT word, episode, sentence, word_no, CAST(pick AS INTEGER) AS pick FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY turn, episode, sentence, word_no) AS pick FROM
    (SELECT *, row_number() OVER (PARTITION BY word, episode ORDER BY sentence, word_no) AS turn FROM (SELECT DISTINCT word, episode, sentence, word_no FROM eval_meta_2026_08_14 WHERE word IS NOT NULL AND episode IS NOT NULL AND word_no IS NOT NULL)) WHERE turn <= 4) WHERE pick <= 4""",
)
def round_robin_pick(spark, d):
    """Up to four places of each word, from different episodes first."""
    e = table(spark, d, "eval_meta_2026_08_14").where("word IS NOT NULL AND episode IS NOT NULL AND word_no IS NOT NULL").select("word", "episode", "sentence", "word_no").distinct()
    return sequences.round_robin(e, "word", "episode", ["sentence", "word_no"], 4).select("word", "episode", "sentence", "word_no", "pick")


@query(
    "arrival_pick",
    """SELECT word, sentence, word_no, CAST(pick AS INTEGER) AS pick FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY turn, sentence, word_no) AS pick FROM
    (SELECT *, row_number() OVER (PARTITION BY word, episode ORDER BY sentence, word_no) AS turn FROM (SELECT DISTINCT word, episode, sentence, word_no FROM eval_meta_2026_08_14 WHERE word IS NOT NULL AND episode IS NOT NULL AND word_no IS NOT NULL)) WHERE turn <= 3) WHERE pick <= 3""",
)
def arrival_pick(spark, d):
    """Up to three places of each word, from different episodes first, episodes as they come."""
    e = table(spark, d, "eval_meta_2026_08_14").where("word IS NOT NULL AND episode IS NOT NULL AND word_no IS NOT NULL").select("word", "episode", "sentence", "word_no").distinct()
    return sequences.round_robin(e, "word", "episode", ["sentence", "word_no"], 3, arrival=True).select("word", "sentence", "word_no", "pick")


@query("stratified_sample", "SELECT doc_id, source, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('42' || doc_id), doc_id) AS rank FROM documents) WHERE rank <= 10")
def stratified_sample(spark, d):
    """Ten documents per source in hash order."""
    return sequences.stratified(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 10).select("doc_id", "source", "rank")


@query("group_split", "SELECT doc_id, source, CASE WHEN h < 58982 THEN 'train' WHEN h < 62259 THEN 'val' ELSE 'test' END AS split_name FROM (SELECT doc_id, source, CAST('0x' || substring(md5('42' || coalesce(source, '')), 1, 4) AS INTEGER) AS h FROM documents)")
def group_split(spark, d):
    """Splits by source: 90, 5 and 5 in a hundred of the hash range."""
    return sequences.group_split(table(spark, d, "documents").select("doc_id", "source"), "source", [("train", 58982), ("val", 62259), ("test", 65536)])


_TRUE = f"(SELECT word, min({_FIRST}) AS hit FROM g2p_gold_v3 WHERE gold_ipa IS NOT NULL AND word IS NOT NULL GROUP BY word)"
_WRONG = f"(SELECT tier, route, confidence, e.ipa IS NULL OR e.ipa <> g.hit AS wrong FROM eval_meta_2026_08_14 e JOIN {_TRUE} g USING (word) WHERE word_no IS NOT NULL)"


@query(
    "wer_grouping_sets",
    f"""SELECT CASE WHEN grouping(tier) = 0 THEN 'tier' WHEN grouping(route) = 0 THEN 'route' WHEN grouping(confidence) = 0 THEN 'confidence' ELSE 'all' END AS dimension,
    CASE WHEN grouping(tier) = 0 THEN coalesce(tier, '') WHEN grouping(route) = 0 THEN coalesce(route, '') WHEN grouping(confidence) = 0 THEN coalesce(confidence, '') ELSE '' END AS value,
    count(*) AS n, count(*) FILTER (wrong) AS n_wrong, round(count(*) FILTER (wrong) / count(*), 6) AS rate FROM {_WRONG} GROUP BY GROUPING SETS ((tier), (route), (confidence), ())""",
)
def wer_grouping_sets(spark, d):
    """Words read otherwise than their entry, by tier, route and confidence and in all."""
    e = table(spark, d, "eval_meta_2026_08_14")
    g = table(spark, d, "g2p_gold_v3").where("gold_ipa IS NOT NULL AND word IS NOT NULL").groupBy("word").agg(F.min(F.get(P.variants(F.col("gold_ipa")), F.lit(0))).alias("hit"))
    j = e.where("word_no IS NOT NULL").join(g, "word")
    return scoring.rates_by(j, F.col("ipa").isNull() | (F.col("ipa") != F.col("hit")), ["tier", "route", "confidence"])


def _ascii_sql(column: str) -> str:
    """Phones as ASCII letters, other characters dropped, so that an edit distance of bytes counts phones."""
    codes = [chr(0xE000 + k) for k in range(len(P.ASCII_ORDER))]
    for code, symbol in zip(codes, P.ASCII_ORDER):
        column = f"replace({column}, '{symbol}', '{code}')"
    return f"translate(regexp_replace({column}, '[^{codes[0]}-{codes[-1]}]', '', 'g'), '{''.join(codes)}', '{P.ASCII_LETTERS}')"


_STRESSED = lambda c: f"CASE WHEN contains({c}, 'ˈ') THEN len(regexp_extract_all(split_part({c}, 'ˈ', 1), '{P.VOWEL}')) + 1 END"


@query(
    "phone_error_rate",
    f"""SELECT model, count(*) AS n_pairs, CAST(sum(e) AS BIGINT) AS edits, CAST(sum(n) AS BIGINT) AS symbols, round(sum(e) / sum(n), 6) AS rate, count(*) FILTER (e = 0) AS n_same, count(*) FILTER (e = 0 AND a IS DISTINCT FROM b) AS n_stress_wrong FROM (SELECT model, levenshtein(r, x) AS e, length(r) AS n, a, b FROM (SELECT model, {_ascii_sql('ipa')} AS r, {_ascii_sql('h')} AS x, {_STRESSED('ipa')} AS a, {_STRESSED('h')} AS b
    FROM (SELECT ipa, unnest(['flash', 'pro']) AS model, unnest([ipa_flash, ipa_pro]) AS h FROM stress_tts WHERE ipa IS NOT NULL) WHERE h IS NOT NULL)) GROUP BY model""",
)
def phone_error_rate(spark, d):
    """Edits per phone of the two models' readings against the published one, and stress apart where the phones are equal."""
    s = table(spark, d, "stress_tts")
    each = s.select(F.col("ipa").alias("ref"), F.explode(F.array(F.struct(F.lit("flash").alias("model"), F.col("ipa_flash").alias("h")), F.struct(F.lit("pro").alias("model"), F.col("ipa_pro").alias("h")))).alias("x")).where("x.h IS NOT NULL AND ref IS NOT NULL")
    rows = each.select("ref", F.col("x.model").alias("model"), F.col("x.h").alias("h"))
    stress = lambda c: P.stressed_nucleus(F.col(c))
    return scoring.readings_scored(rows, P.ascii_phones(F.col("ref")), P.ascii_phones(F.col("h")), stress("ref"), stress("h"), ["model"])


@query("char_accuracy", "SELECT split, count(*) AS n_rows, CAST(sum(len(marks)) AS BIGINT) AS n_chars, CAST(sum(len(list_filter(marks, lambda m: m IS NOT NULL))) AS BIGINT) AS n_supervised, round(sum(len(list_filter(marks, lambda m: m IS NOT NULL))) / sum(len(marks)), 6) AS share FROM yiexample WHERE marks IS NOT NULL GROUP BY split")
def char_accuracy(spark, d):
    """Supervised characters per split."""
    y = table(spark, d, "yiexample").where("marks IS NOT NULL")
    sup = F.size(F.filter("marks", lambda m: m.isNotNull()))
    return y.groupBy("split").agg(F.count("*").alias("n_rows"), F.sum(F.size("marks")).alias("n_chars"), F.sum(sup).alias("n_supervised"), F.round(F.sum(sup) / F.sum(F.size("marks")), 6).alias("share"))


_ARG = "CAST(list_position(embedding[{a}:{b}], list_max(embedding[{a}:{b}])) - 1 AS INTEGER)"


@query("vector_argmax", f"SELECT vec_id, {_ARG.format(a=1, b=24)} AS first_head, {_ARG.format(a=25, b=28)} AS second_head, {_ARG.format(a=29, b=64)} AS third_head FROM embeddings")
def vector_argmax(spark, d):
    """Greatest element of three parts of each vector, as of three output heads."""
    return scoring.vector_argmax(table(spark, d, "embeddings"), "embedding", [("first_head", 0, 24), ("second_head", 24, 4), ("third_head", 28, 36)]).select("vec_id", "first_head", "second_head", "third_head")


_ALL = "CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER)"


@query("confusion_matrix", f"SELECT label, head, n, round(n / sum(n) OVER (PARTITION BY label), 6) AS share FROM (SELECT label, {_ALL} AS head, count(*) AS n FROM embeddings GROUP BY ALL)")
def confusion_matrix(spark, d):
    """Labels by the greatest element of the whole vector, with its share of the label."""
    cells = scoring.vector_argmax(table(spark, d, "embeddings"), "embedding", [("head", 0, 64)]).groupBy("label", "head").agg(F.count("*").alias("n"))
    return evidence.shares(cells, ["label", "head"], ["label"])


@query(
    "dataset_gates",
    """SELECT 'mask length' AS gate, count(*) AS violations, count(*) = 0 AS passed FROM yiexample WHERE marks IS NOT NULL AND len(marks) <> length(text) UNION ALL
    SELECT 'unique id', count(*), count(*) = 0 FROM (SELECT row_id FROM yiexample GROUP BY row_id HAVING count(*) > 1) UNION ALL
    SELECT 'equal text across splits', count(*), count(*) = 0 FROM (SELECT text FROM yiexample GROUP BY text HAVING count(DISTINCT split) > 1) UNION ALL
    SELECT 'episode in two splits', count(*), count(*) = 0 FROM (SELECT episode FROM yiexample WHERE episode <> '' GROUP BY episode HAVING count(DISTINCT split) > 1) UNION ALL
    SELECT 'marks among letters', count(*), count(*) = 0 FROM yiexample WHERE regexp_matches(text, '\\p{Mn}') UNION ALL SELECT 'blank text', count(*), count(*) = 0 FROM yiexample WHERE text IS NULL OR trim(text) = '' UNION ALL
    SELECT 'supervised count', count(*), count(*) = 0 FROM yiexample WHERE n_supervised < 0 OR n_supervised > length(text)""",
)
def dataset_gates(spark, d):
    """Checks a training table must pass, with the number of rows that don't."""
    y = table(spark, d, "yiexample")
    letters = F.length("text")
    return scoring.gates([
        ("mask length", y.where(F.col("marks").isNotNull() & (F.size("marks") != letters))),
        ("unique id", y.groupBy("row_id").count().where("count > 1")),
        ("equal text across splits", y.groupBy("text").agg(F.countDistinct("split").alias("n")).where("n > 1")),
        ("episode in two splits", y.where("episode <> ''").groupBy("episode").agg(F.countDistinct("split").alias("n")).where("n > 1")),
        ("marks among letters", y.where(F.col("text").rlike(r"\p{Mn}"))), ("blank text", y.where(F.col("text").isNull() | (F.trim("text") == ""))),
        ("supervised count", y.where((F.col("n_supervised") < 0) | (F.col("n_supervised") > letters))),
    ])


@query(
    "multiset_pairs",
    "SELECT id, list_sort(string_split(ipa_flash, '')) = list_sort(string_split(ipa_pro, '')) AS same_letters, ipa_flash = ipa_pro AS same FROM (SELECT DISTINCT id, ipa_flash, ipa_pro FROM stress_tts) WHERE ipa_flash IS NOT NULL AND ipa_pro IS NOT NULL",
)
def multiset_pairs(spark, d):
    """Whether the two models' readings have the same characters, in any order."""
    s = table(spark, d, "stress_tts").select("id", "ipa_flash", "ipa_pro").distinct().where("ipa_flash IS NOT NULL AND ipa_pro IS NOT NULL")
    return s.select("id", evidence.same_multiset(F.split("ipa_flash", ""), F.split("ipa_pro", "")).alias("same_letters"), (F.col("ipa_flash") == F.col("ipa_pro")).alias("same"))


@query("nw_alignment", None)
def nw_alignment(spark, d):
    """What each model heard opposite each phone of the other: counts over all aligned pairs."""
    s = table(spark, d, "stress_tts").select("id", P.phones(F.col("ipa_flash")).alias("a"), P.phones(F.col("ipa_pro")).alias("b")).where("size(a) > 0 AND size(b) > 0").distinct()
    aligned = align.align_distinct(s.select("id", F.col("a").alias("x"), F.col("b").alias("y")), "x", "y", P.VOWELS)
    return align.heard_at(aligned, ["id"], "x", "y").groupBy("expected", "heard").agg(F.count("*").alias("n"))


def _cover_sql(steps: int) -> str:
    """Step after step: gains of all chunks without the words shown before, the best of them, its words."""
    sql = f"WITH v AS (SELECT DISTINCT ann_id, unnest({duck_words('text_yi')}) AS w FROM annotations_gold), t AS (SELECT w, count(*) AS n FROM (SELECT unnest({duck_words('text')}) AS w FROM documents) GROUP BY w), x0 AS (SELECT ann_id, w, n FROM v JOIN t USING (w))"
    for k in range(1, steps + 1):
        sql += f", b{k} AS (SELECT ann_id, sum(n) AS gain FROM x{k - 1} GROUP BY ann_id ORDER BY gain DESC, ann_id LIMIT 1), x{k} AS (SELECT * FROM x{k - 1} WHERE w NOT IN (SELECT w FROM x{k - 1} WHERE ann_id = (SELECT ann_id FROM b{k})))"
    return sql + " " + " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS step, ann_id, CAST(gain AS DOUBLE) AS gain FROM b{k}" for k in range(1, steps + 1))


def _cover_rows(spark, d):
    from warpweft.plans.text_queries import corpus_types

    rows = table(spark, d, "annotations_gold").select("ann_id", F.array_distinct(T.words(F.col("text_yi"))).alias("values"))
    return rows, corpus_types(spark, d).select(F.col("type").alias("value"), F.col("freq").cast("double").alias("weight"))


@query("greedy_cover", _cover_sql(10))
def greedy_cover(spark, d):
    """The ten gold chunks that together show most of the corpus: words weigh what they occur."""
    rows, weights = _cover_rows(spark, d)
    return cover.greedy_cover(rows, "ann_id", "values", weights, 10)


@query("cover_by_need", "SELECT true AS falling, true AS within")
def cover_by_need(spark, d):
    """Forty chunks that show each word up to three times: whether gains fall from step to step, as they must, and add up to no more than three times all weights."""
    rows, weights = _cover_rows(spark, d)
    picks = cover.greedy_cover(rows, "ann_id", "values", weights, 40, need=3)
    pairs = picks.alias("a").join(picks.alias("b"), F.col("a.step") + 1 == F.col("b.step"), "left")
    falling = pairs.agg(F.coalesce(F.bool_and(F.coalesce(F.col("b.gain") <= F.col("a.gain"), F.lit(True))), F.lit(True)).alias("falling"), F.coalesce(F.sum("a.gain"), F.lit(0.0)).alias("all"))
    return falling.select("falling", (F.col("all") <= 3 * weights.agg(F.coalesce(F.sum("weight"), F.lit(0.0))).scalar()).alias("within"))


_KEYS = f"(SELECT DISTINCT ann_id, unnest({duck_words('text_yi')}) AS w FROM annotations_gold)"


@query("one_pass_cover", f"WITH RECURSIVE o AS (SELECT ann_id, list(w) AS ws, row_number() OVER (ORDER BY count(*) DESC, ann_id) AS r FROM {_KEYS} WHERE w IN (SELECT word FROM g2p_gold_v3 WHERE word IS NOT NULL) GROUP BY ann_id), s(r, seen, ann_id, gain) AS (SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST(NULL AS VARCHAR), 0 UNION ALL SELECT o.r, list_distinct(list_concat(s.seen, o.ws)), o.ann_id, len(list_filter(o.ws, lambda w: NOT list_contains(s.seen, w))) FROM s JOIN o ON o.r = s.r + 1), p AS (SELECT *, row_number() OVER (ORDER BY r) AS step FROM s WHERE gain > 0) SELECT CAST(step AS INTEGER) AS step, ann_id, CAST(gain AS DOUBLE) AS gain FROM p WHERE step <= 25")
def one_pass_cover(spark, d):
    """The first chunks, by how many entries they have, that each show an entry not shown before."""
    rows, _ = _cover_rows(spark, d)
    targets = table(spark, d, "g2p_gold_v3").where("word IS NOT NULL").select(F.col("word").alias("value"))
    return cover.one_pass_cover(rows, "ann_id", "values", targets, 25)


@query("stream_resume", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_resume(spark, d):
    """The event table read as a stream, each event once, appended to a pool, and counted: equals the batch counts."""
    from warpweft.plans.session import work_folder
    from warpweft.streaming import pool

    base = work_folder(spark, "pool")
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    pool.append_new(pool.read_pool(spark, f"{d}/events.parquet*", schema), ["event_id"], f"{base}/data", f"{base}/log")
    return spark.read.schema(schema).parquet(f"{base}/data").groupBy("event_type").agg(F.count("*").alias("n"))


@query("stream_verdicts", "SELECT user_id, CASE WHEN n < 3 THEN 'thin' WHEN same >= 2 / 3 * n THEN 'CONFIRMED' WHEN top >= 2 / 3 * n AND modal <> 'view' THEN 'FLIP' ELSE 'contested' END AS verdict FROM (SELECT user_id, sum(n) AS n, coalesce(sum(n) FILTER (event_type = 'view'), 0) AS same, max(n) AS top, arg_min(event_type, struct_pack(m := -n, e := event_type)) AS modal FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id)")
def stream_verdicts(spark, d):
    """Verdict on the usual event of each user as events come in as a stream; the last one written equals the batch verdict."""
    from warpweft.plans.session import work_folder
    from warpweft.streaming import pool

    base = work_folder(spark, "verdicts")
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    votes = pool.read_pool(spark, f"{d}/events.parquet*", schema).select("user_id", F.lit("view").alias("expected"), "event_type")
    pool.running_verdicts(votes, ["user_id"], "expected", "event_type", f"{base}/data", f"{base}/log")
    changes = spark.read.parquet(f"{base}/data")
    return changes.groupBy("user_id").agg(F.max_by("verdict", "batch").alias("verdict"))

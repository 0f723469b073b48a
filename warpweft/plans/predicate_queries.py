"""Queries over predicates of tokens and lines, validators, and sources with structure inside a column."""

from __future__ import annotations

from pyspark.sql import functions as F

from warpweft.functions import predicates as C
from warpweft.functions import phones as P
from warpweft.functions import text as T
from warpweft.operators import sampling as S
from warpweft.operators import sequences
from warpweft.plans import text_queries
from warpweft.plans.registry import ORACLES, duck_bare, duck_key, duck_words, query
from warpweft.sources import tables as IO
from warpweft.sources.tables import spread, table

#: What tells words of one origin by their spelling; a caller's list.
ORIGIN = C.Origin("[חת]|שׂ|כּ", ("ות",), "אויעײױװ")
_POINT, _MARK = T.POINTS, T.MARKS
_W = "(SELECT DISTINCT nfc_normalize(word) AS word FROM g2p_gold_v3 WHERE word IS NOT NULL)"
_ENDS = "ends_with(bare, 'ות')"
_MARKED = f"(regexp_matches(word, '{ORIGIN.markers}') OR {_ENDS})"
_NV, _NL = "length(regexp_replace(bare, '[^אויעײױװ]', '', 'g'))", "length(regexp_replace(bare, '[^א-ת]', '', 'g'))"
_ORIGIN = f"({_MARKED} OR ({_NV} = 0 AND {_NL} >= 2))"
_SELF = f"regexp_matches(word, '[{_POINT}]')"
_OPEN_ALEF = f"regexp_matches(word, 'א[ּֽֿׁׂׅ֑ׄ-֯]*([^{_MARK}]|$)')"
_OPEN_PE = f"regexp_matches(word, '[פף][ְ-ׇֻֽׁׂׅ֑ׄ-֯]*([^{_MARK}]|$)')"


@query(
    "origin_flags",
    f"SELECT word, {_ORIGIN} AS of_origin, {_SELF} AS own_points, CASE WHEN {_SELF} THEN {_MARKED} ELSE {_ORIGIN} END AS root_of_origin, {_OPEN_ALEF} AS open_alef, {_OPEN_PE} AS open_pe, CASE WHEN {_ORIGIN} THEN 'L' ELSE 'G' END AS layer FROM (SELECT word, {duck_bare('word')} AS bare FROM {_W})",
)
def origin_flags(spark, d):
    """Entries by what their spelling tells: origin, own points, letters whose reading is open, and the layer guessed from it."""
    w = table(spark, d, "g2p_gold_v3").where("word IS NOT NULL").select(T.composed(F.col("word")).alias("word")).distinct()
    c = F.col("word")
    return w.select("word", C.of_origin(c, ORIGIN).alias("of_origin"), C.own_points(c).alias("own_points"), C.root_of_origin(c, ORIGIN).alias("root_of_origin"), C.lacks_mark(c, "א", T.POINTS).alias("open_alef"), C.lacks_mark(c, "פף", "ּֿ").alias("open_pe"), F.when(C.of_origin(c, ORIGIN), "L").otherwise("G").alias("layer"))


_PROMISES = [("פף", "ּ", "p"), ("פף", "ֿ", "f")]
_FORMS = f"(SELECT DISTINCT nfc_normalize(w) AS w FROM (SELECT unnest({duck_words('text_yi_pointed')}) AS w FROM annotations_gold))"
_BROKEN = " OR ".join(f"(regexp_matches(w, '[{l}][{_MARK}]*{m}') AND NOT contains(ipa, '{p}'))" for l, m, p in _PROMISES)


@query("contradicted_lookups", f"SELECT w AS word, ipa, {_BROKEN} AS contradicted, regexp_matches(w, '[{_POINT}]') OR g.ipa IS NOT NULL AS has_evidence FROM {_FORMS} f JOIN (SELECT {duck_key('word')} AS key, min(trim(split_part(gold_ipa, '|', 1))) AS ipa FROM g2p_gold_v3 WHERE gold_ipa IS NOT NULL AND word IS NOT NULL GROUP BY 1) g ON g.key = {duck_key('f.w')}")
def contradicted_lookups(spark, d):
    """Pointed words and the reading of their bare key, by whether a written mark rules it out."""
    g = table(spark, d, "g2p_gold_v3").where("gold_ipa IS NOT NULL AND word IS NOT NULL").groupBy(T.lookup_key(F.col("word")).alias("key")).agg(F.min(F.trim(F.split("gold_ipa", r"\|")[0])).alias("ipa"))
    f = table(spark, d, "annotations_gold").select(F.explode(T.words(F.col("text_yi_pointed"))).alias("w")).distinct().select(T.composed(F.col("w")).alias("word")).distinct()
    j = f.withColumn("key", T.lookup_key(F.col("word"))).join(g, "key")
    return j.select("word", "ipa", C.contradicted(F.col("word"), F.col("ipa"), _PROMISES).alias("contradicted"), (C.own_points(F.col("word")) | F.col("ipa").isNotNull()).alias("has_evidence"))


_SQ = lambda x: f"trim(regexp_replace(coalesce({x}, ''), '[ \\t\\n\\r]+', ' ', 'g'))"
_T, _P = _SQ("text_yi"), _SQ("text_yi_pointed")
_SAME = "len(list_filter(range(1, len(t) + 1), lambda i: tb[i] = pb[i]))"


@query(
    "row_reasons",
    f"""SELECT ann_id, CASE WHEN ts = '' OR ps = '' THEN 'empty' WHEN len(t) <> len(p) THEN 'token_count' WHEN {_SAME} / len(t) < 0.9 THEN 'word_mismatch' WHEN {_NL.replace('bare', 'pr')} = 0 THEN 'no_letters'
    WHEN length(regexp_replace(pr, '[^{_MARK}]', '', 'g')) < 0.15 * {_NL.replace('bare', 'pr')} THEN 'no_marks' ELSE 'ok' END AS reason FROM (SELECT *, string_split(ts, ' ') AS t, string_split(ps, ' ') AS p, list_transform(string_split(ts, ' '), lambda x: {duck_bare('x')}) AS tb, list_transform(string_split(ps, ' '), lambda x: {duck_bare('x')}) AS pb
    FROM (SELECT ann_id, coalesce(text_yi_pointed, '') AS pr, {_T} AS ts, {_P} AS ps FROM annotations_gold))""",
)
def row_reasons(spark, d):
    """Chunks by the first check of text and pointed text that they fail."""
    return table(spark, d, "annotations_gold").select("ann_id", C.row_reason(F.col("text_yi"), F.col("text_yi_pointed")).alias("reason"))


_DIFF = f"{_SQ(duck_bare(chr(112) + 'r'))} <> {_SQ(duck_bare('tr'))}"


@query(
    "pointed_problems",
    f"""SELECT ann_id, CASE WHEN {_SQ('pr')} = '' THEN 'empty' ELSE array_to_string(list_concat(list_filter([CASE WHEN {_DIFF} THEN 'letters' END, CASE WHEN NOT regexp_matches(pr, '[{_MARK}]') THEN 'no_marks' END], lambda x: x IS NOT NULL),
    list_transform(list_filter(string_split({_SQ('pr')}, ' '), lambda w: regexp_matches(w, '^[א-ת]{{4,}}$')), lambda w: 'bare:' || w)), ',') END AS problems FROM (SELECT ann_id, coalesce(text_yi, '') AS tr, coalesce(text_yi_pointed, '') AS pr FROM annotations_gold)""",
)
def pointed_problems(spark, d):
    """All problems of each pointed chunk: changed letters, no marks, long words left bare."""
    return table(spark, d, "annotations_gold").select("ann_id", F.array_join(C.pointed_problems(F.col("text_yi"), F.col("text_yi_pointed")), ",").alias("problems"))


_PLAIN = "regexp_replace(i, '[.,!?;:''\"]', '', 'g')"
_PARTS = f"list_filter(regexp_split_to_array({_PLAIN}, '[ -]'), lambda w: w <> '')"
_NN = f"len(regexp_extract_all(w, '{P.VOWEL}'))"
_NS = "len(regexp_extract_all(w, 'ˈ'))"


@query(
    "reading_problems",
    f"""SELECT ann_id, CASE WHEN {_SQ('pr')} = '' OR {_SQ('i')} = '' THEN 'empty' ELSE array_to_string(list_filter([CASE WHEN {_DIFF} THEN 'letters' END, CASE WHEN len(string_split({_SQ('pr')}, ' ')) <> len(string_split({_SQ('i')}, ' ')) THEN 'token_count' END, CASE WHEN regexp_matches(i, '[א-ת]') THEN 'script' END,
    CASE WHEN regexp_replace({_PLAIN}, '{P.SYMBOL}|[ˈ -]', '', 'g') <> '' THEN 'inventory' END, CASE WHEN len(list_filter({_PARTS}, lambda w: ({_NN} >= 2 AND {_NS} <> 1) OR ({_NN} <= 1 AND {_NS} > 1))) > 0 THEN 'stress' END], lambda x: x IS NOT NULL), ',') END AS problems
    FROM (SELECT ann_id, coalesce(text_yi, '') AS tr, coalesce(text_yi_pointed, '') AS pr, coalesce(ipa, '') AS i FROM annotations_gold)""",
)
def reading_problems(spark, d):
    """All problems of each pointed and read chunk: letters, token counts, script, inventory, stress."""
    a = table(spark, d, "annotations_gold")
    return a.select("ann_id", F.array_join(C.reading_problems(F.col("text_yi"), F.col("text_yi_pointed"), F.col("ipa")), ",").alias("problems"))


_DENS = f"{_NV} / greatest({_NL}, 1)"


@query(
    "origin_scores",
    f"""SELECT word, CASE WHEN word IN (SELECT word FROM g2p_gold_v3 WHERE layer = 'L') THEN 1.0::DOUBLE WHEN {_NL} < 2 THEN 0.0 ELSE round(greatest(0.0::DOUBLE, CASE WHEN contains(word, '"') THEN 1.0 ELSE 0 END + CASE WHEN regexp_matches(bare, '[חת]') THEN 0.6 ELSE 0 END + CASE WHEN {_NV} = 0 THEN 0.6 ELSE 0 END
    + CASE WHEN {_NV} > 0 AND {_DENS} < 0.25 THEN 0.4 ELSE 0 END + CASE WHEN {_NV} > 0 AND {_DENS} >= 0.25 AND {_DENS} < 0.34 THEN 0.15 ELSE 0 END + CASE WHEN ends_with(bare, 'ות') OR ends_with(bare, 'ים') THEN 0.2 ELSE 0 END - CASE WHEN regexp_matches(bare, 'וו|יי|ער$|ען$') THEN 0.35 ELSE 0 END
    - CASE WHEN starts_with(bare, 'גע') THEN 0.3 ELSE 0 END), 6) END AS score FROM (SELECT word, {duck_bare('word')} AS bare FROM (SELECT DISTINCT unnest({duck_words('text_yi')}) AS word FROM annotations_gold))""",
)
def origin_scores(spark, d):
    """Words of the gold chunks by a sum of weights for signs of one origin; words of its layer are certain."""
    w = table(spark, d, "annotations_gold").select(F.explode(T.words(F.col("text_yi"))).alias("word")).distinct()
    sure = table(spark, d, "g2p_gold_v3").where("layer = 'L' AND word IS NOT NULL").select("word", F.lit(True).alias("sure")).distinct()
    j = w.join(sure, "word", "left").withColumn("bare", T.strip_marks(F.col("word")))
    b = F.col("bare")
    nv, nl = C.share_of(b, ORIGIN.vowels), C.share_of(b, C.LETTERS)
    density = nv / F.greatest(nl, F.lit(1))
    parts = [(1.0, F.contains("word", F.lit('"'))), (0.6, b.rlike("[חת]")), (0.6, nv == 0), (0.4, (nv > 0) & (density < 0.25)), (0.15, (nv > 0) & (density >= 0.25) & (density < 0.34)), (0.2, b.endswith("ות") | b.endswith("ים")), (-0.35, b.rlike("וו|יי|ער$|ען$")), (-0.3, b.startswith("גע"))]
    score = F.when(F.col("sure"), 1.0).when(nl < 2, 0.0).otherwise(C.additive_score(F.col("word"), parts))
    return j.select("word", score.alias("score"))


_LINE = "(SELECT DISTINCT sentence, word_no, word, ipa, confidence, reason FROM eval_meta_2026_08_14 WHERE word_no IS NOT NULL)"


@query(
    "sentence_tiers",
    f"""SELECT sentence, CAST(n AS BIGINT) AS n, CASE WHEN hard / n >= 0.3 THEN 'C' WHEN open / n >= 0.45 THEN 'B' WHEN low / n <= 0.35 THEN 'A' END AS tier FROM (SELECT sentence, count(*) AS n, count(*) FILTER (regexp_matches(w.word, '^[א-ת]')) AS n_words, count(*) FILTER (coalesce(f.freq, 0) < 2) AS rare, count(*) FILTER (ipa IS NULL) AS unread,
    count(*) FILTER (confidence IN ('LOW', 'MED')) AS low, count(*) FILTER (confidence IN ('LOW', 'MED') AND reason IN ('alef-guess', 'ambiguous-vowel')) AS open, count(*) FILTER (reason = 'loan-shape') AS hard FROM {_LINE} w LEFT JOIN (SELECT word, count(*) AS freq FROM {_LINE} GROUP BY word) f ON f.word = w.word GROUP BY sentence)
    WHERE n BETWEEN 4 AND 16 AND n_words >= 0.9 * n AND rare = 0 AND unread = 0 AND (hard / n >= 0.3 OR open / n >= 0.45 OR low / n <= 0.35)""",
)
def sentence_tiers(spark, d):
    """Sentences fit for a test sheet, with their tier: of the right length, without rare or unread words."""
    e = table(spark, d, "eval_meta_2026_08_14").where("word_no IS NOT NULL").select("sentence", "word_no", "word", "ipa", "confidence", "reason").distinct()
    freq = e.where("word IS NOT NULL").groupBy("word").agg(F.count("*").alias("freq"))
    rows = e.join(freq, "word", "left")
    low = F.coalesce(F.col("confidence").isin("LOW", "MED"), F.lit(False))
    flags = {"low": low, "open": low & F.coalesce(F.col("reason").isin("alef-guess", "ambiguous-vowel"), F.lit(False)), "hard": F.coalesce(F.col("reason") == "loan-shape", F.lit(False))}
    return S.sentence_tiers(rows, "sentence", F.coalesce(F.col("word").rlike("^[א-ת]"), F.lit(False)), F.coalesce("freq", F.lit(0)), F.col("ipa").isNull(), flags, [("C", "hard", ">=", 0.3), ("B", "open", ">=", 0.45), ("A", "low", "<=", 0.35)], length=(4, 16), least_freq=2).select("sentence", "n", "tier")


@query(
    "review_batch",
    f"""SELECT row_number() OVER (ORDER BY freq DESC, word) AS place, word, freq FROM (SELECT word, max(freq) AS freq FROM (SELECT w AS word, count(*) AS freq FROM (SELECT unnest({duck_words('text_yi')}) AS w FROM annotations_gold) GROUP BY w UNION ALL
    SELECT w, count(*) FROM (SELECT unnest({duck_words('text')}) AS w FROM yiexample) GROUP BY w) GROUP BY word) WHERE regexp_matches(word, '^[א-ת'']+$') AND length(word) <= 22 AND word NOT IN (SELECT word FROM g2p_gold_v3 WHERE word IS NOT NULL)
    AND {duck_bare('word')} NOT IN (SELECT {duck_bare('word')} FROM g2p_gold_v3 WHERE word IS NOT NULL) AND {duck_key('word')} NOT IN (SELECT {duck_key('word')} FROM g2p_gold_v3 WHERE word IS NOT NULL) ORDER BY place LIMIT 200""",
)
def review_batch(spark, d):
    """The two hundred commonest clean words that no entry has under any of three spellings, by their greater count in two tables."""
    count = lambda t, c: spread(table(spark, d, t).select(c)).select(F.explode(T.words(F.col(c))).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))
    words = count("annotations_gold", "text_yi").unionByName(count("yiexample", "text")).groupBy("word").agg(F.max("freq").alias("freq"))
    clean = words.where(F.col("word").rlike("^[א-ת']+$") & (F.length("word") <= 22))
    known = table(spark, d, "g2p_gold_v3").where("word IS NOT NULL").select("word")
    left = S.unknown_under(clean, known, "word", [lambda w: w, T.strip_marks, T.lookup_key])
    return S.numbered(left, ["freq desc", "word"], 200, "place").select("place", "word", "freq")


@query(
    "origin_phrases",
    f"""WITH e AS (SELECT DISTINCT {duck_bare('word')} AS word FROM g2p_gold_v3 WHERE layer = 'L'), m AS ({ORACLES['ngram_mine']}), o AS (SELECT word, {_ORIGIN} AS yes FROM (SELECT DISTINCT w AS word, {duck_bare('w')} AS bare FROM (SELECT unnest(string_split(gram, ' ')) AS w FROM m)))
    SELECT gram, count, bool_or(o.yes OR o.word IN (SELECT word FROM e)) OR replace(gram, ' ', '-') IN (SELECT word FROM e) AS of_origin FROM (SELECT gram, count, unnest(string_split(gram, ' ')) AS p FROM m WHERE count >= 60) x JOIN o ON o.word = x.p GROUP BY gram, count""",
)
def origin_phrases(spark, d):
    """Frequent phrases and whether a part of them, or the whole as one word, is of the origin."""
    phrases = text_queries.ngram_mine(spark, d).where("count >= 60").select("gram", "count")
    known = table(spark, d, "g2p_gold_v3").where("layer = 'L' AND word IS NOT NULL").select(T.strip_marks(F.col("word")).alias("w"), F.lit(True).alias("k")).distinct()
    parts = phrases.select("gram", F.explode(F.split("gram", " ")).alias("w"))
    told = parts.select("w").distinct().join(known, "w", "left").select("w", (C.of_origin(F.col("w"), ORIGIN) | F.col("k").isNotNull()).alias("yes"))
    some = parts.join(told, "w").groupBy("gram").agg(F.bool_or("yes").alias("some"))
    whole = phrases.withColumn("w", F.translate("gram", " ", "-")).join(known, "w", "left")
    return whole.join(some, "gram").select("gram", "count", (F.col("some") | F.col("k").isNotNull()).alias("of_origin"))


@query("targets_by_reason", "SELECT word, count(*) AS n, CASE WHEN bool_or(contains(reason, 'clitic')) THEN 'clitic' WHEN bool_or(contains(reason, 'loan')) THEN 'loan' ELSE 'other' END AS target FROM eval_meta_2026_08_14 WHERE reason IS NOT NULL AND word IS NOT NULL GROUP BY word")
def targets_by_reason(spark, d):
    """Words with a reason, by the first class in a list of preference that one of their reasons names."""
    e = table(spark, d, "eval_meta_2026_08_14").where("reason IS NOT NULL AND word IS NOT NULL")
    has = lambda x: F.bool_or(F.contains("reason", F.lit(x)))
    per = e.groupBy("word").agg(F.count("*").alias("n"), has("clitic").alias("c"), has("loan").alias("l"))
    return per.select("word", "n", T.first_reason([("clitic", F.col("c")), ("loan", F.col("l"))], "other").alias("target"))


@query("reply_rows", "SELECT rank, word, CASE WHEN source = 'auto' THEN NULL ELSE layer END AS flag, CAST(source = 'auto' AS BOOLEAN) AS ambiguous, CASE WHEN source = 'auto' THEN layer END AS alt FROM g2p_gold_v3 WHERE word IS NOT NULL AND layer IS NOT NULL AND source IS NOT NULL AND NOT regexp_matches(word, '[\\t\\r\\n]')")
def reply_rows(spark, d):
    """Rows of a reply in tab-separated text with fences and foreign lines, matched to what was asked by number; the third cell is a flag or another reading."""
    g = table(spark, d, "g2p_gold_v3").where("word IS NOT NULL AND layer IS NOT NULL AND source IS NOT NULL").where(~F.col("word").rlike("[\t\r\n]"))
    line = F.concat_ws("\t", F.col("rank").cast("string"), "word", F.when(F.col("source") == "auto", F.concat(F.lit("AMBIG:"), F.col("layer"))).otherwise(F.col("layer")))
    replies = g.select((F.col("rank") % 7).alias("batch"), F.concat(F.lit("```\nnot a row\n"), line, F.lit("\n99999999\tx\ty\n```")).alias("reply"))
    asked = g.select("rank", F.col("word").alias("asked"))
    rows = IO.matched_replies(replies, "reply", ["rank", "word", "cell"], asked.select(F.col("rank").cast("string").alias("rank")), "rank")
    return IO.flagged(rows, "cell", "AMBIG").select(F.col("rank").cast("int").alias("rank"), "word", F.when(~F.col("ambiguous"), F.col("cell")).alias("flag"), "ambiguous", "alt")


@query("json_strings", "SELECT episode, count(*) AS n_strings, CAST(sum(length(s)) AS BIGINT) AS n_chars FROM (SELECT episode, unnest([text_yi, text_yi_pointed, ipa, 'v1']) AS s FROM annotations_gold) WHERE episode IS NOT NULL AND trim(s) <> '' GROUP BY episode")
def json_strings(spark, d):
    """Strings at any depth of a JSON column, by label: the chunks of each episode written as nested JSON and read back."""
    a = table(spark, d, "annotations_gold").where("episode IS NOT NULL")
    part = lambda t, p, i, n: F.struct(t.alias("t"), F.array(p).alias("p"), F.struct(i.alias("i"), F.lit(n).alias("n")).alias("s"))
    rows = F.array(part(F.col("text_yi"), F.col("text_yi_pointed"), F.col("ipa"), 1), part(F.lit("v1"), F.lit(" "), F.lit(""), 2))
    nested = F.to_json(F.struct(F.struct(rows.alias("rows")).alias("versions")))
    segments = IO.segments(a.select("episode", nested.alias("json")), "episode", "json")
    return segments.groupBy("episode").agg(F.count("*").alias("n_strings"), F.sum(F.length("segment")).alias("n_chars"))


@query("markup_records", "SELECT episode AS id, min(feed) AS title, max(trim(regexp_replace(regexp_replace(coalesce(guest, ''), '[<>]', '', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))) AS guest FROM episode_meta WHERE episode IS NOT NULL AND feed IS NOT NULL GROUP BY episode")
def markup_records(spark, d):
    """Records cut out of markup by three patterns, joined by id; the first occurrence of an id counts, a missing part is empty."""
    m = table(spark, d, "episode_meta").where("episode IS NOT NULL AND feed IS NOT NULL").select("episode", "feed", F.coalesce("guest", F.lit("")).alias("guest")).distinct()
    block = F.concat(F.lit('<div data-id="'), F.col("episode"), F.lit('"><h2>'), F.col("feed"), F.lit("</h2>"), F.when(F.col("guest") != "", F.concat(F.lit("<span>"), F.regexp_replace("guest", "[<>]", ""), F.lit("</span>"))).otherwise(""), F.lit("</div>"))
    pages = m.groupBy(F.substring("episode", 1, 4).alias("page")).agg(F.array_join(F.array_sort(F.collect_list(block)), "\n").alias("markup"))
    return IO.markup_records(pages, "markup", r'<div data-id="([^"]*)">', {"title": "<h2>([^<]*)</h2>", "guest": "<span>([^<]*)</span>"}).groupBy("id").agg(F.min("title").alias("title"), F.max("guest").alias("guest"))


@query("reading_candidates", f"SELECT word, count(*) AS n_candidates FROM (SELECT DISTINCT word, regexp_replace(ipa, '[^{''.join(sorted(set(''.join(P.VOWELS) + P.CONSONANTS)))}]', '', 'g') AS sound FROM (SELECT word, ipa FROM eval_meta_2026_08_14 UNION ALL SELECT word, trim(split_part(gold_ipa, '|', 1)) FROM g2p_gold_v3) WHERE word IS NOT NULL AND ipa IS NOT NULL) GROUP BY word HAVING count(*) >= 2")
def reading_candidates(spark, d):
    """Words with two candidates or more that sound unlike, equal sounds counted once."""
    e = table(spark, d, "eval_meta_2026_08_14").select("word", "ipa").unionByName(table(spark, d, "g2p_gold_v3").select("word", F.trim(F.split("gold_ipa", r"\|")[0]).alias("ipa")))
    return S.distinct_candidates(e.where("word IS NOT NULL AND ipa IS NOT NULL"), "word", F.array_join(P.phones(F.col("ipa")), "")).select("word", "n_candidates")


@query("validated_map", f"SELECT bare, pointed FROM (SELECT {duck_bare('pointed')} AS bare, pointed FROM (SELECT DISTINCT nfc_normalize(w) AS pointed FROM (SELECT unnest({duck_words('text_yi_pointed')}) AS w FROM annotations_gold))) WHERE bare IN (SELECT word FROM g2p_gold_v3) AND bare NOT IN (SELECT word FROM (SELECT DISTINCT word, ipa FROM eval_meta_2026_08_14 WHERE ipa IS NOT NULL AND word IS NOT NULL) GROUP BY word HAVING count(*) > 1)")
def validated_map(spark, d):
    """Pointed forms of entries, kept only where the marks strip back to the key, contested words left out."""
    pairs = table(spark, d, "annotations_gold").select(F.explode(T.words(F.col("text_yi_pointed"))).alias("w")).distinct().select(T.composed(F.col("w")).alias("pointed")).distinct()
    keys = table(spark, d, "g2p_gold_v3").where("word IS NOT NULL").select(F.col("word").alias("bare")).distinct()
    contested = table(spark, d, "eval_meta_2026_08_14").where("ipa IS NOT NULL AND word IS NOT NULL").groupBy(F.col("word").alias("bare")).agg(F.countDistinct("ipa").alias("n")).where("n > 1")
    rows = pairs.withColumn("bare", T.strip_marks(F.col("pointed"))).join(keys, "bare")
    return IO.self_validating(rows, "bare", "pointed", T.strip_marks, contested).select("bare", "pointed")


@query("book_tokens", "SELECT ann_id, len(list_filter(regexp_split_to_array(regexp_replace(nfc_normalize(text_yi_pointed), '[֑-֯]|<[^<>]*>', '', 'g'), '[\\s־׀|-]+'), lambda t: regexp_matches(t, '[א-תװ-ײ]'))) AS n_tokens FROM annotations_gold WHERE text_yi_pointed IS NOT NULL")
def book_tokens(spark, d):
    """Pointed tokens of each chunk, cut at blanks, hyphens and bars."""
    a = table(spark, d, "annotations_gold").where("text_yi_pointed IS NOT NULL")
    return a.select("ann_id", F.size(T.book_tokens(F.col("text_yi_pointed"))).cast("bigint").alias("n_tokens"))


@query("corpus_folds", f"SELECT ann_id, md5(f) AS folded, md5(trim(regexp_replace(regexp_replace(f, '[֑-֯]', '', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))) AS squeezed FROM (SELECT ann_id, translate(replace(replace(replace(nfc_normalize(text_yi_pointed), 'װ', 'וו'), 'ױ', 'וי'), 'ײ', 'יי'), '{T.NO_WIDTH}', '') AS f FROM annotations_gold WHERE text_yi_pointed IS NOT NULL)")
def corpus_folds(spark, d):
    """Checksums of each pointed chunk after the folds of a corpus: ligatures, direction signs, cantillation, blanks."""
    a = table(spark, d, "annotations_gold").where("text_yi_pointed IS NOT NULL")
    return a.select("ann_id", F.md5(T.corpus_fold(F.col("text_yi_pointed"))).alias("folded"), F.md5(T.corpus_fold(F.col("text_yi_pointed"), cantillation=False)).alias("squeezed"))


_TOL = T.tolerant_pattern("געזאגט")


@query("tolerant_match", f"SELECT episode, count(*) AS n FROM annotations_gold WHERE regexp_matches(nfc_normalize(text_yi_pointed), '{_TOL}') GROUP BY episode")
def tolerant_match(spark, d):
    """Chunks of each episode that have a word, however it is pointed."""
    a = table(spark, d, "annotations_gold").where(T.composed(F.col("text_yi_pointed")).rlike(_TOL))
    return a.groupBy("episode").agg(F.count("*").alias("n"))


@query("first_points", f"SELECT base, point, count(*) AS n FROM (SELECT substring(u, 1, 1) AS base, regexp_extract(u, '[{_POINT}]', 0) AS point FROM (SELECT unnest(regexp_extract_all(nfc_normalize(text_yi_pointed), '\\P{{M}}\\p{{M}}*')) AS u FROM annotations_gold)) WHERE base BETWEEN 'א' AND 'ת' GROUP BY base, point")
def first_points(spark, d):
    """Letters and the first vowel point they bear."""
    a = table(spark, d, "annotations_gold").select(F.explode(F.regexp_extract_all(T.composed(F.col("text_yi_pointed")), F.lit(r"(\P{M}\p{M}*)"), F.lit(1))).alias("u"))
    each = a.select(F.left("u", F.lit(1)).alias("base"), T.first_point(F.col("u")).alias("point")).where(F.col("base").between("א", "ת"))
    return each.groupBy("base", "point").agg(F.count("*").alias("n"))


@query("acoustic_fold", "SELECT vote_id, array_to_string(list_transform(regexp_extract_all(regexp_replace(lower(t), 't͡s', 'ʦ', 'g'), 'aː|ej|aj|ɔj|oʊ|.'), lambda p: CASE WHEN p IN ('aː', 'ej', 'aj', 'ɔj', 'oʊ') OR regexp_matches(p, '^[aɛəiuɔbdfɡhjklmnprstvzxʃʒʦʧʤŋ]$') THEN p WHEN p = 'g' THEN 'ɡ' WHEN p = 'e' THEN 'ɛ' ELSE '' END), '') AS phones FROM (SELECT vote_id, list_filter(list_transform(string_split(ipa, '/'), lambda x: trim(x)), lambda x: x NOT IN ('', '?', '<unk>')) AS l, array_to_string(l, '') AS t FROM stress_votes WHERE ipa IS NOT NULL)")
def acoustic_fold(spark, d):
    """Transcripts cut at bars, special tokens dropped, each symbol folded onto the inventory: longest first, then one by one, others dropped."""
    v = table(spark, d, "stress_votes").where("ipa IS NOT NULL")
    pieces = P.transcript_pieces(F.col("ipa"), "/", ["?", "<unk>"])
    folded = P.fold_symbols(F.lower(F.array_join(pieces, "")), [("t͡s", "ʦ")], {"g": "ɡ", "e": "ɛ"})
    return v.select("vote_id", F.array_join(folded, "").alias("phones"))


@query("edition_fold", "SELECT bare, count(*) AS n_printed, count(DISTINCT f) AS n_folded FROM (SELECT bare, replace(form, 'ׇ', 'ָ') AS f, form FROM (SELECT DISTINCT nfc_normalize(w) AS form, nfc_normalize(strip_accents(w)) AS bare FROM (SELECT unnest(" + duck_words("text_yi_pointed") + ") AS w FROM annotations_gold)) WHERE NOT regexp_matches(form, '[ֹֺּ]')) GROUP BY bare")
def edition_fold(spark, d):
    """Printed forms of each bare word and how many are left when marks on which editions differ are dropped; words with a dot are checked by tests."""
    w = table(spark, d, "annotations_gold").select(F.explode(T.words(F.col("text_yi_pointed"))).alias("w")).distinct().select(T.composed(F.col("w")).alias("form")).distinct()
    w = w.where(~F.col("form").rlike("[ֹֺּ]"))
    w = w.select(T.strip_marks(F.col("form")).alias("bare"), T.edition_fold(F.col("form")).alias("folded"))
    return w.groupBy("bare").agg(F.count("*").alias("n_printed"), F.countDistinct("folded").alias("n_folded"))


_TRI = f"""WITH l AS (SELECT list_transform({duck_words('text')}, lambda x: {duck_key('x')}) AS k FROM held_out_items), g AS (SELECT 2 AS n, unnest(list_transform(range(1, len(k)), lambda i: [k[i], k[i + 1]])) AS m FROM l UNION ALL SELECT 3, unnest(list_transform(range(1, len(k) - 1), lambda i: [k[i], k[i + 1], k[i + 2]])) FROM l)
    SELECT CAST(n AS INTEGER) AS n, array_to_string(m, ' ') AS gram, count(*) AS count FROM g WHERE len(list_filter(m, lambda x: x NOT IN (SELECT {duck_key('word')} FROM g2p_gold_v3 WHERE word IS NOT NULL))) = 0 GROUP BY n, m"""


@query("member_ngrams", _TRI.replace("x NOT IN (SELECT " + duck_key("word") + " FROM g2p_gold_v3 WHERE word IS NOT NULL)", "NOT list_contains(members, x)").replace("FROM g WHERE", f"FROM g, (SELECT list(DISTINCT {duck_key('word')}) AS members FROM g2p_gold_v3 WHERE word IS NOT NULL) WHERE"))
def member_ngrams(spark, d):
    """Pairs and triples of neighbouring keys of the held-out texts whose members are all entries."""
    items = table(spark, d, "held_out_items").select("item_id", F.transform(T.words(F.col("text")), T.lookup_key).alias("k"))
    members = table(spark, d, "g2p_gold_v3").where("word IS NOT NULL").select(T.lookup_key(F.col("word")).alias("key")).distinct()
    return sequences.member_ngrams(items, "item_id", "k", members, "key", (2, 3))

"""Queries over words and characters."""

from __future__ import annotations

from pyspark.sql import functions as F

from warpweft.functions import phones as P
from warpweft.functions import text as T
from warpweft.operators import evidence, rewrite, scoring, sequences
from warpweft.plans.registry import ORACLES, duck_bare, duck_core, duck_key, duck_signs, duck_tokens, duck_words, duck_words_or_null, query
from warpweft.sources.tables import spread, table


def corpus_types(spark, d):
    """Word types of the corpus with their frequency, in no order: what other queries join."""
    each = spread(table(spark, d, "documents").select("text")).select(F.explode(T.words(F.col("text"))).alias("type"))
    return each.groupBy("type").agg(F.count("*").alias("freq"))


@query("token_type_freq", f"SELECT w AS type, count(*) AS freq FROM (SELECT unnest({duck_words('text')}) AS w FROM documents) GROUP BY w ORDER BY freq DESC, type")
def token_type_freq(spark, d):
    """Word types of the corpus by frequency."""
    return corpus_types(spark, d).orderBy(F.desc("freq"), "type")


@query("lookup_key", f"SELECT rank, word, {duck_signs('word')} AS surface, {duck_key('word')} AS key FROM g2p_gold_v3")
def lookup_key(spark, d):
    """Surface form and lookup key of each entry."""
    g = table(spark, d, "g2p_gold_v3")
    return g.select("rank", "word", T.normal_surface(F.col("word")).alias("surface"), T.lookup_key(F.col("word")).alias("key"))


_LEAD, _TRAIL = r"^([^\p{L}\p{N}''׳ʼ‘’`]*)", r"([^\p{L}\p{N}\p{M}''׳ʼ‘’`]*)$"


@query(
    "edge_split",
    rf"""SELECT ann_id, pos, CASE WHEN s THEN t ELSE regexp_extract(t, '{_LEAD}', 1) END AS lead, {duck_core('t')} AS core, CASE WHEN s THEN '' ELSE regexp_extract(t, '{_TRAIL}', 1) END AS trail
    FROM (SELECT ann_id, t, pos, NOT regexp_matches(t, '[\p{{L}}\p{{N}}]') AS s FROM (SELECT ann_id, unnest(l) AS t, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos FROM (SELECT ann_id, {duck_tokens('text_yi')} AS l FROM annotations_gold)))""",
)
def edge_split(spark, d):
    """Leading signs, core and trailing signs of each token of the gold chunks."""
    each = table(spark, d, "annotations_gold").select("ann_id", F.posexplode(T.tokens(F.col("text_yi"))).alias("pos", "t"))
    lead, core, trail = T.edges(F.col("t"))
    return each.select("ann_id", "pos", lead.alias("lead"), core.alias("core"), trail.alias("trail"))


_LETTERS = r"length(regexp_replace(text, '[^\p{L}]', '', 'g'))"


@query(
    "reason_codes",
    rf"""SELECT reason, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 6) AS share FROM (SELECT CASE
      WHEN text IS NULL OR trim(text, ' {chr(9)}{chr(10)}{chr(13)}') = '' THEN 'empty' WHEN length(text) < 20 THEN 'short'
      WHEN {_LETTERS} < 0.6 * length(text) THEN 'few letters' WHEN lang IS NULL THEN 'no language'
      WHEN lang IN ('yi', 'he') AND NOT regexp_matches(text, '[א-ת]') THEN 'no hebrew' ELSE 'ok' END AS reason FROM documents) GROUP BY reason""",
)
def reason_codes(spark, d):
    """Documents by the first check they fail."""
    docs = table(spark, d, "documents")
    text = F.col("text")
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    reason = T.first_reason([
        ("empty", text.isNull() | (F.btrim(text, F.lit(" \t\n\r")) == "")), ("short", F.length(text) < 20), ("few letters", letters < 0.6 * F.length(text)),
        ("no language", F.col("lang").isNull()), ("no hebrew", F.col("lang").isin("yi", "he") & ~text.rlike("[א-ת]")),
    ])  # fmt: skip
    counts = docs.select(reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("reason", "n", F.round(F.col("n") / total, 6).alias("share"))


@query(
    "problem_list",
    r"""SELECT asr_id, array_to_string(list_filter([CASE WHEN text_whisper IS NULL THEN 'no text' END, CASE WHEN language IS NULL OR language = '' THEN 'no label' END,
    CASE WHEN lang_prob IS NULL OR isnan(lang_prob) THEN 'no probability' END, CASE WHEN text_whisper = text_whisper_novad THEN 'same' END], lambda x: x IS NOT NULL), ',') AS problems FROM runpod_whisper_sample""",
)
def problem_list(spark, d):
    """All problems of each transcript."""
    r = table(spark, d, "runpod_whisper_sample")
    label, p = F.col("language"), F.col("lang_prob")
    codes = T.problem_codes([("no text", F.col("text_whisper").isNull()), ("no label", label.isNull() | (label == "")), ("no probability", p.isNull() | F.isnan(p)), ("same", F.col("text_whisper") == F.col("text_whisper_novad"))])
    return r.select("asr_id", F.array_join(codes, ",").alias("problems"))


@query(
    "markup_clean",
    r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '\[[^\[\]]*\]')) AS INTEGER) AS n_cues, CAST(length(clean) AS INTEGER) AS n_clean, md5(clean) AS clean_md5 FROM
    (SELECT doc_id, text, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(text, '<[^<>]*>', ' ', 'g'), '\[[^\[\]]*\]', ' ', 'g'),
     '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\n\r]+', ' ', 'g')) AS clean FROM documents) WHERE text IS NOT NULL""",
)
def markup_clean(spark, d):
    """Cues per document and what is left without tags, cues and entities."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text")).where("text IS NOT NULL")
    clean = T.clean_markup(F.col("text"))
    return docs.select("doc_id", F.regexp_count("text", F.lit(r"\[[^\[\]]*\]")).alias("n_cues"), F.length(clean).alias("n_clean"), F.md5(clean).alias("clean_md5"))


_POINTED = f"(SELECT unnest({duck_words('text_yi_pointed')}) AS form FROM annotations_gold)"
_COUNTED = f"(SELECT {duck_bare('form')} AS bare, nfc_normalize(form) AS form, count(*) AS n FROM {_POINTED} GROUP BY ALL)"


def _pointed_counts(spark, d):
    each = table(spark, d, "annotations_gold").select(F.explode(T.words(F.col("text_yi_pointed"))).alias("form"))
    counted = each.groupBy("form").count()
    formed = counted.select(T.strip_marks(F.col("form")).alias("bare"), T.composed(F.col("form")).alias("form"), "count")
    return formed.groupBy("bare", "form").agg(F.sum("count").alias("n"))


@query("variant_counts", f"SELECT bare, form, n FROM {_COUNTED}")
def variant_counts(spark, d):
    """Pointed forms of each bare word; normalization runs once per distinct form."""
    return _pointed_counts(spark, d)


@query(
    "consistency_metrics",
    f"""SELECT count(*) AS n_types, count(*) FILTER (forms = 1) AS n_single, round(count(*) FILTER (forms = 1) / count(*), 6) AS type_consistency,
    round(sum(top) / sum(n), 6) AS token_consistency, round(avg(forms), 6) AS mean_forms FROM (SELECT bare, sum(n) AS n, max(n) AS top, count(*) AS forms FROM {_COUNTED} GROUP BY bare) WHERE n >= 3""",
)
def consistency_metrics(spark, d):
    return evidence.consistency(_pointed_counts(spark, d), "bare", 3)


_MODAL = f"""(SELECT bare, arg_min(form, struct_pack(a := -n, b := form)) AS modal, round(max(n) / sum(n), 6) AS share, CASE WHEN count(*) = 1 THEN 'single' WHEN max(n) / sum(n) >= 0.8 THEN 'dominant' ELSE 'conflict' END AS bucket,
    CAST(sum(n) AS BIGINT) AS n FROM {_COUNTED} GROUP BY bare)"""


@query("modal_dominance", f"SELECT * FROM {_MODAL}")
def modal_dominance(spark, d):
    return evidence.modal(_pointed_counts(spark, d), "bare", "form")


@query(
    "coverage_buckets",
    f"""SELECT coalesce(bucket, 'miss') AS bucket, count(*) AS n_types, CAST(sum(freq) AS BIGINT) AS n_tokens FROM (SELECT w, count(*) AS freq FROM (SELECT unnest({duck_words('text')}) AS w FROM documents) GROUP BY w) t
    LEFT JOIN {_MODAL} m ON m.bare = t.w GROUP BY 1""",
)
def coverage_buckets(spark, d):
    """Corpus types and tokens by how well the pointed chunks cover them."""
    m = evidence.modal(_pointed_counts(spark, d), "bare", "form").select(F.col("bare").alias("type"), "bucket")
    return corpus_types(spark, d).join(m, "type", "left").groupBy(F.coalesce("bucket", F.lit("miss")).alias("bucket")).agg(F.count("*").alias("n_types"), F.sum("freq").alias("n_tokens"))


@query("char_histogram", "SELECT c, count(*) AS n FROM (SELECT unnest(string_split(coalesce(sentence_yi, ''), '')) AS c FROM stress_tts) WHERE c <> '' GROUP BY c")
def char_histogram(spark, d):
    each = table(spark, d, "stress_tts").select(F.explode(F.split(F.coalesce("sentence_yi", F.lit("")), "")).alias("c")).where("c <> ''")
    return each.groupBy("c").agg(F.count("*").alias("n"))


_IPA = "(SELECT id, ipa FROM stress_tts WHERE ipa IS NOT NULL)"
_SYM = "aː|ej|aj|ɔj|oʊ|[aɛəiuɔbdfɡhjklmnprstvzxʃʒʦʧʤŋ]"


@query(
    "inventory_gate",
    f"SELECT c AS symbol, count(*) AS n FROM (SELECT unnest(list_distinct(list_filter(string_split(regexp_replace(ipa, '{_SYM}|[ˈ -]', '', 'g'), ''), lambda c: c <> ''))) AS c FROM {_IPA}) GROUP BY c",
)
def inventory_gate(spark, d):
    """Characters outside the closed inventory and how many readings have them."""
    return table(spark, d, "stress_tts").select(F.explode(P.violations(F.col("ipa"))).alias("symbol")).groupBy("symbol").agg(F.count("*").alias("n"))


_CODE = f"regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(ipa, '[V C]', ' ', 'g'), 'aː|ej|aj|ɔj|oʊ|[aɛəiuɔ]', 'V', 'g'), '[bdfɡhjklmnprstvzxʃʒʦʧʤŋ]', 'C', 'g'), '-', ' '), '[^VC ]', '', 'g')"


@query(
    "shape_gate",
    f"""SELECT rank, ipa, CAST(length(replace(replace(c, 'C', ''), ' ', '')) AS INTEGER) AS n_vowels, CAST(length(replace(replace(c, 'V', ''), ' ', '')) AS INTEGER) AS n_consonants,
    CAST(list_max(list_transform(regexp_split_to_array(c, '[V ]'), lambda x: length(x))) AS INTEGER) AS longest_run, regexp_matches(c, 'C{{5,}}') OR len(list_filter(regexp_split_to_array(c, ' +'), lambda w: contains(w, 'C') AND NOT contains(w, 'V'))) > 0 AS ill_shaped
    FROM (SELECT rank, ipa, {_CODE} AS c FROM (SELECT rank, trim(split_part(regexp_replace(gold_ipa, '\\[[^\\]]*\\]', '', 'g'), '|', 1)) AS ipa FROM g2p_gold_v3 WHERE gold_ipa IS NOT NULL))""",
)
def shape_gate(spark, d):
    """Counts of vowels and consonants and the shape test of each entry's first reading."""
    g = table(spark, d, "g2p_gold_v3").where("gold_ipa IS NOT NULL").select("rank", F.get(F.transform(F.split(F.regexp_replace("gold_ipa", r"\[[^\]]*\]", ""), r"\|"), T.strip), F.lit(0)).alias("ipa"))
    i = F.col("ipa")
    return g.select("rank", "ipa", P.vowel_count(i).alias("n_vowels"), P.consonant_count(i).alias("n_consonants"), P.longest_consonant_run(i).alias("longest_run"), P.ill_shaped(i).alias("ill_shaped"))


@query(
    "gold_variants",
    r"""SELECT rank, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, unnest(l) AS reading FROM (SELECT rank, list_filter(list_transform(string_split(regexp_replace(gold_ipa, '\[[^\]]*\]', '', 'g'), '|'), lambda x: trim(x)), lambda x, i: x <> '') AS l0, l0 AS l
    FROM g2p_gold_v3 WHERE gold_ipa IS NOT NULL) WHERE len(l) = len(list_distinct(l))
    UNION ALL SELECT rank, CAST(row_number() OVER (PARTITION BY rank ORDER BY p) - 1 AS INTEGER), reading FROM (SELECT rank, reading, min(p) AS p FROM (SELECT rank, unnest(l) AS reading, generate_subscripts(l, 1) AS p FROM
    (SELECT rank, list_filter(list_transform(string_split(regexp_replace(gold_ipa, '\[[^\]]*\]', '', 'g'), '|'), lambda x: trim(x)), lambda x: x <> '') AS l FROM g2p_gold_v3 WHERE gold_ipa IS NOT NULL) WHERE len(l) <> len(list_distinct(l))) GROUP BY rank, reading)""",
)
def gold_variants(spark, d):
    """Readings of each entry in order, the primary first."""
    return table(spark, d, "g2p_gold_v3").select("rank", F.posexplode(P.variants(F.col("gold_ipa"))).alias("pos", "reading"))


@query("phone_counts", f"SELECT p AS phone, count(*) AS n FROM (SELECT unnest(regexp_extract_all(ipa, '{_SYM}')) AS p FROM {_IPA}) GROUP BY p")
def phone_counts(spark, d):
    """Phones of all readings, longest symbol first."""
    return table(spark, d, "stress_tts").select(F.explode(P.phones(F.col("ipa"))).alias("phone")).groupBy("phone").agg(F.count("*").alias("n"))


@query(
    "mark_labels",
    "SELECT m AS mark, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM (SELECT unnest(marks) AS m FROM yiexample WHERE marks IS NOT NULL) WHERE m IS NOT NULL GROUP BY m",
)
def mark_labels(spark, d):
    """Mark labels of supervised characters and their shares."""
    each = table(spark, d, "yiexample").select(F.explode("marks").alias("mark")).where("mark IS NOT NULL").groupBy("mark").agg(F.count("*").alias("n"))
    return each.select("mark", "n", F.round(F.col("n") / each.agg(F.sum("n")).scalar(), 6).alias("share"))


@query(
    "mark_zip",
    "SELECT row_id, CASE WHEN length(text) = len(marks) THEN array_to_string(list_transform(range(1, length(text) + 1), lambda i: substring(text, i, 1) || coalesce(marks[i], '')), '') END AS pointed FROM yiexample",
)
def mark_zip(spark, d):
    """Pointed text of skeleton and marks."""
    return table(spark, d, "yiexample").select("row_id", T.join_marks(F.col("text"), F.col("marks")).alias("pointed"))


_ENDS = r"list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(regexp_replace(s, '[ \t\n\r]+', ' ', 'g'))), lambda s: s <> '')"
_PIECES = r"list_transform(regexp_extract_all(s, '((?:[^ ]+ ){7,24}?[^ ]*,(?: |$)|(?:[^ ]+ ){24}[^ ]+(?: |$)|[^ ].*)', 1), lambda p: trim(p))"


@query(
    "sentence_rows",
    f"""SELECT doc_id, id, text FROM (SELECT doc_id, doc_id || '.' || (generate_subscripts(l, 1) - 1) AS id, unnest(l) AS text FROM
    (SELECT doc_id, flatten(list_transform({_ENDS}, lambda s: CASE WHEN len(string_split(s, ' ')) <= 25 THEN [s] ELSE {_PIECES} END)) AS l FROM documents)) WHERE regexp_matches(text, '[א-ת]')""",
)
def sentence_rows(spark, d):
    """Sentences of the corpus that have a Hebrew letter, cut at commas or at 25 words, numbered within their document before the others are left out."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    each = docs.select("doc_id", F.posexplode(T.cut_sentences(F.col("text"))).alias("sent", "text"))
    return each.where(F.col("text").rlike("[א-ת]")).select("doc_id", F.concat_ws(".", "doc_id", "sent").alias("id"), "text")


_CHUNKS = r"regexp_extract_all(coalesce(text, ''), '(?s)(.{1,400}$|.{0,399}[ \t\n\x0B\f\r]|[^ \t\n\x0B\f\r]+[ \t\n\x0B\f\r]*)', 1)"


@query("budget_chunks", f"SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS chunk, unnest(l) AS text FROM (SELECT doc_id, {_CHUNKS} AS l FROM documents)")
def budget_chunks(spark, d):
    """Documents cut after blanks into pieces of at most 400 characters that give the document when put together."""
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(T.budget_chunks(F.col("text"), 400)).alias("chunk", "text"))


@query(
    "chunk_rejoin",
    "SELECT count(*) AS n_docs, count(*) FILTER (text IS NULL OR text = '') AS n_empty, 0 AS n_broken, 0 AS n_over FROM documents",
)
def chunk_rejoin(spark, d):
    """Documents whose pieces don't give them when put together, or that have a piece over its limit: none."""
    docs = spread(table(spark, d, "documents").select("text")).withColumn("p", T.budget_chunks(F.col("text"), 200, cut_words=True))
    broken, over = F.array_join("p", "") != F.coalesce("text", F.lit("")), F.exists("p", lambda x: F.length(x) > 200)
    return docs.agg(F.count("*").alias("n_docs"), F.count_if(F.size("p") == 0).alias("n_empty"), F.count_if(broken).cast("int").alias("n_broken"), F.count_if(over).cast("int").alias("n_over"))


@query(
    "marked_chunks",
    r"""SELECT row_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS chunk, unnest(l) AS text, CAST(NULL AS INTEGER) AS n_marks FROM (SELECT row_id, regexp_extract_all(text, '(?s)(.{1,60}$|.{0,59}[ 	

]|.{1,60})', 1) AS l FROM yiexample WHERE length(text) = len(marks))""".replace(
        "CAST(NULL AS INTEGER) AS n_marks FROM (SELECT row_id,", "CAST(unnest(list_transform(l, lambda x, i: len(list_filter(marks[CAST(coalesce(list_sum(list_transform(l[1:i - 1], lambda y: length(y))), 0) AS BIGINT) + 1:CAST(list_sum(list_transform(l[1:i], lambda y: length(y))) AS BIGINT)], lambda m: m <> '')))) AS INTEGER) AS n_marks FROM (SELECT row_id, marks,"
    ),
)
def marked_chunks(spark, d):
    """Rows of letters and marks cut into pieces of at most 60 letters, with how many letters of each bear a mark."""
    y = table(spark, d, "yiexample").select("row_id", F.posexplode(T.marked_chunks(F.col("text"), F.col("marks"), 60)).alias("chunk", "p"))
    return y.select("row_id", "chunk", F.col("p.text").alias("text"), F.size(F.filter("p.marks", lambda m: m != "")).alias("n_marks"))


@query("letter_units", "SELECT rank, CAST(len(regexp_extract_all(word, '\\P{M}\\p{M}*')) AS INTEGER) AS n_letters FROM (SELECT rank, nfc_normalize(word) AS word FROM g2p_gold_v3 WHERE word IS NOT NULL) WHERE NOT regexp_matches(word, '^\\p{M}')")
def letter_units(spark, d):
    """Letters of each entry, each with its marks."""
    g = table(spark, d, "g2p_gold_v3").where("word IS NOT NULL")
    return g.select("rank", F.size(T.letter_units(F.col("word"))).alias("n_letters"))


#: Rules of the romanization query: one pass, longer spellings first. Supplied by the caller; nothing in the engine knows a script.
ROMAN_RULES = [[("aː", "aa"), ("ʦ", "ts"), ("ʃ", "sh"), ("x", "kh"), ("ɛ", "e"), ("ɔ", "o"), ("ɡ", "g"), ("ː", ""), ("ˈ", "")]]


@query(
    "rewrite_rules",
    "SELECT id, replace(replace(replace(replace(replace(replace(replace(replace(replace(ipa, 'aː', 'aa'), 'ʦ', 'ts'), 'x', 'kh'), 'ʃ', 'sh'), 'ɛ', 'e'), 'ɔ', 'o'), 'ɡ', 'g'), 'ː', ''), 'ˈ', '') AS roman FROM stress_tts",
)
def rewrite_rules(spark, d):
    """Readings respelt in Latin letters by an ordered rule table."""
    return rewrite.rewrite_distinct(table(spark, d, "stress_tts").select("id", "ipa"), "ipa", ROMAN_RULES, "roman").select("id", "roman")


@query(
    "stress_index",
    "SELECT id, CAST(pos AS INTEGER) AS pos, w AS word, CAST(len(regexp_extract_all(split_part(w, 'ˈ', 1), 'aː|ej|aj|ɔj|oʊ|[aɛəiuɔ]')) + 1 AS INTEGER) AS nucleus FROM (SELECT id, unnest(l) AS w, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT id, string_split(ipa, ' ') AS l FROM stress_tts)) WHERE contains(w, 'ˈ')",
)
def stress_index(spark, d):
    """Which nucleus of each stressed word bears the stress."""
    each = table(spark, d, "stress_tts").select("id", F.posexplode(F.split("ipa", " ")).alias("pos", "word"))
    return each.select("id", "pos", "word", P.stressed_nucleus(F.col("word")).alias("nucleus")).where("nucleus IS NOT NULL")


_VOCAB = f"(SELECT DISTINCT unnest({duck_words('text')}) AS w FROM yiexample WHERE split = 'train')"


@query(
    "oov_split",
    f"SELECT split, CASE WHEN v.w IS NULL THEN 'oov' ELSE 'known' END AS kind, count(DISTINCT t.w) AS n_types, count(*) AS n_tokens FROM (SELECT split, unnest({duck_words('text')}) AS w FROM yiexample WHERE split <> 'train') t LEFT JOIN {_VOCAB} v ON v.w = t.w GROUP BY 1, 2",
)
def oov_split(spark, d):
    """Words of val and test that train knows, and those it doesn't. Counted per type before the join."""
    each = table(spark, d, "yiexample").select("split", F.explode(T.words(F.col("text"))).alias("w")).groupBy("split", "w").agg(F.count("*").alias("n"))
    known = each.where("split = 'train'").select("w", F.lit(True).alias("k"))
    kind = F.when(F.col("k").isNull(), "oov").otherwise("known").alias("kind")
    return each.where("split <> 'train'").join(known, "w", "left").groupBy("split", kind).agg(F.count("*").alias("n_types"), F.sum("n").alias("n_tokens"))


@query(
    "ngram_mine",
    f"""WITH l AS (SELECT {duck_words_or_null('text')} AS w FROM documents), g AS (
    SELECT 2 AS n, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM l UNION ALL SELECT 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM l)
    SELECT CAST(n AS INTEGER) AS n, gram, count(*) AS count FROM g WHERE gram IS NOT NULL GROUP BY ALL HAVING count(*) >= 15""",
)
def ngram_mine(spark, d):
    """Frequent pairs and triples of neighbouring words; a token without a word parts its neighbours."""
    rows = spread(table(spark, d, "documents").select("text")).select(T.words_or_null(F.col("text")).alias("w"))
    return sequences.mine_ngrams(rows, "w", (2, 3), 15)


_BRIDGED = f"""WITH l AS (SELECT {duck_words_or_null('text')} AS w, {duck_words('text')} AS v FROM documents)
    SELECT count(*) FILTER (a.gram IS NULL) AS n_bridges, count(*) AS n_pairs FROM (SELECT DISTINCT unnest(list_transform(range(1, len(v)), lambda i: v[i] || ' ' || v[i + 1])) AS gram FROM l) b
    LEFT JOIN (SELECT DISTINCT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM l) a USING (gram)"""


@query("ngram_bridges", _BRIDGED)
def ngram_bridges(spark, d):
    """Pairs of words that would only be neighbours if tokens without a word were left out: how many, of how many pairs."""
    docs = spread(table(spark, d, "documents").select("text"))
    pairs = lambda w: docs.select(F.explode(sequences.ngrams(w, 2)).alias("gram")).distinct()  # noqa: E731
    with_gaps = pairs(T.words_or_null(F.col("text"))).withColumn("real", F.lit(True))
    both = pairs(T.words(F.col("text"))).join(with_gaps, "gram", "left")
    return both.agg(F.count_if(F.col("real").isNull()).alias("n_bridges"), F.count("*").alias("n_pairs"))


@query(
    "ngram_index",
    f"""WITH l AS (SELECT {duck_words('text')} AS f, list_transform({duck_words('text')}, lambda x: {duck_key('x')}) AS k FROM held_out_items), g AS (
    SELECT 1 AS n, unnest(k) AS key, unnest(f) AS form FROM l UNION ALL SELECT 2, unnest(list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1])), unnest(list_transform(range(1, len(k)), lambda i: f[i] || ' ' || f[i + 1])) FROM l),
    c AS (SELECT n, key, form, count(*) AS cnt FROM g GROUP BY ALL)
    SELECT CAST(n AS INTEGER) AS n, key, CAST(sum(cnt) AS BIGINT) AS total, array_to_string(list(form || ':' || cnt ORDER BY cnt DESC, form), '|') AS forms FROM c GROUP BY n, key""",
)
def ngram_index(spark, d):
    """Words and pairs of the held-out texts by lookup key, with the forms that have it, commonest first."""
    items = table(spark, d, "held_out_items").select("item_id", F.posexplode(T.words(F.col("text"))).alias("pos", "form"))
    keys = items.select("form").distinct().select("form", T.lookup_key(F.col("form")).alias("key"))
    line = items.join(keys, "form").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("pos", "form", "key"))).alias("l"))
    line = line.select(F.transform("l", lambda x: x["form"]).alias("f"), F.transform("l", lambda x: x["key"]).alias("k"))

    def zipped(n: int):
        both = F.arrays_zip(sequences.ngrams(F.col("k"), n).alias("k"), sequences.ngrams(F.col("f"), n).alias("f"))
        return F.transform(both, lambda z: F.struct(F.lit(n).alias("n"), z["k"].alias("key"), z["f"].alias("form")))

    pair = F.flatten(F.array(zipped(1), zipped(2)))
    cells = line.select(F.explode(pair).alias("g")).select("g.*").groupBy("n", "key", "form").agg(F.count("*").alias("cnt"))
    forms = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("cnt")).alias("m"), F.col("form").alias("form")))), lambda x: F.concat(x["form"], F.lit(":"), (-x["m"]).cast("string")))
    return cells.groupBy("n", "key").agg(F.sum("cnt").alias("total"), F.array_join(forms, "|").alias("forms"))


_LINES = f"""(SELECT ann_id, list_transform(t, lambda x: nullif(lower({duck_core('x')}), '')) AS w,
    list_transform(t, lambda x, i: CASE WHEN i = 1 OR (NOT regexp_matches(t[i - 1], '[^\\p{{L}}\\p{{N}}\\p{{M}}''׳ʼ‘’`]$') AND NOT regexp_matches(x, '^[^\\p{{L}}\\p{{N}}''׳ʼ‘’`]')) THEN nullif(lower({duck_core('x')}), '') END) AS f
    FROM (SELECT ann_id, {duck_tokens('text_yi')} AS t FROM annotations_gold))"""


@query(
    "phrase_match",
    f"""WITH RECURSIVE phrases AS (SELECT gram FROM ({ORACLES['ngram_mine']})), l AS {_LINES}, c AS (
    SELECT ann_id, i AS start, 2 AS n, w[i] || ' ' || f[i + 1] AS gram FROM (SELECT ann_id, w, f, unnest(range(1, len(w))) AS i FROM l) UNION ALL SELECT ann_id, i, 3, w[i] || ' ' || f[i + 1] || ' ' || f[i + 2] FROM (SELECT ann_id, w, f, unnest(range(1, len(w) - 1)) AS i FROM l)),
    m AS (SELECT ann_id, start, max(n) AS n, arg_max(gram, n) AS gram FROM c WHERE gram IN (SELECT gram FROM phrases) GROUP BY ann_id, start),
    walk AS (SELECT ann_id, 1 AS p FROM l UNION ALL SELECT walk.ann_id, p + coalesce(m.n, 1) FROM walk JOIN l ON l.ann_id = walk.ann_id AND p <= len(w) LEFT JOIN m ON m.ann_id = walk.ann_id AND m.start = p)
    SELECT m.ann_id, CAST(m.start AS INTEGER) AS start, CAST(m.n AS INTEGER) AS n, m.gram FROM walk JOIN m ON m.ann_id = walk.ann_id AND m.start = walk.p""",
)
def phrase_match(spark, d):
    """Mined phrases in the gold chunks: longest first, left to right, never overlapping, never across a sign."""
    rows = table(spark, d, "annotations_gold").select("ann_id", T.words_or_null(F.col("text_yi")).alias("w"), T.following_words(F.col("text_yi")).alias("f"))
    return sequences.longest_matches(rows, "ann_id", "w", ngram_mine(spark, d).select("gram"), 3, follow="f")


_CTX = f"""(SELECT ann_id, w, generate_subscripts(w, 1) AS p, unnest(w) AS word FROM (SELECT ann_id, {duck_words('text_yi')} AS w FROM annotations_gold))"""


@query(
    "kwic",
    f"""SELECT word, context, CAST(rank AS INTEGER) AS rank FROM (SELECT word, context, row_number() OVER (PARTITION BY word ORDER BY first_at, context) AS rank FROM (
    SELECT word, array_to_string(w[greatest(p - 3, 1):p + 3], ' ') AS context, min(struct_pack(a := ann_id, b := p)) AS first_at FROM {_CTX} GROUP BY 1, 2)) WHERE rank <= 2""",
)
def kwic(spark, d):
    """Up to two contexts of three words on either side for each word of the gold chunks."""
    rows = table(spark, d, "annotations_gold").select("ann_id", T.words(F.col("text_yi")).alias("w"))
    return sequences.contexts(rows, "ann_id", "w")


@query(
    "prefix_join",
    f"""WITH v AS (SELECT DISTINCT unnest({duck_words('text_yi')}) AS w FROM annotations_gold), a AS (SELECT * FROM (VALUES ('גע'), ('אויס'), ('אויפ'), ('באַ'), ('בא'), ('פאר'), ('איבער'), ('אריינ')) t(affix))
    SELECT x.w AS word, arg_min(a.affix, struct_pack(n := -length(a.affix), f := a.affix)) AS affix, arg_min(s.w, struct_pack(n := -length(a.affix), f := a.affix)) AS stem FROM v x JOIN a ON starts_with(x.w, a.affix) JOIN v s ON s.w = substring(x.w, length(a.affix) + 1)
    WHERE length(s.w) >= 2 GROUP BY x.w""",
)
def prefix_join(spark, d):
    """Words that are a known word after a prefix, the longest prefix first."""
    v = table(spark, d, "annotations_gold").select(F.explode(T.words(F.col("text_yi"))).alias("word")).distinct()
    affixes = spark.createDataFrame([(a, k) for k, a in enumerate(["גע", "אויס", "אויפ", "באַ", "בא", "פאר", "איבער", "אריינ"])], "affix string, rank int")
    return rewrite.affix_join(v, v, affixes, "word", "word", prefix=True)


@query(
    "suffix_join",
    f"""WITH v AS (SELECT DISTINCT unnest({duck_words('text_yi')}) AS w FROM annotations_gold), a AS (SELECT * FROM (VALUES ('ער', 0), ('ן', 1), ('ט', 2), ('קייט', 3), ('ונג', 4), ('עס', 5)) t(affix, rank))
    SELECT x.w AS word, arg_min(a.affix, struct_pack(n := a.rank, f := a.affix)) AS affix, arg_min(s.w, struct_pack(n := a.rank, f := a.affix)) AS stem FROM v x JOIN a ON ends_with(x.w, a.affix) JOIN v s ON s.w = left(x.w, CAST(length(x.w) - length(a.affix) AS BIGINT))
    WHERE length(s.w) >= 2 GROUP BY x.w""",
)
def suffix_join(spark, d):
    """Words that are a known word before a suffix, the first suffix in list order."""
    v = table(spark, d, "annotations_gold").select(F.explode(T.words(F.col("text_yi"))).alias("word")).distinct()
    affixes = spark.createDataFrame([(a, k) for k, a in enumerate(["ער", "ן", "ט", "קייט", "ונג", "עס"])], "affix string, rank int")
    return rewrite.affix_join(v, v, affixes, "word", "word", prefix=False)


_ROW = "md5(concat_ws(chr(31), " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), chr(1))" for c in ("rank", "word", "freq", "layer", "gold_ipa", "gold", "source", "native_hint", "review_note")) + "))"


@query(
    "drift_fingerprint",
    f"SELECT count(*) AS n_rows, bit_xor(CAST('0x' || substring(h, 1, 15) AS BIGINT)) AS fingerprint, CAST(sum(CAST('0x' || substring(h, 1, 4) AS BIGINT)) AS BIGINT) AS checksum FROM (SELECT {_ROW} AS h FROM g2p_gold_v3)",
)
def drift_fingerprint(spark, d):
    """Row count and checksums of the entry table, all its columns, to notice a change."""
    g = table(spark, d, "g2p_gold_v3")
    return scoring.fingerprint(g, g.columns)

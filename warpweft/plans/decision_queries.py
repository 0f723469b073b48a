"""Queries that decide, correct, and report."""

from __future__ import annotations

from pyspark.sql import functions as F

from warpweft.functions import text as T
from warpweft.operators import decisions as D
from warpweft.plans.registry import duck_words, query
from warpweft.sources.tables import table

_EVAL = "(SELECT DISTINCT sentence, word_no, word, ipa, tier, route, confidence FROM eval_meta_2026_08_14 WHERE word_no IS NOT NULL)"


def _words(spark, d):
    e = table(spark, d, "eval_meta_2026_08_14").where("word_no IS NOT NULL")
    return e.select("sentence", "word_no", "word", "ipa", "tier", "route", "confidence").distinct()


@query("line_policy", f"""SELECT sentence, n, n_dropped, CASE WHEN n_dropped = 0 THEN 'strict' WHEN n - n_dropped >= 4 AND n_dropped < 0.2 * n THEN 'partial' ELSE 'drop' END AS policy
    FROM (SELECT sentence, count(*) AS n, count(*) FILTER (ipa IS NULL OR confidence = 'LOW') AS n_dropped FROM {_EVAL} GROUP BY sentence)""")
def line_policy(spark, d):
    """Sentences kept whole, in part or not at all, by their words without a sure reading."""
    return D.line_policy(_words(spark, d), ["sentence"], F.col("ipa").isNull() | (F.coalesce("confidence", F.lit("")) == "LOW"))


@query("quarantine_elision", f"SELECT sentence, array_to_string(list(word ORDER BY word_no, word) FILTER (ipa IS NOT NULL AND coalesce(confidence, '') <> 'LOW'), ' ') AS kept FROM {_EVAL} WHERE word IS NOT NULL GROUP BY sentence")
def quarantine_elision(spark, d):
    """Sentences put together again without the words that have no sure reading."""
    e = _words(spark, d).where("word IS NOT NULL").withColumn("drop", F.col("ipa").isNull() | (F.coalesce("confidence", F.lit("")) == "LOW"))
    line = e.groupBy("sentence").agg(F.array_sort(F.collect_list(F.struct("word_no", "word", "drop"))).alias("l"), F.count_if(~F.col("drop")).alias("n"))
    text = D.elide(F.transform("l", lambda x: x["word"]), F.transform("l", lambda x: x["drop"]))
    return line.select("sentence", F.when(F.col("n") > 0, text).alias("kept"))


@query(
    "decision_cascade",
    """SELECT id, CASE WHEN ipa_flash = ipa_pro THEN ipa_flash WHEN ipa_flash IS NULL AND ipa_pro IS NOT NULL THEN ipa_pro WHEN ipa_pro IS NULL AND ipa_flash IS NOT NULL THEN ipa_flash WHEN ipa_pro = ipa THEN ipa_pro WHEN ipa_flash = ipa THEN ipa_flash END AS reading,
    CASE WHEN ipa_flash = ipa_pro THEN 'agree' WHEN ipa_flash IS NULL AND ipa_pro IS NOT NULL THEN 'only pro' WHEN ipa_pro IS NULL AND ipa_flash IS NOT NULL THEN 'only flash' WHEN ipa_pro = ipa THEN 'pro published' WHEN ipa_flash = ipa THEN 'flash published' ELSE 'none' END AS reason
    FROM (SELECT DISTINCT id, ipa, ipa_flash, ipa_pro FROM stress_tts)""",
)
def decision_cascade(spark, d):
    """A reading per item by the first rule that holds, with the rule's name."""
    s = table(spark, d, "stress_tts").select("id", "ipa", "ipa_flash", "ipa_pro").distinct()
    a, b, p = F.col("ipa_flash"), F.col("ipa_pro"), F.col("ipa")
    steps = [("agree", a == b, a), ("only pro", a.isNull() & b.isNotNull(), b), ("only flash", b.isNull() & a.isNotNull(), a), ("pro published", b == p, b), ("flash published", a == p, a)]
    return D.cascade(s, steps, "reading").select("id", "reading", "reason")


_SPANS = "list_filter(regexp_split_to_array(sentence_yi, '[ \\t\\n\\r]'), lambda x: true)"


@query(
    "word_offsets",
    f"""SELECT id, w AS word, CAST(b AS INTEGER) AS "begin", CAST(b + length(w) AS INTEGER) AS "end" FROM (SELECT id, l[i] AS w, coalesce(list_sum(list_transform(l[1:i - 1], lambda x: length(x) + 1)), 0) AS b
    FROM (SELECT id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT DISTINCT id, {_SPANS} AS l FROM stress_tts WHERE sentence_yi IS NOT NULL))) WHERE w <> ''""",
)
def word_offsets(spark, d):
    """Words of each sentence with their places in the text as it is."""
    s = table(spark, d, "stress_tts").where("sentence_yi IS NOT NULL").select("id", "sentence_yi").distinct()
    return s.select("id", F.explode(T.word_spans("sentence_yi")).alias("x")).select("id", "x.*")


@query("aligned_tokens", """SELECT a AS word, b AS reading, count(*) AS n FROM (SELECT unnest(p) AS a, unnest(i) AS b FROM (SELECT string_split(pointed_yi, ' ') AS p, string_split(ipa, ' ') AS i FROM (SELECT DISTINCT id, pointed_yi, ipa FROM stress_tts)) WHERE len(p) = len(i)) GROUP BY a, b""")
def aligned_tokens(spark, d):
    """Pointed words beside their readings, from sentences with equally many of both."""
    s = table(spark, d, "stress_tts").select("id", "pointed_yi", "ipa").distinct()
    return s.select(F.explode(D.zip_equal(F.split("pointed_yi", " "), F.split("ipa", " "))).alias("z")).groupBy(F.col("z.a").alias("word"), F.col("z.b").alias("reading")).agg(F.count("*").alias("n"))


@query("inverted_index", f"SELECT word, episode, count(*) AS n FROM (SELECT episode, unnest({duck_words('text_yi')}) AS word FROM annotations_gold WHERE episode IS NOT NULL) GROUP BY word, episode")
def inverted_index(spark, d):
    """Episodes in which each word of the gold chunks occurs."""
    a = table(spark, d, "annotations_gold").where("episode IS NOT NULL").select("episode", T.words(F.col("text_yi")).alias("w"))
    return D.inverted_index(a, "w", ["episode"])


@query(
    "reason_union",
    f"""SELECT word, max(n) AS weight, array_to_string(list_sort(list_distinct(list(name))), ',') AS reasons FROM (SELECT w AS word, count(*) AS n, 'gold' AS name FROM (SELECT unnest({duck_words('text_yi')}) AS w FROM annotations_gold) GROUP BY w
    UNION ALL SELECT w, count(*), 'held out' FROM (SELECT unnest({duck_words('text')}) AS w FROM held_out_items) GROUP BY w) GROUP BY word""",
)
def reason_union(spark, d):
    """Words of two lists with their greatest count and the lists they are in."""
    counted = lambda t, c: table(spark, d, t).select(F.explode(T.words(F.col(c))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return D.reasons_union([("gold", counted("annotations_gold", "text_yi")), ("held out", counted("held_out_items", "text"))], "word", "n")


@query("top_report", f"SELECT w AS type, count(*) AS freq FROM (SELECT unnest({duck_words('text')}) AS w FROM documents) GROUP BY w ORDER BY freq DESC, type LIMIT 50")
def top_report(spark, d):
    """The fifty commonest words, for a report."""
    from warpweft.plans.text_queries import token_type_freq

    return token_type_freq(spark, d).limit(50)


@query(
    "agreement_histogram",
    """SELECT CAST(floor(10 * share) AS INTEGER) AS bucket, count(*) AS n_items, CAST(sum(votes) AS BIGINT) AS n_votes FROM (SELECT id, max(n) / sum(n) AS share, sum(n) AS votes FROM (SELECT id, ipa, count(*) AS n FROM stress_votes WHERE ipa IS NOT NULL GROUP BY id, ipa) GROUP BY id) GROUP BY 1""",
)
def agreement_histogram(spark, d):
    """Items by the share of their votes that the commonest reading has, in tenths."""
    cells = table(spark, d, "stress_votes").where("ipa IS NOT NULL").groupBy("id", "ipa").agg(F.count("*").alias("n"))
    per = cells.groupBy("id").agg((F.max("n") / F.sum("n")).alias("share"), F.sum("n").alias("votes"))
    return per.groupBy(F.floor(F.col("share") * 10).cast("int").alias("bucket")).agg(F.count("*").alias("n_items"), F.sum("votes").alias("n_votes"))


@query("per_group_cap", "SELECT episode, ann_id, CAST(pick AS INTEGER) AS pick FROM (SELECT episode, ann_id, row_number() OVER (PARTITION BY episode ORDER BY chunk_idx, ann_id) AS pick FROM annotations_gold WHERE episode IS NOT NULL) WHERE pick <= 2")
def per_group_cap(spark, d):
    """At most two chunks of each episode, the first by number."""
    from warpweft.operators.evidence import ranked

    a = table(spark, d, "annotations_gold").where("episode IS NOT NULL").select("episode", "chunk_idx", "ann_id")
    return ranked(a, ["episode"], [F.col("chunk_idx"), F.col("ann_id")], "pick").where("pick <= 2").select("episode", "ann_id", "pick")


@query("load_guard", "SELECT 'entries' AS gate, count(*) AS n_rows, count(*) >= 10 AS passed FROM g2p_gold_v3 UNION ALL SELECT 'readings', count(*), count(*) >= 10 FROM stress_tts UNION ALL SELECT 'chunks', count(*), count(*) >= 10 FROM annotations_gold")
def load_guard(spark, d):
    """Tables that must hold at least so many rows before anything runs on them."""
    parts = [table(spark, d, t).agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("gate"), "n_rows", (F.col("n_rows") >= 10).alias("passed")) for n, t in (("entries", "g2p_gold_v3"), ("readings", "stress_tts"), ("chunks", "annotations_gold"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])

"""Queries of the training-data operators, by problem, and the SQL that some can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warpweft.llm import abuse, canonical, consensus, groups, language, overlap, packing, passages
from warpweft.llm.lookalike import INVISIBLE, look_pairs
from warpweft.plans.session import checkpointed
from warpweft.sources.tables import spread


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Plans are a table made by hand; one with more rows is an error.
MOST_PLANS = 1000


def _plan(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> list[tuple]:
    """All rows of a plan table."""
    rows = _t(spark, sf_dir, name).select(*columns).limit(MOST_PLANS + 1).collect()
    if len(rows) > MOST_PLANS:
        raise ValueError(f"{name} has more than {MOST_PLANS} rows")
    return [tuple(r) for r in rows]


def _p1_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with all their readings, written once: they are read for the sample, in every pass and for the result. Dealt out, since what follows is costly per row."""
    return spread(checkpointed(consensus.readings(_t(spark, sf_dir, "stress_tts"), _t(spark, sf_dir, "stress_votes"))))


def p1_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_item = _p1_items(spark, sf_dir)
    return consensus.consensus(per_item, consensus.fit(per_item)[0])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_items(spark, sf_dir).where("n_readings > 1").select("id", "ipa")


def p1_annotators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.reliability(consensus.fit(_p1_items(spark, sf_dir))[1])


def _p2_values(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    texts = canonical.long_values(_t(spark, sf_dir, "annotations_gold"), "ann_id", ["text_yi", "text_yi_pointed"])
    return texts, canonical.long_values(_t(spark, sf_dir, "g2p_gold_v3"), "rank", ["word"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, words = _p2_values(spark, sf_dir)
    return canonical.lookalike_pairs(texts, False).unionByName(canonical.lookalike_pairs(words, True))


def p2_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, words = _p2_values(spark, sf_dir)
    return canonical.canonical_values(texts.unionByName(words))


def _p3_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of both tables, with a key that is the same in each run: of the sentence and word, or of the transcript."""
    e = _t(spark, sf_dir, "eval_meta_2026_08_14").select(F.lit("eval_meta_2026_08_14").alias("table_name"), F.concat_ws("/", "sentence", "word_no").alias("row_key"), "episode")
    r = _t(spark, sf_dir, "runpod_whisper_sample").select(F.lit("runpod_whisper_sample").alias("table_name"), F.col("asr_id").cast("string").alias("row_key"), "episode")
    return e.unionByName(r)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups.named_groups(_p3_rows(spark, sf_dir), _t(spark, sf_dir, "episode_meta"))
    return found.select("episode", F.col("group_episode").cast("string").alias("group_episode"))


def p3_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = _plan(spark, sf_dir, "split_plan", "split_name", "share")
    rows = _p3_rows(spark, sf_dir)
    return groups.assign_splits(rows, "row_key", groups.named_groups(rows, _t(spark, sf_dir, "episode_meta")), plan)


def p3_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and groups placed, and groups parted: none."""
    return groups.split_checks(p3_splits(spark, sf_dir))


def _p4_links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    y = _t(spark, sf_dir, "yiexample")
    train = F.col("split") == "train"
    rows = y.where("split IN ('train', 'val', 'test')").select(F.when(train, "train").otherwise("eval").alias("side"), F.col("row_id").alias("id"), "text", "split", "source")
    gold = _t(spark, sf_dir, "annotations_gold").select(F.lit("eval").alias("side"), F.col("ann_id").alias("id"), F.col("text_yi").alias("text"), F.lit("gold").alias("split"), F.lit("annotations_gold").alias("source"))
    return overlap.linked_texts(rows.unionByName(gold))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_pairs(*_p4_links(spark, sf_dir))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_report(*_p4_links(spark, sf_dir))


def _p5_segments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    transcripts = _t(spark, sf_dir, "runpod_whisper_sample")
    rows = language.prepared(transcripts)
    return rows, language.segments(rows, language.fit(transcripts))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.mislabelled(_p5_segments(spark, sf_dir)[1])


def p5_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p5_segments(spark, sf_dir)[1]


def p5_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.transcript_language(*_p5_segments(spark, sf_dir))


def p6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = _plan(spark, sf_dir, "pack_plan", "plan_name", "capacity")
    return packing.pack(packing.token_counts(spread(_t(spark, sf_dir, "documents").select("doc_id", "text"))), plans)


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p6_pack(spark, sf_dir))


def p6_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per plan: documents placed, containers above capacity and documents cut without need: none."""
    return packing.pack_checks(p6_pack(spark, sf_dir))


def _p7_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.find_passages(spread(_t(spark, sf_dir, "documents").select("doc_id", "text")), _t(spark, sf_dir, "held_out_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p7_hits(spark, sf_dir).select("doc_id", "item_id")


def p7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p7_hits(spark, sf_dir)


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source and suite: documents that leak, items leaked, and the mean share of the items' words found."""
    docs = _t(spark, sf_dir, "documents").groupBy("doc_id").agg(F.min("source").alias("source"))
    items = _t(spark, sf_dir, "held_out_items").groupBy("item_id").agg(F.min("suite").alias("suite"))
    hits = _p7_hits(spark, sf_dir).groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"), F.max("item_words").alias("item_words"))
    named = hits.join(docs, "doc_id").join(items, "item_id")
    return named.groupBy("source", "suite").agg(F.countDistinct("doc_id").alias("n_docs"), F.countDistinct("item_id").alias("n_items"), F.avg(F.col("matched") / F.col("item_words")).alias("mean_share"))


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents left when those with a leak are removed."""
    docs = _t(spark, sf_dir, "documents")
    return passages.without_leaks(docs, _p7_hits(spark, sf_dir)).select("doc_id", "lang", "source", "n_chars")


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    return abuse.score(spread(docs.select("doc_id", "text")), abuse.fit(docs, _t(spark, sf_dir, "doc_labels")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_scores(spark, sf_dir).where("n_abusive > 0").select("doc_id")


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.rates(_t(spark, sf_dir, "documents"), p8_scores(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_items": p1_items, "p1_annotators": p1_annotators, "p2_found": p2_found, "p2_forms": p2_forms, "p3_found": p3_found, "p3_splits": p3_splits, "p3_checks": p3_checks, "p4_found": p4_found, "p4_report": p4_report, "p5_found": p5_found, "p5_segments": p5_segments, "p5_transcripts": p5_transcripts, "p6_pack": p6_pack, "p6_report": p6_report, "p6_checks": p6_checks, "p7_found": p7_found, "p7_passages": p7_passages, "p7_report": p7_report, "p7_clean": p7_clean, "p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates}


def _p2_values_sql() -> str:
    """Every value with its form by the same tables, as one ``translate`` on composed instead of decomposed text."""
    source, target = look_pairs(True)
    quoted = lambda t: t.replace("'", "''")
    form = (
        f"trim(regexp_replace(replace(replace(replace(translate(nfc_normalize(regexp_replace(value, '{INVISIBLE}', '', 'g')), '{quoted(source)}', '{quoted(target)}'), "
        "'װ', 'וו'), 'ױ', 'וי'), 'ײ', 'יי'), '[\\s\\p{Z}]+', ' ', 'g'))"
    )
    values = (
        "SELECT 'text_yi' AS field, ann_id AS id, text_yi AS value, NULL AS n FROM annotations_gold UNION ALL SELECT 'text_yi_pointed', ann_id, text_yi_pointed, NULL FROM annotations_gold "
        "UNION ALL SELECT 'word', CAST(rank AS VARCHAR), word, rank FROM g2p_gold_v3"
    )
    return f"WITH v AS ({values}), f AS (SELECT field, id, n, value, nfc_normalize({form}) AS form FROM v)"


def _p2_sql() -> str:
    """All pairs with one form and two strings."""
    return (
        f"{_p2_values_sql()} SELECT a.field, a.id AS id_a, b.id AS id_b FROM f a JOIN f b ON a.field = b.field AND a.form = b.form "
        "AND a.value <> b.value AND CASE WHEN a.n IS NULL THEN a.id < b.id ELSE a.n < b.n END WHERE a.form <> ''"
    )


def _p2_forms_sql() -> str:
    """Every row with the form of its value and the commonest value of that form."""
    return (
        f"{_p2_values_sql()}, c AS (SELECT field, value, form, count(*) AS n FROM f WHERE form <> '' GROUP BY ALL), m AS (SELECT field, form, count(*) AS n_values, arg_min(value, struct_pack(m := -n, v := value)) AS canonical FROM c GROUP BY field, form) "
        "SELECT f.field, f.id, f.value, CASE WHEN f.form <> '' THEN f.form ELSE f.value END AS form, coalesce(m.canonical, f.value) AS canonical, coalesce(m.n_values, 1) AS n_values FROM f LEFT JOIN m ON m.field = f.field AND m.form = f.form"
    )


def _p3_sql() -> str:
    """Groups by a recursive walk over the links of the episodes."""
    wide = "".join(chr(0xFF10 + k) for k in range(10))
    number = lambda c: f"nullif(regexp_extract(translate({c}, '{wide}', '0123456789'), '(?:^|[^0-9])0*([1-9][0-9]{{6}})(?:[^0-9]|$)', 1), '')"
    nobody = ", ".join(f"'{x}'" for x in groups.PLACEHOLDERS)
    person = lambda c: f"regexp_replace(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}?]+', '', 'g'), '([a-z])0+([0-9])', '\\1\\2')"
    return f"""WITH RECURSIVE m AS (SELECT DISTINCT {number('episode')} AS e, {person('speaker')} AS s, {person('guest')} AS g, {number('reupload_of')} AS r FROM episode_meta),
    p AS (SELECT e, x FROM (SELECT e, s AS x FROM m UNION SELECT e, g FROM m) WHERE x NOT IN ({nobody}) AND NOT regexp_matches(x, '^[?]*$')),
    link AS (SELECT a.e AS a, b.e AS b FROM p a JOIN p b USING (x) UNION SELECT e, r FROM m WHERE r IS NOT NULL UNION SELECT r, e FROM m WHERE r IS NOT NULL),
    reach AS (SELECT e AS a, e AS b FROM m UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
    least AS (SELECT a, min(b) AS b FROM reach WHERE b IN (SELECT e FROM m) GROUP BY a),
    names AS (SELECT DISTINCT episode, {number('episode')} AS e FROM (SELECT episode FROM eval_meta_2026_08_14 UNION SELECT episode FROM runpod_whisper_sample) WHERE episode <> '')
    SELECT episode, coalesce(least.b, e) AS group_episode FROM names LEFT JOIN least ON least.a = names.e WHERE e IS NOT NULL"""


def oracle_sql() -> dict[str, str]:
    p3 = _p3_sql()
    placed = "SELECT episode FROM eval_meta_2026_08_14 UNION ALL SELECT episode FROM runpod_whisper_sample"
    p3_checks = f"SELECT (SELECT count(*) FROM ({placed})) AS n_rows, CAST(0 AS BIGINT) AS n_unplaced, (SELECT count(DISTINCT group_episode) FROM ({p3})) AS n_groups, CAST(0 AS BIGINT) AS n_parted"
    p6_checks = "SELECT plan_name, (SELECT count(*) FROM documents) AS n_docs, CAST(0 AS BIGINT) AS n_cut_small, CAST(0 AS BIGINT) AS n_over FROM pack_plan WHERE capacity >= 1"
    return {"p2_found": _p2_sql(), "p2_forms": _p2_forms_sql(), "p3_found": p3, "p3_checks": p3_checks, "p6_checks": p6_checks}

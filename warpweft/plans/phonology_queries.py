"""Queries that rewrite readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from warpweft.functions import phonology as G
from warpweft.functions import phones as P
from warpweft.plans.registry import query
from warpweft.sources.tables import table

_READ = "(SELECT DISTINCT ipa FROM stress_tts WHERE ipa IS NOT NULL)"


def _nested(column: str, pairs) -> str:
    for a, b in pairs:
        column = f"replace({column}, '{a}', '{b}')"
    return column


_VOICING = [(s + t, z + t) for _ in range(3) for s, z in G.VOICED_BEFORE.items() for t in G.TRIGGERS]
_DOUBLE = [(c + c, c) for _ in range(2) for c in G.OBSTRUENTS]


def _readings(spark, d):
    return table(spark, d, "stress_tts").where("ipa IS NOT NULL").select("ipa").distinct()


@query("assimilation", f"SELECT ipa, {_nested(_nested('ipa', _VOICING), _DOUBLE)} AS spoken FROM {_READ}")
def assimilation(spark, d):
    """Readings after voicing assimilation and without double obstruents."""
    return _readings(spark, d).select("ipa", G.assimilate(F.col("ipa")).alias("spoken"))


@query(
    "vowel_reduction",
    f"SELECT ipa, array_to_string(list_transform(string_split(ipa, ' '), lambda w: CASE WHEN contains(w, 'ˈ') THEN replace(split_part(w, 'ˈ', 1), 'ɛ', 'ə') || 'ˈ' || substring(w, instr(w, 'ˈ') + 1, 1) || replace(substring(w, instr(w, 'ˈ') + 2), 'ɛ', 'ə') ELSE w END), ' ') AS reduced FROM {_READ}",
)
def vowel_reduction(spark, d):
    return _readings(spark, d).select("ipa", G.reduce_unstressed(F.col("ipa")).alias("reduced"))


_DEVOICED = "ipa"
for _voiced, _plain in G.FINAL_DEVOICE.items():
    _DEVOICED = f"regexp_replace({_DEVOICED}, '{_voiced}([ -]|$)', '{_plain}\\1', 'g')"


@query("final_devoicing", f"SELECT ipa, {_DEVOICED} AS devoiced FROM {_READ} WHERE {_DEVOICED} <> ipa")
def final_devoicing(spark, d):
    """The added variant of each reading that devoicing at the ends of words and of their parts changes."""
    return _readings(spark, d).select("ipa", G.devoiced_final(F.col("ipa")).alias("devoiced")).where("devoiced IS NOT NULL")


@query("first_stress", f"SELECT ipa, CASE WHEN contains(ipa, 'ˈ') THEN ipa ELSE regexp_replace(ipa, 'aː|ej|aj|ɔj|oʊ|[aɛəiuɔ]', 'ˈ\\0') END AS marked FROM (SELECT DISTINCT replace(ipa, 'ˈ', '') AS ipa FROM stress_tts UNION SELECT ipa FROM stress_tts)")
def first_stress(spark, d):
    """Readings with a mark on the first vowel if they have none."""
    s = _readings(spark, d)
    return s.union(s.select(F.replace("ipa", F.lit(P.STRESS), F.lit("")))).distinct().select("ipa", G.ensure_stress(F.col("ipa")).alias("marked"))


_KIND = lambda m: f"CASE WHEN {m} BETWEEN '\u05b0' AND '\u05bb' OR {m} = '\u05c7' THEN 'v' WHEN {m} IN ('\u05c1', '\u05c2') THEN 'd' ELSE {m} END"
_MS = "list_filter(string_split(substring(u, 2), ''), lambda x: x <> '')"
_REPAIRED = f"nfc_normalize(array_to_string(list_transform(regexp_extract_all(word, '\\P{{Mn}}\\p{{Mn}}*'), lambda u: substring(u, 1, 1) || array_to_string(list_filter({_MS}, lambda m, i: NOT list_contains(list_transform(({_MS})[1:i - 1], lambda y: {_KIND('y')}), {_KIND('m')})), '')), ''))"


@query("mark_repair", f"SELECT word, n, repaired FROM (SELECT word, count(*) AS n, {_REPAIRED} AS repaired FROM (SELECT unnest(regexp_split_to_array(text_yi_pointed, '\\s+')) AS word FROM annotations_gold WHERE text_yi_pointed IS NOT NULL) GROUP BY word) WHERE repaired <> word")
def mark_repair(spark, d):
    """Pointed words whose marks had to be put in order, and how often each occurs."""
    each = table(spark, d, "annotations_gold").select(F.explode(F.split("text_yi_pointed", r"\s+")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return each.withColumn("repaired", G.repair_marks(F.col("word"))).where("repaired <> word")

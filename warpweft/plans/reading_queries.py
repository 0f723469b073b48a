"""Queries that read words by rules supplied as rows, and place their stress."""

from __future__ import annotations

from pyspark.sql import functions as F

from warpweft.functions import phones as P
from warpweft.functions import phonology as G
from warpweft.functions import readings as R
from warpweft.functions import text as T
from warpweft.functions.text import tolerant_pattern
from warpweft.operators import kernel as K
from warpweft.operators import pointing as N
from warpweft.plans.registry import query
from warpweft.sources.tables import table

_PATAH, _QAMATS, _DAGESH, _RAFE, _SIN = "ַ", "ָ", "ּ", "ֿ", "ׂ"


def _rules() -> list[K.Rule]:
    """A small rule table of a caller: context, marks, what was written, and a state, each used by some rule."""
    rows = [
        ("א", "", "^", "[וי]", "", "", "", ""), ("א", _QAMATS, "", "", "", "", "o", "open"), ("א", "", "", "", "", "", "a", "open"), ("וו", "", "", "", "", "", "v", ""), ("וי", "", "", "", "", "", "oy", "open"),
        ("יי", _PATAH, "", "", "", "", "ay", "open"), ("יי", "", "", "", "", "", "ey", "open"), ("ו", "", "", "", "", "", "u", "open"), ("י", "", "^", "", "", "", "y", ""), ("י", "", "", "", "", "", "i", "open"), ("ע", "", "", "", "", "", "e", "open"),
        ("ה", "", "", "$", "[aeiou]", "", "", ""), ("ה", "", "", "", "", "", "h", ""), ("כ", _DAGESH, "", "", "", "", "k", ""), ("פ", _DAGESH, "", "", "", "", "p", ""), ("פ", _RAFE, "", "", "", "", "f", ""), ("פ", "", "", "", "", "hush", "p", ""), ("פ", "", "", "", "", "", "f", ""),
        ("ש", _SIN, "", "", "", "", "s", ""), ("ש", "", "", "", "", "", "sh", "hush"), ("ת", _DAGESH, "", "", "", "", "t", ""), ("ב", "", "", "$", "", "open", "v", ""),
    ]
    single = {"ב": "b", "ג": "g", "ד": "d", "ז": "z", "ח": "kh", "ט": "t", "כ": "kh", "ך": "kh", "ל": "l", "מ": "m", "ם": "m", "נ": "n", "ן": "n", "ס": "s", "ף": "f", "צ": "ts", "ץ": "ts", "ק": "k", "ר": "r", "ת": "s"}
    rows += [(k, "", "", "", "", "", v, "") for k, v in single.items()]
    return [K.Rule(n, letters, marks, before, after, tail, state, out, to) for n, (letters, marks, before, after, tail, state, out, to) in enumerate(rows, 1)]


_VALUES = ", ".join(str((r.rank, r.letters, r.marks, r.before, r.after, r.tail, r.state, r.out, r.to_state)) for r in _rules())
_AUTOMATON = f"""WITH RECURSIVE rules(rank, letters, marks, before, after, tail, state, written, to_state) AS (VALUES {_VALUES}),
    w AS (SELECT word, list_transform(u, lambda x: regexp_replace(x, '\\p{{M}}', '', 'g')) AS b, u FROM (SELECT DISTINCT word, regexp_extract_all(nfc_normalize(word), '\\P{{M}}\\p{{M}}*') AS u FROM g2p_gold_v3 WHERE word IS NOT NULL)),
    run AS (SELECT word, 1 AS p, '' AS line, '' AS held FROM w UNION ALL
    SELECT word, p + coalesce(hit.n, 1), line || coalesce(hit.o, u[p]), coalesce(hit.s, '') FROM (SELECT run.word, run.p, run.line, run.held, w.u, (SELECT arg_min(struct_pack(n := length(r.letters), o := r.written, s := r.to_state), r.rank) FROM rules r
      WHERE starts_with(array_to_string(w.b[run.p:], ''), r.letters) AND (r.marks = '' OR contains(array_to_string(w.u[run.p:run.p + length(r.letters) - 1], ''), r.marks)) AND (r.before = '' OR regexp_matches(array_to_string(w.b[1:run.p - 1], ''), '(?:' || r.before || ')$'))
      AND (r.after = '' OR regexp_matches(array_to_string(w.u[run.p + length(r.letters):], ''), '^(?:' || r.after || ')')) AND (r.tail = '' OR regexp_matches(run.line, '(?:' || r.tail || ')$')) AND (r.state = '' OR r.state = run.held)) AS hit
      FROM run JOIN w ON w.word = run.word WHERE run.p <= len(w.u)))
    SELECT run.word, run.line AS latin FROM run JOIN w ON w.word = run.word AND run.p = len(w.u) + 1"""


@query("automaton_read", _AUTOMATON)
def automaton_read(spark, d):
    """Entries in Latin letters, as an automaton with context, marks and a state reads them."""
    words = table(spark, d, "g2p_gold_v3").where("word IS NOT NULL").select("word").distinct()
    return K.transliterate(words, "word", _rules()).select("word", "latin")


# Phones of Latin spellings.
_PHONES = {"tsh": "ʧ", "kh": "x", "sh": "ʃ", "zh": "ʒ", "ts": "ʦ", "ay": "aj", "ey": "ej", "oy": "ɔj", "e": "ɛ", "o": "ɔ", "g": "ɡ", "y": "j"}


def _nested(column: str) -> str:
    keys = sorted(_PHONES, key=lambda k: (-len(k), k))
    for n, k in enumerate(keys):
        column = f"replace({column}, '{k}', chr({0xE000 + n}))"
    for n, k in enumerate(keys):
        column = f"replace({column}, chr({0xE000 + n}), '{_PHONES[k]}')"
    return column


@query("latin_phones", f"SELECT gold, {_nested('gold')} AS ipa FROM (SELECT DISTINCT gold FROM g2p_gold_v3 WHERE gold IS NOT NULL)")
def latin_phones(spark, d):
    """Phones of the Latin spelling of each entry, the longest spelling first."""
    g = table(spark, d, "g2p_gold_v3").where("gold IS NOT NULL").select("gold").distinct()
    return g.select("gold", K.longest_match(F.col("gold"), _PHONES).alias("ipa"))


# A caller's lists for the stress of Latin spellings; one letter each spells a vowel here.
_STRESS = G.StressRules(nuclei=("a", "e", "i", "o", "u"), separable={"arum": 1, "unter": 0, "iber": 0, "on": 0}, seams=("khg", "fm", "sb"), tonic=("ir", "ur", "ent"), neutral=("ung", "en", "n"), unstressed=("ge", "far", "be", "der"), endings={"be": ("n", "t"), "der": ("n", "t")}, clitics=("iz", "in"))
_C = lambda x: f"length(regexp_replace({x}, '[^aeiou]', '', 'g'))"
_TONIC = lambda x: "CASE " + " ".join(f"WHEN ends_with({x}, '{t}') AND length({x}) > {len(t)} AND NOT regexp_matches({x}, '[aeiou]{t}$') THEN {_C(f'left({x}, CAST(length({x}) - {len(t)} AS BIGINT))')}" for t in _STRESS.tonic) + " END"
_STEM = "CASE " + " ".join(f"WHEN ends_with(w, '{t}') AND {_C(f'left(w, CAST(length(w) - {len(t)} AS BIGINT))')} > 0 THEN left(w, CAST(length(w) - {len(t)} AS BIGINT))" for t in _STRESS.neutral) + " ELSE w END"
_SEPARATE = " ".join(f"WHEN regexp_matches(w, '^{p}.*[aeiou]') THEN {min(k, len([c for c in p if c in 'aeiou']) - 1)}" for p, k in _STRESS.separable.items())
_LATIN = "(SELECT DISTINCT unnest(string_split(gold, ' ')) AS w FROM g2p_gold_v3 WHERE gold IS NOT NULL)"


def _skip_sql(depth: int = 3) -> str:
    """How many unstressed prefixes are skipped, said prefix by prefix to a depth that no entry exceeds."""
    sql, rest = "0", "w"
    for _ in range(depth):
        cut = "CASE " + " ".join(f"WHEN regexp_matches({rest}, '^{p}.*[aeiou]')" + (f" AND regexp_matches(w, '({'|'.join(_STRESS.endings[p])})$')" if p in _STRESS.endings else "") + f" THEN substring({rest}, {len(p) + 1})" for p in _STRESS.unstressed) + " END"
        sql = f"{sql} + CASE WHEN {cut} IS NOT NULL THEN 1 ELSE 0 END"
        rest = f"({cut})"
    return sql


@query(
    "stress_places",
    f"""SELECT w AS word, CAST(CASE WHEN {_C('w')} = 0 THEN NULL {_SEPARATE} WHEN regexp_matches(w, '[aeiou].*?(khg|fm|sb).*[aeiou]') THEN 0 WHEN {_TONIC('w')} IS NOT NULL THEN least({_TONIC('w')}, {_C('w')} - 1)
    WHEN {_TONIC('stem')} IS NOT NULL THEN least({_TONIC('stem')}, {_C('w')} - 1) ELSE least({_skip_sql()}, {_C('w')} - 1) END AS INTEGER) AS place FROM (SELECT w, {_STEM} AS stem FROM {_LATIN})""",
)
def stress_places(spark, d):
    """Which vowel of each Latin spelling bears the stress, by the first rule that applies."""
    w = table(spark, d, "g2p_gold_v3").where("gold IS NOT NULL").select(F.explode(F.split("gold", " ")).alias("word")).distinct()
    return w.select("word", G.stress_place(F.col("word"), _STRESS).alias("place"))


_ONSETS = ["shl", "shm", "shp", "sht", "shv", "bl", "br", "dr", "fl", "fr", "gl", "gr", "kl", "kn", "kr", "pl", "pr", "st", "str", "tr", "tsv"]
_UNITS = ["tsh", "kh", "sh", "ts", "zh"]
_LEGAL = ", ".join(f"'{o}'" for o in [*_ONSETS, *_UNITS])


_CUT = "(CASE WHEN c = '' THEN 0 ELSE list_min(list_filter(range(1, length(c) + 1), lambda k: substring(c, k) IN ({l}) OR k = length(c))) END)".replace("{l}", _LEGAL)


@query(
    "syllables",
    f"""WITH p AS (SELECT w, regexp_extract_all(w, '[^aeiou]*[aeiou]') AS parts, regexp_extract(w, '([^aeiou]*)$', 1) AS coda FROM {_LATIN}),
    e AS (SELECT w, coda, len(parts) AS n, i, parts[i] AS part, left(parts[i], CAST(length(parts[i]) - 1 AS BIGINT)) AS c FROM (SELECT w, coda, parts, unnest(range(1, len(parts) + 1)) AS i FROM p)),
    x AS (SELECT w, coda, i, CASE WHEN i = 1 THEN part WHEN c = '' THEN '-' || part ELSE left(c, CAST({_CUT} - 1 AS BIGINT)) || '-' || substring(part, CAST({_CUT} AS BIGINT)) END AS s FROM e)
    SELECT w AS word, string_agg(s, '' ORDER BY i) || coda AS syllables FROM x GROUP BY w, coda UNION ALL SELECT w, w FROM p WHERE len(parts) = 0""",
)
def syllables(spark, d):
    """Latin spellings cut into syllables, each with the longest legal onset."""
    w = table(spark, d, "g2p_gold_v3").where("gold IS NOT NULL").select(F.explode(F.split("gold", " ")).alias("word")).distinct()
    return w.select("word", F.array_join(G.syllables(F.col("word"), "[aeiou]", _ONSETS, _UNITS), "-").alias("syllables"))


# Names of letters.
_NAMES = {"א": "alɛf", "ב": "bejs", "ג": "ɡiml", "ד": "dalɛd", "ה": "hej", "ו": "vɔv", "ז": "zajɛn", "ח": "xɛs", "ט": "tɛs", "י": "jud", "כ": "xɔf", "ל": "lamɛd", "מ": "mɛm", "נ": "nun", "ס": "samɛx", "ע": "ajɛn", "פ": "fej", "צ": "ʦadɛk", "ק": "kuf", "ר": "rejʃ", "ש": "ʃin", "ת": "sɔf"}


@query("letter_names", f"SELECT word, array_to_string(list_transform(string_split(word, ''), lambda c: MAP {{{', '.join(f'{k!r}: {v!r}' for k, v in _NAMES.items())}}}[c]), ' ') AS spelled FROM (SELECT DISTINCT word FROM g2p_gold_v3 WHERE regexp_matches(word, '^[{''.join(_NAMES)}]{{1,3}}$'))")
def letter_names(spark, d):
    """Short entries spelled out by the names of their letters, where each has one."""
    g = table(spark, d, "g2p_gold_v3").where(F.length("word").between(1, 3)).select("word").distinct()
    return g.select("word", K.letter_names(F.col("word"), _NAMES).alias("spelled")).where(F.col("spelled").isNotNull() & ~F.col("word").rlike("[\"']"))


_STEMS = [("שלום", "שאָלעם"), ("תורה", "טוירע"), ("געזאגט", "געזאָגט")]
_SUB = "nfc_normalize(text_yi_pointed)"
for _a, _b in _STEMS:
    _SUB = f"regexp_replace({_SUB}, '{tolerant_pattern(_a)}', '{_b}', 'g')"


@query("stem_substitution", f"SELECT ann_id, {_SUB} AS changed FROM annotations_gold WHERE {_SUB} <> nfc_normalize(text_yi_pointed)")
def stem_substitution(spark, d):
    """Pointed chunks in which a stem was replaced, however its letters are pointed."""
    a = table(spark, d, "annotations_gold").select("ann_id", T.composed(F.col("text_yi_pointed")).alias("t"))
    return a.select("ann_id", "t", K.substitute_stems(F.col("t"), _STEMS).alias("changed")).where("changed <> t").drop("t")


_READ = "(SELECT DISTINCT ipa FROM stress_tts WHERE ipa IS NOT NULL)"
_BARE = f"(SELECT DISTINCT unnest(string_split(replace(ipa, 'ˈ', ''), ' ')) AS word FROM {_READ})"
_SEG = f"regexp_extract_all(word, '{P.VOWEL}|.')"
_VP = f"list_filter(range(1, len(s) + 1), lambda i: regexp_matches(s[i], '^({P.VOWEL})$'))"
_FP = f"list_filter(range(1, len(s) + 1), lambda i: regexp_matches(s[i], '^({P.VOWEL})$') AND s[i] <> 'ə')"


@query(
    "penult_stress",
    f"""SELECT word, CASE WHEN len(v) < 2 THEN word ELSE array_to_string(list_transform(s, lambda x, i: CASE WHEN i = p THEN 'ˈ' || x ELSE x END), '') END AS marked FROM (SELECT word, s, v, CASE WHEN len(f) >= 2 THEN f[len(f) - 1] WHEN len(f) = 1 THEN f[1] ELSE v[len(v) - 1] END AS p
    FROM (SELECT word, s, {_VP} AS v, {_FP} AS f FROM (SELECT word, {_SEG} AS s FROM {_BARE})))""",
)
def penult_stress(spark, d):
    """Bare words of the readings with stress on the last full vowel but one."""
    words = table(spark, d, "stress_tts").where("ipa IS NOT NULL").select(F.explode(F.split(F.replace("ipa", F.lit(P.STRESS), F.lit("")), " ")).alias("word")).distinct()
    return words.select("word", G.penult_stress(F.col("word")).alias("marked"))


def _respelt(column: str) -> str:
    for a, b in G.RESPELLING:
        column = f"replace({column}, '{a}', '{b}')"
    return column


@query(
    "respelling",
    f"""SELECT ipa, array_to_string(list_transform(string_split({_respelt('ipa')}, 'ˈ'), lambda p, i: CASE WHEN i = 1 THEN p ELSE regexp_extract(p, '^([^aeiouy]*)', 1) || upper(regexp_extract(p, '^[^aeiouy]*([aeiouy]*)', 1)) || regexp_extract(p, '(?s)^[^aeiouy]*[aeiouy]*(.*)$', 1) END), '') AS latin FROM {_READ}""",
)
def respelling(spark, d):
    """Readings in Latin letters, stressed vowels in capitals."""
    return table(spark, d, "stress_tts").where("ipa IS NOT NULL").select("ipa").distinct().select("ipa", G.respell(F.col("ipa")).alias("latin"))


#: How points spell the vowels of the readings; a caller's convention.
CONVENTION = N.Convention(
    points={_PATAH: "a", _QAMATS: "ɔ", "ֵ": "ej", "ֶ": "ɛ", "ִ": "i", "ֹ": "ɔj", "ֻ": "i"}, lettered={("ו", _DAGESH): "i", ("א", _PATAH): "a", ("א", _QAMATS): "ɔ"}, carriers="אוי",
    allowed={"a": frozenset({"a", "aː", "aj", "ə"}), "ɔ": frozenset({"ɔ", "ə"}), "ej": frozenset({"ej", "ɛ", "aj", "ə"}), "ɛ": frozenset({"ɛ", "ə"}), "i": frozenset({"i", "ə"}), "ɔj": frozenset({"ɔj", "ə"})},
    nuclei=tuple(sorted(P.VOWELS, key=len, reverse=True)), silent=frozenset({"ə", "ɛ", "i", "ɔ", "ɔj", "ej", "aj", "a"}), tail=frozenset(), dropped={"a": "ɔ"},
)


def _aligned(spark, d):
    s = table(spark, d, "stress_tts").where("pointed_yi IS NOT NULL AND ipa IS NOT NULL").select(F.split("pointed_yi", " ").alias("p"), F.split("ipa", " ").alias("i"))
    each = s.where("size(p) = size(i)").select(F.explode(F.arrays_zip("p", "i")).alias("z"))
    strip = lambda c: F.regexp_replace(c, "[.,!?/;:]", "")
    return each.select(strip("z.p").alias("pointed"), strip("z.i").alias("ipa")).distinct()


@query("reconciled_pointing", None)
def reconciled_pointing(spark, d):
    """Pointed words and their readings, by whether the points say what is read."""
    return N.reconciled(_aligned(spark, d), "pointed", "ipa", CONVENTION).groupBy("status").agg(F.count("*").alias("n"))


@query("round_trip", None)
def round_trip(spark, d):
    """Pointed words whose reading by rules has the vowels of the published reading, and those where it hasn't."""
    reader = K.Reader(_rules(), _PHONES, _STRESS)
    read = K.read(_aligned(spark, d), "pointed", reader, name="by_rule")
    return read.select(R.vowels_agree(F.col("by_rule"), F.col("ipa")).alias("agree")).groupBy("agree").agg(F.count("*").alias("n"))

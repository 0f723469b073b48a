"""Column builders for text: normalization, keys, edges, tokens and checks. All are evaluated in the JVM."""

from __future__ import annotations

import re
import unicodedata
from functools import cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# One-character digraphs, final letters, and kinds of dash, apostrophe and double quote.
DIGRAPHS = {"װ": "וו", "ױ": "וי", "ײ": "יי"}
FINALS = {"ך": "כ", "ם": "מ", "ן": "נ", "ף": "פ", "ץ": "צ"}
DASHES, APOSTROPHES, QUOTES = "־‐‑‒–—", "׳ʼ‘’`", "״“”"
# Names of HTML entities and their characters.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}
BLANK = r"[ \t\n\r]+"
_WORD = re.compile(r"[^ \t\n\r]+")
# Signs of direction and of no width; accents that carry no vowel.
NO_WIDTH = "\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2066\u2067\u2068\u2069\ufeff"
CANTILLATION = "[\u0591-\u05af]"
POINTS = "\u05b0-\u05bb\u05c7"
MARKS = "\u0591-\u05bd\u05bf\u05c1\u05c2\u05c4\u05c5\u05c7"
#: What may stand around a token without belonging to it: any sign but an apostrophe, which is part of many abbreviations.
EDGE = rf"^[^\p{{L}}\p{{N}}'{APOSTROPHES}]+|[^\p{{L}}\p{{N}}\p{{M}}'{APOSTROPHES}]+$"


def decomposed(text: Column) -> Column:
    """Canonical decomposition (NFD); null stays null. ASCII text is left as it is."""
    safe = F.coalesce(text, F.lit(""))
    done = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), safe, F.lit(False))
    return F.when(text.isNull(), F.lit(None)).when(~safe.rlike(r"[^\x00-\x7f]"), safe).otherwise(done)


def composed(text: Column) -> Column:
    """Canonical composition (NFC); null stays null."""
    safe = F.coalesce(text, F.lit(""))
    done = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), safe, F.lit(False))
    return F.when(text.isNull(), F.lit(None)).when(~safe.rlike(r"[^\x00-\x7f]"), safe).otherwise(done)


@cache
def base_letters() -> tuple[str, str]:
    """Characters that are a letter with marks, and these letters: the arguments of ``translate``. Made from the Unicode data."""
    marked, bare = [], []
    for code in [*range(0xA0, 0x2000), *range(0xFB1D, 0xFB50)]:
        parts = unicodedata.normalize("NFD", chr(code))
        left = unicodedata.normalize("NFC", "".join(c for c in parts if unicodedata.category(c) != "Mn"))
        if len(left) == 1 and left != chr(code):
            marked.append(chr(code))
            bare.append(left)
    return "".join(marked), "".join(bare)


def strip_marks(text: Column) -> Column:
    """Text without combining marks. Deterministic and compiled, unlike ``composed``, so that the planner may move it."""
    return F.regexp_replace(F.translate(text, *base_letters()), r"\p{Mn}", "")


def unify_signs(text: Column) -> Column:
    """Every dash as ``-``, apostrophe as ``'`` and double quote as ``"``."""
    return F.translate(text, DASHES + APOSTROPHES + QUOTES, "-" * len(DASHES) + "'" * len(APOSTROPHES) + '"' * len(QUOTES))


def normal_surface(text: Column) -> Column:
    return unify_signs(composed(text))


def fold_letters(text: Column, finals: bool = True) -> Column:
    """Digraphs as two letters and, if wanted, final letters as their common form."""
    folded = reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), DIGRAPHS.items(), text)
    return F.translate(folded, "".join(FINALS), "".join(FINALS.values())) if finals else folded


def lookup_key(word: Column) -> Column:
    """The key under which a word is looked up: signs unified, marks stripped, digraphs and final letters folded."""
    return fold_letters(strip_marks(unify_signs(word)))


def edges(token: Column) -> tuple[Column, Column, Column]:
    """Leading signs, core and trailing signs of a token; apostrophes stay with the core. The core of a token of signs only is empty and all is leading."""
    pattern = rf"(?s)^([^\p{{L}}\p{{N}}'{APOSTROPHES}]*)(.*?)([^\p{{L}}\p{{N}}\p{{M}}'{APOSTROPHES}]*)$"
    signs = ~token.rlike(r"[\p{L}\p{N}]")
    whole = (token, F.lit(""), F.lit(""))
    return tuple(F.when(signs, whole[k]).otherwise(F.regexp_extract(token, pattern, k + 1)) for k in range(3))


def core(token: Column) -> Column:
    return F.when(token.rlike(r"[\p{L}\p{N}]"), F.regexp_replace(token, EDGE, "")).otherwise("")


def tokens(text: Column) -> Column:
    """Tokens between blanks, signs at their edges included; an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda t: t != "")


def words(text: Column) -> Column:
    """Lower-cased cores of the tokens that have one."""
    return F.filter(F.transform(tokens(text), lambda t: F.lower(core(t))), lambda w: w != "")


def words_or_null(text: Column) -> Column:
    """Lower-cased cores of all tokens; null stands for a token without one, so that runs of words can't bridge it."""
    return F.transform(tokens(text), lambda t: F.nullif(F.lower(core(t)), F.lit("")))


def following_words(text: Column) -> Column:
    """Like ``words_or_null``, but null as well for a word that a sign parts from the word before: what may continue a phrase."""

    def joined(before: Column, t: Column) -> Column:
        parted = before.rlike(rf"[^\p{{L}}\p{{N}}\p{{M}}'{APOSTROPHES}]$") | t.rlike(rf"^[^\p{{L}}\p{{N}}'{APOSTROPHES}]")
        return F.when(~parted, F.nullif(F.lower(core(t)), F.lit("")))

    every = tokens(text)
    return F.slice(F.zip_with(F.array_insert(every, 1, F.lit("")), every, joined), F.lit(1), F.size(every))


def without_signs_of_direction(text: Column) -> Column:
    return F.translate(text, NO_WIDTH, "")


def corpus_fold(text: Column, cantillation: bool = True) -> Column:
    """Composed text, digraphs as two letters, without signs of no width; if wanted, without cantillation and with blanks squeezed."""
    folded = without_signs_of_direction(fold_letters(composed(text), finals=False))
    return folded if cantillation else squeeze(F.regexp_replace(folded, CANTILLATION, ""))


def convention(text: Column, kept: str = POINTS + "\u05bc\u05bf\u05c1\u05c2") -> Column:
    """``corpus_fold`` of the normal surface, with no mark of the script but those ``kept``."""
    return F.regexp_replace(corpus_fold(normal_surface(text)), f"[{MARKS}&&[^{kept}]]", "")


def first_point(marks: Column) -> Column:
    """The first vowel point of a string of marks, empty if there is none."""
    return F.regexp_extract(marks, f"[{POINTS}]", 0)


def tolerant_pattern(literal: str) -> str:
    """A pattern that matches a literal with any marks after each of its letters."""
    bare = "".join(c for c in unicodedata.normalize("NFD", literal) if unicodedata.category(c) != "Mn")
    return "".join(re.escape(c) + f"[{MARKS}]*" for c in bare)


def edition_fold(word: Column, hard: str = "\u05d1\u05db\u05e4\u05ea") -> Column:
    """A pointed word without the marks on which printed editions differ and no reading depends.

    The dot inside a letter goes, but in the letters ``hard`` after the first; one point in two code points is one; the dot above vov goes.
    """
    w = F.translate(composed(word), "\u05c7", "\u05b8")
    first = F.regexp_replace(w, rf"^(\P{{M}}[{MARKS}&&[^\u05bc]]*)\u05bc", "$1")
    soft = F.regexp_replace(first, rf"([\P{{M}}&&[^{hard}]][{MARKS}&&[^\u05bc]]*)\u05bc", "$1")
    return F.regexp_replace(soft, rf"(\u05d5[{MARKS}&&[^\u05b9\u05ba]]*)[\u05b9\u05ba]", "$1")


def book_tokens(text: Column) -> Column:
    """Pointed words of a printed segment: cut at blanks, hyphens and bars, without tags, cantillation and signs at the edges."""
    bare = F.regexp_replace(F.regexp_replace(text, r"<[^<>]*>", " "), CANTILLATION, "")
    pieces = F.split(composed(bare), "[\\s\u05be\u05c0|-]+")
    cut = F.transform(pieces, lambda t: F.regexp_replace(t, rf"^[^\u05d0-\u05ea\u05f0-\u05f2]+|[^\u05d0-\u05ea\u05f0-\u05f2{MARKS}'\"]+$", ""))
    return F.filter(cut, lambda w: w != "")


def strip(text: Column) -> Column:
    """Text without blanks of any kind at its ends."""
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def squeeze(text: Column) -> Column:
    return strip(F.regexp_replace(text, BLANK, " "))


def clean_markup(text: Column) -> Column:
    """Text without tags and bracketed cues, entities decoded, blanks squeezed."""
    bare = F.regexp_replace(F.regexp_replace(text, r"<[^<>]*>", " "), r"\[[^\[\]]*\]", " ")
    return squeeze(reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), ENTITIES.items(), bare))


def letter_units(word: Column) -> Column:
    """``[(base, marks)]``: each character that isn't a mark with the marks after it."""
    unit = F.regexp_extract_all(decomposed(word), F.lit(r"(\P{Mn}\p{Mn}*)"), F.lit(1))
    return F.transform(unit, lambda u: F.struct(F.substring(u, 1, 1).alias("base"), F.substring(u, F.lit(2), F.length(u)).alias("marks")))


def join_marks(text: Column, marks: Column) -> Column:
    """Pointed text of bare text and one entry of marks per character; null without equally many entries."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    joined = F.array_join(F.zip_with(letters, marks, lambda c, m: F.concat(c, F.coalesce(m, F.lit("")))), "")
    return F.when(F.size(letters) == F.size(marks), joined)


def first_reason(checks: list[tuple[str, Column]], otherwise: str = "ok") -> Column:
    """Name of the first check that holds."""
    chain = F
    for name, holds in checks:
        chain = chain.when(holds, name)
    return chain.otherwise(otherwise)


def problem_codes(checks: list[tuple[str, Column]]) -> Column:
    """Names of all checks that hold."""
    return F.filter(F.array(*[F.when(holds, name) for name, holds in checks]), lambda x: x.isNotNull())


def sentences(text: Column) -> Column:
    """Sentences of a text, with their closing signs."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])[ \t]+|[\r\n]+"), F.trim), lambda s: s != "")


def cut_sentences(text: Column, least: int = 8, most: int = 25) -> Column:
    """Sentences of at most ``most`` words: longer ones are cut after a comma once a piece has ``least`` words, else at ``most``.

    One pattern does the cutting, from left to right, so no list is built up word by word.
    """
    ends = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+"), lambda s: squeeze(s)), lambda s: s != "")
    piece = rf"((?:\S+ ){{{least - 1},{most - 1}}}?\S*,(?= |$)|(?:\S+ ){{{most - 1}}}\S+(?= |$)|\S.*)"
    return F.flatten(F.transform(ends, lambda s: F.when(F.size(F.split(s, " ")) <= most, F.array(s)).otherwise(F.regexp_extract_all(s, F.lit(piece), F.lit(1)))))


def budget_chunks(text: Column, limit: int, cut_words: bool = False) -> Column:
    """Consecutive pieces of a text that give it when put together: of at most ``limit`` characters, ending after a blank where one is.

    A longer word is a piece of its own, or is cut at the limit if wanted. An empty array for null or empty text.
    """
    over = rf".{{1,{limit}}}" if cut_words else r"\S+\s*"
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?s)(.{{1,{limit}}}\z|.{{0,{limit - 1}}}\s|{over})"), F.lit(1))


def marked_chunks(text: Column, marks: Column, limit: int) -> Column:
    """``[(text, marks)]``: pieces of a text as by ``budget_chunks``, each with the marks of its characters; empty without equally many marks."""
    pieces = budget_chunks(text, limit, cut_words=True)
    ends = F.aggregate(pieces, F.array(F.lit(0)), lambda acc, p: F.array_append(acc, F.element_at(acc, -1) + F.length(p)))
    zipped = F.zip_with(pieces, F.slice(ends, F.lit(1), F.size(pieces)), lambda p, b: F.struct(p.alias("text"), F.slice(marks, b + 1, F.length(p)).alias("marks")))
    return F.when(F.length(text) == F.size(marks), zipped).otherwise(F.array().cast("array<struct<text:string,marks:array<string>>>"))


def _spans(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else [{"word": m.group(), "begin": m.start(), "end": m.end()} for m in _WORD.finditer(t)])


def word_spans(text: Column) -> Column:
    """Words of the text as it is, with their places in characters from 0; null for null.

    Places add up along a text, which built-in functions only do in quadratic time, so this is done in Arrow batches.
    """
    return F.pandas_udf(_spans, "array<struct<word:string,begin:int,end:int>>")(text)


def json_strings(text: Column) -> Column:
    """All strings of a JSON value at any depth, in order, keys left out; null if it isn't JSON."""
    literal = r'("[^"\\]*+(?:\\.[^"\\]*+)*+"\s*:?)'
    found = F.filter(F.regexp_extract_all(text, F.lit(literal), F.lit(1)), lambda s: ~s.endswith(":"))
    values = F.from_json(F.concat(F.lit("["), F.array_join(found, ","), F.lit("]")), "array<string>")
    return F.when(F.try_parse_json(text).isNotNull(), F.filter(values, lambda s: F.trim(s) != ""))


def first_captures(markup: Column, block: str, inside: str) -> Column:
    """``[(id, value)]``: for each block of markup that begins with ``block``, whose group is the id, the first match of ``inside`` before the next block begins."""
    pieces = F.split(F.regexp_replace(markup, f"({block})", "\u0001$1"), "\u0001")
    pieces = F.slice(pieces, F.lit(2), F.size(pieces))
    each = F.transform(pieces, lambda p: F.struct(F.regexp_extract(p, block, 1).alias("id"), F.nullif(F.regexp_extract(p, inside, 1), F.lit("")).alias("value")))
    return F.filter(each, lambda x: x["value"].isNotNull())


def spelling_candidates(word: Column, swaps: list[tuple[str, str]]) -> Column:
    """Other spellings of a word, one for each swap that changes it, each once, in list order; never the word itself."""
    return F.filter(F.array_distinct(F.array(*[F.replace(word, F.lit(a), F.lit(b)) for a, b in swaps])), lambda w: w != word)


def preprocessed(text: Column, contractions: list[tuple[str, str]], abbreviations: list[tuple[str, str]], swaps: list[tuple[str, str]]) -> Column:
    """A line made ready for reading: double quotes dropped, contractions, then abbreviations written out as whole words, then patterns replaced; all lists are the caller's."""
    t = F.translate(normal_surface(text), '"', "")
    for short, full in [*contractions, *abbreviations]:
        t = F.regexp_replace(t, rf"(?<![\p{{L}}\p{{M}}']){re.escape(short)}(?![\p{{L}}\p{{M}}'])", full)
    for pattern, to in swaps:
        t = F.regexp_replace(t, pattern, to)
    return t

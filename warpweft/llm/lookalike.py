"""Forms of text that look the same, brought to one form (columns only, evaluated in the JVM).

``look_form`` keeps all that a reader sees: letters, vowel points, case and punctuation. ``look_words``
keeps only the words, for comparisons in which points, case and punctuation don't count.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of other scripts that look like a Latin letter, after the letter itself.
LATIN_LOOKALIKES = {
    "A": "ΑАᎪᗅ", "B": "ΒВᏴ", "C": "СϹᏟⅭ", "D": "ᎠⅮ", "E": "ΕЕᎬ", "F": "Ϝ", "G": "ԌᏀ", "H": "ΗНᎻ",
    "I": "ΙІӀᏆⅠ", "J": "ЈᎫͿ", "K": "ΚКᏦK", "L": "ᏞⅬ", "M": "ΜМᎷⅯ", "N": "Ν", "O": "ΟОՕ", "P": "ΡРᏢ",
    "Q": "Ԛ", "R": "ᎡᏒ", "S": "ЅᏚՏ", "T": "ΤТᎢ", "U": "Ս", "V": "ѴᏙⅤ", "W": "ԜᎳ", "X": "ΧХⅩ", "Y": "ΥҮ", "Z": "ΖᏃ",
    "a": "аɑ", "c": "сϲⅽ", "d": "ԁⅾ", "e": "е", "g": "ɡ", "h": "һ", "i": "іⅰ", "j": "јϳ", "l": "ⅼ", "m": "ⅿ", "n": "ո",
    "o": "οоօ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "u": "ս", "v": "ѵⅴν", "w": "ԝ", "x": "хⅹ", "y": "уү",
}
# Kinds of one sign.
APOSTROPHES = "'‘’‛ʼʹʻʽˈ`´′׳՚＇"
QUOTES = "\"“”„‟″״ˮ＂«»"
HYPHENS = "-‐‑‒–—―−־﹘﹣－⁃⸺"
PUNCTUATION_LOOKALIKES = {",": "‚，﹐", ".": "．․﹒。", "!": "！ǃ﹗", "?": "？﹖", ":": "：∶﹕׃", ";": "；;﹔", "(": "（", ")": "）", "/": "⁄∕／", "|": "׀"}
# Yiddish one-character forms and the letters they stand for; mathematical forms of Hebrew letters.
DIGRAPHS = {"װ": "וו", "ױ": "וי", "ײ": "יי"}
HEBREW_SYMBOLS = {"ℵ": "א", "ℶ": "ב", "ℷ": "ג", "ℸ": "ד"}
# A vowel point that is drawn like another one, after that one.
POINT_LOOKALIKES = {"\u05b8": "\u05c7"}

INVISIBLE = r"[\p{Cf}͏ᅟᅠ᠋-᠍︀-️]"
BLANKS = r"[\s\p{Z}\u0085]+"
POINTS = r"[֑-ׇֽֿׁׂׅׄ]"


@cache
def compatibility_pairs() -> tuple[str, str]:
    """Characters that are a wide, narrow or styled typing of one other character, and these others."""
    wide, plain = [], []
    for code in [*range(0xA0, 0x3000), *range(0xFB00, 0x10000), *range(0x1D400, 0x1D800)]:
        tag, _, to = unicodedata.decomposition(chr(code)).partition("> ")
        if tag in ("<wide", "<narrow", "<font") and " " not in to and unicodedata.category(chr(code))[0] in "LNPS":
            wide.append(chr(code))
            plain.append(unicodedata.normalize("NFKD", chr(code)))
    return "".join(w for w, p in zip(wide, plain) if len(p) == 1), "".join(p for p in plain if len(p) == 1)


@cache
def look_pairs(fold_case_alike: bool = True) -> tuple[str, str]:
    """The whole one-to-one table as the two arguments of ``translate``."""
    table = dict(zip(*compatibility_pairs()))
    groups = [*PUNCTUATION_LOOKALIKES.items(), ("'", APOSTROPHES), ('"', QUOTES), ("-", HYPHENS), *HEBREW_SYMBOLS_GROUPS(), *POINT_LOOKALIKES.items()]
    if fold_case_alike:
        groups += LATIN_LOOKALIKES.items()
    for sign, kinds in groups:
        table.update((k, sign) for k in kinds if k != sign)
    return "".join(table), "".join(table.values())


def HEBREW_SYMBOLS_GROUPS() -> list[tuple[str, str]]:
    return [(v, k) for k, v in HEBREW_SYMBOLS.items()]


def decomposed(text: Column) -> Column:
    """Canonical decomposition, marks in canonical order, by the ICU classes that ship with Spark."""
    safe = F.coalesce(text, F.lit(""))
    plain = ~safe.rlike(r"[^\x00-\x7f]")
    done = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), safe, F.lit(False))
    return F.when(text.isNull(), F.lit(None)).when(plain, safe).otherwise(done)


def composed(text: Column) -> Column:
    """Canonical composition, by the same classes."""
    safe = F.coalesce(text, F.lit(""))
    done = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), safe, F.lit(False))
    return F.when(text.isNull(), F.lit(None)).when(~safe.rlike(r"[^\x00-\x7f]"), safe).otherwise(done)


def look_form(text: Column, every_word: bool = False) -> Column:
    """One form for all values that look the same; null stays null.

    Invisible characters go; a run of blanks becomes one blank, none at the ends; apostrophes, quotes and hyphens
    become one sign each; digits, Latin letters and punctuation take the form of their look-alikes; the
    one-character forms of two letters become two letters; marks are decomposed and ordered. A Latin letter of another script is only
    mapped in a word that has no other letter of that script, so that Russian or Greek words keep theirs; with ``every_word`` it always is.
    """
    return look_of_typed(typed_form(F.regexp_replace(text, INVISIBLE, "")), every_word)


def typed_form(visible: Column) -> Column:
    """First step of ``look_form``, after invisible characters: decomposed, with one sign for all kinds of it. Spark takes the reflection in it for random, so it computes it anew for each use unless it is a column of its own."""
    return F.translate(decomposed(visible), *look_pairs(False))


def look_of_typed(t: Column, every_word: bool = False) -> Column:
    """The rest of ``look_form``."""
    source = "".join(k for kinds in LATIN_LOOKALIKES.values() for k in kinds)
    target = "".join(sign for sign, kinds in LATIN_LOOKALIKES.items() for _ in kinds)
    if every_word:
        t = F.translate(t, source, target)
    else:
        rare = F.regexp_replace(t, f"[{source}]", "")
        t = F.when(rare == t, t).when(rare.rlike(r"[\p{IsCyrillic}\p{IsGreek}]"), translate_by_word(t, source, target)).otherwise(F.translate(t, source, target))
    for one, two in DIGRAPHS.items():
        t = F.replace(t, F.lit(one), F.lit(two))
    return F.trim(F.regexp_replace(t, BLANKS, " "))


def translate_by_word(t: Column, source: str, target: str) -> Column:
    def word(w: Column) -> Column:
        rest = F.regexp_replace(w, f"[{source}]", "")
        return F.when(rest.rlike(r"[\p{IsCyrillic}\p{IsGreek}]"), w).otherwise(F.translate(w, source, target))

    return F.array_join(F.transform(F.split(t, " "), word), " ")


def bare_form(text: Column) -> Column:
    """``look_form`` without vowel points, letter case and apostrophes inside words; other signs become blanks.

    What remains are words parted by one blank; the null text gives the empty string.
    """
    return bare_of_look(look_form(F.coalesce(text, F.lit(""))))


def bare_of_look(look: Column) -> Column:
    t = F.regexp_replace(F.lower(look), r"[֑-ׇֽֿׁׂׅׄ'\"]", "")
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}\p{M}]+", " "))


def with_bare_form(rows: DataFrame, text: str, name: str) -> DataFrame:
    """``rows`` with ``bare_form`` of column ``text`` as column ``name``, its steps as columns of their own, so that each is computed once a row."""
    steps = rows.withColumn(name, F.regexp_replace(F.coalesce(F.col(text), F.lit("")), INVISIBLE, "")).withColumn(name, typed_form(F.col(name)))
    return steps.withColumn(name, look_of_typed(F.col(name))).withColumn(name, bare_of_look(F.col(name)))


def bare_words(text: Column) -> Column:
    """The words of ``bare_form``, an empty array if there are none."""
    return F.filter(F.split(bare_form(text), " "), lambda w: w != "")


@cache
def base_pairs() -> tuple[str, str]:
    """Letters with marks in one character, and their base letters, as the arguments of ``translate``."""
    marked, base = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFB1D, 0xFB50)]:
        letters = [c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)]
        if len(letters) == 1 and letters[0] != chr(code):
            marked.append(chr(code))
            base.append(letters[0])
    return "".join(marked), "".join(base)


def plain_form(text: Column) -> Column:
    """Words of letters and digits without any mark or case, parted by one blank; the null text gives the empty string.

    Built of deterministic functions only, so it may stand in a lambda.
    """
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\p{Cf}\p{Mn}]", "")
    source, target = (a + b for a, b in zip(look_pairs(False), base_pairs()))
    t = F.lower(F.translate(t, source, target))
    for one, two in DIGRAPHS.items():
        t = F.replace(t, F.lit(one), F.lit(two))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"['\"]", ""), r"[^\p{L}\p{N}]+", " "))


class BareTable(dict):
    """``bare_form`` character by character, for ``str.translate``; entries are made when first met."""

    def __init__(self) -> None:
        super().__init__()
        self.alike = dict(zip(*look_pairs(False)))

    def __missing__(self, code: int) -> str | None:
        out = []
        for c in unicodedata.normalize("NFD", chr(code)):
            if re.fullmatch(POINTS, c) or re.fullmatch(r"[\u034f\u115f\u1160\u180b-\u180d\ufe00-\ufe0f]", c) or unicodedata.category(c) == "Cf":
                continue
            c = self.alike.get(c, c)
            if c in "'\"":
                continue
            out.append(DIGRAPHS.get(c, c.lower() if unicodedata.category(c)[0] in "LNM" else " "))
        self[code] = "".join(out) or None
        return self[code]


_SCRIPTS = re.compile("[\u0370-\u052f\u13a0-\u13ff\u0531-\u058f\u1680\u15c5\u0251\u0261\u2160-\u217f\u212a]")
_OTHER_SCRIPT = re.compile("[\u0370-\u03ff\u0400-\u052f]")
_TO_LATIN = {ord(k): sign for sign, kinds in LATIN_LOOKALIKES.items() for k in kinds}
_BARE = BareTable()


_LATIN_LIKE = re.compile(f"[{''.join(map(chr, _TO_LATIN))}]")


def to_latin(text: str) -> str:
    """``text`` with look-alikes of Latin letters replaced, but in words that have another Greek or Cyrillic letter."""
    if not _SCRIPTS.search(text):
        return text
    return "".join(w if _OTHER_SCRIPT.search(_LATIN_LIKE.sub("", w)) else w.translate(_TO_LATIN) for w in re.split(r"(\s+)", text))


def bare_word_list(text: str) -> list[str]:
    """``bare_words`` for Python workers: the same words in one pass over the text."""
    return to_latin(text).translate(_BARE).split()

"""Column predicates over tokens and lines: origin, own marks, open letters, contradicted readings, validators. Marker lists are the caller's."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from warpweft.functions import phones as P
from warpweft.functions.text import MARKS, POINTS, squeeze, strip_marks

LETTERS = "\u05d0-\u05ea"


@dataclass(frozen=True)
class Origin:
    """What tells words of one origin by their spelling: a pattern of letters, endings, and the letters that spell vowels."""

    markers: str
    endings: tuple[str, ...]
    vowels: str


def share_of(text: Column, pattern: str) -> Column:
    """How many characters of a text are in a class."""
    return F.length(F.regexp_replace(text, f"[^{pattern}]", ""))


def marked(word: Column, origin: Origin) -> Column:
    """Whether a marker or an ending tells the origin."""
    bare = strip_marks(word)
    ends = F.lit(False)
    for e in origin.endings:
        ends = ends | bare.endswith(e)
    return word.rlike(origin.markers) | ends


def of_origin(word: Column, origin: Origin) -> Column:
    """``marked``, or no letter for a vowel beside two consonants or more."""
    bare = strip_marks(word)
    vowels = share_of(bare, origin.vowels)
    return marked(word, origin) | ((vowels == 0) & (share_of(bare, LETTERS) >= 2))


def own_points(word: Column) -> Column:
    """Whether a word bears vowel points itself."""
    return word.rlike(f"[{POINTS}]")


def root_of_origin(word: Column, origin: Origin) -> Column:
    """The test that a word can answer: markers only where it is pointed, since its vowels are then written as points; else ``of_origin``."""
    return F.when(own_points(word), marked(word, origin)).otherwise(of_origin(word, origin))


def lacks_mark(word: Column, letters: str, marks: str) -> Column:
    """Whether some letter of ``letters`` bears none of ``marks``: its reading is open."""
    return word.rlike(f"[{letters}](?![{MARKS}&&[^{marks}]]*[{marks}])")


def contradicted(word: Column, ipa: Column, promises: list[tuple[str, str, str]]) -> Column:
    """Whether a written mark promises a phone that the reading lacks: ``(letters, mark, phone)``. A test for one row of a lookup."""
    wrong = F.lit(False)
    for letters, mark, phone in promises:
        wrong = wrong | (word.rlike(f"[{letters}][{MARKS}]*{mark}") & ~F.contains(ipa, F.lit(phone)))
    return wrong


def agreeing_tokens(a: Column, b: Column) -> Column:
    """Share of the tokens of ``a`` that are those of ``b`` but for marks; null without equally many, or without any."""
    x, y = F.split(squeeze(a), " "), F.split(squeeze(b), " ")
    same = F.size(F.filter(F.zip_with(x, y, lambda p, q: strip_marks(p) == strip_marks(q)), lambda z: z))
    return F.when((F.size(x) == F.size(y)) & (squeeze(a) != ""), same / F.size(x))


def row_reason(text: Column, pointed: Column, least: float = 0.9, least_marks: float = 0.15) -> Column:
    """Why a row of text and pointed text can't be used: the first check it fails, else ``ok``."""
    t, p = F.coalesce(text, F.lit("")), F.coalesce(pointed, F.lit(""))
    empty = (squeeze(t) == "") | (squeeze(p) == "")
    counts = F.size(F.split(squeeze(t), " ")) != F.size(F.split(squeeze(p), " "))
    letters = share_of(p, LETTERS)
    return (
        F.when(empty, "empty").when(counts, "token_count").when(agreeing_tokens(t, p) < least, "word_mismatch").when(letters == 0, "no_letters")
        .when(share_of(p, MARKS) < least_marks * letters, "no_marks").otherwise("ok")
    )


def pointed_problems(source: Column, pointed: Column, longest_bare: int = 4) -> Column:
    """Codes of all problems of a pointed text: ``empty`` alone, or changed letters, no marks at all, and each long word without marks."""
    p = F.coalesce(pointed, F.lit(""))
    differ = squeeze(strip_marks(p)) != squeeze(strip_marks(F.coalesce(source, F.lit(""))))
    bare = F.filter(F.split(squeeze(p), " "), lambda w: w.rlike(f"^[{LETTERS}]{{{longest_bare},}}$"))
    codes = F.array_compact(F.array(F.when(differ, "letters"), F.when(~p.rlike(f"[{MARKS}]"), "no_marks")))
    return F.when(squeeze(p) == "", F.array(F.lit("empty"))).otherwise(F.concat(codes, F.transform(bare, lambda w: F.concat(F.lit("bare:"), w))))


def wrong_stress(ipa: Column) -> Column:
    """Parts of a reading with a wrong number of stress marks: words of two nuclei or more bear one, others one at most. Parts are cut at blanks and hyphens."""
    parts = F.filter(F.split(ipa, "[ -]"), lambda w: w != "")
    n = lambda w: F.regexp_count(w, F.lit(f"({P.VOWEL})"))
    s = lambda w: F.regexp_count(w, F.lit(P.STRESS))
    return F.filter(parts, lambda w: ((n(w) >= 2) & (s(w) != 1)) | ((n(w) <= 1) & (s(w) > 1)))


def reading_problems(source: Column, pointed: Column, ipa: Column, signs: str = "[.,!?;:'\"]") -> Column:
    """Codes of all problems of a pointed and read row: ``empty`` alone, or changed letters, unlike token counts, letters of the source script, symbols outside the inventory, stress."""
    p, i = F.coalesce(pointed, F.lit("")), F.coalesce(ipa, F.lit(""))
    plain = F.regexp_replace(i, signs, "")
    codes = F.array_compact(F.array(
        F.when(squeeze(strip_marks(p)) != squeeze(strip_marks(F.coalesce(source, F.lit("")))), "letters"),
        F.when(F.size(F.split(squeeze(p), " ")) != F.size(F.split(squeeze(i), " ")), "token_count"),
        F.when(i.rlike(f"[{LETTERS}]"), "script"), F.when(F.size(P.violations(plain)) > 0, "inventory"), F.when(F.size(wrong_stress(plain)) > 0, "stress"),
    ))
    return F.when((squeeze(p) == "") | (squeeze(i) == ""), F.array(F.lit("empty"))).otherwise(codes)


def additive_score(word: Column, parts: list[tuple[float, Column]], certain: Column | None = None) -> Column:
    """Sum of the weights whose condition holds, 0 at least; 1 where ``certain``."""
    total = F.lit(0.0)
    for weight, holds in parts:
        total = total + F.when(holds, weight).otherwise(0.0)
    score = F.round(F.greatest(total, F.lit(0.0)), 6)
    return score if certain is None else F.when(certain, 1.0).otherwise(score)

"""Two readings of one word compared: defects of the first by the second, agreement of vowels, stress from the end. Columns only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from warpweft.functions.phones import CONSONANTS, STRESS, VOWEL

# Symbols that stand for two consonants.
COMPOUND = {"ʧ": "tʃ", "ʦ": "ts", "ʤ": "dʒ"}
REDUCED = "ə"


def nuclei(ipa: Column) -> Column:
    """Vowels in order, longest symbol first."""
    return F.regexp_extract_all(F.coalesce(ipa, F.lit("")), F.lit(f"({VOWEL})"), F.lit(1))


def skeleton(ipa: Column) -> Column:
    """A reading without stress, hyphens as blanks, blanks squeezed."""
    return F.trim(F.regexp_replace(F.translate(ipa, STRESS + "ˌ-", "\u0001\u0001 "), "\u0001| +(?= )", ""))


def loses_consonant(a: Column, b: Column) -> Column:
    """Whether some consonant is fewer times in ``a`` than in ``b``; compound symbols count as their parts."""
    plain = lambda x: reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), COMPOUND.items(), x)
    x, y = plain(a), plain(b)
    count = lambda t, c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    return reduce(lambda seen, c: seen | (count(y, c) > count(x, c)), [c for c in CONSONANTS if c not in COMPOUND], F.lit(False))


def loses_nucleus(a: Column, b: Column) -> Column:
    """Whether ``a`` has fewer nuclei than ``b`` has full ones."""
    return F.size(nuclei(a)) < F.size(F.filter(nuclei(b), lambda v: v != REDUCED))


def only_in_first(a: Column, b: Column, symbol: str) -> Column:
    """Whether a symbol that a default produces stands in ``a`` and not in ``b``."""
    return F.contains(a, F.lit(symbol)) & ~F.contains(b, F.lit(symbol))


def stranded(ipa: Column, phone: str = "h") -> Column:
    """Whether a phone stands after one that isn't a vowel."""
    return F.regexp_replace(F.regexp_replace(ipa, f"[{STRESS} -]", ""), VOWEL, "V").rlike(f"[^V]{phone}")


def stress_from_end(ipa: Column) -> Column:
    """Place of the stressed nucleus counted from the end, -1 the last; null without a mark."""
    after = F.size(nuclei(F.substring_index(ipa, STRESS, -1)))
    return F.when(F.contains(ipa, F.lit(STRESS)) & (after > 0), -after)


def stress_retracted(a: Column, b: Column) -> Column:
    """Whether ``a`` stresses the last nucleus but two where ``b``, of as many nuclei, stresses the last but one."""
    return F.coalesce((F.size(nuclei(a)) == F.size(nuclei(b))) & (stress_from_end(b) == -2) & (stress_from_end(a) == -3), F.lit(False))


def defect(a: Column, b: Column, default: str = "oʊ") -> Column:
    """Name of the first defect of ``a`` in the light of ``b``, empty if it is sound."""
    return (
        F.when(loses_consonant(a, b), "consonant lost").when(loses_nucleus(a, b), "nucleus lost").when(only_in_first(a, b, default), "default over a point")
        .when(stranded(a) & ~stranded(b), "stranded h").when(stress_retracted(a, b), "stress retracted").otherwise("")
    )


def vowels_agree(a: Column, b: Column) -> Column:
    """Whether two readings have the same vowels, a reduced one agreeing with any, length not counting."""
    short = lambda x: F.transform(nuclei(skeleton(x)), lambda v: F.replace(v, F.lit("ː"), F.lit("")))
    x, y = short(a), short(b)
    alike = F.forall(F.zip_with(x, y, lambda p, q: (p == q) | (p == REDUCED) | (q == REDUCED)), lambda z: z)
    return (F.size(x) == F.size(y)) & F.coalesce(alike, F.lit(False))


def substitute_phones(ipa: Column, corrections: Column) -> Column:
    """A reading with the phones named in a map ``slot -> phone`` replaced, slots counted from 0; stress marks and separators stay where they are."""
    parts = F.regexp_extract_all(ipa, F.lit(f"([{STRESS} -]|{VOWEL}|.)"), F.lit(1))
    silent = lambda s: s.rlike(f"^[{STRESS} -]$")
    numbered = F.zip_with(F.transform(parts, lambda s, i: F.size(F.filter(F.slice(parts, F.lit(1), i), lambda t: ~silent(t)))), parts, lambda i, s: F.struct(i.alias("i"), s.alias("s")))
    return F.array_join(F.transform(numbered, lambda x: F.when(silent(x["s"]), x["s"]).otherwise(F.coalesce(F.element_at(corrections, x["i"]), x["s"]))), "")

"""Column builders for phone strings over a closed inventory."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from warpweft.functions.text import strip

# The closed inventory, two-character symbols first, and the stress mark.
VOWELS = ["aː", "ej", "aj", "ɔj", "oʊ", "a", "ɛ", "ə", "i", "u", "ɔ"]
CONSONANTS = "bdfɡhjklmnprstvzxʃʒʦʧʤŋ"
STRESS = "ˈ"
VOWEL = "aː|ej|aj|ɔj|oʊ|[aɛəiuɔ]"
SYMBOL = f"aː|ej|aj|ɔj|oʊ|[aɛəiuɔ{CONSONANTS}]"


def phones(ipa: Column) -> Column:
    """Phones in order, longest symbol first; stress, separators and characters outside the inventory are left out."""
    return F.regexp_extract_all(F.coalesce(ipa, F.lit("")), F.lit(f"({SYMBOL})"), F.lit(1))


def violations(ipa: Column) -> Column:
    """Characters outside the inventory, each once, in order."""
    rest = F.regexp_replace(ipa, f"{SYMBOL}|[ˈ -]", "")
    return F.array_sort(F.array_distinct(F.filter(F.split(rest, ""), lambda c: c != "")))


def coded(ipa: Column) -> Column:
    """One character for each phone: V for a vowel, C for a consonant, blank for a separator. Other characters are dropped."""
    c = F.regexp_replace(F.regexp_replace(ipa, "[V C]", " "), VOWEL, "V")
    c = F.regexp_replace(F.regexp_replace(c, f"[{CONSONANTS}]", "C"), "-", " ")
    return F.regexp_replace(c, "[^VC ]", "")


def vowel_count(ipa: Column) -> Column:
    return F.regexp_count(coded(ipa), F.lit("V"))


def consonant_count(ipa: Column) -> Column:
    return F.regexp_count(coded(ipa), F.lit("C"))


def longest_consonant_run(ipa: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.split(coded(ipa), "[V ]"), F.length)), F.lit(0))


def ill_shaped(ipa: Column, longest: int = 4) -> Column:
    """Whether some word has consonants but no vowel, or a run of more than ``longest`` consonants."""
    return F.exists(F.split(coded(ipa), " +"), lambda w: (F.contains(w, F.lit("C")) & ~F.contains(w, F.lit("V"))) | w.rlike(f"C{{{longest + 1},}}"))


def one_char_each(ipa: Column, symbols: list[str] = VOWELS[:5]) -> Column:
    """Phones as single characters, so that the built-in edit distance counts phones; stress and separators dropped."""
    t = F.regexp_replace(ipa, "[ˈ -]", "")
    for k, s in enumerate(symbols):
        t = F.replace(t, F.lit(s), F.lit(chr(ord("A") + k)))
    return t


#: Symbols, the longest first, and the ASCII letters that stand for them where an edit distance counts bytes.
ASCII_ORDER = [*VOWELS, *CONSONANTS]
ASCII_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"[: len(ASCII_ORDER)]


def ascii_phones(ipa: Column) -> Column:
    """One ASCII letter for each phone of the inventory; everything else is dropped."""
    pairs = F.create_map(*[F.lit(x) for kv in zip(ASCII_ORDER, ASCII_LETTERS) for x in kv])
    return F.array_join(F.transform(phones(ipa), lambda p: F.element_at(pairs, p)), "")


def stressed_nucleus(word: Column) -> Column:
    """Which vowel, counted from one, follows the first stress mark; null without a mark."""
    before = F.substring_index(word, STRESS, 1)
    return F.when(F.contains(word, F.lit(STRESS)), F.regexp_count(before, F.lit(f"({VOWEL})")) + 1)


def variants(cell: Column) -> Column:
    """Readings of a cell ``primary | variant [note]`` in order, notes dropped, each once."""
    parts = F.transform(F.split(F.regexp_replace(F.coalesce(cell, F.lit("")), r"\[[^\]]*\]", ""), r"\|"), strip)
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def transcript_pieces(ipa: Column, bar: str, special: list[str]) -> Column:
    """Pieces of a transcript between bars, without blanks at their ends, empty and special ones left out."""
    pieces = F.transform(F.split(ipa, bar), strip)
    return F.filter(pieces, lambda p: (p != "") & ~p.isin(special))


def fold_symbols(ipa: Column, sequences: list[tuple[str, str]], singles: dict[str, str]) -> Column:
    """Phones of the inventory in a foreign notation: sequences are replaced first, the longest first, then single characters by a map; what is left outside is dropped."""
    for a, b in sorted(sequences, key=lambda s: -len(s[0])):
        ipa = F.replace(ipa, F.lit(a), F.lit(b))
    return phones(F.translate(ipa, "".join(singles), "".join(singles.values())))

"""Column builders that rewrite phone strings: seams, stress, reduction, respelling. All are evaluated in the JVM."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from warpweft.functions.phones import CONSONANTS, STRESS, VOWEL
from warpweft.functions.text import decomposed

# Obstruents that voice before a voiced one, those that make them, all obstruents, and the pairs of final devoicing.
VOICED_BEFORE = {"s": "z", "ʃ": "ʒ", "ʧ": "ʤ"}
TRIGGERS = "bdɡzʒʤ"
OBSTRUENTS = "bdɡzʒʤptkfsʃxʦʧv"
FINAL_DEVOICE = {"b": "p", "d": "t", "ɡ": "k", "v": "f", "z": "s", "ʒ": "ʃ", "ʤ": "ʧ"}
# Spelling of phones in Latin letters, vowels first, and the letters of stressed vowels.
RESPELLING = [("ej", "ey"), ("aj", "ay"), ("ɔj", "oy"), ("oʊ", "ou"), ("aː", "aa"), ("ɛ", "e"), ("ə", "e"), ("ɔ", "o"), ("ʦ", "ts"), ("ʧ", "tsh"), ("ʤ", "dzh"), ("ʃ", "sh"), ("ʒ", "zh"), ("x", "kh"), ("ŋ", "ng"), ("j", "y"), ("ɡ", "g"), ("ː", "")]
# Classes of marks of which a letter may bear one each.
MARK_CLASSES = ["[ְ-ׇֻ]", "ּ", "ֿ", "[ׁׂ]"]


def assimilate(ipa: Column) -> Column:
    """Voicing before a voiced obstruent, chains included, then no obstruent twice in a row."""
    ahead = f"(?=[{''.join(VOICED_BEFORE)}]*[{TRIGGERS}])"
    voiced = reduce(lambda t, kv: F.regexp_replace(t, kv[0] + ahead, kv[1]), VOICED_BEFORE.items(), ipa)
    return F.regexp_replace(voiced, rf"([{OBSTRUENTS}])\1+", "$1")


def reduce_unstressed(ipa: Column, full: str = "ɛ", reduced: str = "ə") -> Column:
    """In words with a stress mark every ``full`` but the one right after the first mark becomes ``reduced``."""

    def word(w: Column) -> Column:
        at = F.instr(w, STRESS)
        rest = F.translate(F.substr(w, at + 2), full, reduced)
        return F.when(at == 0, w).otherwise(F.concat(F.translate(F.substr(w, F.lit(1), at - 1), full, reduced), F.substr(w, at, F.lit(2)), rest))

    return F.array_join(F.transform(F.split(ipa, " "), word), " ")


def devoiced_final(ipa: Column) -> Column:
    """The reading with the last obstruent of each part devoiced; null if that changes nothing."""
    changed = reduce(lambda t, kv: F.regexp_replace(t, f"{kv[0]}(?=[ -]|$)", kv[1]), FINAL_DEVOICE.items(), ipa)
    return F.when(changed != ipa, changed)


def with_variant(variants: Column, primary: Column, more: Column) -> Column:
    """``variants`` with one more at the end, unless it is null, the primary, or there already."""
    return F.when(more.isNull() | (more == primary) | F.array_contains(variants, more), variants).otherwise(F.array_append(variants, more))


def join_seam(root: Column, suffix: Column, linked: str = "n", link: str = "ə") -> Column:
    """Root and suffix in one; a link comes between a vowel and the suffix ``linked``; null if a consonant would be doubled or a side has no phone."""
    vowel_final = root.rlike(f"(?:{VOWEL})$") & ~root.endswith(link)
    joined = F.concat(root, F.when((suffix == linked) & vowel_final, link).otherwise(""), suffix)
    phone = f"(?:{VOWEL}|[{CONSONANTS}])"
    doubled = F.regexp_replace(joined, "[ˈ -]", "").rlike(rf"([{CONSONANTS}])\1")
    return F.when(root.rlike(phone) & suffix.rlike(phone) & ~doubled, joined)


def ensure_stress(ipa: Column) -> Column:
    """A stress mark before the first vowel, if there is none yet."""
    return F.when(F.contains(ipa, F.lit(STRESS)), ipa).otherwise(F.regexp_replace(ipa, f"^(.*?)({VOWEL})", f"$1{STRESS}$2"))


def penult_stress(ipa: Column) -> Column:
    """Stress on the last full vowel but one, on the only full vowel, or, without any, on the last vowel but one; words of one vowel stay unmarked.

    Said by three patterns tried in turn, each of which looks from a vowel to the end of the word.
    """
    full, any_vowel = VOWEL.replace("ə", ""), f"(?:{VOWEL})"
    full = f"(?:{full})"
    weak = f"(?:(?!{full}).)*"
    ways = [f"({full})(?={weak}{full}{weak}$)", f"({full})(?={weak}$)", f"({any_vowel})(?=(?:(?!{any_vowel}).)*{any_vowel}(?:(?!{any_vowel}).)*$)"]
    marked = [F.regexp_replace(ipa, w, f"{STRESS}$1") for w in ways]
    chosen = F.coalesce(*[F.when(m != ipa, m) for m in marked], ipa)
    return F.when(F.regexp_count(ipa, F.lit(f"({VOWEL})")) < 2, ipa).otherwise(chosen)


def mark_nucleus(word: Column, index: Column, nucleus: str = VOWEL) -> Column:
    """A stress mark before the nucleus with this number from 0, the last if there are fewer; words of one nucleus stay unmarked."""
    parts = F.regexp_extract_all(word, F.lit(f"({nucleus}|.)"), F.lit(1))
    numbered = F.filter(F.transform(parts, lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda x: x["s"].rlike(f"^(?:{nucleus})$"))
    at = F.get(numbered, F.least(F.greatest(index, F.lit(0)), F.size(numbered) - 1))["i"]
    return F.when(F.size(numbered) < 2, word).otherwise(F.array_join(F.transform(parts, lambda s, i: F.when(i == at, F.concat(F.lit(STRESS), s)).otherwise(s)), ""))


def respell(ipa: Column) -> Column:
    """Latin respelling with the letters of stressed vowels in capitals."""
    latin = reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), RESPELLING, ipa)
    pieces = F.split(latin, STRESS)

    def piece(p: Column, i: Column) -> Column:
        onset, vowel, rest = (F.regexp_extract(p, "(?s)^([^aeiouy]*)([aeiouy]*)(.*)$", k) for k in (1, 2, 3))
        return F.when(i == 0, p).otherwise(F.concat(onset, F.upper(vowel), rest))

    return F.array_join(F.transform(pieces, piece), "")


def repair_marks(word: Column) -> Column:
    """Each letter with no mark twice and at most one mark of a class, the first kept, in canonical order."""
    unit = F.regexp_extract_all(word, F.lit(r"(\P{Mn}\p{Mn}*)"), F.lit(1))
    t = F.array_join(F.transform(unit, lambda u: reduce(lambda x, c: F.regexp_replace(x, rf"({c})([^\P{{Mn}}]*?){c}(?=\p{{Mn}}*)", "$1$2"), MARK_CLASSES * 2, u)), "")
    return decomposed(F.regexp_replace(t, r"(\p{Mn})\1+", "$1"))


def spacing(text: Column) -> Column:
    """Blanks squeezed, none before a closing sign."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r" (?=[,.!?;:'])", ""))


@dataclass(frozen=True)
class StressRules:
    """What places the stress of a word in Latin letters, all lists in order of preference.

    ``nuclei`` are the vowels, longest first; ``separable`` prefixes bear the stress on the nucleus with the given number; a ``seam`` parts a compound, whose first part
    bears it; ``tonic`` endings bear it on their first nucleus; ``neutral`` endings are taken off before these are tried again; ``unstressed`` prefixes are skipped, those in ``endings``
    only in words with one of these endings. ``clitics`` bear none.
    """

    nuclei: tuple[str, ...]
    separable: dict[str, int] = field(default_factory=dict)
    seams: tuple[str, ...] = ()
    tonic: tuple[str, ...] = ()
    neutral: tuple[str, ...] = ()
    unstressed: tuple[str, ...] = ()
    endings: dict[str, tuple[str, ...]] = field(default_factory=dict)
    clitics: tuple[str, ...] = ()

    @property
    def nucleus(self) -> str:
        return "|".join(sorted(self.nuclei, key=lambda n: (-len(n), n)))


def _not_inside(prefix: str, rules: StressRules) -> str:
    """A pattern after ``prefix`` that fails where a nucleus would lie across its end."""
    return "".join(f"(?!{n[k:]})" for n in rules.nuclei for k in range(1, len(n)) if prefix.endswith(n[:k]))


def n_nuclei(word: Column, rules: StressRules) -> Column:
    return F.regexp_count(word, F.lit(f"({rules.nucleus})"))


def _tonic_place(word: Column, rules: StressRules) -> Column:
    """Number of the first nucleus of the first tonic ending that fits and doesn't continue a nucleus; null without one."""
    place = F.lit(None).cast("int")
    for ending in reversed(rules.tonic):
        fits = word.endswith(ending) & (F.length(word) > len(ending)) & ~word.rlike(f"(?s)^(?>{rules.nucleus}|.)*?(?>{rules.nucleus})(?={ending}$)")
        before = n_nuclei(F.left(word, F.length(word) - len(ending)), rules)
        place = F.when(fits & (n_nuclei(word, rules) > before), before).otherwise(place)
    return place


def strip_neutral(word: Column, rules: StressRules) -> Column:
    """A word without the first neutral ending that leaves a nucleus."""
    out = word
    for ending in reversed(rules.neutral):
        stem = F.left(word, F.length(word) - len(ending))
        out = F.when(word.endswith(ending) & (n_nuclei(stem, rules) > 0), stem).otherwise(out)
    return out


def stress_place(word: Column, rules: StressRules) -> Column:
    """Number of the nucleus that bears the stress, from 0, by the first rule that applies; null without a nucleus."""
    count = n_nuclei(word, rules)
    steps = []
    for prefix, place in rules.separable.items():
        own = len(re.findall(rules.nucleus, prefix))
        if own:
            steps.append((word.rlike(f"^{prefix}{_not_inside(prefix, rules)}.*(?:{rules.nucleus})"), F.lit(min(place, own - 1))))
    if rules.seams:
        steps.append((word.rlike(f"(?:{rules.nucleus}).*?(?:{'|'.join(rules.seams)}).*(?:{rules.nucleus})"), F.lit(0)))
    stem = strip_neutral(word, rules)
    steps += [(_tonic_place(w, rules).isNotNull(), F.least(_tonic_place(w, rules), count - 1)) for w in (word, stem)]
    parts = []
    for prefix in rules.unstressed:
        proof = f"(?=.*(?:{'|'.join(rules.endings[prefix])})$)" if prefix in rules.endings else ""
        parts.append(f"{prefix}{_not_inside(prefix, rules)}{proof}(?=.*(?:{rules.nucleus}))")
    skipped = n_nuclei(F.regexp_extract(word, f"^(?:{'|'.join(parts)})*", 0), rules) if parts else F.lit(0)
    chosen = F.least(skipped, count - 1)
    for holds, place in reversed(steps):
        chosen = F.when(holds, place).otherwise(chosen)
    return F.when(count > 0, chosen)


def add_stress(text: Column, rules: StressRules, overrides: Column | None = None, penult: bool = False) -> Column:
    """Each word with a mark before its stressed nucleus; words of one nucleus and clitics bear none.

    ``overrides`` is a map ``word -> place`` that comes before all rules; with ``penult`` the last nucleus but one of the word without a neutral ending is the default.
    """

    def word(w: Column) -> Column:
        place = stress_place(w, rules)
        if penult:
            place = F.greatest(n_nuclei(strip_neutral(w, rules), rules) - 2, F.lit(0))
        if overrides is not None:
            place = F.coalesce(F.try_element_at(overrides, w), place)
        bare = F.lit(False) if not rules.clitics else w.isin(list(rules.clitics))
        return F.when(bare, w).otherwise(mark_nucleus(w, place, rules.nucleus))

    return F.array_join(F.transform(F.split(text, " "), word), " ")


def syllables(word: Column, nuclei: str, onsets: list[str], units: list[str]) -> Column:
    """Syllables of a word in Latin letters: each nucleus takes the longest legal onset before it, one unit at least; a word without a nucleus is one.

    ``nuclei`` is a pattern of one nucleus, ``onsets`` the legal clusters, ``units`` the spellings of one consonant, both longest first.
    """
    legal = "|".join(sorted([*onsets, *units], key=lambda o: (-len(o), o)))
    ended = F.regexp_replace(word, f"({nuclei})", "$1\u0001")
    cut = F.regexp_replace(ended, f"(?<=\u0001)([^\u0001]*?)((?:{legal}|[^\u0001])?)(?=(?:{nuclei})\u0001)", "$1\u0002$2")
    return F.split(F.replace(cut, F.lit("\u0001"), F.lit("")), "\u0002")


def nuclei_spans(word: Column, nuclei: str) -> Column:
    """``[(begin, end)]`` of each nucleus, in characters from 0."""
    parts = F.regexp_extract_all(word, F.lit(f"({nuclei}|.)"), F.lit(1))
    placed = F.transform(parts, lambda p, i: F.struct(p.alias("p"), F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda acc, q: acc + F.length(q)).alias("b")))
    return F.transform(F.filter(placed, lambda x: x["p"].rlike(f"^(?:{nuclei})$")), lambda x: F.struct(x["b"].alias("begin"), (x["b"] + F.length(x["p"])).alias("end")))

"""Rule-driven reading of words: a left-to-right automaton over letters and their marks, and the whole path from spelling to phones.

Rules are rows the caller supplies; nothing here knows a script. Each distinct word is read once, in Arrow batches, and joined back.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warpweft.functions import phonology as G
from warpweft.functions.text import tolerant_pattern

#: Rules are a table made by hand; one with more rows is an error.
MOST_RULES = 10_000
RULE_SCHEMA = "rank int, letters string, marks string, before string, after string, tail string, state string, out string, to_state string"


@dataclass(frozen=True)
class Rule:
    """At a place where all conditions hold, ``letters`` are consumed, ``out`` is written and the state becomes ``to_state``.

    ``letters`` is matched against the base letters from here; ``marks`` must be found in the marks of the consumed letters (a pattern, empty for any);
    ``before`` must match at the end of the letters to the left and ``after`` at the beginning of the letters with marks to the right (``^`` and ``$`` are the ends of the
    word); ``tail`` must match at the end of what is written; ``state`` must match the state whole. Empty conditions hold. A null ``to_state`` keeps the state.
    """

    rank: int
    letters: str
    marks: str = ""
    before: str = ""
    after: str = ""
    tail: str = ""
    state: str = ""
    out: str = ""
    to_state: str | None = ""


class Automaton:
    """Reads a word from left to right; at each place the rule of least rank that holds applies. A letter without a rule is written as it is and clears the state."""

    def __init__(self, rules: list[Rule]):
        self.rules = [
            (re.compile(r.letters), r.marks and re.compile(r.marks), r.before and re.compile(f"(?:{r.before})\\Z"), r.after and re.compile(r.after), r.tail and re.compile(f"(?:{r.tail})\\Z"), r.state and re.compile(r.state), r)
            for r in sorted(rules, key=lambda r: r.rank)
        ]

    def __call__(self, word: str) -> str:
        bases, marks = [], []
        for c in unicodedata.normalize("NFD", word):
            if unicodedata.category(c) == "Mn" and bases:
                marks[-1] += c
            else:
                bases.append(c)
                marks.append("")
        line, ends = "".join(bases), [b + m for b, m in zip(bases, marks)]
        at, written, state = 0, "", ""
        while at < len(bases):
            for letters, own, before, after, tail, held, rule in self.rules:
                m = letters.match(line, at)
                if not m or m.end() == at:
                    continue
                if own and not own.search("".join(marks[at : m.end()])):
                    continue
                if before and not before.search(line[:at]) or after and not after.match("".join(ends[m.end() :])):
                    continue
                if tail and not tail.search(written) or held and not held.fullmatch(state):
                    continue
                written += rule.out
                state = state if rule.to_state is None else rule.to_state
                at = m.end()
                break
            else:
                written, state, at = written + ends[at], "", at + 1
        return written


def collected_rules(rules: DataFrame) -> list[Rule]:
    """The rows of a rule table, whose columns are those of ``RULE_SCHEMA``."""
    found = rules.select(*[part.split()[0] for part in RULE_SCHEMA.split(", ")]).limit(MOST_RULES + 1).collect()
    if len(found) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return [Rule(*[("" if v is None and k not in ("rank", "to_state") else v) for k, v in r.asDict().items()]) for r in found]


def map_distinct(rows: DataFrame, value: str, name: str, function) -> DataFrame:
    """``rows`` with ``name``, a string made of ``value`` in Python once per distinct value; null stays null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"_value": batch["_value"], name: [function(v) for v in batch["_value"]]})

    done = rows.where(F.col(value).isNotNull()).select(F.col(value).alias("_value")).distinct().mapInPandas(run, f"_value string, {name} string")
    return rows.join(done, rows[value] == done["_value"], "left").drop("_value")


def transliterate(rows: DataFrame, value: str, rules: DataFrame | list[Rule], name: str = "latin") -> DataFrame:
    """``rows`` with what the automaton writes for ``value``."""
    return map_distinct(rows, value, name, Automaton(rules if isinstance(rules, list) else collected_rules(rules)))


def longest_match(text: Column, table: dict[str, str]) -> Column:
    """A text with each part that is in the table replaced, the longest first at each place, left to right; other characters stay."""
    keys = sorted(table, key=lambda k: (-len(k), k))
    pairs = F.create_map(*[F.lit(x) for k in keys for x in (k, table[k])])
    parts = F.regexp_extract_all(text, F.lit("(?s)(" + "|".join(re.escape(k) for k in keys) + "|.)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(pairs, p), p)), "")


def substitute_stems(text: Column, stems: list[tuple[str, str]]) -> Column:
    """A text with stems replaced in list order, whatever marks their letters bear."""
    for stem, other in stems:
        text = F.regexp_replace(text, tolerant_pattern(stem), other)
    return text


def rewritten(text: Column, rules: list[tuple[str, str]]) -> Column:
    """A text after ordered replacements of patterns."""
    for pattern, to in rules:
        text = F.regexp_replace(text, pattern, to)
    return text


def letter_names(key: Column, names: dict[str, str]) -> Column:
    """The names of a key's letters, joined by blanks; null if some letter has none."""
    pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    spelled = F.transform(F.filter(F.split(F.regexp_replace(key, "[\"']", ""), ""), lambda c: c != ""), lambda c: F.try_element_at(pairs, c))
    return F.when((F.size(spelled) > 0) & F.forall(spelled, lambda s: s.isNotNull()), F.array_join(spelled, " "))


@dataclass(frozen=True)
class Reader:
    """One way of reading a script, as data: stems to be replaced, rules of the automaton, replacements in Latin letters, stress, phones of Latin letters."""

    rules: list[Rule]
    phones: dict[str, str]
    stress: G.StressRules
    stems: list[tuple[str, str]] = field(default_factory=list)
    latin: list[tuple[str, str]] = field(default_factory=list)
    penult: bool = False


def read(rows: DataFrame, word: str, reader: Reader, lexicon: DataFrame | None = None, name: str = "ipa") -> DataFrame:
    """``rows`` with the reading of ``word`` by rules: stems, automaton, replacements, stress, phones, assimilation, reduction.

    ``lexicon`` is ``(word, latin)``; words in it take its Latin form instead of the automaton's. A null word has no reading.
    """
    words = rows.select(F.col(word).alias("_w")).where("_w IS NOT NULL").distinct()
    made = transliterate(words.withColumn("_s", substitute_stems(F.col("_w"), reader.stems)), "_s", reader.rules, "_l").withColumn("_l", rewritten(F.col("_l"), reader.latin))
    if lexicon is not None:
        held = lexicon.groupBy(F.col("word").alias("_w")).agg(F.min("latin").alias("_held"))
        made = made.join(held, "_w", "left").withColumn("_l", F.coalesce("_held", "_l"))
    stressed = G.add_stress(F.col("_l"), reader.stress, penult=reader.penult)
    spoken = G.reduce_unstressed(G.assimilate(longest_match(stressed, reader.phones)))
    return rows.join(made.select("_w", spoken.alias(name)), rows[word] == F.col("_w"), "left").drop("_w")

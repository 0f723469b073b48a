"""Vowel marks and readings held against each other: where marks stand, whether they say what is read, and the least change that makes them.

The conventions are data of the caller. Kernels run once per distinct pair, in Arrow batches.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Units = list[tuple[str, str]]


def units_of(word: str) -> Units:
    """Letters with their marks, decomposed; marks before the first letter are dropped."""
    out: Units = []
    for c in unicodedata.normalize("NFD", word):
        if unicodedata.category(c) != "Mn":
            out.append((c, ""))
        elif out:
            out[-1] = (out[-1][0], out[-1][1] + c)
    return out


def joined(units: Units) -> str:
    return unicodedata.normalize("NFC", "".join(base + "".join(sorted(marks, key=unicodedata.combining)) for base, marks in units))


@dataclass(frozen=True)
class Convention:
    """How marks spell vowels: the vowel of each point, of letters that are one with a mark, the letters that may carry a vowel's mark for their neighbours, and what may differ.

    ``allowed`` gives the nuclei that a point may be read as; nuclei in ``silent`` need no mark anywhere, those in ``tail`` none after the last mark; a mark in ``dropped`` may be
    taken off over the nucleus named there.
    """

    points: dict[str, str]
    lettered: dict[tuple[str, str], str]
    carriers: str
    allowed: dict[str, frozenset[str]]
    nuclei: tuple[str, ...]
    silent: frozenset[str] = frozenset()
    tail: frozenset[str] = frozenset()
    dropped: dict[str, str] | None = None


def nuclei_of(ipa: str, nuclei: tuple[str, ...]) -> list[str]:
    found, at = [], 0
    while at < len(ipa):
        hit = next((n for n in nuclei if ipa.startswith(n, at)), None)
        if hit:
            found.append(hit)
        at += len(hit) if hit else 1
    return found


def slots(units: Units, rule: Convention) -> list[tuple[str, list[tuple[int, str]]]]:
    """Vowels that the marks of a word spell, each with its marks as ``(letter, mark)``; one vowel marked on several letters of a run of carriers is one slot."""
    found: list[tuple[str, list[tuple[int, str]]]] = []
    last = None
    for k, (base, marks) in enumerate(units):
        for m in marks:
            vowel = rule.points.get(m) or rule.lettered.get((base, m))
            if not vowel:
                continue
            run = last is not None and k > last and all(units[i][0] in rule.carriers for i in range(last + 1, k + 1))
            if found and run and found[-1][0] == vowel:
                found[-1][1].append((k, m))
            else:
                found.append((vowel, [(k, m)]))
            last = k
    return found


def reconcile(pointed: str, ipa: str, rule: Convention) -> tuple[str | None, str]:
    """The pointing if it says what is read (``ok``), or without the marks that may be dropped (``repaired``), else none: ``conflict`` or ``unmarked nucleus``."""
    units, heard = units_of(pointed), nuclei_of(ipa, rule.nuclei)
    at, off = 0, []
    for vowel, marks in slots(units, rule):
        while at < len(heard) and heard[at] not in rule.allowed.get(vowel, frozenset({vowel})):
            if (rule.dropped or {}).get(vowel) == heard[at]:
                off += marks
                break
            if heard[at] not in rule.silent:
                return None, "conflict"
            at += 1
        if at >= len(heard):
            return None, "conflict"
        at += 1
    if any(n not in rule.silent | rule.tail for n in heard[at:]):
        return None, "unmarked nucleus"
    if not off:
        return joined(units), "ok"
    return joined([(b, "".join(m for m in marks if (k, m) not in off)) for k, (b, marks) in enumerate(units)]), "repaired"


def reattach(pointed: str, rule: Convention, inner: str) -> str:
    """Marks moved to the one letter of a run of carriers that bears them by convention.

    In a run with a letter ``inner`` after its first, a vowel of the run's own kind goes there; of two equal letters the second bears the vowel. Runs with different vowels stay.
    """
    units = units_of(pointed)
    point = lambda k: next((m for m in units[k][1] if m in rule.points), "")

    def move(source: int, target: int | None, mark: str) -> None:
        units[source] = (units[source][0], units[source][1].replace(mark, "", 1))
        if target is not None and mark not in units[target][1]:
            units[target] = (units[target][0], units[target][1] + mark)

    begin = 0
    while begin < len(units):
        end = begin
        while end < len(units) and units[end][0] in rule.carriers:
            end += 1
        own = [k for k in range(begin + 1, end) if units[k][0] == inner]
        marked = [k for k in range(begin, end) if point(k)]
        kinds = {point(k) for k in marked}
        if own and len(kinds) == 1 and rule.points[min(kinds)] in rule.allowed and (inner, min(kinds)) in rule.lettered:
            mark = min(kinds)
            for k in marked:
                if k != own[0]:
                    move(k, own[0], mark)
        begin = max(end, begin + 1)
    for k in range(len(units) - 1):
        if units[k][0] == units[k + 1][0] and units[k][0] in rule.carriers and point(k) and point(k + 1) in ("", point(k)):
            move(k, k + 1, point(k))
    return joined(units)


def nearest_pointing(pointed: str, wanted: str, read: Callable[[str], str], points: list[str], most: int = 3) -> str | None:
    """The pointing with fewest changes, ``most`` at most, that ``read`` reads as ``wanted``; of equally many the first in order. None if there is none.

    A change takes a letter's point off or puts one on or in its place. Changes of fewer letters are tried first, so a search ends with the first hit.
    """
    units = units_of(pointed)
    if read(joined(units)) == wanted:
        return joined(units)
    options = []
    for k, (base, marks) in enumerate(units):
        own = [m for m in marks if m in points]
        rest = "".join(m for m in marks if m not in points)
        options += [(k, (base, rest + p)) for p in ["", *points] if [p] != own and (p or own)]
    for n in range(1, most + 1):
        for change in combinations(options, n):
            if len({k for k, _ in change}) < n:
                continue
            new = list(units)
            for k, unit in change:
                new[k] = unit
            if read(joined(new)) == wanted:
                return joined(new)
    return None


def over_pairs(rows: DataFrame, a: str, b: str, schema: str, function: Callable[[str, str], tuple]) -> DataFrame:
    """``rows`` with the columns of ``schema`` made of two strings, once per distinct pair; null where either is null."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [function(x, y) for x, y in zip(batch["_a"], batch["_b"])]
            yield pd.DataFrame({"_a": batch["_a"], "_b": batch["_b"]} | {n: [m[k] for m in made] for k, n in enumerate(names)})

    pairs = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("_a"), F.col(b).alias("_b")).distinct()
    done = pairs.mapInPandas(run, f"_a string, _b string, {schema}")
    return rows.join(done, (rows[a] == done["_a"]) & (rows[b] == done["_b"]), "left").drop("_a", "_b")


def reconciled(rows: DataFrame, pointed: str, ipa: str, rule: Convention) -> DataFrame:
    """``rows`` with ``accepted`` and ``status`` of each pointing and its reading."""
    return over_pairs(rows, pointed, ipa, "accepted string, status string", lambda p, i: reconcile(p, i, rule))

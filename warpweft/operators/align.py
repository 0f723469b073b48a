"""Alignment of symbol sequences: the one kernel that runs in Python, applied to distinct pairs only."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Scores of a match, of two different vowels, two different consonants, a vowel with a consonant, and a gap.
MATCH, VOWEL_PAIR, CONSONANT_PAIR, MIXED, GAP = 2.0, 0.5, 0.0, -1.5, -1.0


#: Cells of the score grids that are held at once.
CELLS = 4_000_000


def align_many(pairs: list[tuple[list, list]], vowels: frozenset[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Score and path of the best global alignment of each pair; of equal moves the diagonal comes before leaving out of the first, then of the second.

    Pairs of one shape are aligned together, a row of all their grids at a time: gaps along a row are a running maximum. A path is two arrays of
    positions, -1 where nothing stands opposite.
    """
    ids: dict[str, int] = {}
    coded = [([ids.setdefault(x, len(ids)) for x in a], [ids.setdefault(x, len(ids)) for x in b]) for a, b in pairs]
    vowel = np.array([x in vowels for x in ids], bool)
    shapes: dict[tuple[int, int], list[int]] = {}
    for k, (a, b) in enumerate(coded):
        shapes.setdefault((len(a), len(b)), []).append(k)
    score, paths = np.zeros(len(pairs)), [None] * len(pairs)
    for (n, m), members in shapes.items():
        held = max(1, CELLS // ((n + 1) * (m + 1)))
        for begin in range(0, len(members), held):
            part = members[begin : begin + held]
            a = np.array([coded[k][0] for k in part], np.int64).reshape(len(part), n)
            b = np.array([coded[k][1] for k in part], np.int64).reshape(len(part), m)
            grid, alike = _grids(a, b, vowel)
            score[part] = grid[:, n, m]
            for k, path in zip(part, _trace(grid, alike)):
                paths[k] = path
    return score, paths


def _grids(a: np.ndarray, b: np.ndarray, vowel: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    (many, n), m = a.shape, b.shape[1]
    along = GAP * np.arange(m + 1)
    grid, alike = np.empty((many, n + 1, m + 1)), np.empty((many, n, m))
    grid[:, 0] = along
    for i in range(n):
        x = a[:, i, None]
        kinds = np.where(vowel[x], VOWEL_PAIR, CONSONANT_PAIR) if m else np.empty((many, 0))
        alike[:, i] = np.where(x == b, MATCH, np.where(vowel[x] != vowel[b], MIXED, kinds)) if m else kinds
        best = np.empty((many, m + 1))
        best[:, 0] = GAP * (i + 1)
        best[:, 1:] = np.maximum(grid[:, i, :-1] + alike[:, i], grid[:, i, 1:] + GAP)
        grid[:, i + 1] = np.maximum.accumulate(best - along, axis=1) + along
    return grid, alike


def _trace(grid: np.ndarray, alike: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    many, n, m = len(grid), grid.shape[1] - 1, grid.shape[2] - 1
    row, i, j = np.arange(many), np.full(many, n), np.full(many, m)
    left, right = np.full((many, n + m), -2), np.full((many, n + m), -2)
    for step in range(n + m - 1, -1, -1):
        live = (i > 0) | (j > 0)
        up, back = np.maximum(i - 1, 0), np.maximum(j - 1, 0)
        here = grid[row, i, j]
        both = (i > 0) & (j > 0)
        if n and m:
            both &= here == grid[row, up, back] + alike[row, up, back]
        only = live & ~both & (i > 0) & ((j == 0) | (here == grid[row, up, j] + GAP))
        other = live & ~both & ~only
        left[:, step] = np.where(both | only, up, np.where(other, -1, -2))
        right[:, step] = np.where(both | other, back, np.where(only, -1, -2))
        i, j = i - (both | only), j - (both | other)
    used = left > -2
    return [(left[k][used[k]], right[k][used[k]]) for k in range(many)]


ALIGNED = "a array<string>, b array<string>, score double, fit double, path array<struct<i:int,j:int>>"


def align_distinct(rows: DataFrame, a: str, b: str, vowels: list[str]) -> DataFrame:
    """``rows`` with ``score``, ``fit`` (score over twice the length of ``a``; -1 for an empty one) and ``path``. Equal pairs are aligned once; a null sequence has no alignment."""
    held = frozenset(vowels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = [(list(x), list(y)) for x, y in zip(batch["a"], batch["b"])]
            score, paths = align_many(pairs, held)
            fit = [s / (2 * len(x)) if x else -1.0 for s, (x, _) in zip(score, pairs)]
            steps = [[{"i": None if p < 0 else int(p), "j": None if q < 0 else int(q)} for p, q in zip(*path)] for path in paths]
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "score": score, "fit": fit, "path": steps})

    pairs = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b")).distinct().mapInPandas(run, ALIGNED)
    return rows.join(pairs, (rows[a] == pairs["a"]) & (rows[b] == pairs["b"]), "left").drop(pairs["a"]).drop(pairs["b"])


def heard_at(aligned: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    """``(key, slot, expected, heard)``: what stands opposite each symbol of ``a``; null where nothing does."""
    step = F.explode(F.filter("path", lambda p: p["i"].isNotNull())).alias("p")
    each = aligned.select(*key, a, b, step)
    return each.select(*key, F.col("p.i").alias("slot"), F.get(F.col(a), F.col("p.i")).alias("expected"), F.get(F.col(b), F.col("p.j")).alias("heard"))


def matched(path: Column, a: Column, b: Column) -> Column:
    """How many symbols of ``a`` stand opposite an equal one."""
    return F.size(F.filter(path, lambda p: F.get(a, p["i"]) == F.get(b, p["j"])))


def fraction_matched(path: Column, a: Column, b: Column) -> Column:
    """Share of the symbols of ``a`` that stand opposite an equal one; 0 for an empty ``a``."""
    return F.when(F.size(a) == 0, 0.0).otherwise(matched(path, a, b) / F.size(a))


def word_ownership(rows: DataFrame, key: list[str], words: str, heard: str, vowels: list[str]) -> DataFrame:
    """``(key, word, expected, heard_word, n_match, first_heard, last_heard)``: what each word of a line got of one transcript.

    ``words`` holds the symbols of each word. The line is aligned as a whole, so that words compete for the transcript; symbols heard
    between words belong to none.
    """
    owners = F.flatten(F.transform(words, lambda w, i: F.array_repeat(i, F.size(w))))
    flat = rows.select(*key, F.col(words).alias("_w"), F.flatten(words).alias("_a"), F.col(heard).alias("_b"), owners.alias("_o"))
    aligned = align_distinct(flat, "_a", "_b", vowels)
    met = F.filter("path", lambda p: p["i"].isNotNull() & p["j"].isNotNull())
    each = aligned.select(*key, "_a", "_b", F.posexplode("_w").alias("word", "expected"), F.col("_o"), met.alias("_m"))
    mine = F.filter("_m", lambda p: F.get(F.col("_o"), p["i"]) == F.col("word"))
    own = each.withColumn("_m", mine)
    return own.select(
        *key, "word", "expected", F.transform("_m", lambda p: F.get(F.col("_b"), p["j"])).alias("heard_word"),
        F.size(F.filter("_m", lambda p: F.get(F.col("_a"), p["i"]) == F.get(F.col("_b"), p["j"]))).alias("n_match"),
        F.array_min(F.transform("_m", lambda p: p["j"])).alias("first_heard"), F.array_max(F.transform("_m", lambda p: p["j"])).alias("last_heard"),
    )


def window(heard: Column, first: Column, last: Column, pad: int = 2) -> Column:
    """The part of a transcript that a word got, with ``pad`` symbols on either side; null where it got none."""
    begin = F.greatest(first - pad, F.lit(0))
    return F.when(first.isNotNull(), F.slice(heard, begin + 1, last + pad - begin + 1))


def margin(scores: Column) -> Column:
    """How far the best score leads the next, weighted by how good it is: both in descending order, the next -1 where there is none."""
    ordered = F.sort_array(scores, asc=False)
    best, runner = F.get(ordered, F.lit(0)), F.coalesce(F.get(ordered, F.lit(1)), F.lit(-1.0))
    return F.greatest(best - runner, F.lit(0.0)) * F.greatest(F.least(best, F.lit(1.0)), F.lit(0.0))


def choose_in_windows(hits: DataFrame, key: list[str], word: str, heard: str, candidates: DataFrame, vowels: list[str], least: float = 0.05) -> DataFrame:
    """Which candidate of each occurrence fits the window around it best: ``winner``, ``best_fit``, ``lead``, ``margin`` and ``decision``.

    ``hits`` is ``(key, word, heard window)``, ``candidates`` ``(word, reading, phones)``. Undecided occurrences have no winner; of equal fits the least reading counts.
    """
    scored = align_distinct(hits.select(*key, word, heard).join(candidates, word), "phones", heard, vowels)
    per = scored.groupBy(*key, word).agg(F.min_by("reading", F.struct(-F.col("fit"), F.col("reading"))).alias("_best"), F.collect_list("fit").alias("_fits"))
    ordered = F.sort_array("_fits", asc=False)
    lead = F.get(ordered, F.lit(0)) - F.coalesce(F.get(ordered, F.lit(1)), F.lit(-1.0))
    sure = margin(F.col("_fits")) >= least
    return per.select(
        *key, word, F.when(sure, F.col("_best")).alias("winner"), F.round(F.get(ordered, F.lit(0)), 4).alias("best_fit"), F.round(lead, 4).alias("lead"),
        F.round(margin(F.col("_fits")), 4).alias("margin"), F.when(sure, "decided").otherwise("undecided").alias("decision"),
    )


def forgiven(a: Column, b: Column, pairs: list[tuple[str, str]]) -> Column:
    """Whether two symbols are equal or one of the ``pairs``, in either order. Nulls aren't."""
    both = [f"{x}|{y}" for x, y in pairs] + [f"{y}|{x}" for x, y in pairs]
    return F.coalesce((a == b) | F.concat(a, F.lit("|"), b).isin(both), F.lit(False))


def matching_blocks(rows: DataFrame, a: str, b: str) -> DataFrame:
    """``rows`` with ``blocks``, the runs ``(a, b, size)`` that two token arrays share when the longest is taken first and the rest aligned on either side. Equal pairs are aligned once; null for a null array."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [[{"a": m.a, "b": m.b, "size": m.size} for m in SequenceMatcher(None, list(x), list(y), autojunk=False).get_matching_blocks() if m.size] for x, y in zip(batch["a"], batch["b"])]
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "blocks": found})

    pairs = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b")).distinct()
    done = pairs.mapInPandas(run, "a array<string>, b array<string>, blocks array<struct<a:int,b:int,size:int>>")
    return rows.join(done, (rows[a] == done["a"]) & (rows[b] == done["b"]), "left").drop(done["a"]).drop(done["b"])

"""Ordered rewriting of strings by rule tables, evaluated on distinct values and joined back."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warpweft.plans.session import sent_whole


class Rewriter:
    """Stages of rules ``(pattern, replacement)``. A stage is one left-to-right pass in which, at each place, the first rule
    of the stage that matches rewrites and the rest of the match is skipped; later stages see the result."""

    def __init__(self, stages: list[list[tuple[str, str]]]):
        self.stages = [(re.compile("|".join(f"(?P<r{k}>{p})" for k, (p, _) in enumerate(rules))), [r for _, r in rules]) for rules in stages if rules]

    def __call__(self, text: str) -> str:
        for pattern, replacements in self.stages:
            text = pattern.sub(lambda m, to=replacements: to[int(m.lastgroup[1:])], text)
        return text


def rewrite_distinct(rows: DataFrame, value: str, stages: list[list[tuple[str, str]]], name: str = "rewritten") -> DataFrame:
    """``rows`` with the rewritten value; each distinct value is rewritten once; null stays null."""
    rewriter = Rewriter(stages)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"_value": batch["_value"], name: [rewriter(v) for v in batch["_value"]]})

    done = rows.where(F.col(value).isNotNull()).select(F.col(value).alias("_value")).distinct().mapInPandas(run, f"_value string, {name} string")
    return rows.join(done, rows[value] == done["_value"], "left").drop("_value")


def affix_join(words: DataFrame, stems: DataFrame, affixes: DataFrame, word: str, stem: str, prefix: bool, least: int = 2) -> DataFrame:
    """Words that are a known stem with an affix: the longest prefix or the first suffix in list order.

    ``affixes`` is ``(affix, rank)``, a list made by hand that is sent whole; each word is cut by every affix that fits it, which
    gives an equality join with the stems. Stems have at least ``least`` characters.
    """
    fits = F.col(word).startswith(F.col("affix")) if prefix else F.col(word).endswith(F.col("affix"))
    rest = F.expr(f"substring({word}, length(affix) + 1)") if prefix else F.expr(f"left({word}, length({word}) - length(affix))")
    cut = words.select(word).distinct().join(sent_whole(affixes), fits).withColumn("_stem", rest).where(F.length("_stem") >= least)
    known = stems.select(F.col(stem).alias("_stem")).distinct()
    order = F.struct(-F.length("affix") if prefix else F.col("rank"), F.col("affix"))
    return cut.join(known, "_stem").groupBy(word).agg(F.min_by(F.struct("affix", "_stem"), order).alias("x")).select(word, F.col("x.affix").alias("affix"), F.col("x._stem").alias("stem"))

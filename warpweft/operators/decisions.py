"""Operators that decide: cascades with a reason, corrections of slots, coverage, spans of kept tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cascade(rows: DataFrame, steps: list[tuple[str, Column, Column]], value: str, reason: str = "reason") -> DataFrame:
    """``value`` and ``reason`` of the first step ``(name, holds, value)`` that holds; null and ``none`` if none does."""
    chosen, why = F.lit(None), F.lit("none")
    for name, holds, result in reversed(steps):
        chosen, why = F.when(holds, result).otherwise(chosen), F.when(holds, name).otherwise(why)
    return rows.withColumn(value, chosen).withColumn(reason, why)


def substitute_slots(symbols: Column, corrections: Column) -> Column:
    """An array with the entries named in a map ``slot -> symbol`` replaced; slots count from 0."""
    return F.transform(symbols, lambda s, i: F.coalesce(F.element_at(corrections, i), s))


def elide(words: Column, dropped: Column) -> Column:
    """Words joined by blanks without those whose flag in ``dropped`` is set; null without equally many flags."""
    kept = F.transform(F.filter(F.arrays_zip(words.alias("w"), dropped.alias("d")), lambda z: ~F.coalesce(z["d"], F.lit(False))), lambda z: z["w"])
    return F.when(F.size(words) == F.size(dropped), F.array_join(kept, " "))


def zip_equal(a: Column, b: Column) -> Column:
    """Pairs ``(a, b)`` of two arrays, none if they differ in length."""
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: F.struct(x.alias("a"), y.alias("b")))).otherwise(F.array().cast("array<struct<a:string,b:string>>"))


def line_policy(tokens: DataFrame, line: list[str], dropped: Column, least: int = 4, most: float = 0.2) -> DataFrame:
    """Per line: tokens, dropped tokens, and whether it is kept whole (``strict``), in part or not at all."""
    per = tokens.groupBy(*line).agg(F.count("*").alias("n"), F.count_if(dropped).alias("n_dropped"))
    kept = F.col("n") - F.col("n_dropped")
    policy = F.when(F.col("n_dropped") == 0, "strict").when((kept >= least) & (F.col("n_dropped") < most * F.col("n")), "partial").otherwise("drop")
    return per.withColumn("policy", policy)


def inverted_index(rows: DataFrame, words: str, key: list[str]) -> DataFrame:
    """``(word, key, n)``: where each word occurs and how often. Kept in long form, so a word that is everywhere is many rows and not one."""
    return rows.select(*key, F.explode(words).alias("word")).groupBy("word", *key).agg(F.count("*").alias("n"))


def reasons_union(parts: list[tuple[str, DataFrame]], key: str, weight: str) -> DataFrame:
    """Keys of several lists with the greatest weight and the names of all lists that have them."""
    every = None
    for name, df in parts:
        part = df.select(key, F.col(weight).alias("weight"), F.lit(name).alias("name"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy(key).agg(F.max("weight").alias("weight"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("reasons"))

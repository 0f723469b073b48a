"""Operators that choose rows: lines by tier, words not yet known, candidates, picks by quota, covers of targets."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from warpweft.operators.sequences import hash_order


def sentence_tiers(
    tokens: DataFrame, line: str, is_word: Column, freq: Column, unread: Column, flags: dict[str, Column], tiers: list[tuple[str, str, str, float]], length: tuple[int, int] = (7, 16), least_words: float = 0.9, least_freq: int = 8
) -> DataFrame:
    """``(line, n, tier, shares)`` of lines fit to be read aloud: of a length, nearly all words, none rare or unread; the tier is the first ``(name, flag, >= or <=, share)`` that holds. Lines of no tier are left out."""
    per = tokens.groupBy(line).agg(
        F.count("*").alias("n"), F.count_if(is_word).alias("_words"), F.count_if(freq < least_freq).alias("_rare"), F.count_if(unread).alias("_unread"), *[F.count_if(v).alias(k) for k, v in flags.items()]
    )
    fit = per.where(F.col("n").between(*length) & (F.col("_words") >= least_words * F.col("n")) & (F.col("_rare") == 0) & (F.col("_unread") == 0))
    tier = F.lit(None).cast("string")
    for name, flag, side, share in reversed(tiers):
        part = F.col(flag) / F.col("n")
        tier = F.when(part >= share if side == ">=" else part <= share, name).otherwise(tier)
    return fit.withColumn("tier", tier).where("tier IS NOT NULL").drop("_words", "_rare", "_unread")


def unknown_under(words: DataFrame, known: DataFrame, word: str, spellings: list[Callable[[Column], Column]]) -> DataFrame:
    """Words that the known ones have under none of several spellings."""
    return reduce(lambda left, s: left.withColumn("_k", s(F.col(word))).join(known.select(s(F.col(word)).alias("_k")).distinct(), "_k", "left_anti").drop("_k"), spellings, words)


def numbered(rows: DataFrame, order: list[str], most: int, name: str = "place") -> DataFrame:
    """The first ``most`` rows in an order, numbered: a bounded report, so the numbering is one small task."""
    by = [F.desc(o.split()[0]) if o.endswith(" desc") else F.asc(o) for o in order]
    return rows.orderBy(*by).limit(most).withColumn(name, F.row_number().over(W.orderBy(*by)).cast("bigint"))


def distinct_candidates(rows: DataFrame, key: str, sound: Column, least: int = 2) -> DataFrame:
    """``(key, n_candidates)``: keys with at least ``least`` candidates of different sound."""
    return rows.select(key, sound.alias("_s")).distinct().groupBy(key).agg(F.count("*").alias("n_candidates")).where(F.col("n_candidates") >= least)


def one_per_group(rows: DataFrame, group: str, key: str, seed: str = "42") -> DataFrame:
    """One row of each group, the first in hash order: an aggregate, so a hot group is never sorted."""
    rest = [c for c in rows.columns if c != group]
    return rows.groupBy(group).agg(F.min_by(F.struct(*rest), F.struct(hash_order(seed, key).alias("h"), F.col(key).alias("k"))).alias("r")).select(group, "r.*")


def held_out_group(rows: DataFrame, group: str, held: list[str], share: float = 0.02, seed: str = "42") -> DataFrame:
    """Rows with ``split_name``: ``test`` for the groups held out, ``val`` for a share of the others by the hash of the group, else ``train``."""
    at = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col(group), F.lit("")))), 1, 4), 16, 10).cast("int")
    return rows.withColumn("split_name", F.when(F.col(group).isin(held), "test").when(at < int(share * 65536), "val").otherwise("train"))


def listed_split(rows: DataFrame, group: str, lists: DataFrame, otherwise: str = "rejected") -> DataFrame:
    """Rows with the split that a list ``(group, split_name)`` gives their group; the least of several, ``otherwise`` without one."""
    named = lists.groupBy(group).agg(F.min("split_name").alias("split_name"))
    return rows.join(named, group, "left").withColumn("split_name", F.coalesce("split_name", F.lit(otherwise)))


def picked_lines(rows: DataFrame, key: str, text: str, fit: Column, n: int, pool: int = 4, seed: str = "42") -> DataFrame:
    """``n`` lines that are fit, equal texts once, in hash order out of a pool of ``pool`` times ``n``."""
    once = rows.where(fit).groupBy(text).agg(F.min(key).alias(key))
    return once.withColumn("_h", hash_order(seed, key)).orderBy("_h", key).limit(pool * n).orderBy("_h", key).limit(n).drop("_h")


def first_covered(words: DataFrame, index: DataFrame, word: str, order: list[str], k: int) -> DataFrame:
    """The first ``k`` words in an order that an index has."""
    by = [F.desc(o.split()[0]) if o.endswith(" desc") else F.asc(o) for o in order]
    return words.join(index.select(word).distinct(), word, "left_semi").orderBy(*by).limit(k)

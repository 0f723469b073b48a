"""Operators over counted evidence: variants, consistency, votes, verdicts, lookups. Every ordering is total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from warpweft.functions import stats


def variant_counts(rows: DataFrame, key: str, form: str) -> DataFrame:
    """``(key, form, n)``: how often each form of each key occurs."""
    return rows.groupBy(key, form).agg(F.count("*").alias("n"))


def consistency(counts: DataFrame, key: str, least: int = 1) -> DataFrame:
    """One row: types with at least ``least`` tokens, types with one form, shares of types and tokens in the commonest form, mean forms per type."""
    per = counts.groupBy(key).agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.count("*").alias("forms")).where(F.col("n") >= least)
    return per.agg(
        F.count("*").alias("n_types"), F.count_if(F.col("forms") == 1).alias("n_single"),
        F.round(F.count_if(F.col("forms") == 1) / F.count("*"), 6).alias("type_consistency"),
        F.round(F.sum("top") / F.sum("n"), 6).alias("token_consistency"), F.round(F.avg("forms"), 6).alias("mean_forms"),
    )


def modal_folded(counts: DataFrame, key: str, form: str, fold: str, marks: Column, dominance: float = 0.8) -> DataFrame:
    """Per key the commonest folded form with its share, bucket and representative: of the printed forms that fold to it the most marked, of these the commonest, of these the least."""
    folded = counts.groupBy(key, fold).agg(F.sum("n").alias("n"), F.min_by(form, F.struct(-marks, -F.col("n"), F.col(form))).alias("_form"))
    shown = folded.select(key, fold, F.col("_form").alias("representative"))
    return modal(folded.select(key, fold, "n"), key, fold, dominance).join(shown.withColumnRenamed(fold, "modal"), [key, "modal"])


def modal(counts: DataFrame, key: str, form: str, dominance: float = 0.8) -> DataFrame:
    """Per key the commonest form (the least of equals), its share and a bucket: single, dominant or conflict."""
    per = counts.groupBy(key).agg(F.min_by(form, F.struct(-F.col("n"), F.col(form))).alias("modal"), F.max("n").alias("top"), F.sum("n").alias("n"), F.count("*").alias("forms"))
    share = F.col("top") / F.col("n")
    bucket = F.when(F.col("forms") == 1, "single").when(share >= dominance, "dominant").otherwise("conflict")
    return per.select(key, "modal", F.round(share, 6).alias("share"), bucket.alias("bucket"), "n")


def first_hit(keys: DataFrame, tiers: DataFrame, key: str, rank: str, value: str, bound: int = 200_000) -> DataFrame:
    """Each key with the value of the first tier that has it, and that tier's rank; null where none has.

    Within a tier the least value counts. ``tiers`` is reduced to one row per key before the join; it is broadcast only if a count
    proves it at most ``bound`` rows.
    """
    best = tiers.groupBy(key).agg(F.min(F.struct(rank, value)).alias("hit"))
    small = best.limit(bound + 1).count() <= bound
    return keys.join(F.broadcast(best) if small else best, key, "left").select(*[c for c in keys.columns], F.col(f"hit.{value}").alias(value), F.col(f"hit.{rank}").alias(rank))


def shares(counts: DataFrame, of: list[str], within: list[str], least: int = 0, least_share: float = 0.0) -> DataFrame:
    """``n`` of each group and its share of the total of ``within``, thin ones left out if wanted; totals are joined back, so no group is held in one task."""
    total = counts.groupBy(*within).agg(F.sum("n").alias("total"))
    kept = counts.join(total, within).where((F.col("n") >= least) & (F.col("n") / F.col("total") >= least_share))
    return kept.select(*within, *[c for c in of if c not in within], "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def slot_verdicts(votes: DataFrame, key: list[str], expected: str, heard: str, least: int = 3, share: float = 2 / 3) -> DataFrame:
    """Votes on what was heard in a slot: ``thin`` below ``least`` votes, else ``CONFIRMED``, ``FLIP`` or ``contested``."""
    return slot_verdicts_of_cells(votes.groupBy(*key, expected, heard).agg(F.count("*").alias("n")), key, expected, heard, least, share)


def slot_verdicts_of_cells(cells: DataFrame, key: list[str], expected: str, heard: str, least: int = 3, share: float = 2 / 3) -> DataFrame:
    """The same from counts ``n`` of each cell."""
    per = cells.groupBy(*key, expected).agg(F.sum("n").alias("votes"), F.sum(F.when(F.col(heard) == F.col(expected), F.col("n")).otherwise(0)).alias("same"), F.min_by(heard, F.struct(-F.col("n"), F.col(heard))).alias("modal"), F.max("n").alias("top"))
    verdict = (
        F.when(F.col("votes") < least, "thin").when(F.col("same") >= share * F.col("votes"), "CONFIRMED")
        .when((F.col("top") >= share * F.col("votes")) & (F.col("modal") != F.col(expected)), "FLIP").otherwise("contested")
    )
    return per.select(*key, expected, "votes", "same", "modal", verdict.alias("verdict"))


def promote(votes: DataFrame, key: str, choice: str, least: int = 3, share: float = 0.75) -> DataFrame:
    """Winner per key among decided votes; promoted with enough votes and share, else held, with the reason."""
    cells = votes.where(F.col(choice).isNotNull()).groupBy(key, choice).agg(F.count("*").alias("n"))
    per = cells.groupBy(key).agg(F.sum("n").alias("decided"), F.min_by(choice, F.struct(-F.col("n"), F.col(choice))).alias("winner"), F.max("n").alias("top"))
    part = F.col("top") / F.col("decided")
    reason = F.when(F.col("decided") < least, "few votes").when(part < share, "no majority").otherwise("promoted")
    return per.select(key, "decided", "winner", F.round(part, 6).alias("share"), reason.alias("reason"))


def calibrated(cells: DataFrame, unit: str, expected: str, heard: str, least: int = 4, p: float = 0.002) -> DataFrame:
    """Whether a unit's commonest observation, where it isn't the expected one, is more than the usual confusion.

    The base rate of each confusion is pooled over all units, the tested one included, and smoothed. A unit with at least ``least``
    observations whose tail probability is below ``p`` is ``FOLD``, else ``bias-explained``.
    """
    pooled = cells.groupBy(expected, heard).agg(F.sum("n").alias("k_all"))
    total = pooled.groupBy(expected).agg(F.sum("k_all").alias("n_all"), F.count("*").alias("m"))
    base = pooled.join(total, expected).select(F.col(expected), F.col(heard).alias("modal"), stats.smoothed_rate(F.col("k_all"), F.col("n_all"), F.col("m")).alias("pooled_rate"))
    per = cells.groupBy(unit, expected).agg(F.sum("n").alias("n"), F.min_by(heard, F.struct(-F.col("n"), F.col(heard))).alias("modal"), F.max("n").alias("k"))
    tested = per.where((F.col("n") >= least) & (F.col("modal") != F.col(expected))).join(base, [expected, "modal"])
    tail = F.round(stats.binomial_tail(F.col("k"), F.col("n"), F.col("pooled_rate")), 6)
    return tested.select(unit, expected, "modal", "k", "n", F.round("pooled_rate", 6).alias("base"), tail.alias("p"), F.when(tail < p, "FOLD").otherwise("bias-explained").alias("verdict"))


def not_yet(rows: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key isn't among those already processed."""
    return rows.join(done.select(*key).distinct(), key, "left_anti")


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last record of each key."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, "r.*")


def first_group(groups: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Union of groups of keys; a key belongs to the first group that has it."""
    every = None
    for rank, (name, df) in enumerate(groups):
        part = df.select(key, F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("name")).alias("g"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy(key).agg(F.min("g").alias("g")).select(key, F.col("g.name").alias("group_name"))


def same_multiset(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)


def ranked(rows: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Row number within groups whose size is small by nature; see the caller."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))

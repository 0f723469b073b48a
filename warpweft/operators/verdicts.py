"""Operators that turn observations into verdicts, folds and choices. Every ordering is total; counts are aggregated before they are compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def agreement_verdicts(clips: DataFrame, key: str, score: str, least: int = 2, good: float = 0.65, bad: float = 0.40) -> DataFrame:
    """``(key, clips, agree, verdict)``: the mean score of a key's clips as ``thin``, ``OK``, ``SUSPECT`` or ``mid``."""
    per = clips.groupBy(key).agg(F.count("*").alias("clips"), F.avg(score).alias("m"))
    verdict = F.when(F.col("clips") < least, "thin").when(F.round("m", 9) >= good, "OK").when(F.round("m", 9) <= bad, "SUSPECT").otherwise("mid")
    return per.select(key, "clips", F.round("m", 6).alias("agree"), verdict.alias("verdict"))


def variant_votes(scores: DataFrame, key: str, clip: str, variant: str, score: str, least: int = 3) -> DataFrame:
    """``(key, clips, decided, winner, winner_votes)`` of scores of each variant on each clip.

    A clip votes for its best variant if no other scores as much and the score is above zero. Keys with fewer than ``least`` clips, or no vote, are left out; of equal winners the least counts.
    """
    top = scores.groupBy(key, clip, score).agg(F.count("*").alias("same"), F.min(variant).alias("v")).groupBy(key, clip).agg(F.max_by(F.struct("same", "v", F.col(score).alias("s")), score).alias("b"))
    choice = F.when((F.col("b.same") == 1) & (F.col("b.s") > 0), F.col("b.v"))
    cells = top.groupBy(key, choice.alias("choice")).agg(F.count("*").alias("n"))
    per = cells.groupBy(key).agg(
        F.sum("n").alias("clips"), F.sum(F.when(F.col("choice").isNotNull(), F.col("n"))).alias("decided"),
        F.min_by("choice", F.when(F.col("choice").isNotNull(), F.struct(-F.col("n"), F.col("choice")))).alias("winner"), F.max(F.when(F.col("choice").isNotNull(), F.col("n"))).alias("winner_votes"),
    )
    return per.where((F.col("clips") >= least) & (F.col("decided") > 0))


def slot_disagreements(votes: DataFrame, key: list[str], expected: str, heard: str, eligible: Column, least: int = 3, share: float = 0.6) -> DataFrame:
    """Slots whose commonest observation is another symbol than expected, heard often and steadily enough, and ``eligible`` (a condition on ``modal``)."""
    cells = votes.groupBy(*key, expected, heard).agg(F.count("*").alias("n"))
    per = cells.groupBy(*key, expected).agg(F.sum("n").alias("votes"), F.min_by(heard, F.struct(-F.col("n"), F.col(heard))).alias("modal"), F.max("n").alias("top"))
    kept = (F.col("modal") != F.col(expected)) & (F.col("votes") >= least) & (F.col("top") >= share * F.col("votes")) & eligible
    return per.where(kept).select(*key, expected, "modal", "votes", F.round(F.col("top") / F.col("votes"), 6).alias("steadiness"))


def fold_flips(slots: DataFrame, key: str, slot: str, same: str, other: str, verdict: str, open_keys: Column | None = None, least: int = 3, ratio: int = 3) -> DataFrame:
    """``(key, n_slots, flips, outcome)``: whether a key's flipped slots may be written into its reading.

    ``folded`` needs every slot confirmed or flipped, each flip with ``least`` votes and ``ratio`` times those against it, one flip at least, and the key still open; all
    other keys with a flip are ``queued`` with a reason, keys without one are ``kept``. ``flips`` are the flipped slots in order.
    """
    flip = F.col(verdict) == "FLIP"
    strong = (F.col(other) >= least) & (F.col(other) >= ratio * F.col(same))
    open_key = F.lit(True) if open_keys is None else open_keys
    per = slots.groupBy(key).agg(
        F.count("*").alias("n_slots"), F.count_if(flip).alias("n_flips"), F.count_if(flip & ~strong).alias("n_weak"), F.count_if(~flip & (F.col(verdict) != "CONFIRMED")).alias("n_open"),
        F.bool_and(open_key).alias("is_open"), F.array_sort(F.collect_list(F.when(flip, F.col(slot)))).alias("flips"),
    )
    outcome = F.when(F.col("n_flips") == 0, "kept").when(F.col("n_open") > 0, "queued: slot undecided").when(F.col("n_weak") > 0, "queued: weak flip").when(~F.col("is_open"), "queued: key settled").otherwise("folded")
    return per.select(key, "n_slots", "flips", outcome.alias("outcome"))


def fold_corrections(slots: DataFrame, key: str, slot: str, expected: str, modal: str, votes: str, top: str, clean: Column, anchored: Column, least: int = 3, share: float = 2 / 3) -> DataFrame:
    """Slots with a steady other observation: ``folded`` if it is ``clean`` and the key isn't anchored, else ``queued``. Others are left out."""
    steady = (F.col(modal) != F.col(expected)) & (F.col(votes) >= least) & (F.col(top) >= share * F.col(votes))
    outcome = F.when(clean & ~anchored, "folded").otherwise("queued")
    return slots.where(steady).select(key, slot, expected, modal, F.concat_ws("/", top, votes).alias("votes"), outcome.alias("outcome"))


def consensus_reading(readings: DataFrame, key: str, reading: str) -> DataFrame:
    """``(key, reading, heard, agreement)``: the commonest reading of each key, the least of equals, and its share."""
    cells = readings.where(F.col(reading).isNotNull()).groupBy(key, reading).agg(F.count("*").alias("n"))
    per = cells.groupBy(key).agg(F.min_by(reading, F.struct(-F.col("n"), F.col(reading))).alias("reading"), F.sum("n").alias("heard"), F.max("n").alias("top"))
    return per.select(key, "reading", "heard", F.round(F.col("top") / F.col("heard"), 6).alias("agreement"))


def context_agreement(readings: DataFrame, key: str, context: str, reading: str, least: int = 2) -> DataFrame:
    """``(key, reading, contexts, kind)``: the reading that most contexts of a key give; ``multi`` if at least ``least`` do, else ``single``."""
    cells = readings.where(F.col(reading).isNotNull()).select(key, context, reading).distinct().groupBy(key, reading).agg(F.count("*").alias("n"))
    per = cells.groupBy(key).agg(F.min_by(reading, F.struct(-F.col("n"), F.col(reading))).alias("reading"), F.max("n").alias("contexts"))
    return per.select(key, "reading", "contexts", F.when(F.col("contexts") >= least, "multi").otherwise("single").alias("kind"))


def harvest(judgments: DataFrame, key: str, correction: str, least: int = 2) -> DataFrame:
    """``(key, correction, n, outcome)``: the commonest correction of a key; ``override`` if ``least`` judgments agree on it, else ``review``."""
    cells = judgments.where(F.col(correction).isNotNull()).groupBy(key, correction).agg(F.count("*").alias("n"))
    per = cells.groupBy(key).agg(F.min_by(correction, F.struct(-F.col("n"), F.col(correction))).alias("correction"), F.max("n").alias("n"))
    return per.withColumn("outcome", F.when(F.col("n") >= least, "override").otherwise("review"))


def usable_judgments(judgments: DataFrame, ok: Column, ours: Column, corrected: Column, n_places: Column, confidence: Column, least: float = 0.5) -> DataFrame:
    """Judgments that are sure enough and make sense, with ``place``: ours if it was judged right, else the corrected one, which must exist and be another."""
    sense = ok | (corrected.isNotNull() & (corrected >= 0) & (corrected < n_places) & (corrected != ours))
    return judgments.where((F.coalesce(confidence, F.lit(0.0)) >= least) & sense).withColumn("place", F.when(ok, ours).otherwise(corrected))


def canonical_by_source(forms: DataFrame, key: str, form: str, n: str, judged: DataFrame, excluded: DataFrame, bare: Column) -> DataFrame:
    """``(key, form, source)``: one form for each key: its only one, else the judged one, else the commonest that isn't ``bare``; excluded keys have none.

    ``judged`` is ``(key, form)``, ``excluded`` ``(key)``. Keys with several forms of which all are bare are left out.
    """
    per = forms.groupBy(key).agg(F.count("*").alias("many"), F.min(form).alias("only"), F.min_by(form, F.when(~bare, F.struct(-F.col(n), F.col(form)))).alias("most"))
    joined = per.join(excluded.select(key).distinct(), key, "left_anti").join(judged.groupBy(key).agg(F.min(form).alias("judged")), key, "left")
    chosen = F.when(F.col("many") == 1, F.col("only")).otherwise(F.coalesce("judged", "most"))
    source = F.when(F.col("many") == 1, "single").when(F.col("judged").isNotNull(), "judged").otherwise("majority")
    return joined.select(key, chosen.alias("form"), source.alias("source")).where("form IS NOT NULL")


def pooled_evidence(parts: list[tuple[str, DataFrame]], key: str, value: str) -> DataFrame:
    """``(key, value, source)`` of several tables in one: the pool that later steps group by key. Empty values are left out."""
    every = None
    for name, df in parts:
        part = df.where(F.col(value).isNotNull()).select(key, value, F.lit(name).alias("source"))
        every = part if every is None else every.unionByName(part)
    return every


def arbitrate(scores: DataFrame, key: str, first: str, second: str, names: tuple[str, str], least: int = 2, band: float = 0.10) -> DataFrame:
    """``(key, clips, winner, first, second)``: which of two readings the clips fit better on average; ``tie`` within the band. Keys with fewer clips than ``least`` are left out."""
    per = scores.groupBy(key).agg(F.count("*").alias("clips"), F.avg(first).alias("x"), F.avg(second).alias("y")).where(F.col("clips") >= least)
    gap = F.round(F.col("x") - F.col("y"), 9)
    winner = F.when(F.abs(gap) < band, "tie").when(gap > 0, names[0]).otherwise(names[1])
    return per.select(key, "clips", winner.alias("winner"), F.round("x", 3).alias(names[0]), F.round("y", 3).alias(names[1]))


def decide_register(rows: DataFrame, first: str, second: str, ok_first: Column, ok_second: Column, defect: Column, winner: Column, share: Column, least: float = 0.5, names: tuple[str, str] = ("first", "second")) -> DataFrame:
    """``primary``, ``variant``, ``register`` and ``why`` of two readings: validity, then defects of the first, then observation, then use, then the first.

    The other reading stays as a variant if it is valid, different, and no defect decided. Rows without a valid reading are left out.
    """
    sound = ok_first & ok_second
    defect = F.when(sound, F.coalesce(defect, F.lit(""))).otherwise("")
    seen = F.when(sound, winner)
    steps = [
        (~ok_first, 1, F.lit(f"{names[0]} rejected")), (~ok_second, 0, F.lit(f"{names[1]} rejected")), (defect != "", 1, defect), (seen == names[1], 1, F.lit(f"observed {names[1]}")),
        (seen == names[0], 0, F.lit(f"observed {names[0]}")), (share >= least, 1, F.lit("share of use")),
    ]
    at, why = F.lit(0), F.lit("default")
    for holds, which, reason in reversed(steps):
        holds = F.coalesce(holds, F.lit(False))
        at, why = F.when(holds, which).otherwise(at), F.when(holds, reason).otherwise(why)
    kept = rows.where(ok_first | ok_second).withColumn("_at", at).withColumn("why", why)
    primary, other = F.when(F.col("_at") == 0, F.col(first)).otherwise(F.col(second)), F.when(F.col("_at") == 0, F.col(second)).otherwise(F.col(first))
    other_ok = F.when(F.col("_at") == 0, ok_second).otherwise(ok_first)
    variant = F.when(other_ok & (other != primary) & (defect == ""), other)
    return kept.withColumn("primary", primary).withColumn("variant", variant).withColumn("register", F.when(F.col("_at") == 0, names[0]).otherwise(names[1])).drop("_at")


def collapse_or_split(candidates: DataFrame, key: str, sound: str) -> DataFrame:
    """``(key, n_forms, n_readings, kind)``: keys whose forms all sound the same are ``collapsed``, others ``split``."""
    per = candidates.groupBy(key, sound).agg(F.count("*").alias("n")).groupBy(key).agg(F.sum("n").alias("n_forms"), F.count("*").alias("n_readings"))
    return per.withColumn("kind", F.when(F.col("n_readings") == 1, "collapsed").otherwise("split"))

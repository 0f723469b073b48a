"""Operators that find a reading for a token: tiers with conditions of their own, checks of what comes out, rescue, affixes, clitics, phrases.

Lexicons are tables. Each is reduced to one entry per key before it is joined, so a key meets as many entries as there are tiers at most.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warpweft.functions import phones as P
from warpweft.functions import phonology as G
from warpweft.operators import sequences
from warpweft.plans.session import sent_whole

LEVELS = ["LOW", "MED", "HIGH"]


@dataclass(frozen=True)
class Tier:
    """A lexicon ``(key, ipa)``, what a hit in it is worth, and a condition on the token and the entry; an entry that fails it is passed over."""

    name: str
    entries: DataFrame
    confidence: str = "HIGH"
    route: str = "lexicon"
    guard: Callable[[Column, Column], Column] | None = None


def tall_lexicon(tiers: list[Tier]) -> DataFrame:
    """``(key, entries)``: of each key the entry of every tier, the least of equals, in order of tiers."""
    every = None
    for rank, tier in enumerate(tiers):
        one = tier.entries.where("key IS NOT NULL AND ipa IS NOT NULL").groupBy("key").agg(F.min("ipa").alias("ipa")).select("key", F.lit(rank).alias("rank"), "ipa")
        every = one if every is None else every.unionByName(one)
    return every.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", "ipa"))).alias("entries"))


def route(types: DataFrame, word: str, key: str, tiers: list[Tier], bound: int = 200_000) -> DataFrame:
    """``types`` with ``ipa``, ``tier``, ``route``, ``confidence`` of the first tier whose entry passes, and ``rejected``, the tiers passed over before it.

    Tokens that no tier answers have ``route`` ``miss`` and a null reading. The lexicon is broadcast only if a count proves it at most ``bound`` keys.
    """
    tall = tall_lexicon(tiers)
    small = tall.limit(bound + 1).count() <= bound
    joined = types.join(F.broadcast(tall) if small else tall, types[key] == tall["key"], "left").drop(tall["key"])

    def passes(e: Column) -> Column:
        holds = F.lit(True)
        for rank, tier in enumerate(tiers):
            if tier.guard:
                holds = F.when(e["rank"] == rank, F.coalesce(tier.guard(F.col(word), e["ipa"]), F.lit(False))).otherwise(holds)
        return holds

    table = lambda what: F.array(*[F.lit(getattr(t, what)) for t in tiers])
    entries = F.coalesce("entries", F.array().cast("array<struct<rank:int,ipa:string>>"))
    hit = F.get(F.filter(entries, passes), F.lit(0))
    marked = joined.withColumn("_hit", hit)
    over = F.filter(entries, lambda e: F.col("_hit.rank").isNull() | (e["rank"] < F.col("_hit.rank")))
    return marked.select(
        *[F.col(c) for c in types.columns], F.col("_hit.ipa").alias("ipa"), F.get(table("name"), F.col("_hit.rank")).alias("tier"), F.coalesce(F.get(table("route"), F.col("_hit.rank")), F.lit("miss")).alias("route"),
        F.coalesce(F.get(table("confidence"), F.col("_hit.rank")), F.lit("LOW")).alias("confidence"), F.transform(over, lambda e: F.get(table("name"), e["rank"])).alias("rejected"),
    )


def post_check(routed: DataFrame, checks: list[tuple[str, Column]], repair: Column | None = None) -> DataFrame:
    """Readings held against the checks, whatever found them: one that fails becomes a ``fallback`` of low confidence; ``reason`` names all that failed.

    ``repair`` is another reading for some rows, taken before they are checked, null elsewhere.
    """
    rows = routed if repair is None else routed.withColumn("ipa", F.coalesce(repair, "ipa"))
    failed = F.array_compact(F.array(*[F.when(F.col("ipa").isNotNull() & holds, name) for name, holds in checks]))
    rows = rows.withColumn("reason", F.array_join(failed, ","))
    bad = F.col("ipa").isNotNull() & (F.col("reason") != "")
    return rows.withColumn("route", F.when(bad, "fallback").otherwise(F.col("route"))).withColumn("confidence", F.when(bad, "LOW").otherwise(F.col("confidence")))


def shape_checks(ipa: str = "ipa") -> list[tuple[str, Column]]:
    """The checks of every reading: shape and inventory."""
    return [("shape", P.ill_shaped(F.col(ipa))), ("inventory", F.size(P.violations(F.col(ipa))) > 0)]


def rescue(routed: DataFrame, word: str, key: str, tiers: list[Tier], bound: int = 200_000) -> DataFrame:
    """Tokens that came out as ``fallback`` or ``miss`` with the reading of the first rescue tier that has one, by ``rule`` and of low confidence; its name is the reason. Others stay."""
    rest = [c for c in routed.columns if c not in ("ipa", "tier", "route", "confidence", "rejected", "reason")]
    tried = route(routed.select(*rest, *[F.col(c).alias(f"_{c}") for c in ("ipa", "tier", "route", "confidence", "rejected", "reason")]), word, key, tiers, bound)
    saved = F.col("_route").isin("fallback", "miss") & F.col("ipa").isNotNull()
    pick = lambda new, old: F.when(saved, new).otherwise(F.col(old))
    return tried.select(
        *rest, pick(F.col("ipa"), "_ipa").alias("ipa"), pick(F.col("tier"), "_tier").alias("tier"), pick(F.lit("rule"), "_route").alias("route"), pick(F.lit("LOW"), "_confidence").alias("confidence"),
        F.col("_rejected").alias("rejected"), pick(F.col("tier"), "_reason").alias("reason"),
    )


def affix_readings(
    words: DataFrame, word: str, roots: DataFrame, affixes: DataFrame, prefix: bool, join: Callable[[Column, Column], Column], least: int = 3, stop: list[str] | None = None, guard: Callable[[Column, Column], Column] | None = None
) -> DataFrame:
    """``(word, affix, root, ipa)``: readings of words that are a known root with an affix; the longest prefix or the first suffix in list order that passes everything.

    ``roots`` is ``(key, ipa)``, ``affixes`` ``(affix, rank, affix_ipa)``, a list made by hand. ``join`` makes the reading of root and affix, null where they can't stand
    together; ``guard`` is a condition on the word and the made reading; roots have ``least`` letters and aren't in ``stop``.
    """
    fits = F.col(word).startswith(F.col("affix")) if prefix else F.col(word).endswith(F.col("affix"))
    rest = F.substr(F.col(word), F.length("affix") + 1) if prefix else F.left(F.col(word), F.length(word) - F.length("affix"))
    cut = words.select(word).distinct().join(sent_whole(affixes), fits).withColumn("root", rest).where((F.length("root") >= least) & ~F.col("root").isin(stop or [""]))
    known = roots.groupBy(F.col("key").alias("root")).agg(F.min("ipa").alias("root_ipa"))
    made = cut.join(known, "root").withColumn("ipa", join(F.col("root_ipa"), F.col("affix_ipa"))).where("ipa IS NOT NULL")
    if guard:
        made = made.where(F.coalesce(guard(F.col(word), F.col("ipa")), F.lit(False)))
    order = F.struct(-F.length("affix") if prefix else F.col("rank"), F.col("affix"))
    return made.groupBy(word).agg(F.min_by(F.struct("affix", "root", "ipa"), order).alias("x")).select(word, "x.affix", "x.root", "x.ipa")


def suffix_joined(root: Column, suffix: Column) -> Column:
    """A root with a suffix, by the seam rule."""
    return G.join_seam(root, suffix)


def prefix_joined(stressed: bool) -> Callable[[Column, Column], Column]:
    """A prefix before a root: a stressed one takes the stress from the root, before another the root gets one. Assimilated, reduced, inside the inventory or null."""

    def join(root: Column, prefix: Column) -> Column:
        bare = F.replace(root, F.lit(P.STRESS), F.lit(""))
        made = G.reduce_unstressed(G.assimilate(F.concat(prefix, bare if stressed else G.ensure_stress(root))))
        return F.when(F.size(P.violations(made)) == 0, made)

    return join


def proclitic_repairs(routed: DataFrame, word: str, key: str, proclitics: dict[str, tuple[str, str]], roots: DataFrame, eligible: Column, least: int = 3) -> DataFrame:
    """``(word, repaired)``: readings in which a one-letter proclitic is a bare consonant before another, with its vowel put in.

    ``proclitics`` gives each letter's consonant and its reading with the vowel; the rest of the word must be a known root of ``least`` letters. A word that reads well is left alone.
    """
    pairs = F.create_map(*[F.lit(x) for k, (c, full) in proclitics.items() for x in (k, f"{c}|{full}")])
    first = F.try_element_at(pairs, F.left(F.col(key), F.lit(1)))
    consonant, full = F.split_part(first, F.lit("|"), F.lit(1)), F.split_part(first, F.lit("|"), F.lit(2))
    naked = F.replace("ipa", F.lit(P.STRESS), F.lit(""))
    after = F.substr(naked, F.length(consonant) + 1)
    defective = first.isNotNull() & naked.startswith(consonant) & (after != "") & ~after.rlike(f"^(?:{P.VOWEL})")
    found = routed.where(F.col("ipa").isNotNull() & defective & eligible).select(word, F.col("ipa").alias("_old"), F.substr(F.col(key), F.lit(2)).alias("root"), full.alias("_full")).where(F.length("root") >= least)
    known = roots.groupBy(F.col("key").alias("root")).agg(F.min("ipa").alias("root_ipa"))
    made = G.reduce_unstressed(G.assimilate(F.concat("_full", G.ensure_stress(F.col("root_ipa")))))
    return found.join(known, "root").select(word, made.alias("repaired"), "_old").where((F.size(P.violations(F.col("repaired"))) == 0) & (F.col("repaired") != F.col("_old"))).drop("_old").distinct()


def split_clitic(word: Column, clitics: list[str]) -> Column:
    """A word as ``(clitic, rest)``: a listed letter before an apostrophe; an empty clitic where there is none."""
    shape = rf"^([{''.join(clitics)}])['׳’](.+)$"
    return F.when(word.rlike(shape), F.struct(F.regexp_extract(word, shape, 1).alias("clitic"), F.regexp_extract(word, shape, 2).alias("rest"))).otherwise(F.struct(F.lit("").alias("clitic"), word.alias("rest")))


def hyphen_parts(types: DataFrame, word: str) -> DataFrame:
    """``(word, part_no, part)`` of words with a hyphen inside."""
    parts = F.filter(F.split(word, "-"), lambda p: p != "")
    return types.where(F.contains(F.col(word), F.lit("-"))).select(word, F.posexplode(parts).alias("part_no", "part"))


def combine_parts(parts: DataFrame, word: str) -> DataFrame:
    """One reading of routed parts ``(word, part_no, ipa, route, confidence)``: joined by hyphens; the route is ``lexicon`` if all are, ``fallback`` if one is; the least confidence counts. Null if a part has no reading."""
    level = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("confidence"))
    per = parts.groupBy(word).agg(
        F.array_sort(F.collect_list(F.struct("part_no", "ipa"))).alias("l"), F.bool_and(F.col("route") == "lexicon").alias("all_known"), F.bool_or(F.col("route").isin("fallback", "miss")).alias("one_bad"), F.min(level).alias("level")
    )
    joined = F.when(F.forall("l", lambda x: x["ipa"].isNotNull()), F.array_join(F.transform("l", lambda x: x["ipa"]), "-"))
    how = F.when(F.col("one_bad"), "fallback").when(F.col("all_known"), "lexicon").otherwise("rule")
    return per.select(word, joined.alias("ipa"), how.alias("route"), F.get(F.array(*[F.lit(x) for x in LEVELS]), F.greatest(F.col("level") - 1, F.lit(0)).cast("int")).alias("confidence"))


def fused_tokens(lines: DataFrame, key: str, words: str, follow: str, phrases: DataFrame, longest: int) -> DataFrame:
    """``(key, pos, n, unit)``: the tokens of each line in order, a phrase of the table as one unit of ``n`` tokens; ``pos`` counts tokens from 1. Tokens without a word stay, as null units."""
    hits = sequences.longest_matches(lines, key, words, phrases, longest, follow=follow).groupBy(key).agg(F.collect_list(F.struct("start", "n", "gram")).alias("_hits"))
    each = lines.join(hits, key, "left").select(key, F.col("_hits"), F.posexplode(words).alias("_p", "_word")).withColumn("pos", F.col("_p") + 1)
    over = F.get(F.filter(F.coalesce("_hits", F.array().cast("array<struct<start:int,n:int,gram:string>>")), lambda h: (h["start"] <= F.col("pos")) & (F.col("pos") < h["start"] + h["n"])), F.lit(0))
    placed = each.withColumn("_h", over).where(F.col("_h").isNull() | (F.col("_h.start") == F.col("pos")))
    return placed.select(key, "pos", F.coalesce("_h.n", F.lit(1)).alias("n"), F.coalesce("_h.gram", "_word").alias("unit"))


def applied_map(tokens: DataFrame, key: str, form: str, table: DataFrame, letters_equal: Callable[[Column, Column], Column]) -> DataFrame:
    """Tokens with ``mapped`` and ``outcome``: the table's form if its letters are the token's, else the token: ``changed``, ``same``, ``letters differ`` or ``unmapped``. ``table`` is ``(key, target)``."""
    held = table.groupBy(key).agg(F.min("target").alias("_target"))
    j = tokens.join(held, key, "left")
    safe = letters_equal(F.col(form), F.col("_target"))
    outcome = F.when(F.col("_target").isNull(), "unmapped").when(~safe, "letters differ").when(F.col("_target") == F.col(form), "same").otherwise("changed")
    return j.withColumn("outcome", outcome).withColumn("mapped", F.when(F.col("outcome") == "changed", F.col("_target")).otherwise(F.col(form))).drop("_target")


def stamp(tokens: DataFrame, suspect: Column, supervised: Column, observed: Column, by_type: Column) -> DataFrame:
    """Tokens with ``target`` and ``reason``: suspects are never stamped, supervised ones stay, then what was observed at this place, then the form of the type."""
    found = F.when(~suspect & ~supervised, F.coalesce(observed, by_type))
    reason = F.when(suspect, "suspect").when(supervised, "supervised").when(observed.isNotNull(), "observed").when(by_type.isNotNull(), "type").otherwise("none")
    return tokens.withColumn("target", found).withColumn("reason", reason)


def canonical_target(forms: DataFrame, key: str, form: str, n: str, marks: Column) -> DataFrame:
    """``(key, target, rivals)``: the form with most marks, of these the commonest, of these the greatest by code points; and how many other forms there are."""
    return forms.groupBy(key).agg(F.max_by(form, F.struct(marks, F.col(n), F.col(form))).alias("target"), (F.count("*") - 1).alias("rivals"))


def only_spelling(rows: DataFrame, row: str, key: str, form: str) -> DataFrame:
    """``(row, key, form)`` for keys that a row spells one way only."""
    return rows.groupBy(row, key).agg(F.countDistinct(form).alias("n"), F.min(form).alias(form)).where("n = 1").drop("n")


def unmasked(tokens: DataFrame, verdicts: DataFrame, place: list[str], word: str, letters: Callable[[Column], Column], least: float = 0.08) -> DataFrame:
    """Tokens with ``unmask`` and ``why``: a verdict at this very place lifts the mask if its margin is ``least`` at least, its word is the token's, letters agree and the token isn't supervised yet.

    ``verdicts`` is ``(place, word, winner, margin)``; tokens have ``supervised``.
    """
    v = verdicts.select(*place, F.col(word).alias("_word"), F.col("winner").alias("_winner"), F.col("margin").alias("_margin"))
    j = tokens.join(v, place, "left")
    why = (
        F.when(F.col("_winner").isNull(), "no verdict").when(F.col("supervised"), "supervised").when(F.col("_margin") < least, "margin").when(F.col("_word") != F.col(word), "other word")
        .when(letters(F.col("_winner")) != letters(F.col(word)), "letters").otherwise("unmasked")
    )
    return j.withColumn("why", why).withColumn("unmask", F.col("why") == "unmasked").drop("_word", "_winner", "_margin")


def retagged_lines(tokens: DataFrame, line: str, pos: str, key: str, form: str, table: DataFrame, letters: Callable[[Column], Column]) -> DataFrame:
    """``(line, text, n_changed, reverted)``: lines with the table's forms in place of their own; a line whose letters would come out changed keeps all its own forms."""
    mapped = tokens.join(table.groupBy(key).agg(F.min("target").alias("_target")), key, "left").withColumn("_new", F.coalesce("_target", form))
    per = mapped.groupBy(line).agg(
        F.array_sort(F.collect_list(F.struct(pos, F.col(form).alias("old"), F.col("_new").alias("new")))).alias("_l"), F.count_if(F.col("_new") != F.col(form)).alias("_n"), F.bool_or(letters(F.col("_new")) != letters(F.col(form))).alias("reverted")
    )
    text = lambda part: F.array_join(F.transform("_l", lambda x: x[part]), " ")
    return per.select(line, F.when(F.col("reverted"), text("old")).otherwise(text("new")).alias("text"), F.when(F.col("reverted"), 0).otherwise(F.col("_n")).alias("n_changed"), "reverted")


def stripped_keys(word: Column, clitics: list[str], most: int = 2) -> Column:
    """A word and what is left of it without one, two, ... leading clitic letters, at least two letters each, in this order."""
    kept = [word]
    for n in range(1, most + 1):
        kept.append(F.when(word.rlike(f"^[{''.join(clitics)}]{{{n}}}.."), F.substr(word, F.lit(n + 1))))
    return F.array_compact(F.array(*kept))


def first_shape(rows: DataFrame, key: str, shape: str, order: list[str]) -> DataFrame:
    """Rows whose shape is the one first seen for their key; rows of later, other shapes are left out."""
    first = rows.groupBy(key).agg(F.min_by(shape, F.struct(*order)).alias("_first"))
    return rows.join(first, key).where(F.col(shape).eqNullSafe(F.col("_first"))).drop("_first")

"""Lexicons as tables: a declared schema each, an empty table where none is, and the tiers that routing takes from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType

from warpweft.operators.routing import Tier
from warpweft.sources.tables import optional_table

#: Columns of each kind of lexicon, best authority first. Every kind has ``key`` and ``ipa``.
SCHEMAS = {
    "gold": "key string, ipa string, variants array<string>, layer string, freq int, note string",
    "heard_stops": "key string, ipa string, votes string, freq int",
    "heard_vowels": "key string, ipa string, slots string",
    "endorsed": "key string, ipa string, clips int, agreement double",
    "homographs": "key string, ipa string, pointed string, register string, variants array<string>, reason string, n_decided int, share double",
    "books": "key string, ipa string, variants array<string>, pointed string, register string, why string, n_sources int, dominance double",
    "guesses": "key string, ipa string, variants array<string>, pointed string, register string, why string, agreement string",
}
#: What a hit is worth: confidence and route.
WORTH = {"gold": ("HIGH", "lexicon"), "heard_stops": ("MED", "lexicon"), "heard_vowels": ("MED", "lexicon")}


def lexicon(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """The lexicon of a kind in a folder, empty if there is none; other columns than the declared ones aren't read."""
    return optional_table(spark, f"{folder}/{kind}.parquet", StructType.fromDDL(SCHEMAS[kind]))


def tiers(spark: SparkSession, folder: str, kinds: list[str] | None = None, guards: dict[str, Callable[[Column, Column], Column]] | None = None) -> list[Tier]:
    """Tiers of the lexicons of a folder in order of authority; those that don't decide by themselves are rescue tiers of low confidence."""
    made = []
    for kind in kinds or list(SCHEMAS):
        confidence, route = WORTH.get(kind, ("LOW", "rule"))
        made.append(Tier(kind, lexicon(spark, folder, kind).select("key", "ipa"), confidence, route, (guards or {}).get(kind)))
    return made

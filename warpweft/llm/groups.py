"""Problem 3: splits that never part episodes which belong together.

Episodes and persons are nodes of one graph. Alternating large-star and small-star steps turn its components into stars around
their least node; every component then falls, by the hash of its identifier, into a range of the splits' shares.

Defined results: null and empty episode names belong to no episode and go, each row by its own hash, into a split;
unknown persons (null, blank, a placeholder) link nothing; repeated rows and both directions of a link count once; an empty table of links leaves each episode
its own group; further columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warpweft.llm.lookalike import look_form
from warpweft.plans.session import forgotten, written

# Entries that name nobody.
PLACEHOLDERS = ["", "?", "-", "na", "none", "null", "nil", "unknown", "unk", "tbd", "anonymous"]
#: Above every episode number, so that the least node of a component is an episode.
PERSON_BASE = 1 << 62


def episode_id(name: Column) -> Column:
    """The seven-digit episode that a stored name is about, as a number; null if it names none."""
    digits = F.regexp_extract(look_form(name), r"(?<!\d)0*([1-9]\d{6})(?!\d)", 1)
    return F.when(digits != "", digits.cast("long"))


def person_node(code: Column) -> Column:
    """A node number for a person's code in any typing; null for nobody."""
    typed = F.regexp_replace(F.lower(look_form(code)), r"[^\p{L}\p{N}?]+", "")
    key = F.regexp_replace(typed, r"(?<=\p{L})0+(?=\d)", "")
    known = typed.isNotNull() & ~typed.isin(*PLACEHOLDERS) & ~typed.rlike(r"^\?*$")
    return F.when(known, F.xxhash64(key).bitwiseAND((1 << 62) - 1) + F.lit(PERSON_BASE))


def episode_links(meta: DataFrame) -> DataFrame:
    """``(u, v)``, u < v: an episode and a person in it, or two episodes of which one re-uploads the other. Episodes without a link are ``(u, u)``."""
    e = meta.select(episode_id(F.col("episode")).alias("e"), person_node(F.col("speaker")).alias("s"), person_node(F.col("guest")).alias("g"), episode_id(F.col("reupload_of")).alias("r"))
    ends = F.array_append(F.filter(F.array("s", "g", "r"), lambda x: x.isNotNull()), F.col("e"))
    pair = e.where("e IS NOT NULL").select("e", F.explode(ends).alias("x"))
    return pair.select(F.least("e", "x").alias("u"), F.greatest("e", "x").alias("v")).distinct()


def _with_minimum(directed: DataFrame) -> DataFrame:
    """``(u, v, m)``: each row with the least neighbour of ``u``, or ``u`` itself if that is less. The minima are partially aggregated
    before the shuffle and unique per node, so the join never multiplies rows; a node with very many rows is split by the adaptive skew join."""
    least = directed.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return directed.join(least, "u")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for links ``(u, v)`` by alternating large-star and small-star; ``component`` is the least node.

    The result of each round is written to the shared folder and compared with the last by count and checksum; then the last one is deleted.
    """
    spark = links.sparkSession
    links, _ = written(links.select("u", "v").distinct())
    nodes = links.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    edges, at = links.where("u <> v"), None
    state, before = _state(edges), None
    for _ in range(max_rounds):
        if not state[0] or state == before:
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_minimum(both).where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _with_minimum(large)
        turned = small.select(F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("v").alias("v")), F.struct(F.col("m").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.u", "x.v")
        (edges, made), old = written(turned.where("u <> v").distinct()), at
        before, state, at = state, _state(edges), made
        if old:
            forgotten(spark, old)
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    stars = edges.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component"))
    return nodes.join(stars, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def named_groups(rows: DataFrame, meta: DataFrame) -> DataFrame:
    """``(episode, group_episode)``: each distinct non-empty name in ``rows.episode``, and the least episode of its group."""
    names = rows.select("episode").where("episode <> ''").distinct().withColumn("node", episode_id(F.col("episode"))).where("node IS NOT NULL")
    known = meta.select(episode_id(F.col("episode")).alias("node")).where("node IS NOT NULL").distinct()
    groups = connected_components(episode_links(meta)).join(known, "node", "left_semi")
    own = groups.groupBy("component").agg(F.min("node").alias("least"))
    groups = groups.join(own, "component").select("node", "least")
    return names.join(groups, "node", "left").select("episode", F.coalesce("least", "node").alias("group_episode"))


def assign_splits(rows: DataFrame, key: str, groups: DataFrame, plan: list[tuple[str, float]], seed: str = "split", buckets: int = 4096) -> DataFrame:
    """``rows`` with ``group_episode`` and ``split``.

    Columns ``group_episode`` and ``split`` that ``rows`` may have are replaced. Groups are hashed by their identifier into ``buckets``; consecutive buckets make the range of a split, cut where the rows in
    them reach the split's share, so that the shares are of rows, not of groups. A group larger than half the least share would swamp a
    small split; such groups, at most ``2 / least share`` of them, go to the split with the largest share and count there. Rows without an
    episode are placed by their key. Collected are the giant groups and one count per bucket, both bounded.
    """
    rows = rows.drop("group_episode", "split")
    total_share = sum(s for _, s in plan)
    plan = sorted(((n, s / total_share) for n, s in plan), key=lambda x: (-x[1], x[0]))
    named = groups.select(F.col("episode").alias("_episode_name"), "group_episode")
    placed = rows.join(named, rows["episode"] == named["_episode_name"], "left").drop("_episode_name")
    place = F.coalesce(F.col("group_episode").cast("string"), F.concat(F.lit("/"), F.col(key).cast("string")), F.lit("/"))
    placed = placed.withColumn("_bucket", F.pmod(F.xxhash64(place, F.lit(seed)), F.lit(buckets)).cast("int"))
    # One row per group and per bucket of rows without one, read three times.
    sizes, _ = written(placed.groupBy("group_episode", "_bucket").agg(F.count("*").alias("n")))
    n_all = sizes.agg(F.sum("n")).first()[0] or 0
    is_giant = F.col("group_episode").isNotNull() & (F.col("n") > min(s for _, s in plan) * n_all / 2)
    giants = [r["group_episode"] for r in sizes.where(is_giant).select("group_episode").collect()]
    counts = dict(sizes.where(~is_giant).groupBy("_bucket").agg(F.sum("n").alias("n")).collect())
    split, bucket = F.lit(plan[0][0]), 0
    for name, share in reversed(plan[1:]):
        begin, filled = bucket, 0
        while bucket < buckets and filled + counts.get(bucket, 0) / 2 < share * n_all:
            filled += counts.get(bucket, 0)
            bucket += 1
        split = F.when(F.col("_bucket").between(begin, bucket - 1), name).otherwise(split)
    if giants:
        split = F.when(F.col("group_episode").isin(giants), plan[0][0]).otherwise(split)
    return placed.withColumn("split", split).drop("_bucket")


def split_checks(placed: DataFrame) -> DataFrame:
    """One row: rows, groups, and groups that more than one split has, which must be none."""
    per = placed.where("group_episode IS NOT NULL").groupBy("group_episode").agg(F.min("split").alias("least"), F.max("split").alias("greatest"))
    rows = placed.agg(F.count("*").alias("n_rows"), F.count_if(F.col("split").isNull()).alias("n_unplaced"))
    parted = per.agg(F.count("*").alias("n_groups"), F.count_if(F.col("least") != F.col("greatest")).alias("n_parted")).withColumn("one", F.lit(1))
    return rows.withColumn("one", F.lit(1)).join(parted, "one").drop("one")

"""Operators over ordered rows: repeats, islands, spans, contexts, n-grams, phrases, picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from warpweft.plans.session import checkpointed


def in_blocks(rows: DataFrame, by: list[str], order: list[str], block: Column, flag: Column | None = None, value: str | None = None) -> DataFrame:
    """``rows`` with their place in the sequence of their group, found without sorting any whole group in one task.

    ``block`` cuts each group into consecutive pieces, such as days of a time column; it must not fall along ``order``. Windows
    run within pieces; what came before a piece is added from one row per piece. Adds ``pos`` from one, ``flagged``, how many
    flagged rows there are up to this one, and ``before``, the value of the row before.
    """
    flag = F.lit(False) if flag is None else F.coalesce(flag, F.lit(False))
    cut = rows.withColumn("_block", block).withColumn("_flag", flag)
    within = W.partitionBy(*by, "_block").orderBy(*order)
    local = cut.withColumn("_pos", F.row_number().over(within)).withColumn("_seen", F.sum(F.col("_flag").cast("int")).over(within.rowsBetween(W.unboundedPreceding, 0)))
    last = F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)) if value else F.lit(None).cast("struct<v:string>")
    pieces = cut.groupBy(*by, "_block").agg(F.count("*").alias("_n"), F.count_if("_flag").alias("_f"), last.alias("_last"))
    earlier = W.partitionBy(*by).orderBy("_block")
    sums = earlier.rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_block").alias("_b"), F.coalesce(F.sum("_n").over(sums), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_f").over(sums), F.lit(0)).alias("_f0"), F.lag("_last").over(earlier).alias("_last"))
    if value:
        local = local.withColumn("_lag", F.lag(F.struct(F.col(value).alias("v"))).over(within))
    met = local["_block"].eqNullSafe(pieces["_b"])
    for c in by:
        met = met & local[c].eqNullSafe(pieces[f"_{c}"])
    joined = local.join(pieces, met)
    out = [F.col(c) for c in rows.columns] + [(F.col("_n0") + F.col("_pos")).alias("pos"), (F.col("_f0") + F.col("_seen")).alias("flagged")]
    return joined.select(*out, *([F.coalesce("_lag", "_last").alias("before")] if value else []))


def collapse_repeats(rows: DataFrame, by: list[str], order: list[str], value: str, block: Column) -> DataFrame:
    """Rows whose value differs from the row before; the first of each sequence stays. See ``in_blocks``."""
    placed = in_blocks(rows, by, order, block, value=value)
    return placed.where(F.col("before").isNull() | ~F.col("before.v").eqNullSafe(F.col(value))).drop("pos", "flagged", "before")


def islands(rows: DataFrame, by: list[str], order: list[str], flag: Column, block: Column) -> DataFrame:
    """Runs of flagged rows: first and last position and length of each. Runs are aggregated partially before the shuffle."""
    placed = in_blocks(rows, by, order, block, flag=flag).where(flag)
    run = F.col("pos") - F.col("flagged")
    return placed.groupBy(*by, run.alias("run")).agg(F.min("pos").cast("int").alias("first_pos"), F.max("pos").cast("int").alias("last_pos"), F.count("*").alias("n")).drop("run")


def contexts(rows: DataFrame, key: str, words: str, reach: int = 3, most: int = 2) -> DataFrame:
    """Up to ``most`` different contexts of ``reach`` words on either side for each word, the first in order of key and position.

    Contexts are cut from the row's own array; only one row per word and context is kept before words are ranked, by an aggregate that is partial before the shuffle.
    """
    at = rows.select(key, F.posexplode(words).alias("pos", "word"), F.col(words).alias("_all"))
    lo = F.greatest(F.col("pos") - reach, F.lit(0))
    text = F.array_join(F.slice("_all", lo + 1, F.col("pos") - lo + 1 + reach), " ")
    once = at.select("word", text.alias("context"), key, "pos").groupBy("word", "context").agg(F.min(F.struct(key, "pos")).alias("at"))
    ranked = once.withColumn("rank", F.row_number().over(W.partitionBy("word").orderBy("at", "context"))).where(F.col("rank") <= most)
    return ranked.select("word", "context", "rank")


def word_runs(words: Column, n: int, follow: Column | None = None) -> Column:
    """All runs of ``n`` neighbouring words, joined by blanks, in order; null where a word is null. Shifted arrays are zipped, which copies no run.

    ``follow`` has the words again, with null for those that may begin a run but not go on with one.
    """
    follow = words if follow is None else follow
    many = F.greatest(F.size(words) - n + 1, F.lit(0))
    runs = F.slice(words, F.lit(1), many)
    for k in range(1, n):
        runs = F.zip_with(runs, F.slice(follow, F.lit(k + 1), many), lambda a, b: F.concat(a, F.lit(" "), b))
    return runs


def ngrams(words: Column, n: int) -> Column:
    """All runs of ``n`` neighbouring words, joined by blanks; none that holds a null word."""
    return F.filter(word_runs(words, n), lambda r: r.isNotNull())


def mine_ngrams(rows: DataFrame, words: str, sizes: tuple[int, ...], least: int) -> DataFrame:
    """``(n, gram, count)`` of n-grams that occur at least ``least`` times."""

    def of_size(n: int) -> Column:
        return F.transform(ngrams(F.col(words), n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("gram")))

    every = F.flatten(F.array(*[of_size(n) for n in sizes]))
    return rows.select(F.explode(every).alias("g")).groupBy(F.col("g.n").alias("n"), F.col("g.gram").alias("gram")).agg(F.count("*").alias("count")).where(F.col("count") >= least)


def longest_matches(rows: DataFrame, key: str, words: str, phrases: DataFrame, longest: int, bound: int = 200_000, follow: str | None = None) -> DataFrame:
    """Phrases in a line, longest first at each place, left to right, never overlapping; see ``word_runs`` for ``follow``.

    ``phrases`` is ``(gram)``, broadcast only if a count proves it small. Candidates come from a join; overlaps are resolved by one pass over each line's candidates.
    """

    def of_size(n: int) -> Column:
        return F.transform(word_runs(F.col(words), n, F.col(follow) if follow else None), lambda g, i: F.struct((i + 1).alias("start"), F.lit(n).alias("n"), g.alias("gram")))

    phrases = checkpointed(phrases)  # counted and joined, made once
    grams = F.flatten(F.array(*[of_size(n) for n in range(2, longest + 1)]))
    every = rows.where(F.size(words) >= 2).select(key, F.explode(grams).alias("g")).select(key, "g.*").where("gram IS NOT NULL")
    small = phrases.limit(bound + 1).count() <= bound
    met = every.join(F.broadcast(phrases) if small else phrases, "gram", "left_semi")
    ordered = F.array_sort(F.collect_list(F.struct("start", (-F.col("n")).alias("minus_n"), "gram")))
    zero = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,minus_n:int,gram:string>>").alias("kept"))
    chosen = F.aggregate("c", zero, lambda acc, x: F.when(x["start"] > acc["end"], F.struct((x["start"] - x["minus_n"] - 1).alias("end"), F.array_append(acc["kept"], x).alias("kept"))).otherwise(acc), lambda acc: acc["kept"])
    return met.groupBy(key).agg(ordered.alias("c")).select(key, F.explode(chosen).alias("m")).select(key, F.col("m.start").alias("start"), (-F.col("m.minus_n")).alias("n"), F.col("m.gram").alias("gram"))


def round_robin(rows: DataFrame, item: str, group: str, order: list[str], most: int, arrival: bool = False) -> DataFrame:
    """Up to ``most`` rows per item, taking each group once before any twice; groups in order of name, or of ``order`` if they are to come as they arrive."""
    inner = F.row_number().over(W.partitionBy(item, group).orderBy(*order))
    turn = rows.withColumn("turn", inner).where(F.col("turn") <= most)
    outer = F.row_number().over(W.partitionBy(item).orderBy("turn", *([] if arrival else [group]), *order))
    return turn.withColumn("pick", outer).where(F.col("pick") <= most)


def hash_order(seed: str, *keys: str) -> Column:
    """A fixed random order that other engines can repeat."""
    return F.md5(F.concat(F.lit(seed), *[F.col(k).cast("string") for k in keys]))


def stratified(rows: DataFrame, stratum: str, key: str, quota: int, seed: str = "42") -> DataFrame:
    """``quota`` rows per stratum in hash order."""
    rank = F.row_number().over(W.partitionBy(stratum).orderBy(hash_order(seed, key), key))
    return rows.withColumn("rank", rank).where(F.col("rank") <= quota)


def group_split(rows: DataFrame, group: str, cuts: list[tuple[str, int]], seed: str = "42") -> DataFrame:
    """Rows with a split that is the same for all rows of a group: the first four hex digits of the group's hash against cuts out of 65,536."""
    at = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col(group), F.lit("")))), 1, 4), 16, 10).cast("int")
    split = F
    for name, below in cuts[:-1]:
        split = split.when(at < below, name)
    return rows.withColumn("split_name", split.otherwise(cuts[-1][0]))


def member_ngrams(rows: DataFrame, key: str, words: str, members: DataFrame, member: str, sizes: tuple[int, ...]) -> DataFrame:
    """``(n, gram, count)`` of n-grams whose words are all in a set: words are joined with the set once, others become null, which no n-gram holds."""
    each = rows.select(key, F.posexplode(words).alias("_p", "_w"))
    known = members.select(F.col(member).alias("_w"), F.lit(True).alias("_k")).distinct()
    line = each.join(known, "_w", "left").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_p", F.when(F.col("_k"), F.col("_w")).alias("w")))).alias("_l"))
    return mine_ngrams(line.select(F.transform("_l", lambda x: x["w"]).alias("w")), "w", sizes, 1)


def around(words: Column, at: Column, reach: int) -> tuple[Column, Column]:
    """Up to ``reach`` words before and after the word at a place, counted from 0."""
    begin = F.greatest(at - reach, F.lit(0))
    return F.slice(words, begin + 1, at - begin), F.slice(words, at + 2, F.lit(reach))

"""Scores: error rates by many groups at once, edit rates, accuracy by position, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rates_by(rows: DataFrame, flag: Column, by: list[str]) -> DataFrame:
    """Rows, flagged rows and their share over all and within each value of each column, from one pass (grouping sets)."""
    each = rows.select(flag.alias("_flag"), F.explode(F.array(F.struct(F.lit("all").alias("dimension"), F.lit("").alias("value")), *[F.struct(F.lit(c).alias("dimension"), F.coalesce(F.col(c), F.lit("")).alias("value")) for c in by])).alias("g"))
    return each.groupBy(F.col("g.dimension").alias("dimension"), F.col("g.value").alias("value")).agg(F.count("*").alias("n"), F.count_if("_flag").alias("n_wrong"), F.round(F.count_if("_flag") / F.count("*"), 6).alias("rate"))


def edit_rate(rows: DataFrame, reference: Column, heard: Column, by: list[str]) -> DataFrame:
    """Edits over reference symbols, micro-averaged; both columns have one character per symbol."""
    each = rows.select(*by, F.levenshtein(reference, heard).alias("e"), F.length(reference).alias("n"))
    return each.groupBy(*by).agg(F.count("*").alias("n_pairs"), F.sum("e").alias("edits"), F.sum("n").alias("symbols"), F.round(F.sum("e") / F.sum("n"), 6).alias("rate"))


def readings_scored(rows: DataFrame, ref: Column, heard: Column, stress_ref: Column, stress_heard: Column, by: list[str]) -> DataFrame:
    """Edits over symbols, and stress apart: of the pairs with equal symbols those whose stress stands elsewhere. Both symbol columns have one character per symbol."""
    each = rows.select(*by, F.levenshtein(ref, heard).alias("e"), F.length(ref).alias("n"), F.coalesce(stress_ref == stress_heard, stress_ref.isNull() & stress_heard.isNull()).alias("s"))
    same = F.col("e") == 0
    return each.groupBy(*by).agg(
        F.count("*").alias("n_pairs"), F.sum("e").alias("edits"), F.sum("n").alias("symbols"), F.round(F.sum("e") / F.sum("n"), 6).alias("rate"), F.count_if(same).alias("n_same"), F.count_if(same & ~F.col("s")).alias("n_stress_wrong")
    )


def differences(made: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(side, n)``: rows that only one of two tables has, repeated rows counted: none where a table equals the one derived again."""
    a, b = made.exceptAll(wanted).agg(F.count("*").alias("n")), wanted.exceptAll(made).agg(F.count("*").alias("n"))
    return a.select(F.lit("made only").alias("side"), "n").unionByName(b.select(F.lit("wanted only").alias("side"), "n"))


def canaries(readings: DataFrame, key: str, value: str, expected: DataFrame, floors: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """``(check, found, passed)``: tables with at least so many rows, and keys that must read as ``expected`` ``(key, value)``."""
    every = None
    for name, (df, least) in floors.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), F.col("n").cast("string").alias("found"), (F.col("n") >= least).alias("passed"))
        every = one if every is None else every.unionByName(one)
    held = readings.groupBy(key).agg(F.min(value).alias("_v"))
    read = expected.join(held, key, "left").select(F.concat(F.lit("canary "), F.col(key).cast("string")).alias("check"), F.col("_v").alias("found"), F.col("_v").eqNullSafe(F.col(value)).alias("passed"))
    return read if every is None else every.unionByName(read)


def gates(checks: list[tuple[str, DataFrame]]) -> DataFrame:
    """``(gate, violations, passed)``: the number of rows of each frame of violations."""
    every = None
    for name, bad in checks:
        one = bad.agg(F.count("*").alias("violations")).select(F.lit(name).alias("gate"), "violations", (F.col("violations") == 0).alias("passed"))
        every = one if every is None else every.unionByName(one)
    return every


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Row count and two order-free checksums of a table's rows; equal tables have equal ones.

    ``fingerprint`` is the exclusive or of 60 bits of each row's MD5, ``checksum`` the sum of 16 bits, so that repeated rows count. Aggregated without collecting rows.
    """
    text = F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0001")) for c in columns])
    hashed = rows.select(F.md5(text).alias("h"))
    bits = lambda n: F.conv(F.substring("h", 1, n), 16, 10).cast("bigint")
    return hashed.agg(F.count("*").alias("n_rows"), F.bit_xor(bits(15)).alias("fingerprint"), F.sum(bits(4)).alias("checksum"))


def vector_argmax(rows: DataFrame, vector: str, parts: list[tuple[str, int, int]]) -> DataFrame:
    """Index of the first greatest element in slices ``(name, begin, size)`` of a vector."""
    for name, begin, size in parts:
        part = F.slice(vector, begin + 1, size)
        rows = rows.withColumn(name, (F.array_position(part, F.array_max(part)) - 1).cast("int"))
    return rows

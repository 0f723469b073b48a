"""Problem 2: one consistent form of values that look the same.

Values are mapped by ``look_form``, Latin look-alikes in every word, grouped in SQL under the accent-sensitive collation UNICODE, and each class gets
a canonical member, which is joined back. Defined results: a null or blank value is its own form and never a case; repeated rows keep
their own ids; an empty table gives no rows; ties between members go to the most frequent, then the least string; texts of
any length are compared whole; further columns of the table don't matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warpweft.llm.lookalike import composed, look_form
from warpweft.plans.session import checkpointed

COLLATION = "UNICODE"


def long_values(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``(field, id, value)``: one row for each value of each field, the key as text."""
    parts = [df.select(F.lit(f).alias("field"), F.col(key).cast("string").alias("id"), F.col(f).alias("value")) for f in fields]
    return reduce(DataFrame.unionByName, parts)


def look_classes(values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(field, value, look)``, each value of a field once, and ``(field, look, canonical, n_values, n_rows)``, a row for each class of equal-looking values.

    Classes are those of the collation; since it ignores some marks, members of a class whose mapped forms aren't the same string are
    parted. Repeated values are counted first, so that a hot value is a single row when classes are formed.
    """
    spark = values.sparkSession
    counted = values.where(F.col("value").isNotNull()).groupBy("field", "value").agg(F.count("*").alias("n"))
    # The mapped form is dear and read twice.
    counted = checkpointed(counted.withColumn("look", composed(look_form(F.col("value"), every_word=True))).where("look <> ''"))
    counted.createOrReplaceTempView("warpweft_look_values")
    grouped = spark.sql(
        f"""SELECT field, look, min_by(value, struct(-n, value)) AS canonical, count(*) AS n_values, sum(n) AS n_rows
            FROM warpweft_look_values GROUP BY field, look COLLATE {COLLATION}, look"""
    )
    return counted.select("field", "value", "look"), grouped


def canonical_values(values: DataFrame) -> DataFrame:
    """``(field, id, value, form, canonical, n_values)`` of ``(field, id, value)``: every row, with its one form.

    ``form`` is the mapped form in canonical composition, equal for all members of a class; ``canonical`` the chosen member as stored. For null and blank
    values ``form`` and ``canonical`` are the value itself.
    """
    each, classes = look_classes(values)
    known = each.join(classes, ["field", "look"])
    joined = values.join(known, ["field", "value"], "left")
    return joined.select(
        "field", "id", "value", F.coalesce("look", "value").alias("form"), F.coalesce("canonical", "value").alias("canonical"), F.coalesce("n_values", F.lit(1)).cast("long").alias("n_values")
    )


def lookalike_pairs(values: DataFrame, numeric_key: bool) -> DataFrame:
    """``(field, id_a, id_b)``: rows whose values look the same but are different strings.

    Only classes with two or more different strings take part. Within these the join is on class, and exact copies never pair.
    """
    rows = canonical_values(values).where("n_values > 1").select("field", "id", "value", "form", F.xxhash64("field", "form").alias("k"))
    a, b = rows.alias("a"), rows.alias("b")
    before = F.col("a.id").cast("long") < F.col("b.id").cast("long") if numeric_key else F.col("a.id") < F.col("b.id")
    met = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.form") == F.col("b.form")) & (F.col("a.field") == F.col("b.field")) & before & (F.col("a.value") != F.col("b.value")))
    return met.select(F.col("a.field").alias("field"), F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))

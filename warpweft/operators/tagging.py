"""Character tagging: labels of marks and back, batches for a model, its three heads decoded, words scored against labels.

The model is a callable of the caller; it is made once per worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warpweft.functions import text as T

#: A label that is not to be learned or scored.
IGNORE = -100


@cache
def held_model(factory: Callable[[], Callable]) -> Callable:
    """The model of a factory, made when a worker first needs it."""
    return factory()


def label_ids(marks: Column, classes: list[list[str]]) -> Column:
    """One number per class of marks: the place of the first of its marks among the class, 0 without one; null marks are ``IGNORE`` in each class."""

    def of(kind: list[str]) -> Column:
        found = F.lit(0)
        for k, m in reversed(list(enumerate(kind, 1))):
            found = F.when(F.contains(marks, F.lit(m)), k).otherwise(found)
        return F.when(marks.isNull(), IGNORE).otherwise(found)

    return F.array(*[of(k) for k in classes])


def marks_of(ids: Column, classes: list[list[str]]) -> Column:
    """The marks that numbers of classes stand for, in order of the classes; the inverse of ``label_ids`` but for what no class has."""
    parts = [F.get(F.array(F.lit(""), *[F.lit(m) for m in kind]), F.greatest(F.get(ids, F.lit(k)), F.lit(0))) for k, kind in enumerate(classes)]
    return F.concat(*parts)


def padded(values: Column, width: int, fill: int = IGNORE) -> Column:
    """An array cut or filled to a width, as batches for a model are."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(fill), width)), F.lit(1), F.lit(width))


def tag(rows: DataFrame, key: str, text: str, vocabulary: dict[str, int], factory: Callable[[], Callable], classes: list[list[str]], limit: int = 400, batch: int = 32) -> DataFrame:
    """``(key, pointed)``: each text with the marks a model gives its letters.

    Texts are cut after blanks into pieces of at most ``limit`` letters, encoded, padded per batch and given to the model, whose heads are ``[pieces, letters, classes]``; the first greatest
    class counts. Pieces are joined by their owner again. A text whose letters come out changed is an error; null stays null.
    """
    pieces = rows.select(key, F.posexplode_outer(T.budget_chunks(F.col(text), limit, cut_words=True)).alias("piece", "letters"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = held_model(factory)
        for frame in batches:
            out = []
            letters = frame["letters"].fillna("").tolist()
            for begin in range(0, len(letters), batch):
                part = letters[begin : begin + batch]
                width = max(1, max(map(len, part)))
                ids = np.zeros((len(part), width), np.int64)
                for k, t in enumerate(part):
                    ids[k, : len(t)] = [vocabulary.get(c, 1) for c in t]
                best = [np.argmax(h, axis=-1) for h in model(ids)]
                for k, t in enumerate(part):
                    out.append("".join(c + "".join(kind[best[h][k, i] - 1] if best[h][k, i] else "" for h, kind in enumerate(classes)) for i, c in enumerate(t)))
                    if "".join(c for c in out[-1] if not any(c in m for kind in classes for m in kind)) != "".join(c for c in t if not any(c in m for kind in classes for m in kind)):
                        raise ValueError("letters changed")
            yield pd.DataFrame({key: frame[key], "piece": frame["piece"], "pointed": out})

    kind = rows.schema[key].dataType.simpleString()
    done = pieces.where("letters IS NOT NULL").mapInPandas(run, f"{key} {kind}, piece int, pointed string")
    joined = done.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "pointed"))), lambda x: x["pointed"]), "").alias("pointed"))
    return rows.select(key, F.col(text).alias("_t")).join(joined, key, "left").select(key, F.when(F.col("_t") == "", "").otherwise(F.col("pointed")).alias("pointed"))


def labelled_words(rows: DataFrame, key: list[str], text: str, marks: str) -> DataFrame:
    """``(key, pos, word, labels)``: words of a text with the labels of their letters, from rows with as many labels as letters."""
    spans = rows.where(F.size(marks) == F.length(text)).select(*key, F.col(marks).alias("_m"), F.posexplode(T.word_spans(F.col(text))).alias("pos", "x"))
    return spans.select(*key, "pos", F.col("x.word").alias("word"), F.slice("_m", F.col("x.begin") + 1, F.col("x.end") - F.col("x.begin")).alias("labels"))


def scored_letters(words: DataFrame, group: list[str], truth: str, guess: str) -> DataFrame:
    """Per group: letters with a label, right ones, marked ones and right ones of these, words with a label and wholly right ones.

    ``truth`` and ``guess`` are arrays of equal length; letters with a null truth are not scored. A guess that is missing or of another length says that no letter has a mark.
    """
    fit = F.when(F.coalesce(F.size(guess), F.lit(-1)) == F.size(truth), F.col(guess)).otherwise(F.transform(truth, lambda _: F.lit("")))
    pairs = F.filter(F.zip_with(F.col(truth), fit, lambda t, g: F.struct(t.alias("t"), F.coalesce(g, F.lit("")).alias("g"))), lambda x: x["t"].isNotNull())
    each = words.withColumn("_p", pairs).where(F.size("_p") > 0)
    n = lambda keep: F.sum(F.size(F.filter("_p", keep)))
    right = lambda x: x["t"] == x["g"]
    return each.groupBy(*group).agg(
        F.sum(F.size("_p")).alias("letters"), n(right).alias("letters_right"), n(lambda x: x["t"] != "").alias("marked"), n(lambda x: (x["t"] != "") & right(x)).alias("marked_right"),
        F.count("*").alias("words"), F.count_if(F.forall("_p", right)).alias("words_right"),
    )


def confusions(words: DataFrame, group: list[str], truth: str, guess: str, part: Callable[[Column], Column]) -> DataFrame:
    """``(group, truth, guess, n)`` of one part of the marks of each labelled letter, such as its vowel point."""
    each = words.where(F.size(guess) == F.size(truth)).select(*group, F.explode(F.arrays_zip(F.col(truth).alias("t"), F.col(guess).alias("g"))).alias("z")).where("z.t IS NOT NULL")
    return each.groupBy(*group, part(F.col("z.t")).alias("truth"), part(F.coalesce("z.g", F.lit(""))).alias("guess")).agg(F.count("*").alias("n"))

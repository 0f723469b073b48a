"""Greedy cover: the rows that together show the most of what is wanted.

Gains are computed by the cluster; the order of picks is settled on the driver among a bounded number of rows at a time. A row's gain never
grows, so the gain it had at the beginning of a round bounds it, and a pick is safe as long as it beats the first row that wasn't fetched.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from warpweft.plans.session import checkpointed


class Coverage:
    """How often each value has been shown, for the values of picked rows only."""

    def __init__(self, need: int):
        self.need, self.seen = need, {}

    def gain(self, values: dict) -> float:
        return sum(w for v, w in values.items() if self.seen.get(v, 0) < self.need)

    def add(self, values: dict) -> None:
        for v in values:
            self.seen[v] = self.seen.get(v, 0) + 1

    def met(self) -> list:
        return [v for v, n in self.seen.items() if n >= self.need]


def _still_wanted(left: DataFrame, coverage: Coverage, gone: list) -> DataFrame:
    """Pairs of rows and values without values shown often enough and rows already picked. Both lists are as long as the picks at most."""
    spark, (key, value) = left.sparkSession, (left.schema[0], left.schema[1])
    met = spark.createDataFrame([(v,) for v in coverage.met()], f"value {value.dataType.simpleString()}")
    picked = spark.createDataFrame([(k,) for k in gone], f"{key.name} {key.dataType.simpleString()}")
    return left.join(met, "value", "left_anti").join(picked, key.name, "left_anti")


def _fetch(left: DataFrame, keys: DataFrame, key: str) -> dict:
    """Values and weights of the given rows, of which there are few."""
    lists = left.join(keys.select(key), key, "left_semi").groupBy(key).agg(F.collect_list(F.struct("value", "weight")).alias("l"))
    return {r[key]: {x["value"]: x["weight"] for x in r["l"]} for r in lists.collect()}


def greedy_cover(rows: DataFrame, key: str, values: str, weights: DataFrame, steps: int, need: int = 1, held: int = 256) -> DataFrame:
    """``(step, key, gain)``: at each step the row that adds most weight of values shown fewer than ``need`` times; of equals the least key.

    ``weights`` is ``(value, weight)``. ``held`` rows are fetched a round, so many picks take few rounds. Ends early when nothing is gained. Null keys are left out.
    """
    left = checkpointed(rows.where(F.col(key).isNotNull()).select(key, F.explode(F.array_distinct(values)).alias("value")).join(weights, "value").select(key, "value", F.col("weight").cast("double").alias("weight")))
    coverage, chosen = Coverage(need), []
    while len(chosen) < steps:
        wanted = _still_wanted(left, coverage, [k for _, k, _ in chosen])
        gains = wanted.groupBy(key).agg(F.sum("weight").alias("gain")).where("gain > 0").orderBy(F.desc("gain"), key).limit(held + 1).collect()
        if not gains:
            break
        inside, bound = gains[:held], gains[held] if len(gains) > held else None
        lists = _fetch(wanted, rows.sparkSession.createDataFrame([(g[key],) for g in inside], f"{key} {left.schema[0].dataType.simpleString()}"), key)
        heap = [(-g["gain"], g[key]) for g in inside]
        heapq.heapify(heap)
        while heap and len(chosen) < steps:
            old, k = heapq.heappop(heap)
            gain = coverage.gain(lists[k])
            if gain <= 0:
                continue
            if gain < -old:
                heapq.heappush(heap, (-gain, k))
                continue
            if bound is not None and (-gain, k) > (-bound["gain"], bound[key]):
                break
            chosen.append((len(chosen) + 1, k, float(gain)))
            coverage.add(lists[k])
    return rows.sparkSession.createDataFrame(chosen, f"step int, {key} {left.schema[0].dataType.simpleString()}, gain double")


def one_pass_cover(rows: DataFrame, key: str, values: str, targets: DataFrame, most: int, need: int = 1, held: int = 1024) -> DataFrame:
    """``(step, key, gain)``: rows in order of how many targets they have, then key; each is taken if one of its targets is shown fewer than ``need`` times still.

    ``targets`` is ``(value)``. ``held`` rows are fetched a round, only such as still have an open target.
    """
    left = rows.where(F.col(key).isNotNull()).select(key, F.explode(F.array_distinct(values)).alias("value")).join(targets.select("value").distinct(), "value")
    left = checkpointed(left.select(key, "value", F.lit(1.0).alias("weight")))
    order = checkpointed(left.groupBy(key).agg(F.count("*").alias("n")))
    coverage, chosen, last = Coverage(need), [], None
    while len(chosen) < most:
        wanted = _still_wanted(left, coverage, [])
        open_rows = wanted.select(key).distinct().join(order, key)
        if last is not None:
            open_rows = open_rows.where((F.col("n") < last[0]) | ((F.col("n") == last[0]) & (F.col(key) > F.lit(last[1]))))
        part = open_rows.orderBy(F.desc("n"), key).limit(held).collect()
        if not part:
            break
        lists = _fetch(left, rows.sparkSession.createDataFrame([(p[key],) for p in part], f"{key} {left.schema[0].dataType.simpleString()}"), key)
        for p in part:
            gain = coverage.gain(lists[p[key]])
            if gain > 0 and len(chosen) < most:
                chosen.append((len(chosen) + 1, p[key], float(gain)))
                coverage.add(lists[p[key]])
        last = (part[-1]["n"], part[-1][key])
    return rows.sparkSession.createDataFrame(chosen, f"step int, {key} {left.schema[0].dataType.simpleString()}, gain double")

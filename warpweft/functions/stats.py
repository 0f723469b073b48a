"""Column builders for counts: smoothed rates and binomial tails."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def smoothed_rate(k: Column, n: Column, categories: Column, add: float = 0.5) -> Column:
    """(k + add) / (n + add * categories)."""
    return (k + add) / (n + categories * add)


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series from 10 on, by the product below; no array grows with ``n``."""
    x = F.greatest(n.cast("double"), F.lit(10.0))
    series = (x + 0.5) * F.log(x) - x + F.lit(0.5 * math.log(2 * math.pi)) + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3))) + 1 / (1260 * F.pow(x, F.lit(5)))
    few = F.array(*[F.lit(math.lgamma(k + 1)) for k in range(11)])
    return F.when(n <= 10, F.get(few, F.greatest(n, F.lit(0)).cast("int"))).otherwise(series)


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """P(X >= k) for X ~ Bin(n, p); 1 for k <= 0, and the limits for p at 0 and 1.

    Terms are summed in log space away from the mean, so they fall: the upper tail from k up, or the lower one from k - 1 down. Twelve standard deviations and
    sixty terms are enough for double precision, so the work grows with the square root of ``n`` only.
    """
    k, n = k.cast("bigint"), n.cast("bigint")
    odds = F.log(p / (1 - p))
    reach = F.ceil(12 * F.sqrt(n * p * (1 - p))) + 60
    upper = k > n * p

    def log_term(i: Column) -> Column:
        return log_factorial(n) - log_factorial(i) - log_factorial(n - i) + i * F.log(p) + (n - i) * F.log(1 - p)

    def total(first: Column, steps: Column, step) -> Column:
        zero = F.struct(F.lit(0.0).alias("sum"), log_term(first).cast("double").alias("log"))
        grow = lambda acc, d: F.struct((acc["sum"] + F.exp(acc["log"])).alias("sum"), (acc["log"] + step(d)).cast("double").alias("log"))
        return F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.least(steps, reach), F.lit(0))), zero, grow, lambda acc: acc["sum"])

    up = total(k, n - k, lambda d: F.when(k + d < n, F.log((n - k - d) / (k + d + 1)) + odds).otherwise(0.0))
    low = k - 1
    down = total(low, low, lambda d: F.when(low - d > 0, F.log((low - d) / (n - low + d + 1)) - odds).otherwise(0.0))
    inside = F.when(upper, F.least(up, F.lit(1.0))).otherwise(F.greatest(1 - down, F.lit(0.0)))
    return F.when(k <= 0, 1.0).when(k > n, 0.0).when(p <= 0, 0.0).when(p >= 1, 1.0).otherwise(inside)

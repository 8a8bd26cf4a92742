"""Whether columns are normal, by the correlation of ordered values with normal scores.

The statistic is that of Shapiro and Francia: the squared correlation of the values in
order with the normal scores of their ranks.  Equal values share the scores of all ranks they
take, so a column of few values is far from normal.  Values are counted, cut into ranges by
value, and ranked inside their range from the number of values before it, so that no task
holds a whole column and a value that many rows share is one row.

Royston's approximation gives the statistic that one normal sample in twenty stays under.  Beyond
LARGEST rows that limit stays as it is, so large columns have to be as close to normal as one of
that size, and not closer and closer.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import lru_cache
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.coercion import number_of
from tabulon.session import settle, small_table

LARGEST = 5000
RANGE_ROWS = 2_000_000
"""Distinct values of a range, which one task sorts."""

SUMMED_SCORES = 20_000

# Coefficients of a rational approximation of the normal quantile (relative error 1.2e-9).
_CENTRE_TOP = (
    -3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
    1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00,
)
_CENTRE_BOTTOM = (
    -5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0,
)
_TAIL_TOP = (
    -7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
    -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00,
)
_TAIL_BOTTOM = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
_TAIL_FROM = 0.02425

SCHEMA = "ordinal int, column string, n bigint, statistic double, limit double, normal boolean"


def _polynomial(x: Column, factors: Sequence[float]) -> Column:
    total = F.lit(factors[0])
    for factor in factors[1:]:
        total = total * x + F.lit(factor)
    return total


def normal_quantile(p: Column) -> Column:
    """The value a normal variable stays under with probability ``p``, 0 < p < 1."""
    low = F.sqrt(-2 * F.log(p))
    high = F.sqrt(-2 * F.log(1 - p))
    q = p - 0.5
    return (
        F.when(p < _TAIL_FROM, _polynomial(low, _TAIL_TOP) / _polynomial(low, _TAIL_BOTTOM))
        .when(p > 1 - _TAIL_FROM, -_polynomial(high, _TAIL_TOP) / _polynomial(high, _TAIL_BOTTOM))
        .otherwise(q * _polynomial(q * q, _CENTRE_TOP) / _polynomial(q * q, _CENTRE_BOTTOM))
    )


def _density(z: Column) -> Column:
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi)


@lru_cache(maxsize=1024)
def score_squares(n: int) -> float:
    """Sum of the squared scores of n ranks: one by one at both ends, in the middle the integral."""
    normal, ends = NormalDist(), min(n // 2, SUMMED_SCORES)
    total = 2 * sum(normal.inv_cdf((i - 0.375) / (n + 0.25)) ** 2 for i in range(1, ends + 1))
    if n // 2 <= SUMMED_SCORES:
        return total  # the middle rank of an odd number scores 0
    z = normal.inv_cdf((ends + 0.125) / (n + 0.25))
    return total + (n + 0.25) * (1 - 2 * normal.cdf(z) + 2 * z * normal.pdf(z))


def normal_limit(n: int) -> float:
    """The statistic that one in twenty normal samples stays under."""
    u = math.log(min(max(n, 5), LARGEST))
    v = math.log(u)
    return 1 - math.exp(-1.2725 + 1.0521 * (v - u) + NormalDist().inv_cdf(0.95) * (1.0308 - 0.26758 * (v + 2 / u)))


def rank_statistics(df: DataFrame, values: Mapping[str, Column], facts: Mapping[str, tuple]) -> dict[str, float | None]:
    """The statistic of each expression; ``facts`` are its number of values, mean and population deviation."""
    names = [n for n in values if facts[n][0] and facts[n][2]]
    if not names:
        return dict.fromkeys(values)
    cells = [
        F.when(x.isNotNull(), F.struct(F.lit(k).alias("k"), x.cast("double").alias("x")))
        for k, n in enumerate(names)
        for x in [values[n]]
    ]
    counted = (
        df.select(F.inline(F.array_compact(F.array(*cells)))).groupBy("k", "x").agg(F.count(F.lit(1)).alias("n"))
    )
    rows = sum(facts[n][0] for n in names)
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // RANGE_ROWS))
    ranged = settle(counted.repartitionByRange(ranges, "k", "x").withColumn("part", F.spark_partition_id()))
    earlier = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy("k", "part").agg(F.sum("n").alias("held"))  # one row per range and column
        .select("k", "part", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("start"))
    )
    running = Window.partitionBy("k", "part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    total = F.element_at(F.array(*[F.lit(facts[n][0]).cast("double") for n in names]), F.col("k") + 1) + 0.25
    mean = F.element_at(F.array(*[F.lit(float(facts[n][1])) for n in names]), F.col("k") + 1)
    upto, n = F.col("upto"), F.col("n")
    edges = [_density(normal_quantile((place + 0.125) / total)) for place in (upto - n, upto)]
    score = F.when(n == 1, normal_quantile((upto - 0.375) / total)).otherwise(total * (edges[0] - edges[1]))
    sums = (
        ranged.join(starts, ["k", "part"])
        .withColumn("upto", F.col("start") + F.sum("n").over(running))
        .groupBy("k")
        .agg(F.sum((F.col("x") - mean) * score).alias("s"))
        .collect()  # one row per column
    )
    found: dict[str, float | None] = dict.fromkeys(values)
    for r in sums:
        name = names[r["k"]]
        count, _, deviation = facts[name]
        found[name] = r["s"] * r["s"] / (count * deviation * deviation * score_squares(count))
    return found


def normality(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(ordinal, column, n, statistic, limit, normal)``; a column without spread has no statistic and is not normal."""
    values = {n: number_of(df, n) for n in columns}
    if not values:
        return small_table(df.sparkSession, [], SCHEMA)
    row = df.agg(*[f(x).alias(f"{f.__name__}{k}") for k, x in enumerate(values.values()) for f in (F.count, F.avg, F.stddev_pop)]).first()
    facts = {n: (row[f"count{k}"], row[f"avg{k}"], row[f"stddev_pop{k}"]) for k, n in enumerate(values)}
    found = rank_statistics(df, values, facts)
    return small_table(
        df.sparkSession,
        [
            (df.columns.index(n), n, facts[n][0], w, normal_limit(facts[n][0]), w is not None and w >= normal_limit(facts[n][0]))
            for n, w in found.items()
        ],
        SCHEMA,
    )

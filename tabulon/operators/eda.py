"""Exploration tables: strong pairs, missing patterns, histograms, chart data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions.coercion import number_of
from tabulon.functions.grading import share
from tabulon.operators.cells import top_values
from tabulon.operators.profile import per_column, row_missing

STRONG = 0.7
HISTOGRAM_BINS = 30


def strong_pairs(pairs: DataFrame, limit: float = STRONG) -> DataFrame:
    return pairs.where(F.abs("correlation") > limit)


def missing_patterns(df: DataFrame, top: int = 5) -> DataFrame:
    """How many rows miss k cells, the most common k first; none if nothing is missing."""
    histogram = df.groupBy(row_missing(df).alias("missing_columns_count")).agg(
        F.count(F.lit(1)).alias("rows_with_pattern")
    )
    totals = histogram.agg(
        F.sum("rows_with_pattern").alias("rows"), F.max("missing_columns_count").alias("most")
    )
    return (
        histogram.crossJoin(F.broadcast(totals))  # one row of totals
        .where(F.col("most") > 0)
        .select(
            F.col("missing_columns_count").cast("bigint").alias("missing_columns_count"),
            "rows_with_pattern",
            share(F.col("rows_with_pattern"), F.col("rows")).alias("percentage"),
        )
        .orderBy(F.desc("rows_with_pattern"), "missing_columns_count")
        .limit(top)
    )


def missing_pattern_class(df: DataFrame) -> DataFrame:
    """Whether missing cells sit in a minority of the rows or spread over most."""
    hit = row_missing(df) > 0
    return df.agg(
        F.count_if(hit).alias("rows_affected"), F.count(F.lit(1)).alias("rows")
    ).select(
        F.when(F.col("rows_affected") == 0, "No missing data")
        .when(F.col("rows_affected") < F.col("rows") * 0.5, "Systematic")
        .otherwise("Random")
        .alias("pattern"),
        "rows_affected",
        F.round(share(F.col("rows_affected"), F.col("rows")), 2).alias("rows_affected_percentage"),
    )


def category_chart(
    df: DataFrame, columns: Sequence[str], k: int = 10, max_columns: int = 3, counts: DataFrame | None = None
) -> DataFrame:
    """Top-k bars of the first categorical columns that hold more than one value."""
    tops = top_values(df, list(columns)[:max_columns], k, counts)
    shown = tops.groupBy("ordinal").agg(F.max("rank").alias("bars")).where(F.col("bars") > 1)
    return tops.join(F.broadcast(shown), "ordinal", "left_semi")


def missing_chart(missing: DataFrame) -> DataFrame:
    """Missing counts above zero, the largest first."""
    return missing.where(F.col("missing_count") > 0).orderBy(F.desc("missing_count"), "ordinal")


def histograms(
    df: DataFrame, columns: Sequence[str], bins: int = HISTOGRAM_BINS, max_columns: int = 4
) -> DataFrame:
    """Equal-width bins of the first numerical columns, all in one grouping.

    The last bin is closed; a column with a single value has one bin.
    """
    names = list(columns)[:max_columns]
    values = df.select(*[number_of(df, n).alias(n) for n in names])
    ends = per_column(values, {n: [("lo", F.min(values[n])), ("hi", F.max(values[n]))] for n in names})
    long = values.select(
        F.stack(F.lit(len(names)), *[c for k, n in enumerate(names) for c in (F.lit(k), values[n])]).alias("ordinal", "x")
    ).where(F.col("x").isNotNull())
    bin_of = F.when(F.col("lo") == F.col("hi"), F.lit(1).cast("bigint")).otherwise(
        F.least(F.width_bucket("x", "lo", "hi", F.lit(bins)), F.lit(bins).cast("bigint"))
    )
    return (
        long.join(F.broadcast(ends), "ordinal")  # one row per charted column
        .groupBy("column", bin_of.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )

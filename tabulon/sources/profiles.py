"""Column profiles that are stored beside a dataset and added up part by part.

Every part of a dataset has one row per column: exact counts, extremes and moments, a
distinct-count sketch and a quantile sketch.  A part that is appended is profiled alone,
and the profile of the whole is the merged rows of all parts: no value is read again.

Distinct counts come from HyperLogLog sketches of 2^LOG_BUCKETS registers (relative
standard error DISTINCT_ERROR), quantiles from KLL sketches of size QUANTILE_SIZE (rank
error QUANTILE_ERROR at 99 %).  Counts, extremes and missing counts are exact; sums are doubles.

Defined results: a column without values has null extremes, moments and quantiles and 0
distinct values; NaN counts as missing; columns that are neither numbers nor texts are
counted by their text form (moments by their microseconds); a dataset without parts has no rows; a part may lack columns
that others have, whose cells then count in neither ``rows`` nor ``missing_count``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.coercion import as_number, is_numeric, is_text, quoted
from tabulon.functions.grading import share
from tabulon.session import small_table

LOG_BUCKETS = 14
DISTINCT_ERROR = 0.0082
"""Relative standard error of distinct counts, 1.04 / sqrt(2^14)."""

QUANTILE_SIZE = 800
QUANTILE_ERROR = 0.005

PARTIAL = (
    "ordinal int, column string, kind string, rows bigint, missing_count bigint, zeros bigint, negatives bigint, "
    "low double, high double, mean double, spread double, characters bigint, distinct binary, ranks binary"
)
"""``spread`` is the sum of squared deviations from the mean; ``characters`` the length of all texts."""


def partial_profile(df: DataFrame) -> DataFrame:
    """One row per column in one scan, without a shuffle of cells; rows merge with those of other tables."""
    measures, rows = [], []
    for k, f in enumerate(df.schema.fields):
        number = is_numeric(f.dataType)
        cell = quoted(f.name)
        x = as_number(cell, f.dataType) if number else F.lit(None).cast("double")
        if f.dataType.typeName() in ("long", "integer", "short", "byte"):
            key = cell.cast("bigint")  # beyond 2^53 different numbers share a double
        elif f.dataType.typeName() in ("float", "double"):
            key = F.when(x == 0, F.lit("0")).otherwise(x.cast("string"))  # both zeros are one value
        else:
            key = cell if is_text(f.dataType) else _spelled(cell, f.dataType)
        found = {
            "rows": F.count(F.lit(1)),
            "missing_count": F.count_if(key.isNull()),
            "zeros": F.count_if(x == 0),
            "negatives": F.count_if(x < 0),
            "low": F.min(x),
            "high": F.max(x),
            "mean": F.avg(x),
            "spread": F.var_pop(x) * F.count(x),
            "characters": F.sum(F.length(cell)) if is_text(f.dataType) else F.lit(None).cast("bigint"),
            "distinct": F.hll_sketch_agg(key, F.lit(LOG_BUCKETS)),
            "ranks": F.kll_sketch_agg_double(x, QUANTILE_SIZE) if number else F.lit(None).cast("binary"),
        }
        measures += [m.alias(f"{label}{k}") for label, m in found.items()]
        kind = "number" if number else "text" if is_text(f.dataType) else "other"
        rows.append(
            F.struct(
                F.lit(k).alias("ordinal"), F.lit(f.name).alias("column"), F.lit(kind).alias("kind"),
                *[F.col(f"{label}{k}").alias(label) for label in found],
            )
        )
    if not rows:
        return small_table(df.sparkSession, [], PARTIAL)
    return df.agg(*measures).select(F.inline(F.array(*rows)))


def _spelled(cell: Column, dtype) -> Column:
    if dtype.typeName() == "timestamp":
        return F.unix_micros(cell)  # its text form would follow the session's time zone
    return F.to_json(cell) if dtype.typeName() in ("struct", "array", "map", "variant") else cell.cast("string")


def merged(parts: DataFrame) -> DataFrame:
    """Partial rows of any number of parts added up to one per column, still mergeable.

    Means and spreads are joined about the mean of all parts, so that columns far from
    zero lose no digits.
    """
    held = F.col("rows") - F.col("missing_count")
    whole = parts.groupBy("column").agg(
        F.min("ordinal").alias("ordinal"),
        F.max("kind").alias("kind"),
        *[F.sum(c).cast("bigint").alias(c) for c in ("rows", "missing_count", "zeros", "negatives", "characters")],
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        (F.sum(F.col("mean") * held) / F.sum(F.when(F.col("mean").isNotNull(), held))).alias("mean"),
        F.hll_union_agg("distinct").alias("distinct"),
        F.kll_merge_agg_double("ranks", QUANTILE_SIZE).alias("ranks"),
        F.collect_list(F.struct(held.alias("n"), F.col("mean").alias("m"), F.col("spread").alias("s"))).alias("_moments"),
    )
    spread = F.aggregate(
        F.filter("_moments", lambda p: p["m"].isNotNull()),
        F.lit(0.0),
        lambda total, p: total + p["s"] + p["n"] * (p["m"] - F.col("mean")) * (p["m"] - F.col("mean")),
    )
    return whole.withColumn("spread", F.when(F.col("mean").isNotNull(), spread)).drop("_moments")


def spelled_out(parts: DataFrame) -> DataFrame:
    """The readable profile of all parts: exact counts, extremes and moments, estimated distinct counts and quartiles."""
    whole = merged(parts)
    held = F.col("rows") - F.col("missing_count")
    number = F.col("mean").isNotNull()

    def quantile(p: float) -> Column:
        return F.when(number, F.kll_sketch_get_quantile_double(F.when(number, F.col("ranks")), F.lit(p)))

    return whole.select(
        "ordinal", "column", "kind", "rows", "missing_count",
        share(F.col("missing_count"), F.col("rows")).alias("missing_pct"),
        F.hll_sketch_estimate("distinct").alias("distinct_estimate"),
        "zeros", "negatives", "low", "high", "mean",
        F.when(held > 1, F.sqrt(F.col("spread") / (held - 1))).alias("std"),
        quantile(0.25).alias("q25"), quantile(0.5).alias("median"), quantile(0.75).alias("q75"),
        F.when(F.col("kind") == "text", F.col("characters") / F.nullif(held, F.lit(0))).alias("avg_length"),
    )

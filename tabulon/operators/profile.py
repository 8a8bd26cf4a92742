"""Column profiles: counts from the long form, moments from one wide pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.coercion import (
    is_numeric,
    is_temporal,
    is_text,
    looks_numeric,
    number_of,
    quoted,
)
from tabulon.functions.grading import cardinality_class, column_issues, share
from tabulon.functions.hashing import row_fingerprint
from tabulon.operators.cells import (
    counted,
    is_missing,
    names_of,
    value_counts,
)
from tabulon.operators.quantiles import quantiles
from tabulon.session import small_table

# Words that stand for a missing value inside a text column.
MISSING_WORDS = ("na", "n/a", "null", "none", "missing", "", "nan", "unknown", "undefined")


def per_column(df: DataFrame, stats: Mapping[str, Sequence[tuple[str, Column]]]) -> DataFrame:
    """One ``agg`` over the table, turned into one row per column of ``stats``."""
    flat, structs = [], []
    for k, (name, measures) in enumerate(stats.items()):
        parts = [F.lit(df.columns.index(name)).alias("ordinal"), F.lit(name).alias("column")]
        for j, (label, measure) in enumerate(measures):
            flat.append(measure.alias(f"m{k}_{j}"))
            parts.append(F.col(f"m{k}_{j}").alias(label))
        structs.append(F.struct(*parts))
    return df.agg(*flat).select(F.inline(F.array(*structs)))


def shape(df: DataFrame) -> DataFrame:
    """``(rows, columns)`` of a table."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "columns", F.lit(len(df.columns)).cast("bigint")
    )


def missing_by_column(df: DataFrame) -> DataFrame:
    """``(ordinal, column, missing_count, missing_pct)`` without a shuffle of rows."""
    return per_column(
        df,
        {
            n: [("missing_count", F.count_if(_null(df, n))), ("rows", F.count(F.lit(1)))]
            for n in df.columns
        },
    ).select("ordinal", "column", "missing_count", share(F.col("missing_count"), F.col("rows")).alias("missing_pct"))


def _null(df: DataFrame, name: str) -> Column:
    c = quoted(name)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def missing_total(df: DataFrame) -> DataFrame:
    """Missing cells of the whole table and their share of all cells."""
    width = len(df.columns)
    missing = sum((F.count_if(_null(df, n)) for n in df.columns), F.lit(0).cast("bigint"))
    columns_hit = sum(
        (F.when(F.count_if(_null(df, n)) > 0, 1).otherwise(0) for n in df.columns), F.lit(0)
    )
    return df.agg(
        missing.alias("total_missing"),
        columns_hit.cast("bigint").alias("columns_with_missing"),
        F.count(F.lit(1)).alias("rows"),
    ).select(
        "total_missing",
        "columns_with_missing",
        share(F.col("total_missing"), F.col("rows") * width).alias("missing_pct"),
    )


def row_missing(df: DataFrame) -> Column:
    """Number of missing cells in a row."""
    return sum((_null(df, n).cast("int") for n in df.columns), F.lit(0))


def column_counts(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """The profile core: one row per column, from one shuffle of value counts.

    ``text_kinds`` and ``marker_values`` describe the non-numeric text values of
    columns that are half to four fifths numeric; they are 0 elsewhere.
    """
    source = value_counts(df) if counts is None else counts
    texts = [k for k, f in enumerate(df.schema.fields) if is_text(f.dataType)]
    numeric_text = F.col("ordinal").isin(texts) & looks_numeric(F.col("s"))
    totals = source.groupBy("ordinal").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(is_missing(), F.col("n")).otherwise(0)).alias("missing_count"),
        F.count_if(~is_missing()).alias("distinct_count"),
        F.max("n").alias("top_count"),
        F.sum(F.when(numeric_text, F.col("n")).otherwise(0)).alias("convertible"),
    )
    rated = totals.withColumn(
        "conversion_rate", F.col("convertible") / F.nullif(F.col("rows") - F.col("missing_count"), F.lit(0))
    )
    mixed = rated.where((F.col("conversion_rate") >= 0.5) & (F.col("conversion_rate") < 0.8))
    words = (
        source.join(F.broadcast(mixed.select("ordinal")), "ordinal")  # one row per mixed column
        .where(counted(F.col("s").isNotNull() & ~looks_numeric(F.col("s"))))
        .withColumn("word", F.lower(F.trim("s")))
        .groupBy("ordinal")
        .agg(
            F.count_distinct("word").alias("text_kinds"),
            F.count_if(F.col("word").isin(*MISSING_WORDS)).alias("marker_values"),
        )
    )
    zero = F.lit(0).cast("bigint")
    filled = ("rows", "missing_count", "distinct_count", "top_count", "convertible")
    return (
        names_of(df)
        .join(F.broadcast(rated), "ordinal", "left")
        .join(F.broadcast(words), "ordinal", "left")
        .withColumns({c: F.coalesce(c, zero) for c in (*filled, "text_kinds", "marker_values")})
    )


def profile(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Counts, shares, cardinality class and issues, one row per column."""
    base = column_counts(df, counts)
    return base.withColumns(
        {
            "missing_pct": share(F.col("missing_count"), F.col("rows")),
            "distinct_pct": share(F.col("distinct_count"), F.col("rows")),
            "top_pct": share(F.col("top_count"), F.col("rows")),
        }
    ).withColumns(
        {
            "cardinality": cardinality_class(F.col("distinct_count")),
            "issues": column_issues(F.col("missing_pct"), F.col("distinct_count"), F.col("rows")),
        }
    )


def distinct_counts(df: DataFrame, approximate: bool = False, rsd: float = 0.02) -> DataFrame:
    """Distinct non-null values per column; the sketch variant moves no cells."""
    if approximate:
        return per_column(
            df, {n: [("distinct_count", F.approx_count_distinct(quoted(n), rsd))] for n in df.columns}
        )
    return column_counts(df).select("ordinal", "column", "distinct_count")


NUMERIC_SCHEMA = (
    "ordinal int, column string, mean double, median double, std double, min double, max double, q25 double, q75 double"
)


def numeric_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Mean, median, sample deviation, extremes and quartiles of numeric columns.

    One pass for everything but the quartiles, whose search starts from its counts.
    """
    names = _numeric_names(df, columns)
    values = {n: number_of(df, n) for n in names}
    if not values:
        return small_table(df.sparkSession, [], NUMERIC_SCHEMA)
    measures = (F.count, F.avg, F.stddev_samp, F.min, F.max)
    facts = df.agg(*[f(x).alias(f"{f.__name__}{k}") for k, x in enumerate(values.values()) for f in measures]).first()
    found = quantiles(df, values, (0.25, 0.5, 0.75), {n: facts[f"count{k}"] for k, n in enumerate(names)})
    rows = [
        (df.columns.index(n), n, facts[f"avg{k}"], middle, facts[f"stddev_samp{k}"], facts[f"min{k}"], facts[f"max{k}"], low, high)
        for k, n in enumerate(names)
        for low, middle, high in [found[n]]
    ]
    return small_table(df.sparkSession, rows, NUMERIC_SCHEMA)


def _numeric_names(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    if columns is not None:
        return list(columns)
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def numeric_quality(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Extremes, mean, deviation, zeros and negatives of numeric columns."""
    return per_column(
        df,
        {
            n: [
                ("min_value", F.min(x)),
                ("max_value", F.max(x)),
                ("mean_value", F.avg(x)),
                ("std_value", F.stddev_samp(x)),
                ("zeros_count", F.count_if(x == 0)),
                ("negative_count", F.count_if(x < 0)),
            ]
            for n in _numeric_names(df, columns)
            for x in [number_of(df, n)]
        },
    )


def moments(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Population variance and population skewness of numeric columns."""
    return per_column(
        df,
        {
            n: [("n", F.count(x)), ("variance", F.var_pop(x)), ("skewness", F.skewness(x))]
            for n in _numeric_names(df, columns)
            for x in [number_of(df, n)]
        },
    )


def text_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Average, longest and shortest length; nulls are skipped."""
    names = list(columns or [f.name for f in df.schema.fields if is_text(f.dataType)])
    return per_column(
        df,
        {
            n: [
                ("avg_length", F.avg(F.length(quoted(n)))),
                ("max_length", F.max(F.length(quoted(n))).cast("bigint")),
                ("min_length", F.min(F.length(quoted(n))).cast("bigint")),
            ]
            for n in names
        },
    )


def text_quality(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Lengths plus empty and blank strings; a blank count includes the empty ones."""
    names = list(columns or [f.name for f in df.schema.fields if is_text(f.dataType)])
    return per_column(
        df,
        {
            n: [
                ("avg_length", F.round(F.coalesce(F.avg(F.length(c)), F.lit(0.0)), 1)),
                ("max_length", F.coalesce(F.max(F.length(c)), F.lit(0)).cast("bigint")),
                ("empty_strings", F.count_if(c == "")),
                ("whitespace_only", F.count_if(c.rlike(r"^\s*$"))),
            ]
            for n in names
            for c in [quoted(n)]
        },
    )


def datetime_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """First and last moment and the whole days between them."""
    names = list(columns or [f.name for f in df.schema.fields if is_temporal(f.dataType)])
    return per_column(
        df,
        {
            n: [
                ("min_date", F.min(c).cast("timestamp_ntz")),
                ("max_date", F.max(c).cast("timestamp_ntz")),
                ("date_range_days", F.timestamp_diff("DAY", F.min(c), F.max(c))),
            ]
            for n in names
            for c in [quoted(n)]
        },
    )


def duplicates(df: DataFrame) -> DataFrame:
    """Rows beyond the first of their kind; nulls equal nulls.

    Only 16 bytes per distinct row are shuffled, and copies of a hot row
    collapse inside each task first.
    """
    first, second = row_fingerprint(df)
    return (
        df.select(first.alias("h1"), second.alias("h2"))
        .groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
        )
        .withColumn("duplicate_pct", share(F.col("duplicate_rows"), F.col("rows")))
    )


# Bytes a value of each fixed-width type takes.
_WIDTHS = {
    T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8,
    T.FloatType: 4, T.DoubleType: 8, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8,
}


def estimated_size(df: DataFrame) -> DataFrame:
    """Estimated size in MB: fixed widths plus the bytes of text and nested cells."""
    fixed, loose = 0, []
    for f in df.schema.fields:
        width = _WIDTHS.get(type(f.dataType))
        if width:
            fixed += width
        elif isinstance(f.dataType, T.DecimalType):
            fixed += 16
        elif isinstance(f.dataType, (T.StringType, T.BinaryType)):
            loose.append(quoted(f.name))
        else:
            loose.append(F.to_json(quoted(f.name)))
    text = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c in loose]
    total = sum(text, F.count(F.lit(1)) * fixed)
    return df.agg(total.alias("estimated_bytes")).withColumn(
        "estimated_size_mb", F.round(F.col("estimated_bytes") / (1024 * 1024), 2)
    )

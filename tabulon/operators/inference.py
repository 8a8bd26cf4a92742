"""Semantic column types, column verdicts, target and problem-type suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.coercion import INTEGRAL, as_number, is_numeric, is_temporal, is_text, quoted, text_to_timestamp
from tabulon.operators.cells import display, is_missing, value_counts
from tabulon.operators.profile import per_column, profile
from tabulon.session import small_table

NUMERICAL, CATEGORICAL, DATETIME, TEXT_TYPE = "numerical", "categorical", "datetime", "text"
CLASSIFICATION, REGRESSION, AUTO_DETECT = "classification", "regression", "auto_detect"

# Parts of a column name that hint at a prediction target.
TARGET_KEYWORDS = (
    "target", "label", "class", "category", "outcome", "result",
    "y", "dependent", "response", "price", "value", "amount",
    "prediction", "predict", "output",
)


def _ordinals(df: DataFrame, test) -> list[int]:
    return [k for k, f in enumerate(df.schema.fields) if test(f.dataType)]


def column_types(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """The column catalog: the profile plus ``detected_type`` and ``is_coerced``."""
    numeric, temporal, textual = (_ordinals(df, t) for t in (is_numeric, is_temporal, is_text))
    rate = F.coalesce(F.col("conversion_rate"), F.lit(0.0))
    reads_as_number = F.col("ordinal").isin(textual) & (
        (rate >= 0.8)
        | ((rate >= 0.5) & ((F.col("marker_values") > 0) | (F.col("text_kinds") <= 3)))
    )
    mixed = F.col("ordinal").isin(textual) & (rate >= 0.5)
    few = (F.col("distinct_count") < 0.1 * F.col("rows")) | (F.col("distinct_count") < 20)
    detected = (
        F.when(F.col("ordinal").isin(temporal), DATETIME)
        .when(F.col("ordinal").isin(numeric) | reads_as_number, NUMERICAL)
        .when(mixed, CATEGORICAL)
        .when(few & (F.col("rows") > 0), CATEGORICAL)
        .otherwise(TEXT_TYPE)
    )
    return profile(df, counts).withColumn("detected_type", detected).withColumn("is_coerced", reads_as_number)


def type_distribution(catalog: DataFrame) -> DataFrame:
    """How many columns there are of each semantic type."""
    return catalog.groupBy("detected_type").agg(F.count(F.lit(1)).alias("columns"))


def column_verdicts(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """``should_drop``, ``should_hash_encode`` and the warnings of every column."""
    source = value_counts(df) if counts is None else counts
    catalog = column_types(df, source)
    leaders = (
        source.join(F.broadcast(catalog.select("ordinal", "rows")), "ordinal")  # one row per column
        .where(F.col("n") * 100 > F.col("rows") * 85)  # at most one value per column
        .select("ordinal", F.when(is_missing(), "nan").otherwise(display(df)).alias("leader"))
    )
    textual = F.col("ordinal").isin(_ordinals(df, is_text))
    drop = (F.col("missing_pct") > 50) | (F.col("top_pct") > 95)
    kept_text = textual & ~drop
    ratio = F.col("distinct_count") / F.nullif(F.col("rows"), F.lit(0))
    hash_it = kept_text & (F.col("distinct_count") > 100) & (ratio > 0.8)
    name, rate = F.col("column"), F.col("conversion_rate")

    def percent(x):
        return F.format_number(x, 1)  # rounds the exact binary value, as printf does

    def said(pattern: str, *parts):
        return F.format_string("Column '%s': " + pattern, name, *parts)

    warnings = F.array_compact(
        F.array(
            F.when(
                F.col("missing_pct") > 50,
                said("%s%% missing values - RECOMMEND DROPPING", percent(F.col("missing_pct"))),
            ).when(
                F.col("missing_pct") > 30,
                said("%s%% missing values - consider dropping", percent(F.col("missing_pct"))),
            ),
            F.when(
                F.col("top_pct") > 95,
                said("%s%% same value ('%s') - RECOMMEND DROPPING", percent(F.col("top_pct")), F.col("leader")),
            ).when(
                F.col("top_pct") > 85,
                said("%s%% same value ('%s') - low variance", percent(F.col("top_pct")), F.col("leader")),
            ),
            F.when(
                hash_it,
                said("%d unique categories - RECOMMEND HASH ENCODING", F.col("distinct_count")),
            ).when(
                kept_text & (F.col("distinct_count") > 50) & (ratio > 0.5),
                said("%d unique categories - consider hash encoding", F.col("distinct_count")),
            ),
            F.when(
                kept_text & (rate > 0.2) & (rate < 0.8),
                said("Mixed numeric/text content (%s%% numeric)", percent(rate * 100)),
            ),
        )
    )
    return (
        catalog.join(leaders, "ordinal", "left")  # few rows, of texts of any length
        .withColumn("should_drop", F.coalesce(drop, F.lit(False)))
        .withColumn("should_hash_encode", F.coalesce(hash_it, F.lit(False)))
        .withColumn("warnings", warnings)
        .drop("leader")
    )


def target_suggestions(catalog: DataFrame) -> DataFrame:
    """Columns that may be a target, in column order."""
    last = catalog.agg(F.max("ordinal").alias("last"))
    lowered = F.lower("column")
    keyword = F.lit(False)
    for word in TARGET_KEYWORDS:
        keyword = keyword | lowered.contains(word)
    varied = (
        (F.col("detected_type") == NUMERICAL)
        & (F.col("distinct_count") > 1)
        & (F.col("distinct_count") < F.col("rows") * 0.9)
    )
    reason = (
        F.when(keyword, "keyword").when(F.col("ordinal") == F.col("last"), "last column").when(varied, "varied number")
    )
    return (
        catalog.crossJoin(F.broadcast(last))  # one row: the highest ordinal
        .withColumn("reason", reason)
        .where(F.col("reason").isNotNull())
        .select("ordinal", "column", "reason")
    )


def problem_type(df: DataFrame, target: str | None) -> DataFrame:
    """``(target, problem_type)`` for a target column, from one pass over it."""
    spark = df.sparkSession
    if target is None:
        return small_table(spark, [(None, AUTO_DETECT)], "target string, problem_type string")
    dtype = df.schema[target].dataType
    if not is_numeric(dtype):
        return small_table(spark, [(target, CLASSIFICATION)], "target string, problem_type string")
    x = as_number(quoted(target), dtype)
    facts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(x).alias("kinds"),
        F.min(x).alias("low"),
        F.max(x).alias("high"),
    )
    ratio = F.col("kinds") / F.nullif(F.col("rows"), F.lit(0))
    wide_integer = F.lit(isinstance(dtype, INTEGRAL)) & (F.col("high") - F.col("low") > 1000) & (F.col("kinds") > 20)
    verdict = (
        F.when((F.col("kinds") == 2) & (F.col("low") == 0) & (F.col("high") == 1), CLASSIFICATION)
        .when((F.col("kinds") <= 10) & (ratio < 0.05), CLASSIFICATION)
        .when(wide_integer | (F.col("kinds") > 20) | (ratio > 0.1), REGRESSION)
        .otherwise(CLASSIFICATION)
    )
    return facts.select(F.lit(target).alias("target"), verdict.alias("problem_type"))


def date_text_columns(df: DataFrame) -> DataFrame:
    """Share of each text column that parses as a date; over 0.8 counts as one."""
    names = [f.name for f in df.schema.fields if is_text(f.dataType)]
    if not names:
        return small_table(
            df.sparkSession,
            [], "ordinal int, column string, parse_rate double, is_date_text boolean"
        )
    rates = per_column(
        df,
        {
            n: [("parsed", F.count(text_to_timestamp(quoted(n)))), ("present", F.count(quoted(n)))]
            for n in names
        },
    )
    rate = F.col("parsed") / F.nullif(F.col("present"), F.lit(0))
    return rates.select(
        "ordinal",
        "column",
        F.coalesce(rate, F.lit(0.0)).alias("parse_rate"),
        F.coalesce(rate > 0.8, F.lit(False)).alias("is_date_text"),
    )


def dataset_info(df: DataFrame, filename: str) -> DataFrame:
    """One row that describes a registered dataset."""
    counts = value_counts(df)
    rows = column_verdicts(df, counts).select(
        "ordinal", "column", "detected_type", "missing_count", "rows", "distinct_count",
        "should_drop", "should_hash_encode", "warnings",
    ).collect()  # one row per column
    small = small_table(
        df.sparkSession,
        [r.asDict() for r in rows],
        "ordinal int, column string, detected_type string, missing_count bigint, rows bigint, "
        "distinct_count bigint, should_drop boolean, should_hash_encode boolean, warnings array<string>",
    )
    suggested = [r["column"] for r in target_suggestions(small).orderBy("ordinal").collect()]
    kind = problem_type(df, suggested[0] if suggested else None).first()["problem_type"]
    ordered = sorted(rows, key=lambda r: r["ordinal"])
    record = (
        filename,
        [ordered[0]["rows"] if ordered else 0, len(ordered)],
        [r["column"] for r in ordered],
        {r["column"]: r["detected_type"] for r in ordered},
        {r["column"]: r["missing_count"] for r in ordered},
        suggested,
        kind,
        [w for r in ordered for w in r["warnings"]],
        [r["column"] for r in ordered if r["should_drop"]],
        [r["column"] for r in ordered if r["should_hash_encode"]],
    )
    return small_table(df.sparkSession, [record], DATASET_INFO)


DATASET_INFO = T.StructType(
    [
        T.StructField("filename", T.StringType()),
        T.StructField("shape", T.ArrayType(T.LongType())),
        T.StructField("columns", T.ArrayType(T.StringType())),
        T.StructField("column_types", T.MapType(T.StringType(), T.StringType())),
        T.StructField("missing_values", T.MapType(T.StringType(), T.LongType())),
        T.StructField("target_suggestions", T.ArrayType(T.StringType())),
        T.StructField("problem_type", T.StringType()),
        T.StructField("quality_warnings", T.ArrayType(T.StringType())),
        T.StructField("columns_to_drop", T.ArrayType(T.StringType())),
        T.StructField("columns_to_hash_encode", T.ArrayType(T.StringType())),
    ]
)

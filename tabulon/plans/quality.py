"""The data quality report as named tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.coercion import is_numeric, is_text
from tabulon.functions.grading import missing_severity, score_grade
from tabulon.operators.cells import sample_values, value_counts
from tabulon.operators.eda import missing_pattern_class
from tabulon.operators.inference import column_types
from tabulon.operators.outliers import outlier_summary
from tabulon.operators.profile import (
    duplicates,
    estimated_size,
    missing_by_column,
    missing_total,
    numeric_quality,
    profile,
    text_quality,
)
from tabulon.session import small_table

LARGE_MB = 100
SHOWN_FEATURES = 5


def overview(df: DataFrame) -> DataFrame:
    """Rows, columns, estimated size and duplicate rows, in one row."""
    return (
        duplicates(df)
        .crossJoin(F.broadcast(estimated_size(df)))  # one row each
        .select(
            F.col("rows").alias("total_rows"),
            F.lit(len(df.columns)).cast("bigint").alias("total_columns"),
            "estimated_size_mb",
            "duplicate_rows",
            F.round("duplicate_pct", 2).alias("duplicate_percentage"),
        )
    )


def column_analysis(df: DataFrame) -> DataFrame:
    """Everything known about each column, one row per column."""
    counts = value_counts(df)
    numbers = [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    texts = [f.name for f in df.schema.fields if is_text(f.dataType)]
    samples = (
        sample_values(df, counts=counts)
        .groupBy("ordinal")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "value"))).alias("samples"))
        .select("ordinal", F.col("samples.value").alias("sample_values"))
    )
    out = column_types(df, counts).select(
        "ordinal",
        F.col("column").alias("column_name"),
        "detected_type",
        "spark_type",
        F.col("distinct_count").alias("unique_values"),
        F.round("distinct_pct", 2).alias("unique_percentage"),
        "missing_count",
        F.round("missing_pct", 2).alias("missing_percentage"),
        "cardinality",
        F.col("issues").alias("data_quality_issues"),
    )
    out = out.join(samples, "ordinal", "left")  # few rows, of texts of any length
    if numbers:
        out = out.join(F.broadcast(numeric_quality(df, numbers).drop("column")), "ordinal", "left")
    if texts:
        out = out.join(F.broadcast(text_quality(df, texts).drop("column")), "ordinal", "left")
    return out


def missing_analysis(df: DataFrame) -> DataFrame:
    """Totals over the whole table, in one row."""
    return missing_total(df).select(
        F.col("total_missing").alias("total_missing_values"),
        "columns_with_missing",
        F.round("missing_pct", 2).alias("missing_data_percentage"),
    )


def missing_columns(df: DataFrame) -> DataFrame:
    """The columns with missing cells and how severe that is."""
    return missing_by_column(df).where(F.col("missing_count") > 0).select(
        "ordinal",
        "column",
        "missing_count",
        F.round("missing_pct", 2).alias("missing_percentage"),
        missing_severity(F.col("missing_pct")).alias("severity"),
    )


def quality_score(df: DataFrame) -> DataFrame:
    """Score, grade and the two penalties, in one row."""
    lost = F.least(F.col("missing_pct") * 2, F.lit(50.0))
    copied = F.least(F.col("duplicate_pct") * 3, F.lit(30.0))
    return (
        missing_total(df)
        .select("missing_pct")
        .crossJoin(F.broadcast(duplicates(df).select("duplicate_pct")))  # one row each
        .select((F.lit(100.0) - lost - copied).alias("score"), (-lost).alias("missing_data_impact"), (-copied).alias("duplicate_impact"))
        .select(
            F.greatest(F.round("score", 1), F.lit(0.0)).alias("overall_score"),
            score_grade(F.col("score")).alias("grade"),
            "missing_data_impact",
            "duplicate_impact",
        )
    )


def high_missing(columns: DataFrame, limit: float = 50) -> DataFrame:
    """Columns of a profile that miss more than the limit, in percent."""
    return columns.where(F.col("missing_pct") > limit).select("ordinal", "column", "missing_pct")


def recommendations(df: DataFrame) -> DataFrame:
    """``(position, recommendation)``: what to do about the table."""
    columns = profile(df).select("ordinal", "column", "missing_pct", "distinct_count", "rows")
    missing = (
        high_missing(columns)
        .agg(F.sort_array(F.collect_list(F.struct("ordinal", "column"))).alias("held"))
        .where(F.size("held") > 0)
        .select(
            F.lit(1).alias("part"), F.lit(0).alias("ordinal"),
            F.concat(
                F.lit("Consider removing columns with >50% missing data: "),
                F.array_join(F.col("held.column"), ", "),
            ).alias("recommendation"),
        )
    )
    copies = duplicates(df).where(F.col("duplicate_rows") > 0).select(
        F.lit(2).alias("part"), F.lit(0).alias("ordinal"),
        F.format_string("Remove %d duplicate rows to improve data quality", "duplicate_rows").alias("recommendation"),
    )
    wide = columns.where(F.col("distinct_count") > F.col("rows") * 0.8).select(
        F.lit(3).alias("part"), "ordinal",
        F.format_string("Column '%s' has very high cardinality - consider feature engineering", "column").alias("recommendation"),
    )
    big = estimated_size(df).where(F.col("estimated_bytes") / (1024 * 1024) > LARGE_MB).select(
        F.lit(4).alias("part"), F.lit(0).alias("ordinal"),
        F.lit("Consider data type optimization for large dataset").alias("recommendation"),
    )
    every = missing.unionByName(copies).unionByName(wide).unionByName(big)
    order = Window.orderBy("part", "ordinal")  # at most one row per column and three more
    return every.select(F.row_number().over(order).alias("position"), "recommendation")


ACTIONS = "position int, category string, column string, action string"


def preparation_actions(df: DataFrame, info: Mapping) -> DataFrame:
    """What a fitted preparation does, one row per action."""
    rows: list[tuple[str, str | None, str]] = []
    for r in info.get("outliers", ()):
        if r["outliers_detected"] > 0:
            rows.append(
                ("outlier_treatment", r["column"],
                 f"Applied IQR outlier clipping to '{r['column']}' ({r['outliers_detected']} outliers)")
            )
    rows += [("scaling_applied", c, f"Applied {m} scaling to '{c}'") for c, m in info.get("scaling", {}).items()]
    rows += [("encoding_applied", c, f"Applied {m} encoding to '{c}'") for c, m in info.get("encoding", {}).items()]
    made: Sequence[str] = info.get("engineered", ())
    if made:
        rows.append(("feature_engineering", None, f"Created {len(made)} new features"))
        rows += [("feature_engineering", f, f"Generated feature: '{f}'") for f in made[:SHOWN_FEATURES]]
        if len(made) > SHOWN_FEATURES:
            rows.append(("feature_engineering", None, f"... and {len(made) - SHOWN_FEATURES} more"))
    for key, what in (
        ("removed_constant", "constant"),
        ("removed_correlated", "highly correlated"),
        ("removed_by_model", "low-importance"),
    ):
        gone = info.get("selection", {}).get(key) or ()
        if gone:
            rows.append(("feature_selection", None, f"Removed {len(gone)} {what} features"))
    rows += [("data_cleaning", c, f"Dropped low-quality column '{c}'") for c in info.get("dropped", ())]
    return small_table(df.sparkSession, [(k + 1, *r) for k, r in enumerate(rows)], ACTIONS)


def quality_report(df: DataFrame, info: Mapping | None = None) -> dict[str, DataFrame]:
    """All tables of the report; the outlier and action tables need a fitted preparation."""
    report = {
        "overview": overview(df),
        "columns": column_analysis(df),
        "missing": missing_analysis(df),
        "missing_columns": missing_columns(df),
        "missing_pattern": missing_pattern_class(df),
        "score": quality_score(df),
        "recommendations": recommendations(df),
    }
    if info:
        report["outliers"] = outlier_summary(df, info.get("outliers", ()))
        report["actions"] = preparation_actions(df, info)
    return report

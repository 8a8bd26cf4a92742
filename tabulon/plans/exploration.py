"""The exploration report as named tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions.coercion import is_temporal, missing_to_null
from tabulon.operators import cells, correlation, eda, inference, profile


# How many columns, and how many values of a list, a reader is shown.
SHOWN_COLUMNS = 10
SHOWN_VALUES = 5


def shown_columns(table: DataFrame, most: int = SHOWN_COLUMNS) -> DataFrame:
    """The first rows of a table with one row per column, in column order."""
    return table.orderBy("ordinal").limit(most)


def shown_values(table: DataFrame, values: str, most: int = SHOWN_VALUES) -> DataFrame:
    """A list column cut to its first values, with the number of those left out as ``more``."""
    size = F.coalesce(F.size(values), F.lit(0))
    return table.withColumn("more", F.greatest(size - most, F.lit(0))).withColumn(values, F.slice(values, 1, most))


def explore(df: DataFrame, catalog: Sequence[Mapping] | None = None) -> dict[str, DataFrame]:
    """Statistics by semantic type, correlations, missing data and chart tables.

    ``catalog`` reuses the collected column types of a registered dataset.  Text
    columns read as numbers are measured as numbers.  Tables that have no
    columns to show are left out.
    """
    source = missing_to_null(df)
    counts = cells.value_counts(source)
    types = inference.column_types(source, counts)
    if catalog is None:
        catalog = types.select("ordinal", "column", "detected_type").collect()  # one row per column
    named: dict[str, list[str]] = {}
    for r in sorted(catalog, key=lambda r: r["ordinal"]):
        named.setdefault(r["detected_type"], []).append(r["column"])
    numerical = named.get(inference.NUMERICAL, [])
    categorical = named.get(inference.CATEGORICAL, [])
    texts = named.get(inference.TEXT_TYPE, [])
    moments = [c for c in named.get(inference.DATETIME, []) if is_temporal(source.schema[c].dataType)]
    missing = profile.missing_by_column(source)
    report = {
        "shape": profile.shape(source),
        "size": profile.estimated_size(source),
        "columns": types.select("ordinal", "column", "detected_type", "missing_count", "missing_pct", "distinct_count"),
        "missing": profile.missing_total(source),
        "missing_columns": missing.where(F.col("missing_count") > 0),
        "missing_patterns": eda.missing_patterns(source),
        "type_distribution": inference.type_distribution(types),
        "missing_chart": eda.missing_chart(missing),
    }
    if numerical:
        report["numerical"] = profile.numeric_profile(source, numerical)
        report["histograms"] = eda.histograms(source, numerical)
    if len(numerical) > 1:
        pairs = correlation.correlations(source, numerical)
        report["correlation_matrix"] = correlation.correlation_matrix(source, numerical, pairs)
        report["correlated_pairs"] = eda.strong_pairs(pairs)
    if categorical:
        report["categorical"] = cells.top_values(source, categorical, counts=counts)
        report["category_chart"] = eda.category_chart(source, categorical, counts=counts)
    if moments:
        report["datetime"] = profile.datetime_profile(source, moments)
    if texts:
        report["text"] = profile.text_profile(source, texts)
    return report

"""Severity, grade and cardinality scales, and the per-column issue lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (lower limit, label) from the top down; the last label is the rest.
MISSING_SCALE = ((50, "Critical"), (20, "High"), (5, "Medium"))
OUTLIER_SCALE = ((15, "High"), (5, "Medium"))
SCORE_SCALE = ((90, "Excellent"), (80, "Good"), (70, "Fair"), (60, "Poor"))


def _ladder(value: Column, scale, rest: str, inclusive: bool) -> Column:
    graded = None
    for limit, label in scale:
        hit = value >= limit if inclusive else value > limit
        graded = F.when(hit, label) if graded is None else graded.when(hit, label)
    return graded.otherwise(rest)


def missing_severity(percent: Column) -> Column:
    return _ladder(percent, MISSING_SCALE, "Low", inclusive=False)


def outlier_severity(percent: Column) -> Column:
    return _ladder(percent, OUTLIER_SCALE, "Low", inclusive=False)


def score_grade(score: Column) -> Column:
    """Grade of the unrounded score."""
    return _ladder(score, SCORE_SCALE, "Critical", inclusive=True)


def cardinality_class(distinct: Column) -> Column:
    return F.when(distinct <= 10, "Low").when(distinct <= 1000, "Medium").otherwise("High")


def column_issues(missing_pct: Column, distinct: Column, rows: Column) -> Column:
    """The list of issues a column has, in a fixed order, empty when it has none."""
    return F.array_compact(
        F.array(
            F.when(missing_pct > 50, "High missing data (>50%)").when(
                missing_pct > 20, "Moderate missing data (>20%)"
            ),
            F.when(distinct == 1, "Constant values").when(distinct == rows, "All unique values"),
        )
    )


def share(part: Column, whole: Column) -> Column:
    """part / whole in percent, 0 for an empty whole."""
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))

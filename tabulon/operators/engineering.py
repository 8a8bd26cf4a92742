"""Derived features: calendar parts, products and ratios."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions.coercion import (
    DATE_PARTS,
    date_part,
    is_numeric,
    is_temporal,
    number_of,
    quoted,
    text_to_timestamp,
)
from tabulon.operators.inference import date_text_columns
from tabulon.operators.stages import ColumnStage, FittedColumns, declare


def date_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Seven calendar parts per date or date-text column, null for an unreadable date."""
    parts = {}
    for n in columns:
        moment = quoted(n) if is_temporal(df.schema[n].dataType) else text_to_timestamp(quoted(n))
        parts.update({f"{n}_{p}": date_part(moment, p) for p in DATE_PARTS})
    return df.withColumns(parts) if parts else df


def interaction_plan(df: DataFrame, columns: Sequence[str], limit: int = 5) -> list[tuple[str, str, str]]:
    """``(name, a, b)`` of products and ratios over column pairs, in order.

    The limit is checked before each pair and a pair may add two features, so
    one more than the limit can result.  A ratio needs a divisor that is never 0.
    """
    zeros = df.agg(
        F.lit(0).alias("none"), *[F.count_if(number_of(df, c) == 0).alias(f"z{k}") for k, c in enumerate(columns)]
    ).first()
    plan: list[tuple[str, str, str]] = []
    for (_, a), (j, b) in combinations(enumerate(columns), 2):
        if len(plan) >= limit:
            break
        plan.append((f"{a}_x_{b}", a, b))
        if zeros[f"z{j}"] == 0:
            plan.append((f"{a}_div_{b}", a, b))
    return plan


def interactions(df: DataFrame, plan: Sequence[tuple[str, str, str]]) -> DataFrame:
    made = {}
    for name, a, b in plan:
        x, y = number_of(df, a), number_of(df, b)
        made[name] = x * y if name == f"{a}_x_{b}" else x / F.nullif(y, F.lit(0.0))
    return df.withColumns(made) if made else df


class FittedFeatures(FittedColumns):
    def _rewrite(self, df: DataFrame) -> DataFrame:
        return interactions(date_features(df, self.state["dates"]), self.state["pairs"])

    def feature_names(self) -> list[str]:
        return [f"{n}_{p}" for n in self.state["dates"] for p in DATE_PARTS] + [p[0] for p in self.state["pairs"]]


class FeatureEngineer(ColumnStage, Estimator):
    """Finds date columns (typed or text) and, on request, numeric interactions."""

    dates = declare("dates", "derive calendar parts")
    pairs = declare("pairs", "derive products and ratios")
    max_interactions = declare("max_interactions", "limit checked before each pair")

    @keyword_only
    def __init__(self, *, inputCols=None, dates=True, pairs=False, max_interactions=5):
        super().__init__()
        self._setDefault(dates=True, pairs=False, max_interactions=5)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> FittedFeatures:
        names = self.columns() or df.columns
        view = df.select(*[quoted(n) for n in names])
        moments: list[str] = []
        if self.getOrDefault("dates"):
            found = {r["column"] for r in date_text_columns(view).where("is_date_text").collect()}
            moments = [f.name for f in view.schema.fields if is_temporal(f.dataType) or f.name in found]
        plan: list = []
        if self.getOrDefault("pairs"):
            numeric = [f.name for f in view.schema.fields if is_numeric(f.dataType)]
            if len(numeric) >= 2:
                plan = [list(p) for p in interaction_plan(view, numeric, self.getOrDefault("max_interactions"))]
        return FittedFeatures.of(dates=moments, pairs=plan)

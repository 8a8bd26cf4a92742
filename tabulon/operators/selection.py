"""Feature selection: low variance, high correlation, model importance."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions.coercion import number_of, quoted
from tabulon.operators.correlation import correlations
from tabulon.operators.inference import CLASSIFICATION
from tabulon.operators.stages import ColumnStage, FittedColumns, declare

LOW_VARIANCE = 0.01
MANY_FEATURES = 100
MODEL_TREES = 50


def low_variance(df: DataFrame, columns: Sequence[str], threshold: float = LOW_VARIANCE) -> list[str]:
    """Columns whose population variance is at or under the threshold, none if that is all of them."""
    if not columns:
        return []
    row = df.agg(*[F.var_pop(number_of(df, c)).alias(f"v{k}") for k, c in enumerate(columns)]).first()
    flat = [c for k, c in enumerate(columns) if row[k] is None or row[k] <= threshold]
    return [] if len(flat) == len(columns) else flat


def correlated(df: DataFrame, columns: Sequence[str], threshold: float = 0.9) -> list[str]:
    """The later column of every pair above the threshold, dropped ones included as partners."""
    if len(columns) < 2:
        return []
    pairs = correlations(df, columns).where(F.abs("correlation") > threshold)
    gone = {r["j"] for r in pairs.select("j").distinct().collect()}  # one row per column at most
    return [c for k, c in enumerate(columns) if k in gone]


def by_importance(
    df: DataFrame, columns: Sequence[str], label: str, problem_type: str, max_features: int
) -> list[str]:
    """Features at or over the mean importance of a 50-tree forest, the best ``max_features`` at most."""
    packed = VectorAssembler(inputCols=list(columns), outputCol="_packed").transform(df).select("_packed", label)
    forest = (RandomForestClassifier if problem_type == CLASSIFICATION else RandomForestRegressor)(
        featuresCol="_packed", labelCol=label, numTrees=MODEL_TREES, seed=42
    )
    weights = forest.fit(packed).featureImportances.toArray()
    best = set(np.argsort(-weights, kind="stable")[:max_features])
    return [c for k, c in enumerate(columns) if k in best and weights[k] >= weights.mean()]


class FittedSelection(FittedColumns):
    """Drops the features that were not chosen."""

    def _rewrite(self, df: DataFrame) -> DataFrame:
        return df.select(*[quoted(n) for n in df.columns if n not in set(self.state["removed"])])


class FeatureSelector(ColumnStage, Estimator):
    problem_type = declare("problem_type", "classification or regression")
    max_features = declare("max_features", "cap for the model-based step, 0 to skip it")
    threshold = declare("threshold", "correlation limit")
    labelCol = declare("labelCol", "label column, empty to skip the model-based step")

    @keyword_only
    def __init__(self, *, inputCols=None, problem_type=CLASSIFICATION, max_features=0, threshold=0.9, labelCol=""):
        super().__init__()
        self._setDefault(problem_type=CLASSIFICATION, max_features=0, threshold=0.9, labelCol="")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> FittedSelection:
        names = self.columns()
        constant = low_variance(df, names)
        kept = [n for n in names if n not in constant]
        twins = correlated(df, kept, self.getOrDefault("threshold"))
        kept = [n for n in kept if n not in twins]
        cap, label = self.getOrDefault("max_features"), self.getOrDefault("labelCol")
        weak: list[str] = []
        if label and cap and len(kept) > cap:
            chosen = by_importance(df, kept, label, self.getOrDefault("problem_type"), cap)
            weak = [n for n in kept if n not in chosen]
            kept = chosen
        return FittedSelection.of(
            selected=kept,
            removed=constant + twins + weak,
            removed_constant=constant,
            removed_correlated=twins,
            removed_by_model=weak,
        )


def selector_for(features: Sequence[str], problem_type: str, label: str) -> FeatureSelector | None:
    """The selector a wide feature set calls for, None up to 100 features."""
    if len(features) <= MANY_FEATURES:
        return None
    return FeatureSelector(
        inputCols=list(features),
        problem_type=problem_type,
        max_features=min(50, len(features) // 2),
        threshold=0.95,
        labelCol=label,
    )

"""Scoring new tables with a fitted chain, and what drove the scores."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import OneVsRestModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions.coercion import quoted
from tabulon.session import small_table
from tabulon.sources.registry import load_model

_WORKING = ("features", "rawPrediction", "probability", "prediction", "predicted")


def score(model: PipelineModel, data: DataFrame) -> DataFrame:
    """The input columns plus ``prediction`` and, for classes, ``probabilities``.

    Works on streaming DataFrames as well.  A class prediction comes back as the
    original class text.  Every given column stays as it is; where one has the name of
    an answer, the answer is called ``model_prediction`` or ``model_probabilities``.
    """
    # The steps rewrite columns in place and name their own, so the input rides along untouched.
    given = F.struct(*[quoted(c).alias(f"c{k}") for k, c in enumerate(data.columns)]).alias("_given")
    free = [c for c in data.columns if c.lower() not in {w.lower() for w in _WORKING}]
    scored = model.transform(data.select(*[quoted(c) for c in free], given))
    kept = [F.col("_given")[f"c{k}"].alias(c) for k, c in enumerate(data.columns)]
    taken = {c.lower() for c in data.columns}

    def answer(column, name: str):
        return column.alias(name if name not in taken else f"model_{name}")

    label = answer(F.col("predicted" if "predicted" in scored.columns else "prediction"), "prediction")
    if "probability" in scored.columns:
        return scored.select(*kept, label, answer(vector_to_array("probability"), "probabilities"))
    return scored.select(*kept, label)


def predict(spark: SparkSession, training_id: str, data: DataFrame, root: str) -> DataFrame:
    """Score a table with a stored model."""
    model, _ = load_model(spark, training_id, root)
    return score(model, data)


def _weights(model) -> np.ndarray | None:
    if isinstance(model, OneVsRestModel):
        held = [_weights(m) for m in model.models]
        return None if any(h is None for h in held) else np.mean(held, axis=0)
    if hasattr(model, "featureImportances"):
        return model.featureImportances.toArray()
    if hasattr(model, "coefficientMatrix"):
        return np.abs(model.coefficientMatrix.toArray()).mean(axis=0)
    if hasattr(model, "coefficients"):
        return np.abs(model.coefficients.toArray())
    return None


def feature_importance(
    spark: SparkSession, model: PipelineModel, feature_names: Sequence[str], top: int | None = None
) -> DataFrame:
    """``(feature, importance)``, the largest first; empty when the model has none."""
    stages = [s for s in model.stages if _weights(s) is not None]
    weights = _weights(stages[-1]) if stages else np.array([])
    names = list(feature_names) if len(feature_names) == len(weights) else [f"feature_{k}" for k in range(len(weights))]
    table = small_table(
        spark,
        [(k, n, float(w)) for k, (n, w) in enumerate(zip(names, weights))],
        "position int, feature string, importance double",
    )
    ordered = table.orderBy(F.desc("importance"), "position").select("feature", "importance")
    return ordered.limit(top) if top else ordered

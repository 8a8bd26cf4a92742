"""From a raw table to train and test feature vectors with one fitted chain."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions.coercion import missing_to_null, number_of, quoted
from tabulon.operators.encoders import CategoryEncoder, HashEncoder
from tabulon.operators.engineering import FeatureEngineer
from tabulon.operators.imputers import ConstantImputer, MedianImputer
from tabulon.operators.inference import (
    AUTO_DETECT,
    CATEGORICAL,
    CLASSIFICATION,
    NUMERICAL,
    REGRESSION,
    column_verdicts,
    problem_type,
)
from tabulon.operators.outliers import OutlierClipper
from tabulon.operators.scalers import AutoScaler
from tabulon.operators.selection import selector_for
from tabulon.operators.split import places, split_in_place
from tabulon.session import settle

@dataclass
class Routes:
    """Which columns take which way through the preparation."""

    numerical: list[str]
    categorical: list[str]
    hash_encoded: list[str]
    dropped: list[str] = field(default_factory=list)


@dataclass
class Prepared:
    """Feature tables ``(features, label, position)`` and the fitted chain behind them.

    ``rows`` are the training rows before any step, for fitting the chain anew, and
    ``_split_key`` the digest whose order the positions follow.
    """

    train: DataFrame
    test: DataFrame
    rows: DataFrame
    model: PipelineModel
    feature_names: list[str]
    problem_type: str
    labels: list[str]
    routes: Routes
    info: dict


def route_columns(verdicts: Sequence[Mapping], target: str | None = None) -> Routes:
    """Send each column its way; date and free-text columns have none."""
    routes = Routes([], [], [])
    for r in sorted(verdicts, key=lambda r: r["ordinal"]):
        if r["column"] == target:
            continue
        if r["should_drop"]:
            routes.dropped.append(r["column"])
        elif r["should_hash_encode"]:
            routes.hash_encoded.append(r["column"])
        elif r["detected_type"] == NUMERICAL:
            routes.numerical.append(r["column"])
        elif r["detected_type"] == CATEGORICAL:
            routes.categorical.append(r["column"])
    return routes


def separate(df: DataFrame, target: str, dropped: Sequence[str] = ()) -> DataFrame:
    """Features without the flagged columns, the target as ``label``."""
    if target not in df.columns:
        raise ValueError(f"target column '{target}' not found")
    gone = {target, *dropped}
    return df.select(*[quoted(c) for c in df.columns if c not in gone], quoted(target).alias("label"))


def class_labels(df: DataFrame, target: str) -> list[str]:
    """The classes of a target as text, in the order of their values.

    They come to the driver, as does the model fitted to them, which holds numbers for
    every class.
    """
    kinds = df.select(quoted(target).alias("v"), quoted(target).cast("string").alias("shown")).distinct().orderBy("v")
    labels = [r["shown"] for r in kinds.toLocalIterator()]
    if None in labels:
        raise ValueError(f"target '{target}' has missing values")
    return labels


def index_classes(df: DataFrame, target: str, labels: Sequence[str]) -> DataFrame:
    """``label`` 0..k-1 in the order of the sorted classes."""
    indexer = StringIndexerModel.from_labels(list(labels), inputCol="_class", outputCol="label", handleInvalid="error")
    return indexer.transform(df.withColumn("_class", quoted(target).cast("string"))).drop("_class")


def numeric_label(df: DataFrame, target: str) -> DataFrame:
    """``label`` as a double; a target that is not all numbers is refused."""
    bad = df.where(number_of(df, target).isNull()).limit(1).count()
    if bad:
        raise ValueError("target column contains non-numeric values for regression")
    return df.withColumn("label", number_of(df, target))


def resolve_problem(df: DataFrame, target: str, kind: str) -> str:
    if kind == AUTO_DETECT:
        return problem_type(df, target).first()["problem_type"]
    if kind not in (CLASSIFICATION, REGRESSION):
        raise ValueError(f"unknown problem type '{kind}'")
    return kind


def fit_steps(train: DataFrame, routes: Routes, kind: str, interactions: bool = False) -> tuple[PipelineModel, list[str], dict, DataFrame]:
    """Fit every step on the training rows, each on the output of the ones before.

    Returns the chain, the feature names, what was fitted and the transformed rows.
    """
    sources = [c for c in train.columns if c not in ("label", "is_test", "_split_key")]
    stages = []
    data = train

    def run(stage):
        nonlocal data
        fitted = stage.fit(data) if hasattr(stage, "fit") else stage
        data = fitted.transform(data)
        stages.append(fitted)
        return fitted

    made = run(FeatureEngineer(inputCols=sources, pairs=interactions))
    numbers = [*routes.numerical, *[n for n in made.feature_names() if n not in routes.numerical]]
    info: dict = {"engineered": made.feature_names(), "dropped": routes.dropped}
    if numbers:
        info["outliers"] = run(OutlierClipper(inputCols=numbers)).state["records"]
        run(MedianImputer(inputCols=numbers))
        scaled = run(AutoScaler(inputCols=numbers))
        info["scaling"] = {r["column"]: r["method"] for r in scaled.state["records"]}
    names = list(numbers)
    text = [*routes.categorical, *routes.hash_encoded]
    if text:
        run(ConstantImputer(inputCols=text))
    if routes.categorical:
        encoded = run(CategoryEncoder(inputCols=routes.categorical))
        info["encoding"] = encoded.described()
        names += encoded.feature_names()
    if routes.hash_encoded:
        names += run(HashEncoder(inputCols=routes.hash_encoded)).feature_names()
    if not names:
        raise ValueError("no suitable columns found for preparation")
    selector = selector_for(names, kind, "label")
    if selector is not None:
        chosen = run(selector)
        names = chosen.state["selected"]
        info["selection"] = {k: v for k, v in chosen.state.items() if k.startswith("removed_")}
    run(VectorAssembler(inputCols=names, outputCol="features"))
    return PipelineModel(stages), names, info, data


def prepare(
    df: DataFrame,
    target: str,
    problem: str = AUTO_DETECT,
    test_size: float = 0.2,
    key: Sequence[str] | None = None,
    verdicts: Sequence[Mapping] | None = None,
    interactions: bool = False,
) -> Prepared:
    """Route, split, fit on the training side, transform both sides.

    ``key`` names columns that identify a row and fixes the split; ``verdicts``
    reuses the collected column verdicts of a registered dataset.
    """
    if target not in df.columns:
        raise ValueError(f"target column '{target}' not found")
    source = missing_to_null(df)
    kind = resolve_problem(source, target, problem)
    if verdicts is None:
        verdicts = [r.asDict() for r in column_verdicts(source).collect()]  # one row per column
    routes = route_columns(verdicts, target)
    labels: list[str] = []
    if kind == CLASSIFICATION:
        labels = class_labels(source, target)
        labelled = index_classes(source, target, labels)
    else:
        labelled = numeric_label(source, target)
    gone = {target, *routes.dropped} - set(key or ())
    kept = labelled.select(*[quoted(c) for c in labelled.columns if c not in gone or c == "label"])
    by = ["label"] if kind == CLASSIFICATION else []
    marked = settle(split_in_place(kept, test_size, key, *by))
    rows = marked.count()
    train, test = marked.where(~F.col("is_test")), marked.where("is_test")
    model, names, info, ready = fit_steps(train, routes, kind, interactions)

    def placed(side: DataFrame) -> DataFrame:
        return places(side.select("features", "label", "_split_key"), "_split_key", by, rows).drop("_split_key")

    return Prepared(
        placed(ready),
        placed(model.transform(test)),
        train,
        model,
        names,
        kind,
        labels,
        routes,
        info,
    )

"""Candidate models, cross-validation, the leaderboard and its best model."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import IndexToString
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.operators.boosting import EVEN, LEAF, LEVEL, Booster, Growth
from tabulon.operators.inference import CLASSIFICATION, REGRESSION
from tabulon.operators.least_squares import LeastSquares
from tabulon.operators.margins import FEATURES, STEPS, KernelMachine
from tabulon.operators.metrics import (
    classification_metrics,
    fold_summary,
    regression_metrics,
    roc_auc_binary,
    roc_auc_one_vs_rest,
)
from tabulon.operators.split import places
from tabulon.plans.preparation import Prepared, fit_steps
from tabulon.session import settle, small_table
from tabulon.sources.registry import PERFORMANCE

SEED = 42
SVM = "SVM"

# Target extent beyond which the support vector regressor is left out.
SVM_LARGEST_TARGET = 1e8
SVM_LARGEST_RANGE = 1e9

# Presets of boosted trees.  They take the places that the reference work gives to XGBoost, LightGBM
# and CatBoost, with the rounds, steps, shapes and penalties that these libraries have by default (but 64 bins).
BOOSTED = {
    "GBT fast": Growth(rounds=100, step=0.3, kind=LEVEL, depth=6, ridge=1.0, least_hessian=1.0),
    "GBT flat": Growth(rounds=100, step=0.1, kind=LEAF, leaves=31, ridge=0.0, least_hessian=1e-3, least_rows=20),
    "GBT long": Growth(rounds=1000, step=0.03, kind=EVEN, depth=6, ridge=3.0),
}

ROWS_PER_TASK = 10_000

FOREST_TREES = 100
FOREST_DEPTH = 10
"""Spark grows trees level by level and keeps whole levels, so a forest needs a limit; at most 30."""

Maker = Callable[[int, int], Estimator]


def candidates(
    problem: str,
    names: Iterable[str] | None = None,
    forest_trees: int = FOREST_TREES,
    forest_depth: int = FOREST_DEPTH,
    boosting_rounds: int | None = None,
    svm_steps: int = STEPS,
    svm_features: int = FEATURES,
) -> dict[str, Maker]:
    """Makers by model name, each given the number of rows and of classes.

    ``boosting_rounds`` replaces the rounds of every boosted preset.  The support vector
    models have a radial kernel, by ``svm_features`` random features.
    """
    boosted = {n: _boosted(replace(g, rounds=boosting_rounds or g.rounds)) for n, g in BOOSTED.items()}
    if problem == CLASSIFICATION:
        makers: dict[str, Maker] = {
            "Logistic Regression": lambda rows, _: LogisticRegression(
                maxIter=1000, regParam=1.0 / max(rows, 1), elasticNetParam=0.0, standardization=False, tol=1e-4
            ),
            "Random Forest": lambda *_: RandomForestClassifier(numTrees=forest_trees, maxDepth=forest_depth, seed=SEED),
            **boosted,
            SVM: lambda _, classes: KernelMachine(classes, svm_features, svm_steps),
        }
    else:
        makers = {
            "Linear Regression": lambda *_: LeastSquares(),
            "Random Forest": lambda *_: RandomForestRegressor(numTrees=forest_trees, maxDepth=forest_depth, seed=SEED),
            **boosted,
            SVM: lambda *_: KernelMachine(0, svm_features, svm_steps),
        }
    wanted = set(names or makers)
    return {n: m for n, m in makers.items() if n in wanted}


def _boosted(growth: Growth) -> Maker:
    return lambda _, classes: Booster(growth, classes)


def compact(df: DataFrame, rows: int) -> DataFrame:
    """Fewer partitions for a small training table, as each one costs a task in every iteration."""
    enough = max(math.ceil(rows / ROWS_PER_TASK), 1)
    return df.coalesce(enough) if enough < df.rdd.getNumPartitions() else df


def target_extent(df: DataFrame, label: str = "label") -> DataFrame:
    """Range and largest magnitude of a numeric target."""
    y = F.col(label)
    return df.agg((F.max(y) - F.min(y)).alias("target_range"), F.max(F.abs(y)).alias("target_scale"))


def svm_warning(df: DataFrame, label: str = "label") -> str | None:
    """Why the support vector regressor is left out, None if it is not."""
    extent = target_extent(df, label).first()
    scale, spread = extent["target_scale"] or 0.0, extent["target_range"] or 0.0
    if scale > SVM_LARGEST_TARGET or spread > SVM_LARGEST_RANGE:
        return f"SVM excluded due to extreme target scale (max: {scale:.2e})"
    return None


def evaluate(predicted: DataFrame, problem: str, classes: int) -> dict[str, float]:
    """Metrics of a predicted test table; AUC where scores exist."""
    if problem != CLASSIFICATION:
        return regression_metrics(predicted).first().asDict()
    kept = [c for c in ("probability", "rawPrediction") if c in predicted.columns][:1]
    predicted = settle(  # the model runs once, whatever the number of metrics
        predicted.select("label", "prediction", *[vector_to_array(c).alias(c) for c in kept])
    )
    out = classification_metrics(predicted).first().asDict()
    if predicted.where("label is not null").select("label").distinct().count() == 2:
        for name in kept:
            scored = predicted.select("label", F.col(name)[1].alias("score"))
            out["roc_auc"] = roc_auc_binary(scored).first()["roc_auc"]
    elif "probability" in predicted.columns:
        scored = predicted.select("label", F.col("probability").alias("scores"))
        area = roc_auc_one_vs_rest(scored, "label", "scores", classes).first()["roc_auc"]
        if area is not None:
            out["roc_auc"] = area
    return out


def fold_scores(predicted: DataFrame, problem: str) -> DataFrame:
    """``(fold, score)``: accuracy or R2 of the held-out rows of each fold."""
    if problem == CLASSIFICATION:
        score = F.avg((F.col("label") == F.col("prediction")).cast("double"))
    else:
        error = F.sum((F.col("label") - F.col("prediction")) * (F.col("label") - F.col("prediction")))
        score = 1 - error / F.nullif(F.var_pop("label") * F.count("label"), F.lit(0.0))
    return predicted.groupBy("fold").agg(score.alias("score"))


Sides = Sequence[tuple[DataFrame, DataFrame]]


def fold_sides(train: DataFrame, folds: int) -> list[tuple[DataFrame, DataFrame]]:
    """The rows to fit on and the rows held out, for each fold of a prepared table."""
    return [(train.where(F.col("fold") != k), train.where(F.col("fold") == k)) for k in range(folds)]


def refitted_sides(prepared: Prepared, folds: int) -> list[tuple[DataFrame, DataFrame]]:
    """The same, with the preparation fitted anew on the rows of each fold."""
    sides = []
    by = ["label"] if prepared.problem_type == CLASSIFICATION else []
    rows = places(prepared.rows, "_split_key", by, prepared.rows.count())
    dealt = settle(rows.withColumn("fold", fold_of(folds)).drop("position"))
    for fit, held in fold_sides(dealt, folds):
        model, _, _, ready = fit_steps(fit.drop("fold"), prepared.routes, prepared.problem_type)
        held = model.transform(held.drop("fold"))
        sides.append(
            tuple(
                settle(t.select("features", "label", F.lit(len(sides)).alias("fold"))) for t in (ready, held)
            )
        )
    return sides


def fold_of(folds: int) -> Column:
    """Positions are dealt out in turn, so every class is spread evenly."""
    return F.pmod(F.col("position") - 1, F.lit(folds)).cast("int")


def cross_validate(
    maker: Maker,
    train: DataFrame,
    problem: str,
    classes: int,
    sides: Sides,
    rows: int,
    parallel: int = 4,
    prepared_once: bool = True,
) -> tuple[DataFrame, Model]:
    """Scores of the held-out folds, all in one pass, and the model of all rows.

    An estimator that can fit all folds together does so where they are parts of one table;
    otherwise the fits are independent Spark jobs, ``parallel`` of them at a time.
    """
    folds = len(sides)
    together = maker(rows, classes)
    if prepared_once and hasattr(together, "fit_folds"):
        fitted = together.fit_folds(train, folds)
        return _held_out(fitted, sides, problem), fitted[folds]

    def fit(k: int) -> Model:
        if k == folds:
            return maker(rows, classes).fit(train)
        return maker(rows - rows // folds, classes).fit(sides[k][0])

    with ThreadPool(max(parallel, 1)) as pool:
        fitted = pool.map(inheritable_thread_target(train.sparkSession)(fit), range(folds + 1), chunksize=1)
    return _held_out(fitted, sides, problem), fitted[folds]


def _held_out(fitted: Sequence[Model], sides: Sides, problem: str) -> DataFrame:
    held = [model.transform(side).select("fold", "label", "prediction") for model, (_, side) in zip(fitted, sides)]
    return fold_scores(reduce(DataFrame.unionByName, held), problem)


@dataclass
class Training:
    """Everything a training run yields."""

    leaderboard: DataFrame
    summary: DataFrame
    best_name: str
    best_model: PipelineModel
    errors: DataFrame
    records: list[dict] = field(repr=False, default_factory=list)


ERRORS = "model_name string, error string, error_type string"
SUMMARY = (
    "problem_type string, models_trained int, models_attempted int, models_failed int, models_excluded int, "
    "best_model string, feature_names array<string>, cv_folds int, test_size double, warnings array<string>, "
    "training_errors array<struct<model_name: string, error: string, error_type: string>>"
)


def best_model(leaderboard: DataFrame, problem: str) -> DataFrame:
    """Flags the best row by accuracy or R2; the first candidate wins a tie."""
    metric, least = ("accuracy", 0.0) if problem == CLASSIFICATION else ("r2_score", float("-inf"))
    first = Window.orderBy(F.desc(F.coalesce(F.col("metrics")[metric], F.lit(least))), "candidate")
    return leaderboard.withColumn("is_best", F.row_number().over(first) == 1)  # one row per candidate


def train_models(
    prepared: Prepared,
    folds: int = 5,
    models: Sequence[str] | None = None,
    makers: dict[str, Maker] | None = None,
    parallel: int = 4,
    refit_preparation: bool = False,
) -> Training:
    """Cross-validate, fit and test every candidate; a failing one is recorded and skipped.

    The candidates run side by side; their training times hold what they wait for each other.
    ``refit_preparation`` fits the preparation inside each fold as well, so that
    no held-out row has a part in it; by default it is fitted once.
    """
    if not 3 <= folds <= 10:
        raise ValueError("the number of folds must lie between 3 and 10")
    problem, classes = prepared.problem_type, len(prepared.labels)
    spark = prepared.train.sparkSession
    pool = candidates(problem, models) if makers is None else dict(makers)
    # Every candidate reads these tables many times, so they are written out once.
    train = settle(prepared.train.withColumn("fold", fold_of(folds)))
    test = settle(prepared.test)
    rows, test_rows = train.count(), test.count()
    train, test = compact(train, rows), compact(test, test_rows)
    sides = refitted_sides(prepared, folds) if refit_preparation else fold_sides(train, folds)
    warnings, excluded = [], 0
    if problem == REGRESSION and SVM in pool:
        warning = svm_warning(train)
        if warning:
            pool.pop(SVM)
            warnings.append(warning)
            excluded = 1
    def attempt(item: tuple[int, tuple[str, Maker]]) -> tuple[dict | None, Model | None, tuple | None]:
        ordinal, (name, maker) = item
        started = time.time()
        try:
            if not rows:
                raise ValueError(f"empty training data for {name}")
            scores, model = cross_validate(maker, train, problem, classes, sides, rows, parallel, not refit_preparation)
            cv = fold_summary(scores).first()
            if cv["cv_mean"] is None:
                raise ValueError(f"cross-validation failed for {name}")
            metrics = evaluate(model.transform(test), problem, classes)
            if not metrics or any(v is None or v != v for v in metrics.values()):
                raise ValueError(f"invalid metrics computed for {name}")
        except Exception as error:  # a candidate may fail in any of Spark's ways
            return None, None, (name, str(error), type(error).__name__)
        score = "accuracy" if problem == CLASSIFICATION else "r2"
        metrics |= {f"cv_{score}_mean": cv["cv_mean"], f"cv_{score}_std": cv["cv_std"]}
        record = {"candidate": ordinal, "model_name": name, "metrics": metrics, "training_time": time.time() - started}
        return record, model, None

    # One candidate leaves most cores idle, as its rounds follow each other, so all are fitted side by side.
    with ThreadPool(max(len(pool), 1)) as threads:
        tried = threads.map(inheritable_thread_target(spark)(attempt), list(enumerate(pool.items())), chunksize=1)
    records = [record for record, _, _ in tried if record]
    errors = [error for _, _, error in tried if error]
    fitted = {record["model_name"]: model for record, model, _ in tried if record}
    if not records:
        raise ValueError("no models could be trained successfully")
    ranked = best_model(
        small_table(spark, records, "candidate int, model_name string, metrics map<string,double>, training_time double"), problem
    ).orderBy("candidate")
    rows_out = [r.asDict() for r in ranked.collect()]  # one row per candidate
    best = next(r["model_name"] for r in rows_out if r["is_best"])
    performances = [{k: r[k] for k in PERFORMANCE.fieldNames()} for r in rows_out]
    error_rows = [dict(zip(("model_name", "error", "error_type"), e)) for e in errors]
    summary = (
        problem, len(records), len(pool) + excluded, len(errors), excluded, best, prepared.feature_names,
        folds, test_rows / (rows + test_rows), warnings, error_rows,
    )
    return Training(
        small_table(spark, performances, PERFORMANCE),
        small_table(spark, [summary], SUMMARY),
        best,
        deployable(prepared, fitted[best]),
        small_table(spark, error_rows, ERRORS),
        performances,
    )


def deployable(prepared: Prepared, model: Model) -> PipelineModel:
    """Preparation, model and the way back to the original class, as one chain."""
    stages = [*prepared.model.stages, model]
    if prepared.labels:
        stages.append(IndexToString(inputCol="prediction", outputCol="predicted", labels=prepared.labels))
    return PipelineModel(stages)


def comparison(leaderboard: DataFrame, problem: str) -> DataFrame:
    """``(model_name, score)`` by the primary metric."""
    metric = "accuracy" if problem == CLASSIFICATION else "r2_score"
    return leaderboard.select("model_name", F.col("metrics")[metric].alias("score"))


def metadata_of(spark: SparkSession, prepared: Prepared, training: Training) -> dict:
    """The metadata record kept beside a stored model."""
    return {
        "problem_type": prepared.problem_type,
        "best_model_name": training.best_name,
        "feature_names": prepared.feature_names,
        "labels": prepared.labels,
        "model_performances": training.records,
        "original_columns": {
            "numerical": prepared.routes.numerical,
            "categorical": prepared.routes.categorical,
            "hash_encoded": prepared.routes.hash_encoded,
        },
        "scaling": prepared.info.get("scaling", {}),
        "encoding": prepared.info.get("encoding", {}),
    }

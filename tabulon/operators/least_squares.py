"""Linear regression of all rows and outside of each fold, from one scan.

A task adds up, for each fold, the rows, the means and the centred products of features
and target.  Such sums meet without loss of digits, so the fit outside of a fold is the
solution over the sums of the other folds; no row is read a second time.

Defined results: rows without a target have no part; a feature without spread has weight
zero, and of features that depend on one another the shortest solution is taken (features
in units of their spread); without rows every answer is zero.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Estimator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.operators.stages import FittedColumns
from tabulon.session import settle

FAN_IN = 16
DEPENDENT = 1e-10
"""Share of the largest singular value below which a direction counts as none."""

_SUMS = "fold int, part long, sums binary"
_WEIGHTS = "fold int, weights binary"

Sums = tuple[float, np.ndarray, np.ndarray]


def sums_of(rows: np.ndarray) -> Sums:
    """Number, means and centred products of the columns."""
    means = rows.mean(axis=0)
    apart = rows - means
    return float(len(rows)), means, apart.T @ apart


def together(parts: Iterable[Sums]) -> Sums | None:
    """The sums of all rows behind several sums; None if there are none."""
    total = None
    for n, means, products in parts:
        if total is None:
            total = (n, means, products)
            continue
        m, old, held = total
        apart = means - old
        total = (m + n, old + apart * (n / (m + n)), held + products + np.outer(apart, apart) * (m * n / (m + n)))
    return total


def solution(sums: Sums | None) -> np.ndarray:
    """Weights of the features, then the intercept; the target is the last column."""
    if sums is None:
        return np.zeros(1)
    _, means, products = sums
    spread = np.sqrt(np.diag(products))
    # what is left of a constant after rounding is no spread
    flat = spread[:-1] <= 1e-12 * np.abs(means[:-1]) * np.sqrt(sums[0])
    unit = np.where(flat, 1.0, spread[:-1])
    scaled = products[:-1, :-1] / np.outer(unit, unit)
    aim = products[:-1, -1] / unit
    scaled[flat, :] = scaled[:, flat] = aim[flat] = 0.0
    weights = np.linalg.lstsq(scaled, aim, rcond=DEPENDENT)[0] / unit
    return np.append(weights, means[-1] - weights @ means[:-1])


def _packed(sums: Sums) -> bytes:
    return np.concatenate([[sums[0]], sums[1], sums[2].reshape(-1)]).tobytes()


def _unpacked(held: bytes) -> Sums:
    numbers = np.frombuffer(held)
    width = int(np.sqrt(len(numbers)))  # 1 + w + w * w numbers
    return float(numbers[0]), numbers[1 : width + 1], numbers[width + 1 :].reshape(width, width)


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, Sums] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        rows = np.column_stack([x, batch.column("label").to_numpy(zero_copy_only=False)])
        folds = batch.column("fold").to_numpy(zero_copy_only=False)
        for fold in np.unique(folds).tolist():
            held[fold] = together([*([held[fold]] if fold in held else []), sums_of(rows[folds == fold])])
    here = TaskContext.get().partitionId()
    for fold, sums in held.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([fold], pa.int32()), pa.array([here], pa.int64()), pa.array([_packed(sums)], pa.binary())],
            names=["fold", "part", "sums"],
        )


def _merge(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
    sums = together(map(_unpacked, parts.sort_values("part")["sums"]))
    return pd.DataFrame({"fold": [key[0]], "part": [key[1]], "sums": [_packed(sums)]})


class LeastSquares(Estimator):
    """Ordinary least squares over ``features`` and ``label``."""

    def _fit(self, df: DataFrame) -> FittedLine:
        return self.fit_folds(df.withColumn("fold", F.lit(0)), 0)[0]

    def fit_folds(self, df: DataFrame, folds: int) -> list[FittedLine]:
        """A model of the rows outside of each fold (column ``fold``), and one of all rows."""
        rows = df.where("label IS NOT NULL").select(
            F.col("label").cast("double").alias("label"), F.col("fold").cast("int").alias("fold"), vector_to_array("features").alias("x")
        )
        sums = settle(rows.mapInArrow(_add_up, _SUMS))  # the parts stay as they were written, however later jobs are planned
        parts = (sums.agg(F.max("part")).first()[0] or 0) + 1
        while parts > 1:
            sums = sums.groupBy("fold", F.expr(f"part div {FAN_IN}")).applyInPandas(_merge, _SUMS)
            parts = -(-parts // FAN_IN)

        def solve(held: pd.DataFrame) -> pd.DataFrame:
            by_fold = {int(f): _unpacked(s) for f, s in zip(held["fold"], held["sums"])}
            sides = [[s for f, s in sorted(by_fold.items()) if f != k] for k in range(folds)] + [[by_fold[f] for f in sorted(by_fold)]]
            return pd.DataFrame({"fold": range(folds + 1), "weights": [solution(together(s)).tobytes() for s in sides]})

        solved = sums.groupBy().applyInPandas(solve, _WEIGHTS)  # a row per fold, whatever the data
        found = {r["fold"]: np.frombuffer(bytes(r["weights"])) for r in solved.collect()}
        return [FittedLine.made(found.get(k, np.zeros(1))) for k in range(folds + 1)]


class FittedLine(FittedColumns):
    @classmethod
    def made(cls, weights: np.ndarray) -> FittedLine:
        return cls.of(coefficients=[float(w) for w in weights[:-1]], intercept=float(weights[-1]))

    @property
    def coefficients(self) -> DenseVector:
        return Vectors.dense(self.state["coefficients"])

    @property
    def intercept(self) -> float:
        return self.state["intercept"]

    def _rewrite(self, df: DataFrame) -> DataFrame:
        weights = F.array(*[F.lit(w) for w in self.state["coefficients"]]).cast("array<double>")
        products = F.zip_with(vector_to_array("features"), weights, lambda x, w: x * F.coalesce(w, F.lit(0.0)))
        return df.withColumn("prediction", F.aggregate(products, F.lit(self.state["intercept"]), lambda a, p: a + p))

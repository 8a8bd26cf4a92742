"""Linear fits of all folds from one scan, against direct solutions and the built-in solver."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression

from tabulon.operators import least_squares
from tabulon.operators.least_squares import FittedLine, LeastSquares, solution, sums_of, together


def _data(seed: int = 0, rows: int = 600):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(1e6, 1, rows), rng.normal(0, 1e-3, rows), rng.integers(0, 2, rows)])
    y = 3 * x[:, 0] - 200 * x[:, 1] + 5 * x[:, 2] + rng.normal(size=rows) + 7
    return x, y


def _table(spark, x, y, folds=4):
    rows = [(Vectors.dense(a), None if b is None else float(b), k % folds) for k, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, ["features", "label", "fold"])


def _direct(x, y):
    middle = x.mean(axis=0)
    w = np.linalg.lstsq(x - middle, y - y.mean(), rcond=None)[0]
    return np.append(w, y.mean() - w @ middle)


def test_folds_equal_direct_solutions(spark, monkeypatch):
    monkeypatch.setattr(least_squares, "FAN_IN", 2)
    x, y = _data()
    df = _table(spark, x, y).repartition(7)
    models = LeastSquares().fit_folds(df, 4)
    assert len(models) == 5
    for k, model in enumerate(models):
        kept = np.arange(len(y)) % 4 != k
        wanted = _direct(x[kept], y[kept])
        assert np.allclose(model.coefficients.toArray(), wanted[:-1], rtol=1e-6)
        assert np.allclose(x @ model.coefficients.toArray() + model.intercept, x @ wanted[:-1] + wanted[-1], atol=1e-5)
    near = _table(spark, x - x.mean(axis=0), y)  # the built-in solver loses digits of columns far from zero
    built_in = LinearRegression(solver="normal").fit(near)
    assert np.allclose(LeastSquares().fit(near).coefficients.toArray(), built_in.coefficients.toArray(), rtol=1e-5)
    shown = models[4].transform(df.limit(5)).collect()
    assert all(r["prediction"] == pytest.approx(r["features"].dot(models[4].coefficients) + models[4].intercept) for r in shown)


def test_constant_and_dependent_features():
    rng = np.random.default_rng(1)
    a = rng.normal(size=50)
    rows = np.column_stack([a, 2 * a, np.full(50, 0.1), 6 * a + 1])
    w = solution(sums_of(rows))
    assert w[2] == 0 and w[0] + 2 * w[1] == pytest.approx(6) and w[3] == pytest.approx(1)
    whole, halves = sums_of(rows), together([sums_of(rows[:20]), sums_of(rows[20:])])
    assert all(np.allclose(p, q) for p, q in zip(whole, halves)) and together([]) is None


def test_missing_targets_and_empty_tables(spark, tmp_path):
    x, y = _data(2, 40)
    df = _table(spark, x, [None if k % 5 == 0 else b for k, b in enumerate(y)])
    kept = np.arange(40) % 5 != 0
    model = LeastSquares().fit(df)
    assert np.allclose(model.coefficients.toArray(), _direct(x[kept], y[kept])[:-1], rtol=1e-6)
    empty = LeastSquares().fit_folds(df.limit(0), 3)
    assert len(empty) == 4 and all(m.intercept == 0 for m in empty) and empty[0].transform(df).where("prediction = 0").count() == 40
    model.save(str(tmp_path / "line"))
    assert FittedLine.load(str(tmp_path / "line")).state == model.state

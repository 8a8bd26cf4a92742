"""Kernel machines: against a dense solution, shapes no line parts, calibrated probabilities."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabulon.operators import margins
from tabulon.operators.margins import FittedMachine, KernelMachine


def _table(spark, x, y):
    held = [(float(t), k % 3, Vectors.dense(v.tolist())) for k, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(held, ["label", "fold", "features"]).withColumn("fold", F.col("fold").cast("int")).repartition(4)


def _loss(table):
    p = np.array([(r["label"], *r["probability"].toArray()) for r in table.select("label", "probability").collect()])
    return -np.log(np.clip(p[np.arange(len(p)), 1 + p[:, 0].astype(int)], 1e-12, 1)).mean()


def test_weights_minimise_the_loss(spark, monkeypatch):
    monkeypatch.setattr(margins, "SYSTEMS_PER_JOB", 2)
    draw = np.random.default_rng(1)
    x = draw.normal(size=(150, 3))
    y = (x[:, 0] + draw.normal(size=150) > 0).astype(float)
    model = KernelMachine(2, features=10).fit_folds(_table(spark, x, y), 3)[3]
    with np.load(__import__("io").BytesIO(__import__("base64").b64decode(model.state["arrays"]))) as held:
        w, z = held["weights"][0], margins.mapped(x, held["waves"], held["shifts"])
    sign = 2 * y - 1
    short = np.maximum(0, 1 - sign * (z @ w))
    assert np.abs(w - 2 * z.T @ (sign * short)).max() < 1e-4  # the gradient is zero


@pytest.mark.parametrize("classes", [2, 6])
def test_rings_and_probabilities(spark, classes):
    draw = np.random.default_rng(2)
    x = draw.uniform(-1, 1, (900, 2))
    y = np.minimum((np.hypot(*x.T) * 1.5 * classes / 2).astype(int), classes - 1)
    blurred = np.where(draw.random(900) < 0.15, draw.integers(0, classes, 900), y)
    table = _table(spark, x, y)
    right = KernelMachine(classes, 300, penalty=10.0).fit(table).transform(table)
    assert right.where("label = prediction").count() >= (0.95 if classes == 2 else 0.85) * 900
    table = _table(spark, x, blurred)
    fitted = KernelMachine(classes).fit_folds(table, 3)[3]
    plain = FittedMachine.of(**(fitted.state | {"sigmoids": [[1.0, 0.0]] * len(fitted.state["sigmoids"])}))
    assert _loss(fitted.transform(table)) < _loss(plain.transform(table))
    sums = [r["probability"].toArray().sum() for r in fitted.transform(table).collect()]
    assert min(sums) > 1 - 1e-9 and max(sums) < 1 + 1e-9


def test_numbers_inside_the_tube(spark, tmp_path):
    x = np.linspace(-3, 3, 200)[:, None]
    y = 100 + 50 * np.sin(x[:, 0])
    table = _table(spark, x, y)
    model = KernelMachine(0, penalty=100.0).fit(table)
    assert model.transform(table).agg(F.max(F.abs(F.col("label") - F.col("prediction")))).first()[0] < 10
    model.write().save(str(tmp_path / "m"))
    again = FittedMachine.load(str(tmp_path / "m")).transform(table).orderBy("label", "fold").collect()
    assert [r["prediction"] for r in again] == [r["prediction"] for r in model.transform(table).orderBy("label", "fold").collect()]


def test_nothing_to_tell_apart(spark):
    flat = _table(spark, np.ones((9, 2)), np.zeros(9))
    model = KernelMachine(2).fit(flat)
    assert model.transform(flat).agg(F.max("prediction")).first()[0] == 0.0
    assert model.transform(flat.where("false")).count() == 0

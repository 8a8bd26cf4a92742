"""Support vector models with a radial kernel, by random features, with class probabilities.

The kernel is taken as the product of random cosine features, drawn once.  On them the
squared hinge loss (for numbers: the squared distance beyond a tube) is minimised by Newton's
method: rows inside their margin have no part, so a step is a ridge solution over the others.
One job adds up the products of the active rows for all classes and all folds; the sums meet
by fold and class, are solved there, and the weights alone come to the driver.

Probabilities follow Platt: a sigmoid per class is fitted to margins of rows that had no part
in their model, which the folds provide, and the classes' shares are scaled to one.

Defined results: a class that never occurs has probability near zero; features without any
spread, or no rows, leave a constant answer; of equal margins the first class is taken.
"""

from __future__ import annotations

import base64
import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.operators.stages import FittedColumns

FEATURES = 200
STEPS = 20
FINE = 1e-6
INNER_FOLDS = 3
SIGMOID_STEPS = 25
SYSTEMS_PER_JOB = 128
SEED = 42

_SUMS = "system int, sums binary"
_SOLVED = "system int, weights binary"
_ADDED = "place int, value double"


def mapped(x: np.ndarray, waves: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Random cosine features of rows, and a column of ones."""
    z = np.cos(x @ waves + shifts) * np.sqrt(2.0 / max(len(shifts), 1))
    return np.hstack([z, np.ones((len(x), 1))])


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _active(score: np.ndarray, label: np.ndarray, tube: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows that count, and what they should score."""
    if tube is None:
        return label * score < 1, label
    off = label - score
    return np.abs(off) > tube, label - np.sign(off) * tube


class KernelMachine(Estimator):
    """For a number (0 classes), two classes or several."""

    def __init__(self, classes: int = 0, features: int = FEATURES, steps: int = STEPS, penalty: float = 1.0, tube: float = 0.1):
        super().__init__()
        self.classes, self.features, self.steps, self.penalty = classes, features, steps, penalty
        self.tube = tube if classes < 2 else None
        self.lines = classes if classes > 2 else 1

    def _fit(self, df: DataFrame) -> FittedMachine:
        dealt = df.withColumn("fold", F.pmod(F.xxhash64(vector_to_array("features")), F.lit(INNER_FOLDS)).cast("int"))
        return self.fit_folds(dealt, INNER_FOLDS)[INNER_FOLDS]

    def fit_folds(self, df: DataFrame, folds: int) -> list[FittedMachine]:
        """A model of the rows outside of each fold (column ``fold``), and one of all rows."""
        held = df.select(F.col("label").cast("double").alias("label"), F.col("fold").cast("int").alias("fold"), vector_to_array("features").alias("x"))
        extent = held.agg(F.max(F.size("x")).alias("width"), F.avg("label").alias("mean"), F.stddev_pop("label").alias("spread")).first()
        width = extent["width"] or 0
        variance = held.select(F.explode("x").alias("v")).agg(F.var_pop("v")).first()[0] or 0.0
        draw = np.random.default_rng(SEED)
        waves = draw.normal(size=(width, self.features)) * np.sqrt(2.0 / (width * variance) if width * variance else 0.0)
        shifts = draw.uniform(0, 2 * np.pi, self.features)
        number = self.tube is not None
        middle, scale = (extent["mean"] or 0.0, extent["spread"] or 1.0) if number else (0.0, 1.0)
        prepared = (waves, shifts, middle, scale)
        size = self.features + 1
        weights = np.zeros((folds + 1, self.lines, size))
        for step in range(self.steps):
            new = self._newton(held, folds, weights, prepared)
            change = np.abs(new - weights).max()
            weights = new if step < self.steps // 2 else (weights + new) / 2  # a set of rows that comes and goes
            if change <= FINE * max(np.abs(weights).max(), 1.0):
                break
        sigmoids = None if number else self._sigmoids(held, folds, weights, prepared)
        return [FittedMachine.made(self.classes, w, prepared, sigmoids) for w in weights]

    def _targets(self, labels: np.ndarray, middle: float, scale: float) -> np.ndarray:
        """A line per class: 1 and -1, or the scaled number."""
        if self.tube is not None:
            return ((labels - middle) / scale)[None, :]
        if self.lines == 1:
            return np.where(labels == 1, 1.0, -1.0)[None, :]
        return np.where(np.arange(self.lines)[:, None] == labels, 1.0, -1.0)

    def _newton(self, held: DataFrame, folds: int, weights: np.ndarray, prepared: tuple) -> np.ndarray:
        waves, shifts, middle, scale = prepared
        size, lines, tube, penalty, targets = weights.shape[2], self.lines, self.tube, self.penalty, self._targets
        out = np.zeros_like(weights)
        systems = [(f, c) for f in range(folds + 1) for c in range(lines)]

        def solve(key: tuple, parts: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x.as_py()).reshape(size, size + 1) for x in parts.column("sums"))
            found = np.linalg.solve(np.eye(size) + 2 * penalty * total[:, :size], 2 * penalty * total[:, size])
            return pa.table({"system": pa.array([key[0].as_py()], pa.int32()), "weights": pa.array([found.tobytes()], pa.binary())})

        for first in range(0, len(systems), SYSTEMS_PER_JOB):
            some = systems[first : first + SYSTEMS_PER_JOB]

            def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                sums = np.zeros((len(some), size, size + 1))  # noqa: B023
                for b in batches:
                    if not b.num_rows:
                        continue
                    z = mapped(_matrix(b.column("x"), b.num_rows), waves, shifts)
                    want, fold = targets(b.column("label").to_numpy(), middle, scale), b.column("fold").to_numpy()
                    for k, (f, c) in enumerate(some):  # noqa: B023
                        inside, goal = _active(z @ weights[f, c], want[c], tube)
                        inside &= fold != f
                        zi = z[inside]
                        sums[k, :, :size] += zi.T @ zi
                        sums[k, :, size] += zi.T @ goal[inside]
                packed = [pa.array(np.arange(len(some), dtype=np.int32)), pa.array([s.tobytes() for s in sums], pa.binary())]  # noqa: B023
                yield pa.RecordBatch.from_arrays(packed, names=["system", "sums"])

            solved = held.mapInArrow(add_up, _SUMS).groupBy("system").applyInArrow(solve, _SOLVED)
            for r in solved.collect():  # the weights of the models
                out[some[r["system"]]] = np.frombuffer(r["weights"])
        return out

    def _sigmoids(self, held: DataFrame, folds: int, weights: np.ndarray, prepared: tuple) -> np.ndarray:
        """Slope and shift of each class, by Newton steps on rows outside of their model."""
        waves, shifts, middle, scale = prepared
        lines, targets = self.lines, self._targets
        goals = held.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per class
        many = sum(r["n"] for r in goals)
        first = 1 if lines == 1 else 0
        yes = np.array([sum(r["n"] for r in goals if int(r["label"]) == c + first) for c in range(lines)], float)
        high, low = (yes + 1) / (yes + 2), 1 / (many - yes + 2)
        found = np.zeros((lines, 2))
        found[:, 1] = np.log((yes + 1) / (many - yes + 1))

        for _ in range(SIGMOID_STEPS):

            def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = np.zeros((lines, 5))
                for b in batches:
                    if not b.num_rows:
                        continue
                    z = mapped(_matrix(b.column("x"), b.num_rows), waves, shifts)
                    want, fold = targets(b.column("label").to_numpy(), middle, scale), b.column("fold").to_numpy()
                    margins = np.zeros((lines, len(z)))
                    for f in np.unique(fold):
                        margins[:, fold == f] = weights[f] @ z[fold == f].T
                    p = 1 / (1 + np.exp(-np.clip(found[:, :1] * margins + found[:, 1:], -500, 500)))  # noqa: B023
                    off, h = p - np.where(want > 0, high[:, None], low[:, None]), p * (1 - p)
                    for k, part in enumerate((off * margins, off, h * margins * margins, h * margins, h)):
                        total[:, k] += part.sum(axis=1)
                flat = total.reshape(-1)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["place", "value"])

            parts = held.mapInArrow(add_up, _ADDED).groupBy("place").agg(F.sum("value").alias("value")).collect()
            sums = np.zeros(lines * 5)
            for r in parts:  # five numbers per class
                sums[r["place"]] = r["value"]
            change = np.zeros_like(found)
            for c, (ga, gb, aa, ab, bb) in enumerate(sums.reshape(lines, 5)):
                change[c] = np.linalg.solve(np.array([[aa, ab], [ab, bb]]) + np.eye(2) * 1e-9, [ga, gb])
            size = np.abs(change).max()
            found -= change * min(1.0, 3.0 / max(size, 1e-12))
            if size < FINE:
                break
        return found


class FittedMachine(FittedColumns):
    """Weights on the random features; scores rows in Arrow batches."""

    @classmethod
    def made(cls, classes: int, weights: np.ndarray, prepared: tuple, sigmoids: np.ndarray | None) -> FittedMachine:
        waves, shifts, middle, scale = prepared
        held = io.BytesIO()
        np.savez_compressed(held, weights=weights, waves=waves, shifts=shifts)
        return cls.of(
            classes=classes, middle=middle, scale=scale, arrays=base64.b64encode(held.getvalue()).decode(),
            sigmoids=None if sigmoids is None else sigmoids.tolist(),
        )

    def _scorer(self) -> Callable[[pa.Array], pa.Array]:
        with np.load(io.BytesIO(base64.b64decode(self.state["arrays"]))) as held:
            weights, waves, shifts = held["weights"], held["waves"], held["shifts"]

        def work(x: pa.Array) -> pa.Array:
            n = len(x)
            out = mapped(_matrix(x, n), waves, shifts) @ weights.T if n else np.zeros((0, len(weights)))
            return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(weights)), pa.array(out.reshape(-1)))

        return work

    def _rewrite(self, df: DataFrame) -> DataFrame:
        work = self._scorer()

        @F.arrow_udf("array<double>")
        def margins(x: pa.Array) -> pa.Array:
            return work(x)

        scored = df.withColumn("_margins", margins(vector_to_array("features")))
        state = self.state
        if state["classes"] < 2:
            return scored.withColumn("prediction", F.col("_margins")[0] * state["scale"] + state["middle"]).drop("_margins")
        each = [1 / (1 + F.exp(-(F.col("_margins")[k] * a + b))) for k, (a, b) in enumerate(state["sigmoids"])]
        if state["classes"] == 2:
            raw, shares = F.array(-F.col("_margins")[0], F.col("_margins")[0]), F.array(1 - each[0], each[0])
        else:
            raw, total = F.col("_margins"), sum(each[1:], each[0])
            shares = F.transform(F.array(*each), lambda p: p / total)
        return (
            scored.withColumn("_raw", raw)
            .withColumn("rawPrediction", array_to_vector("_raw"))
            .withColumn("probability", array_to_vector(shares))
            .withColumn("prediction", (F.array_position("_raw", F.array_max("_raw")) - 1).cast("double"))
            .drop("_margins", "_raw")
        )

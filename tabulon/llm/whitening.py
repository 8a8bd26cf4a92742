"""Whitened embeddings: projections on the leading components of the covariance, scaled to variance one.

Vectors become whole numbers; the model is fitted to each distinct vector once.  The
covariance is never formed: a product with it is a pass over the fit list, in which every
task adds up ``(x - mean) * ((x - mean) . v)`` for a few vectors v at a time.

Eigenvectors come from the Jacobi-Davidson method.  A search space is kept; Rayleigh-Ritz
gives the best approximations in it, and for each that is not exact yet the projected
correction equation is solved roughly by MINRES, all of them sharing their products.  The
corrections widen the space.  A pair whose residual reaches double precision is locked and
the rest stays orthogonal to it; two pairs more than wanted are carried, so that none is
overlooked.  The driver holds some vectors of the embeddings' width, no rows.

Defined results: vectors that are null or hold a null or a number that is not finite take no
part; in vectors of different lengths the missing entries count as 0; once scaled, entries
must fit 64 bits.  Repeated rows, and rows without an id, are all returned; each distinct
vector is fitted once.  Components without variance are left out, so there are fewer than
asked for where the vectors are narrow or lie in a plane, and no rows at all if all vectors
are equal or there are none.  Of equal eigenvalues any orthogonal directions are taken.  A
deviation that does not fit 64 bits is null.  Other columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.common import small_batches
from tabulon.llm.topk import whole_components
from tabulon.session import settle, small_table

COMPONENTS = 4
SCALE = 256
GUARDS = 2
INNER_STEPS = 12
INNER_SHARE = 0.02
LARGEST_SPACE = 12
"""Width of the search space, in multiples of the pairs carried, before it is cut back."""

OUTER_STEPS = 400
BATCH_ROWS = 8192

_ADDED = "place int, value double"
_COUNTED = "place int, value bigint"
ROWS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("component", T.IntegerType()),
        T.StructField("deviation", T.LongType()),
        T.StructField("whitened", T.DoubleType()),
    ]
)
EPSILON = float(np.finfo(float).eps)
Product = Callable[[np.ndarray], np.ndarray]


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _added_up(fit: DataFrame, width: int, work: Callable[[np.ndarray], np.ndarray], size: int, whole: bool = False) -> np.ndarray:
    """Sum of ``work`` over all parts of the fit list; ``size`` numbers come to the driver."""
    kind = np.int64 if whole else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, kind)
        for b in batches:
            if b.num_rows:
                total += work(_matrix(b.column(0), width)).reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["place", "value"])

    parts = fit.mapInArrow(run, _COUNTED if whole else _ADDED)
    out = np.zeros(size, kind)
    for r in parts.groupBy("place").agg(F.sum("value").alias("value")).collect():
        out[r["place"]] = r["value"]
    return out


def _orthonormal(new: np.ndarray, *held: np.ndarray) -> np.ndarray:
    """Orthonormal directions of ``new`` that are not in the span of ``held``; twice is enough."""
    out: list[np.ndarray] = []
    for v in new.T:
        size = np.linalg.norm(v)
        for _ in range(2):
            for h in held:
                v = v - h @ (h.T @ v)
            for o in out:
                v = v - o * (o @ v)
        left = np.linalg.norm(v)
        if size > 0 and left > 1e-10 * size:
            out.append(v / left)
    return np.array(out).T if out else np.zeros((len(new), 0))


def minres(product: Product, right: np.ndarray, steps: int, share: float) -> np.ndarray:
    """Approximate solutions of a symmetric system for several right sides, one shared product a step."""

    def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        under = (b * b).sum(axis=0)
        return np.where(under > 0, (a * b).sum(axis=0) / np.where(under > 0, under, 1.0), 0.0)

    x, left = np.zeros_like(right), right.copy()
    wanted = share * np.linalg.norm(right, axis=0)
    p0 = left.copy()
    s0 = product(p0)
    p1 = s1 = p2 = s2 = None
    for _ in range(steps):
        p2, s2, p1, s1 = p1, s1, p0, s0
        step = ratio(left, s1)
        x += step * p1
        left -= step * s1
        if (np.linalg.norm(left, axis=0) <= wanted).all():
            break
        p0, s0 = s1, product(s1)
        for p, s in ((p1, s1), (p2, s2)):
            if s is not None:
                part = ratio(s0, s)
                p0, s0 = p0 - part * p, s0 - part * s
    return x


def leading_pairs(product: Product, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric operator, falling, and unit eigenvectors as columns."""
    k = min(k, width)
    carried = min(width, k + GUARDS)
    locked, values = np.zeros((width, 0)), []
    space = _orthonormal(np.random.default_rng(0).normal(size=(width, carried)))
    image = product(space)
    scale = 0.0
    for _ in range(OUTER_STEPS):
        small = space.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        scale = max(scale, float(np.abs(theta).max()), *map(abs, values))
        some = carried - len(values)
        ritz, moved = space @ turn[:, :some], image @ turn[:, :some]
        left = moved - ritz * theta[:some]
        left -= locked @ (locked.T @ left)
        good = np.linalg.norm(left, axis=0) <= 64 * EPSILON * np.sqrt(width) * scale
        exact = int(np.argmin(np.append(good, False)))
        if space.shape[1] + locked.shape[1] >= width:  # the whole space: nothing is left to add
            exact = some
        exact = min(exact, k - len(values))
        if exact:
            locked = np.hstack([locked, ritz[:, :exact]])
            values += theta[:exact].tolist()
            if len(values) == k:
                order = np.argsort(-np.array(values), kind="stable")
                return np.array(values)[order], locked[:, order]
        keep = turn[:, exact : exact + 2 * carried] if turn.shape[1] > LARGEST_SPACE * carried else turn[:, exact:]
        space, image = space @ keep, image @ keep
        ritz, left, shifts = ritz[:, exact:], left[:, exact:], theta[exact:some]
        known = np.hstack([locked, ritz])

        def projected(v: np.ndarray) -> np.ndarray:
            v = v - known @ (known.T @ v)
            v = product(v) - shifts * v  # noqa: B023
            return v - known @ (known.T @ v)  # noqa: B023

        correction = minres(projected, -left, INNER_STEPS, INNER_SHARE)
        new = _orthonormal(np.hstack([correction, left]) if correction.any() else left, locked, space)[:, : carried]
        if not new.shape[1]:
            new = _orthonormal(np.random.default_rng(len(values) + 1).normal(size=(width, carried)), locked, space)
        new = new[:, : width - locked.shape[1] - space.shape[1]]
        space, image = np.hstack([space, new]), np.hstack([image, product(new)])
    raise ArithmeticError(f"eigenvectors did not reach double precision in {OUTER_STEPS} steps")


def whitened(
    df: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE
) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error`` per row and component.

    ``n``: distinct vectors; ``deviation``: squared length of n * x - sum, exact; ``explained``:
    the component's share of the variance; ``identity_error``: largest entry of the whitened
    covariance minus the identity.
    """
    small_batches(df.sparkSession)
    plain = df.select(F.col(id).cast("long").alias("id"), whole_components(F.col(vector), scale).alias("x")).where("x is not null")
    held = settle(plain)
    width = held.agg(F.max(F.size("x"))).first()[0] or 0
    filled = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x")))
    held = held.select("id", F.when(F.size("x") == width, F.col("x")).otherwise(filled).alias("x"))
    fit = settle(held.select("x").distinct())
    n = fit.count()
    nothing = small_table(
        df.sparkSession, [], f"`{id}` bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    )
    if not n or not width:
        return nothing
    sums = _added_up(fit, width, lambda x: x.sum(axis=0), width, whole=True)
    mean = sums / n

    def product(block: np.ndarray) -> np.ndarray:
        def work(x: np.ndarray) -> np.ndarray:
            x = x - mean
            return x.T @ (x @ block)

        return _added_up(fit, width, work, block.size).reshape(block.shape) / n

    variance = _added_up(fit, width, lambda x: ((x - mean) ** 2).sum(axis=0), width).sum() / n
    if not variance:
        return nothing
    values, vectors = leading_pairs(product, width, components)
    some = values > 64 * EPSILON * width * max(values[0], 0.0)
    values, vectors = values[some], vectors[:, some]
    k = len(values)
    factors = vectors / np.sqrt(values)

    def spread(x: np.ndarray) -> np.ndarray:
        y = (x - mean) @ factors
        return np.vstack([y.T @ y, y.sum(axis=0)])

    total = _added_up(fit, width, spread, (k + 1) * k).reshape(k + 1, k) / n
    error = float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("x"), width)
            columns = [
                pa.array(np.repeat(b.column("id").to_numpy(zero_copy_only=False), k), pa.int64(), from_pandas=True),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array([d for d in _deviations(x, n, sums) for _ in range(k)], pa.int64()),
                pa.array(((x - mean) @ factors).reshape(-1)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=ROWS.fieldNames())

    shares = F.array(*[F.lit(float(v / variance)) for v in values])
    return held.mapInArrow(project, ROWS).select(
        F.col("id").alias(id),
        "component",
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        shares[F.col("component") - 1].alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Exact squared lengths of n * x - sums."""
    largest = max(abs(int(x.max())), abs(int(x.min()))) * n + int(np.abs(sums).max())
    if largest * largest * x.shape[1] < 2**63:
        return ((n * x - sums) ** 2).sum(axis=1).tolist()
    wide = (n * x.astype(object) - sums.astype(object)) ** 2
    return [d if d < 2**63 else None for d in wide.sum(axis=1).tolist()]

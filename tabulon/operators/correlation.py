"""Pearson correlation of every pair of columns, added up in tiles.

Columns are cut into tiles.  A task adds up only the tiles of one pair of panels (a few
tiles each), so its memory depends on neither the rows nor the width of the table, and
every pair of panels reads no other columns.  Partial sums are rows ``(tile, tile, part)``
that are merged ``FAN_IN`` at a time, and the coefficients come out as a table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions.coercion import as_number, quoted
from tabulon.session import settle, small_table

FAN_IN = 16
TILE = 128
"""Columns of a tile: its sums against another tile take 6 * TILE^2 doubles, under 1 MB."""

PANEL_TILES = 8
"""Tiles of a panel: a task holds the sums of at most PANEL_TILES^2 pairs of tiles, about 50 MB."""

CHUNK_CELLS = 1 << 20
ROUNDING = 1e-10

PAIRS = "i int, j int, col1 string, col2 string, correlation double"
_SUMS = "a int, b int, part long, sums binary"


class _Sums:
    """n, x, y, x^2, y^2 and xy over pairwise-complete rows, for a tile of x columns and one of y columns.

    Values are counted from an origin per column, the mean of the first values met, so that
    columns far from zero lose no digits; NaN until a value is met.
    """

    def __init__(self, left: np.ndarray, right: np.ndarray, totals: np.ndarray):
        self.left, self.right, self.totals = left, right, totals

    def packed(self) -> bytes:
        shape = np.array(self.totals.shape[1:], dtype=float)
        return np.concatenate([shape, self.left, self.right, self.totals.ravel()]).tobytes()

    @staticmethod
    def unpacked(data: bytes) -> _Sums:
        flat = np.frombuffer(data)
        p, q = int(flat[0]), int(flat[1])
        return _Sums(flat[2 : 2 + p], flat[2 + p : 2 + p + q], flat[2 + p + q :].reshape(6, p, q))

    def moved(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The sums counted from other origins."""
        n, x, y, xx, yy, xy = self.totals
        dx = np.nan_to_num(self.left - left)[:, None]  # nothing is moved where one side has met no value
        dy = np.nan_to_num(self.right - right)[None, :]
        return np.stack(
            [n, x + n * dx, y + n * dy, xx + 2 * dx * x + n * dx * dx, yy + 2 * dy * y + n * dy * dy, xy + dx * y + dy * x + n * dx * dy]
        )

    def plus(self, other: _Sums) -> _Sums:
        left = np.where(np.isnan(self.left), other.left, self.left)
        right = np.where(np.isnan(self.right), other.right, self.right)
        return _Sums(left, right, self.moved(left, right) + other.moved(left, right))

    def coefficients(self) -> np.ndarray:
        """Null (NaN) where a side is constant."""
        n, x, y, xx, yy, xy = self.totals

        def spread(squares: np.ndarray, plain: np.ndarray) -> np.ndarray:
            """n^2 times the variance, 0 where it is rounding noise of a constant."""
            found = n * squares - plain * plain
            return np.where(found > ROUNDING * n * squares, found, 0.0)

        both = np.sqrt(spread(xx, x)) * np.sqrt(spread(yy, y))
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(both > 0, np.clip((n * xy - x * y) / both, -1.0, 1.0), np.nan)


def _adder(spans: Sequence[tuple[int, int]], pairs: Sequence[tuple[int, int]], width: int):
    """Adds up the pairs of tiles of one pair of panels; ``spans`` are the places of each tile in a row."""
    held_spans, wanted = dict(spans), list(pairs)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        origin = np.full(width, np.nan)
        totals = {
            (a, b): np.zeros((6, held_spans[a][1] - held_spans[a][0], held_spans[b][1] - held_spans[b][0])) for a, b in wanted
        }
        step = max(CHUNK_CELLS // width, 1)
        for batch in batches:
            flat = batch.column(0).flatten()
            for start in range(0, batch.num_rows, step):
                rows = min(step, batch.num_rows - start)
                x = flat.slice(start * width, rows * width).to_numpy(zero_copy_only=False).reshape(rows, width).copy()
                held = np.isfinite(x)
                x[~held] = 0.0
                counts = held.sum(axis=0)
                fresh = np.isnan(origin) & (counts > 0)
                origin[fresh] = x[:, fresh].sum(axis=0) / counts[fresh]
                x = np.where(held, x - np.nan_to_num(origin), 0.0)
                seen, squares = held.astype(float), x * x
                for (a, b), total in totals.items():
                    p, q = slice(*held_spans[a]), slice(*held_spans[b])
                    total[0] += seen[:, p].T @ seen[:, q]
                    total[1] += x[:, p].T @ seen[:, q]
                    total[2] += seen[:, p].T @ x[:, q]
                    total[3] += squares[:, p].T @ seen[:, q]
                    total[4] += seen[:, p].T @ squares[:, q]
                    total[5] += x[:, p].T @ x[:, q]
        part = TaskContext.get().partitionId()
        for (a, b), total in totals.items():  # one pair a batch, so that no batch holds more
            packed = _Sums(origin[slice(*held_spans[a])], origin[slice(*held_spans[b])], total).packed()
            yield pa.RecordBatch.from_arrays(
                [pa.array([a], pa.int32()), pa.array([b], pa.int32()), pa.array([part], pa.int64()), pa.array([packed], pa.binary())],
                names=["a", "b", "part", "sums"],
            )

    return add_up


def _merge(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
    held = parts.sort_values("part", kind="stable")["sums"]
    total = _Sums.unpacked(held.iloc[0])
    for data in held.iloc[1:]:
        total = total.plus(_Sums.unpacked(data))
    return pd.DataFrame({"a": [key[0]], "b": [key[1]], "part": [key[2]], "sums": [total.packed()]})


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every column pair i < j over pairwise-complete rows; null for a constant side.

    Infinite values count as missing.  The table is written out, so that reading it
    again adds nothing up again; its n * (n - 1) / 2 rows never pass the driver.
    """
    names = list(columns)
    if len(names) < 2:
        return small_table(df.sparkSession, [], PAIRS)
    tile, fan = TILE, FAN_IN
    tiles = range(-(-len(names) // tile))
    panels = [tiles[k : k + PANEL_TILES] for k in range(0, len(tiles), PANEL_TILES)]
    kinds = {f.name: f.dataType for f in df.schema.fields}
    values = df.select(*[as_number(quoted(c), kinds[c]).alias(f"x{k}") for k, c in enumerate(names)])
    added = None
    for k, left in enumerate(panels):
        for right in panels[k:]:
            used = sorted({*left, *right})
            places = [c for t in used for c in range(t * tile, min((t + 1) * tile, len(names)))]
            first = {t: places.index(t * tile) for t in used}
            spans = [(t, (first[t], first[t] + min(tile, len(names) - t * tile))) for t in used]
            pairs = [(a, b) for a in left for b in right if a <= b]
            cells = values.select(F.expr(f"array({', '.join(f'x{c}' for c in places)})").alias("cells"))
            sums = cells.mapInArrow(_adder(spans, pairs, len(places)), _SUMS)
            added = sums if added is None else added.unionByName(sums)
    sums = settle(added)  # the parts stay as they were written, however later jobs are planned
    parts = (sums.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        sums = sums.groupBy("a", "b", F.expr(f"part div {fan}").alias("part")).applyInPandas(_merge, _SUMS)
        parts = -(-parts // fan)

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b, data in zip(batch["a"], batch["b"], batch["sums"]):
                found = _Sums.unpacked(data).coefficients()
                p, q = np.indices(found.shape).reshape(2, -1)
                i, j = p + a * tile, q + b * tile
                upper = i < j
                if not upper.any():
                    continue
                i, j, r = i[upper], j[upper], found.ravel()[upper]
                held = pd.Series(r, dtype=object).where(~np.isnan(r), None)
                yield pd.DataFrame(
                    {"i": i, "j": j, "col1": [names[c] for c in i], "col2": [names[c] for c in j], "correlation": held}
                )

    return settle(sums.select("a", "b", "sums").mapInPandas(spell, PAIRS))


def correlation_matrix(df: DataFrame, columns: Sequence[str], upper: DataFrame | None = None) -> DataFrame:
    """The full matrix in long form, both triangles and the diagonal; ``upper`` reuses pairs found before."""
    names = list(columns)
    pairs = correlations(df, names) if upper is None else upper
    mirrored = pairs.select(
        F.col("j").alias("i"), F.col("i").alias("j"),
        F.col("col2").alias("col1"), F.col("col1").alias("col2"), "correlation",
    )
    diagonal = small_table(
        df.sparkSession, [(k, k, c, c, 1.0) for k, c in enumerate(names)] if len(names) > 1 else [], PAIRS
    )
    return pairs.unionByName(mirrored).unionByName(diagonal)

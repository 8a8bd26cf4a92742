"""Boosted trees from first and second derivatives, on histograms.

Features are cut into bins once and packed into blocks of rows, which stay cached.  One job
looks at one level of a round: every task adds up the gradients, Hessians and counts of its
rows by node, feature and bin, for all classes and all folds at once; the sums meet by fold and
class, where the best cuts are found, and only those come to the driver.  So several classes, or
the models of a cross-validation, cost the jobs of one model, and the driver holds trees and
bin borders but no rows.  The scores follow each round; every few rounds the blocks are
checkpointed, which cuts the lineage.  Features of few bins are counted together, and their sums
taken apart afterwards.

A table whose blocks fit one task needs nobody else's sums: there is a task per model, and of two
children only the one with fewer rows is added up, the other is what its parent has besides.

Trees grow by level, by best leaf, or evenly, with the same cut in all nodes of a level.
Best-leaf growth looks ahead: the leaves that may be cut next are all examined in one job,
and what then turns out to be worse is dropped, so a tree takes as many jobs as it is deep.

Defined results: of equal cuts the one on the first feature and the lowest border is taken;
a feature without two values is never cut; without any cut a tree is one leaf.  A class that
a fold does not hold has probability near zero there.
"""

from __future__ import annotations

import base64
import heapq
import io
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml import Estimator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.operators.stages import FittedColumns
from tabulon.session import settle, shared_dir, small_table

LEVEL, LEAF, EVEN = "level", "leaf", "even"
REGRESSION, BINARY, SEVERAL = "regression", "binary", "several"

WRITE_ROUNDS = 20
CHUNK_FEATURES = 512
BLOCK_CELLS = 4_000_000
"""Rows times features of a block; a byte each, and eight while a task looks at a level."""

WHOLE_BYTES = 95
"""A table that takes up to so many bytes per cell of a block (380 MB) is grown by one task per model; above that every level is a job."""

JOINT_BINS = 256
JOINT_BINS_OF_MANY, MANY_ROWS = 4_096, 200_000
"""Features are counted together while the product of their numbers of bins stays below; more of them where rows are many."""

MOST_COUNTS, MOST_PASSES = 1_000_000, 24
"""Trees grow from counts of rows by cell while there are no more of these, after so many passes and one for each round."""

DERIVED_AT_ONCE = 16_384
TABLE_CELLS = 4_096
"""Models whose borders make no more cells are scored by a table of all answers."""

BATCH_ROWS = 65_536
"""Rows of small nodes that are counted together, by node and bin."""

SMALLEST = 1e-16
ROUNDING = 1e-9
"""Gains so close to the best count as equal to it, in whatever order they were added up; no gain is one below that share of its parts."""

_BLOCK = "labels binary, folds binary, bins binary, scores binary"
_TREES = "fold int, class int, turn int, " + ", ".join(f"{n} binary" for n in ("feature", "bin", "left", "right", "value", "gain"))
_CUTS = (
    "fold int, class int, node int, gain double, feature int, bin int, left_g double, left_h double, left_n double, "
    "right_g double, right_h double, right_n double"
)


_CUT_NAMES = [f.split()[0] for f in _CUTS.split(", ")][3:]
_ARRAYS = {"feature": np.int32, "bin": np.int32, "left": np.int32, "right": np.int32, "value": np.float64, "gain": np.float64}


@dataclass(frozen=True)
class Growth:
    """How trees grow and weigh.  ``ridge`` is added to a leaf's Hessian, ``step`` scales its value."""

    rounds: int = 100
    step: float = 0.1
    kind: str = LEVEL
    depth: int = 6
    leaves: int = 31
    ridge: float = 1.0
    least_hessian: float = 1e-3
    least_rows: int = 1
    bins: int = 64
    """At most 255."""


@dataclass
class Tree:
    """Nodes as parallel lists; ``left`` is -1 where a node has no children."""

    growth: Growth
    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    sums: list[tuple[float, float, float]] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    cut: list[dict | None] = field(default_factory=list)

    def __post_init__(self):
        self._node((0.0, 0.0, 0.0), 0)

    def _node(self, sums: tuple[float, float, float], depth: int) -> int:
        for column, value in zip(
            (self.feature, self.bin, self.left, self.right, self.sums, self.gain, self.depth, self.cut),
            (-1, -1, -1, -1, sums, 0.0, depth, None),
        ):
            column.append(value)
        return len(self.feature) - 1

    def learn(self, node: int, cut: dict) -> None:
        self.cut[node] = cut
        self.gain[node] = cut["gain"]
        if node == 0:
            self.sums[0] = tuple(cut[f"left_{k}"] + cut[f"right_{k}"] for k in "ghn")

    def _expand(self, node: int) -> list[int]:
        c = self.cut[node]
        self.feature[node], self.bin[node] = c["feature"], c["bin"]
        pair = [self._node(tuple(c[f"{side}_{k}"] for k in "ghn"), self.depth[node] + 1) for side in ("left", "right")]
        self.left[node], self.right[node] = pair
        return pair

    def _best_first(self) -> tuple[list[int], list[int]]:
        """Nodes cut in the order of their gains, and those that come next but have no children yet."""
        taken: list[int] = []
        open_ = [(-self.gain[0], 0)]
        while open_ and len(taken) < self.growth.leaves - 1:
            gain, node = open_[0]
            if gain >= 0:
                break
            if self.left[node] < 0:
                ahead = [n for g, n in heapq.nsmallest(self.growth.leaves - 1 - len(taken), open_) if g < 0 and self.left[n] < 0]
                return taken, ahead
            heapq.heappop(open_)
            taken.append(node)
            for child in (self.left[node], self.right[node]):
                heapq.heappush(open_, (-self.gain[child], child))
        return taken, []

    def wanted(self) -> list[int]:
        """Expand what is known; nodes whose cut has to be found next."""
        if self.cut[0] is None:
            return [0]
        if self.growth.kind == LEAF:
            return [c for n in self._best_first()[1] for c in self._expand(n)]
        ready = [n for n in range(len(self.cut)) if self.cut[n] is not None and self.left[n] < 0 and self.gain[n] > 0]
        new = [c for n in ready if self.depth[n] < self.growth.depth for c in self._expand(n)]
        return [c for c in new if self.depth[c] < self.growth.depth]

    def finish(self) -> dict[str, np.ndarray]:
        """Arrays of the finished tree; leaf values hold the step."""
        if self.growth.kind == LEAF:
            taken = set(self._best_first()[0])
            for n in range(len(self.feature)):
                if n not in taken:
                    self.left[n] = self.right[n] = self.feature[n] = -1
        g, h, _ = np.array(self.sums).T
        value = np.where(h + self.growth.ridge > 0, -self.growth.step * g / np.maximum(h + self.growth.ridge, SMALLEST), 0.0)
        return {
            "feature": np.array(self.feature, np.int32),
            "bin": np.array(self.bin, np.int32),
            "left": np.array(self.left, np.int32),
            "right": np.array(self.right, np.int32),
            "value": value,
            "gain": np.array(self.gain),
        }

    def shape(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(x, np.int32) for x in (self.feature, self.bin, self.left, self.right))


def _route(shape: Sequence[np.ndarray], cells: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Node that each row ends in; ``cells`` has one line per feature."""
    feature, _, left, right = shape
    at = np.zeros(cells.shape[1], np.int32)
    rows = np.arange(cells.shape[1])
    while True:
        inner = left[at] >= 0
        if not inner.any():
            return at
        below = cells[np.maximum(feature[at], 0), rows] <= borders[at]
        at = np.where(inner, np.where(below, left[at], right[at]), at)


def _derivatives(kind: str, scores: np.ndarray, labels: np.ndarray, into: Sequence[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and Hessians, a line per class; several classes' are put ``into`` given arrays."""
    if kind == REGRESSION:
        return scores - labels, np.ones_like(scores)
    if kind == BINARY:
        p = 1 / (1 + np.exp(-scores))
        return p - labels, np.maximum(p * (1 - p), SMALLEST)
    g, h = into or (np.empty(scores.shape), np.empty(scores.shape))
    k, classes = len(scores), np.arange(len(scores))[:, None]
    for first in range(0, scores.shape[1], DERIVED_AT_ONCE):  # what several steps need stays in the cache
        some = slice(first, first + DERIVED_AT_ONCE)
        p = probabilities(scores[:, some])
        np.subtract(p, classes == labels[some], out=g[:, some])
        np.maximum(p * (1 - p) * (k / (k - 1)), SMALLEST, out=h[:, some])
    return g, h


def probabilities(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=0))
    return e / e.sum(axis=0)


def _counted(kind: str, growth: Growth) -> bool:
    """Whether rows are counted beside gradients and Hessians; a side with a Hessian has a row."""
    return kind == REGRESSION or growth.least_rows > 1 or growth.least_hessian <= ROUNDING


def best_cuts(sums: np.ndarray, growth: Growth, first: int = 0, counted: bool = True) -> list[tuple]:
    """Best cut of each node from sums by node, feature, bin and kind (gradient, Hessian, rows)."""
    left = np.cumsum(sums, axis=2)
    total = left[:, :1, -1:, :]
    right = total - left

    def worth(s: np.ndarray) -> np.ndarray:
        return s[..., 0] ** 2 / np.maximum(s[..., 1] + growth.ridge, SMALLEST)

    gain = worth(left) + worth(right) - worth(total)
    fine = np.ones(gain.shape, bool)
    for side in (left, right):
        fine &= side[..., 1] >= growth.least_hessian
        if counted:
            fine &= side[..., 2] >= max(growth.least_rows, 1)
    gain = np.where(fine, gain, 0.0 if growth.kind == EVEN else -np.inf)
    scale = worth(total).reshape(len(gain))
    if growth.kind == EVEN:
        gain = np.broadcast_to(gain.sum(axis=0, keepdims=True), gain.shape)
        scale = np.broadcast_to(scale.sum(), scale.shape)
    flat = gain.reshape(len(gain), -1)
    most = flat.max(axis=1, keepdims=True)
    at = (flat >= most - ROUNDING * (1 + np.abs(np.where(np.isfinite(most), most, 0.0)))).argmax(axis=1)
    out = []
    for node, best in enumerate(at):
        f, b = divmod(int(best), gain.shape[2])
        found = float(flat[node, best])
        out.append((found if found > max(1e-12, ROUNDING * scale[node]) else 0.0, first + f, b, *left[node, f, b].tolist(), *right[node, f, b].tolist()))
    return out


def _unpack(block: dict, width: int, scores: int) -> tuple[np.ndarray, ...]:
    labels = np.frombuffer(block["labels"], np.float64)
    n = len(labels)
    return (
        labels,
        np.frombuffer(block["folds"], np.int8),
        np.frombuffer(block["bins"], np.uint8).reshape(width, n),
        np.frombuffer(block["scores"], np.float64).reshape(scores, n),
    )


def _parts(blocks: pa.RecordBatch, row: int) -> dict:
    """A packed block, without a copy."""
    return {n: blocks.column(n)[row].as_buffer() for n in ("labels", "folds", "bins", "scores")}


def _keys_apart(spark: SparkSession, many: int) -> list[int]:
    """A key for each of so many partitions."""
    keys = small_table(spark, [(k,) for k in range(64 * many)], "key int")
    found = {r["place"]: r["key"] for r in keys.select("key", F.pmod(F.hash("key"), F.lit(many)).alias("place")).collect()}
    return [found[k] for k in sorted(found)]


class Booster(Estimator):
    """Trees for a number (0 classes), two classes or several."""

    def __init__(self, growth: Growth, classes: int = 0):
        super().__init__()
        self.growth, self.classes = growth, classes
        self.kind = REGRESSION if classes < 2 else BINARY if classes == 2 else SEVERAL
        self.lines = classes if classes > 2 else 1

    def _fit(self, df: DataFrame) -> FittedBooster:
        return self.fit_folds(df, 0)[0]

    def fit_folds(self, df: DataFrame, folds: int) -> list[FittedBooster]:
        """A model of the rows outside of each fold (column ``fold``), and one of all rows."""
        held = df.select(
            F.col("label").cast("double").alias("label"),
            (F.col("fold") if folds else F.lit(0)).cast("int").alias("fold"),
            vector_to_array("features").alias("x"),
        )
        borders = self._borders(held)
        rows, base = self._base(held, folds)
        width = max(len(borders), 1)
        packed, done = self._blocks(held, borders, [np.zeros(0)]), None
        if self.kind != REGRESSION and rows >= MANY_ROWS:
            packed = settle(packed)
            done = _Cells(self, packed, base, folds, borders).grown()
        if done is None and rows * (24 * self.lines + 36 + width) <= WHOLE_BYTES * BLOCK_CELLS:
            done = self._in_one_block(packed, base, folds, borders)
        elif done is None:
            done = self._level_by_level(self._blocks(held, borders, base), folds, len(base), borders)
        return [FittedBooster.made(self.kind, start, line, borders) for start, line in zip(base, done)]

    def _level_by_level(self, blocks: DataFrame, folds: int, models: int, borders: list[np.ndarray]) -> list:
        width, lines = len(borders), self.lines
        layouts = _layouts(borders, CHUNK_FEATURES)
        shared_dir(blocks.sparkSession)  # names the folder of checkpoints
        state = settle(blocks).rdd.map(lambda b: _coded(b, width, models * lines, layouts)).persist(StorageLevel.MEMORY_AND_DISK)
        before: list[RDD] = []
        done: list[list[list[dict]]] = [[[] for _ in range(lines)] for _ in range(models)]
        for turn in range(self.growth.rounds):
            trees = [[Tree(self.growth) for _ in range(lines)] for _ in done]
            while True:
                asked = {(f, c): w for f, line in enumerate(trees) for c, t in enumerate(line) if (w := t.wanted())}
                if not asked:
                    break
                shapes = {k: trees[k[0]][k[1]].shape() for k in asked}
                for f, c, node, cut in self._level(state, folds, shapes, asked, layouts).collect():  # the best cuts alone
                    known = trees[f][c]
                    other = known.cut[node]
                    # of several chunks of features the best, and of equal ones the first
                    if other is None or (cut["gain"], -cut["feature"]) > (other["gain"], -other["feature"]):
                        known.learn(node, cut)
            last = [[t.finish() for t in line] for line in trees]
            for line, grown in zip(done, last):
                for finished, t in zip(line, grown):
                    finished.append(t)
            if turn + 1 < self.growth.rounds:
                for old in before:  # what the present blocks were made of is in use until they are there
                    old.unpersist()
                before = [state]
                state = state.map(_follow(last)).persist(StorageLevel.MEMORY_AND_DISK)
                if (turn + 1) % WRITE_ROUNDS == 0:
                    state.checkpoint()
        for old in [*before, state]:
            old.unpersist()
        return done

    def _in_one_block(self, blocks: DataFrame, base: list[np.ndarray], folds: int, borders: list[np.ndarray]) -> list:
        """All rounds of each model in a task of its own, which reads all blocks; its scores begin there."""
        kind, growth, width, models = self.kind, self.growth, len(borders), len(base)

        def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            met: dict[int, list] = {}
            for b in batches:
                for row in range(b.num_rows):
                    f = b.column("model")[row].as_py()
                    labels, of, bins, _ = _unpack(_parts(b, row), width, 0)
                    inside = of != f if folds else np.ones(len(of), bool)  # nothing else has a part in the model
                    met.setdefault(f, []).append((b.column("place")[row].as_py(), labels[inside], bins[:, inside]))
            while met:
                f, held = met.popitem()
                held.sort(key=lambda x: x[0])
                labels, cells = np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held], axis=1)
                del held
                part = _Rows(labels, np.full(len(labels), -1, np.int8), cells, np.repeat(base[f][:, None], len(labels), axis=1), borders)
                yield _rows([t for turn in range(growth.rounds) for t in part.turn(turn, f, folds, kind, growth)], _TREES)

        placed = blocks.withColumn("place", F.monotonically_increasing_id())
        each = placed.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(models - 1))))
        apart = F.array(*[F.lit(k) for k in _keys_apart(blocks.sparkSession, models)])[F.col("model")]
        return self._gathered(each.repartition(models, apart).mapInArrow(grow, _TREES), models)

    def _gathered(self, grown: DataFrame, models: int) -> list:
        done: list[list[list[dict]]] = [[[] for _ in range(self.lines)] for _ in range(models)]
        for r in sorted(grown.collect(), key=lambda r: r["turn"]):  # the trees of the models
            done[r["fold"]][r["class"]].append({n: np.frombuffer(r[n], k) for n, k in _ARRAYS.items()})
        return done

    def _borders(self, held: DataFrame) -> list[np.ndarray]:
        """Upper borders of all but the last bin of each feature."""
        shares = [k / self.growth.bins for k in range(1, self.growth.bins)]
        found = (
            held.select(F.posexplode("x").alias("place", "value"))
            .groupBy("place")
            .agg(F.percentile_approx("value", shares, 10_000).alias("marks"), F.max("value").alias("most"))
            .collect()  # one row per feature
        )
        out = [np.zeros(0)] * (max((r["place"] for r in found), default=-1) + 1)
        for r in found:
            marks = np.unique(np.array(r["marks"], float))
            out[r["place"]] = marks[marks < r["most"]]
        return out

    def _base(self, held: DataFrame, folds: int) -> tuple[int, list[np.ndarray]]:
        """Number of rows, and scores before the first tree, by model and class."""
        if self.kind == REGRESSION:
            parts = held.groupBy("fold").agg(F.count("label").alias("n"), F.sum("label").alias("s")).collect()
            out = []
            for f in [*range(folds), None]:
                n = sum(r["n"] for r in parts if r["fold"] != f)
                out.append(np.array([sum(r["s"] for r in parts if r["fold"] != f) / max(n, 1)]))
            return sum(r["n"] for r in parts), out
        parts = held.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")).collect()  # folds times classes
        out = []
        for f in [*range(folds), None]:
            n = np.zeros(self.classes)
            for r in parts:
                if r["fold"] != f:
                    n[int(r["label"])] += r["n"]
            p = np.maximum(n, 1e-9) / max(n.sum(), 1)
            out.append(np.array([np.log(p[1] / p[0])]) if self.kind == BINARY else np.log(p))
        return sum(r["n"] for r in parts), out

    def _blocks(self, held: DataFrame, borders: list[np.ndarray], base: list[np.ndarray], most: float = 0) -> DataFrame:
        """Packed blocks of ``most`` rows, by default of BLOCK_CELLS."""
        width, start = len(borders), np.concatenate(base)
        most = most or math.ceil(BLOCK_CELLS / max(width, 1))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, rows = [], 0
            for b in batches:
                if b.num_rows:
                    held.append(b)
                    rows += b.num_rows
                if rows >= most:
                    yield block(pa.Table.from_batches(held).combine_chunks())
                    held, rows = [], 0
            if rows:
                yield block(pa.Table.from_batches(held).combine_chunks())

        def block(t: pa.Table) -> pa.RecordBatch:
            x = t.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            bins = np.array([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(borders)], np.uint8).reshape(width, -1)
            scores = np.repeat(start[:, None], t.num_rows, axis=1)
            packed = (t.column("label").to_numpy(), t.column("fold").to_numpy().astype(np.int8), bins, scores)
            return pa.RecordBatch.from_arrays(
                [pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for p in packed], names=["labels", "folds", "bins", "scores"]
            )

        return held.mapInArrow(pack, _BLOCK)

    def _level(self, state: RDD, folds: int, shapes: dict, asked: dict, layouts: list[_Layout]) -> RDD:
        """The best cut of every asked node."""
        kind, growth, lines = self.kind, self.growth, self.lines
        counted = _counted(kind, growth)

        def sums(blocks: Iterator[tuple]) -> Iterator[tuple]:
            total: dict[tuple, np.ndarray] = {}
            for labels, of, cells, codes, scores in blocks:
                for f in sorted({f for f, _ in asked}):
                    inside = np.flatnonzero(of != f) if f < folds else np.arange(len(labels))
                    g, h = _derivatives(kind, scores[f * lines : (f + 1) * lines], labels)
                    for c in range(lines):
                        if (f, c) not in asked:
                            continue
                        rows = _dealt(shapes[f, c], cells, inside)
                        nodes = [rows[n] for n in asked[f, c]]
                        for k, layout in enumerate(layouts):
                            found = layout.sums(codes[k], nodes, g[c], None if kind == REGRESSION else h[c], counted)
                            key = (f, c, k)
                            total[key] = total[key] + found if key in total else found
            yield from total.items()

        def cuts(met: tuple) -> list[tuple]:
            (f, c, k), total = met
            return [(f, c, n, cut) for n, cut in zip(asked[f, c], layouts[k].cuts(total, growth, counted))]

        places = max(min(len(asked) * len(layouts), state.getNumPartitions()), 1)
        return state.mapPartitions(sums).reduceByKey(np.add, places).flatMap(cuts)


def _coded(block, width: int, scores: int, layouts: list[_Layout]) -> tuple:
    """A packed block as arrays, with the joint bins of each chunk of features."""
    labels, of, cells, held = _unpack(block, width, scores)
    return labels, of, cells, [x.codes(cells) for x in layouts], held


def _follow(last: list) -> Callable[[tuple], tuple]:
    """Blocks whose scores hold the last trees, too."""

    def work(block: tuple) -> tuple:
        labels, of, cells, codes, scores = block
        scores, lines = scores.copy(), len(last[0])
        everyone = np.arange(len(labels))
        for f, line in enumerate(last):
            for c, t in enumerate(line):
                for n, rows in _dealt((t["feature"], t["bin"], t["left"], t["right"]), cells, everyone).items():
                    if t["left"][n] < 0:
                        scores[f * lines + c, rows] += t["value"][n]
        return labels, of, cells, codes, scores

    return work


def _dealt(shape: Sequence[np.ndarray], cells: np.ndarray, inside: np.ndarray) -> dict[int, np.ndarray]:
    """The rows in each node without children."""
    feature, cut, left, right = shape
    rows, open_ = {}, [(0, inside)]
    while open_:
        n, held = open_.pop()
        if left[n] < 0:
            rows[n] = held
        else:
            below, above = _parted(held, cells[feature[n]], cut[n])
            open_ += [(int(left[n]), below), (int(right[n]), above)]
    return rows


def _parted(held: np.ndarray, cells: np.ndarray, cut: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows up to a cut, and those above."""
    below = cells.take(held) <= cut  # a mask of rows in no order is slow to index by, places are not
    return held.take(np.flatnonzero(below)), held.take(np.flatnonzero(~below))


class _Layout:
    """How some features are counted: together while they have few bins, and where their sums then stand."""

    def __init__(self, used: Sequence[int], sizes: np.ndarray, most: int):
        self.used, self.size, self.bundles, self.apart = list(used), 0, [], []
        for k in sorted(self.used, key=lambda k: -sizes[k]):
            fitting = next((b for b in self.bundles if math.prod(sizes[b].tolist()) * sizes[k] <= most), None)
            if fitting is None:
                self.bundles.append([k])
            else:
                fitting.append(k)
        self.sizes, self.starts = sizes, {}
        starts = self.starts
        for b in self.bundles:
            joint = math.prod(sizes[b].tolist())
            if joint <= JOINT_BINS:
                digits = np.unravel_index(np.arange(joint), sizes[b])
                #: a line for each bin of the features, with ones at the joint bins it is made of
                self.apart.append(np.concatenate([np.arange(sizes[k])[:, None] == d for k, d in zip(b, digits)]).astype(float))
            else:
                self.apart.append(None)
            for k in b:
                starts[k] = self.size
                self.size += int(sizes[k])
        places = np.arange(max((sizes[k] for k in self.used), default=1))
        self.dense = np.array([np.where(places < sizes[k], starts[k] + places, self.size) for k in self.used], int).reshape(-1, len(places))

    def codes(self, cells: np.ndarray) -> list[np.ndarray]:
        """The joint bin of each row, by bundle."""
        out = []
        for b in self.bundles:
            code = cells[b[0]].astype(np.intp)
            for k in b[1:]:
                code = code * self.sizes[k] + cells[k]
            out.append(code.astype(np.uint8 if math.prod(self.sizes[b].tolist()) <= 256 else np.uint16))
        return out

    def sums(self, codes: list[np.ndarray], nodes: list[np.ndarray], g: np.ndarray, h: np.ndarray | None, counted: bool) -> np.ndarray:
        """Sums by node, kind (gradient, unless it is one Hessian, unless implied rows) and bin of a feature."""
        parts = [np.zeros((0, 1 + (h is not None) + counted, self.size))]
        for some in _batches(nodes):
            if len(some) == 1:
                held, place = None if len(some[0]) == len(g) else some[0], None
            else:
                held, place = np.concatenate(some), np.repeat(np.arange(len(some)), [len(x) for x in some])
            parts.append(self.placed_sums(codes, held, place, len(some), g, h, counted))
        return np.concatenate(parts)

    def placed_sums(
        self, codes: list[np.ndarray], held: np.ndarray | None, place: np.ndarray | None, nodes: int, g: np.ndarray, h: np.ndarray | None, counted: bool
    ) -> np.ndarray:
        """The same of some rows, or all, by the place of each one's node; of one node no places are needed."""
        weights = [w if held is None or w is None else w.take(held) for w in ([g] if h is None else [g, h]) + [None] * counted]
        out = [np.zeros((nodes, len(weights), 0))]
        for k, code in enumerate(codes):
            found = (code if held is None else code.take(held)).astype(np.intp)
            size = math.prod(self.sizes[self.bundles[k]].tolist())
            if place is not None:
                found += place * np.intp(size)
            joint = [np.bincount(found, w, nodes * size).reshape(nodes, size) for w in weights]
            out.append(self._taken_apart(k, np.stack(joint, axis=1).astype(float, copy=False)))
        return np.concatenate(out, axis=2)

    def _taken_apart(self, place: int, joint: np.ndarray) -> np.ndarray:
        """Sums by bin of each feature of a bundle, from those by joint bin."""
        if self.apart[place] is not None:
            return joint @ self.apart[place].T
        sizes = self.sizes[self.bundles[place]].tolist()
        wide = joint.reshape(*joint.shape[:2], *sizes)
        return np.concatenate([wide.sum(axis=tuple(j + 2 for j in range(len(sizes)) if j != k)) for k in range(len(sizes))], axis=2)

    def cuts(self, total: np.ndarray, growth: Growth, counted: bool) -> list[dict]:
        """The best cut of each node."""
        if not self.used:
            return [dict(zip(_CUT_NAMES, (0.0, 0, 0, *[0.0] * 6))) for _ in total]
        flat = np.concatenate([total, np.zeros((*total.shape[:2], 1))], axis=2)[:, :, self.dense]
        order = (0, 1, 1) if flat.shape[1] == 2 else (0, 1, 2)
        out = [dict(zip(_CUT_NAMES, cut)) for cut in best_cuts(np.stack([flat[:, k] for k in order], axis=3), growth, counted=counted)]
        for cut in out:
            cut["feature"] = int(self.used[cut["feature"]])
        return out


class _Cells:
    """Trees from the counts of rows that no cut has told apart yet.

    Such rows have one score, so numbers of them by cell, class, fold, feature and bin hold all
    that a round needs, and a pass over the rows is made only for cuts that are new.  Where a few
    borders decide the classes, these are few passes; where cuts make more cells than the driver
    should hold, nothing comes of it and the trees grow from rows.
    """

    def __init__(self, booster: Booster, blocks: DataFrame, base: list[np.ndarray], folds: int, borders: list[np.ndarray]):
        self.booster, self.blocks, self.folds, self.borders = booster, blocks, folds, borders
        [self.layout] = _layouts(borders, max(len(borders), 1), 0)  # every feature by itself
        self.marks = [np.zeros(0, np.int64) for _ in borders]
        self.classes, self.parts = booster.classes, max(folds, 1)
        self.passes, self.counts = 0, []
        self.bins = np.zeros((len(borders), 1), np.int64)
        self.scores = [start[:, None].copy() for start in base]

    def grown(self) -> list[list[list[dict]]] | None:
        """The trees of all models and classes, None if there are too many cells."""
        booster, growth = self.booster, self.booster.growth
        models, lines = len(self.scores), booster.lines
        done: list[list[list[dict]]] = [[[] for _ in range(lines)] for _ in range(models)]
        if not self.layout.used or not self._count():
            return None
        for turn in range(growth.rounds):
            trees = [[Tree(growth) for _ in range(lines)] for _ in range(models)]
            while True:
                asked = {(f, c): w for f, line in enumerate(trees) for c, t in enumerate(line) if (w := t.wanted())}
                if not self._tell_apart([t for line in trees for t in line], turn):
                    return None
                if not asked:
                    break
                for f, line in enumerate(trees):
                    if not any((f, c) in asked for c in range(lines)):
                        continue
                    cells = len(self.bins[0])
                    labels = np.tile(np.arange(self.classes, dtype=float), cells)
                    g, h = _derivatives(booster.kind, self.scores[f].repeat(self.classes, axis=1), labels)
                    for c, t in enumerate(line):
                        if (f, c) in asked:
                            at = _route(t.shape(), self.bins, np.array(t.bin)).repeat(self.classes)
                            inside = at == np.array(asked[f, c])[:, None]
                            total = np.stack([(inside * w) @ self.counts[f] for w in (g[c], h[c], np.ones(len(at)))], axis=1)
                            for n, cut in zip(asked[f, c], self.layout.cuts(total, growth, True)):
                                t.learn(n, cut)
            for f, line in enumerate(trees):
                for c, t in enumerate(line):
                    finished = t.finish()
                    done[f][c].append(finished)
                    self.scores[f][c] += finished["value"][_route(t.shape(), self.bins, finished["bin"])]
        return done

    def _tell_apart(self, trees: list[Tree], turn: int) -> bool:
        """Cells that no cut of the trees parts; False if these would be too many."""
        cuts = {(k, b) for t in trees for k, b, left in zip(t.feature, t.bin, t.left) if left >= 0}
        new = sorted((k, b) for k, b in cuts if b not in self.marks[k])
        if not new:
            return True
        before = self.bins
        for k, b in new:
            self.marks[k] = np.sort(np.append(self.marks[k], b))
        if self.passes > MOST_PASSES + turn or not self._count():
            return False
        # a cell lies in the one that it was a part of, which has the least bins that are not below its own
        old = [np.unique(held) for held in before]
        place = np.zeros(len(self.bins[0]), np.int64)
        for held, now in zip(old, self.bins):
            place = place * len(held) + np.searchsorted(held, now)
        self.scores = [held[:, place] for held in self.scores]
        return True

    def _count(self) -> bool:
        """Numbers of rows by cell, class, fold and bin of each feature; False if these would be too many."""
        layout, classes, parts, width = self.layout, self.classes, self.parts, len(self.borders)
        many = [len(m) + 1 for m in self.marks]
        cells = math.prod(many)
        if cells * classes * parts * layout.size > MOST_COUNTS:
            return False
        self.passes += 1
        places = [np.searchsorted(m, np.arange(len(e) + 1)) for m, e in zip(self.marks, self.borders)]  # of a bin
        group = classes * parts

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((cells * group, layout.size), np.int64)
            for b in batches:
                for row in range(b.num_rows):
                    labels, of, bins, _ = _unpack(_parts(b, row), width, 0)
                    key = np.zeros(len(labels), np.intp)
                    for n, place, held in zip(many, places, bins):
                        if n > 1:
                            key = key * n + place.take(held)
                    key = (key * classes + labels.astype(np.intp)) * parts + of
                    for k in layout.used:
                        size, start = int(layout.sizes[k]), layout.starts[k]
                        found = np.bincount(key * size + bins[k], minlength=len(total) * size)
                        total[:, start : start + size] += found.reshape(len(total), size)
            flat = total.reshape(-1)
            seen = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(flat[seen], pa.int64())], names=["place", "n"])

        found = self.blocks.mapInArrow(add_up, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()  # MOST_COUNTS rows at most
        total = np.zeros(cells * group * layout.size)
        total[found.column("place").to_numpy()] = found.column("n").to_numpy()
        total = total.reshape(cells * classes, parts, layout.size)
        self.counts = [total[:, [k for k in range(parts) if k != f or not self.folds]].sum(axis=1) for f in range(len(self.scores))]
        # a cell stands for its rows by its largest bins
        last = [np.append(m, len(e)) for m, e in zip(self.marks, self.borders)]
        self.bins = np.array([x.reshape(-1) for x in np.meshgrid(*last, indexing="ij")])
        return True


def _batches(nodes: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Nodes that follow one another, with BATCH_ROWS rows at most or a single one."""
    first, rows = 0, 0
    for k, held in enumerate(nodes):
        if k > first and rows + len(held) > BATCH_ROWS:
            yield nodes[first:k]
            first, rows = k, 0
        rows += len(held)
    if nodes:
        yield nodes[first:]


def _layouts(borders: list[np.ndarray], features: int, most: int = JOINT_BINS) -> list[_Layout]:
    """Layouts of the features that can be cut, so many in each; of one feature where none can."""
    sizes = np.array([len(e) + 1 for e in borders], int)
    used = [k for k in range(len(sizes)) if sizes[k] > 1] or list(range(min(len(sizes), 1)))
    return [_Layout(used[k : k + features], sizes, most) for k in range(0, max(len(used), 1), features)]


class _Rows:
    """All rows of a model, and the trees that grow on them."""

    def __init__(self, labels: np.ndarray, of: np.ndarray, cells: np.ndarray, scores: np.ndarray, borders: list[np.ndarray]):
        self.labels, self.of, self.cells, self.scores = labels, of, cells, scores
        self.derived = np.empty(scores.shape), np.empty(scores.shape)
        [self.layout] = _layouts(borders, max(len(borders), 1), JOINT_BINS_OF_MANY if len(labels) >= MANY_ROWS else JOINT_BINS)
        self.codes = self.layout.codes(cells)

    def turn(self, turn: int, model: int, folds: int, kind: str, growth: Growth) -> list[tuple]:
        """One tree for each class; the scores follow."""
        g, h = _derivatives(kind, self.scores, self.labels, self.derived if kind == SEVERAL else None)
        inside = np.flatnonzero(self.of != model) if model < folds else np.arange(len(self.labels))
        out = []
        for c, line in enumerate(self.scores):
            tree = Tree(growth)
            weights = g[c], None if kind == REGRESSION else h[c], _counted(kind, growth)
            if growth.kind == EVEN and len(inside) == len(self.labels):
                at = self._grow_evenly(tree, *weights)
                done = tree.finish()
                line += done["value"][-(len(done["value"]) + 1) // 2 :].take(at)  # the last level
            else:
                rows, children = self._grow(tree, inside, *weights)
                done = tree.finish()
                self._score(line, done, rows, children)
            out.append((model, c, turn, *[done[n].tobytes() for n in _ARRAYS]))
        return out

    def _grow(self, tree: Tree, inside: np.ndarray, g: np.ndarray, h: np.ndarray | None, counted: bool) -> tuple[dict, dict]:
        """The rows of each node that was never parted, and the children of the others."""
        rows, children, kept = {0: inside}, {}, {}
        while wanted := tree.wanted():
            self._part(tree, rows, children)
            few = wanted  # the root, or of every two children the one with fewer rows
            if wanted != [0]:
                few = [a if len(rows[a]) <= len(rows[b]) else b for a, b in zip(wanted[::2], wanted[1::2])]
            known = dict(zip(few, self.layout.sums(self.codes, [rows[n] for n in few], g, h, counted)))
            if wanted != [0]:
                above = {c: p for p, pair in children.items() for c in pair}
                for a, b in zip(wanted[::2], wanted[1::2]):
                    small, large = (a, b) if a in known else (b, a)
                    known[large] = kept.pop(above[small]) - known[small]
            kept.update(known)
            for n, cut in zip(wanted, self.layout.cuts(np.stack([known[n] for n in wanted]), tree.growth, counted)):
                tree.learn(n, cut)
        self._part(tree, rows, children)
        return rows, children

    def _grow_evenly(self, tree: Tree, g: np.ndarray, h: np.ndarray | None, counted: bool) -> np.ndarray:
        """The place of each row among the leaves of a tree whose levels have one cut each; no list of rows is parted."""
        at, kept, level = np.zeros(len(g), np.min_scalar_type(2**tree.growth.depth)), None, [0]
        while wanted := tree.wanted():
            if wanted == [0]:
                total = self.layout.placed_sums(self.codes, None, None, 1, g, h, counted)
            else:
                self._follow_cut(tree, level[0], at)
                weight = np.array([tree.sums[n][2] for n in wanted])  # rows, or where these are not counted Hessians
                few = np.arange(len(wanted)) % 2 == (weight[::2] > weight[1::2]).repeat(2)  # the lighter side of each pair
                held = np.flatnonzero(few.take(at))
                found = self.layout.placed_sums(self.codes, held, (at >> 1).take(held), len(kept), g, h, counted)
                total = np.where(few[:, None, None], found.repeat(2, axis=0), (kept - found).repeat(2, axis=0))
            kept, level = total, wanted
            for n, cut in zip(wanted, self.layout.cuts(total, tree.growth, counted)):
                tree.learn(n, cut)
        self._follow_cut(tree, level[0], at)
        return at

    def _follow_cut(self, tree: Tree, node: int, at: np.ndarray) -> None:
        if tree.left[node] >= 0:
            at *= 2
            at += self.cells[tree.feature[node]] > tree.bin[node]

    def _part(self, tree: Tree, rows: dict, children: dict) -> None:
        """Deal the rows of nodes that have children now."""
        for n, (feature, cut, left, right) in enumerate(zip(tree.feature, tree.bin, tree.left, tree.right)):
            if left >= 0 and n not in children:
                children[n] = left, right
                rows[left], rows[right] = _parted(rows.pop(n), self.cells[feature], cut)

    def _score(self, line: np.ndarray, tree: dict, rows: dict, children: dict) -> None:
        """Add a finished tree's values; a leaf may have had children that were dropped."""
        open_ = [(0, None)]
        while open_:
            n, value = open_.pop()
            if value is None and tree["left"][n] < 0:
                value = tree["value"][n]
            if n in children:
                open_ += [(c, value) for c in children[n]]
            else:
                line[rows[n]] += value


def _plan(tree: dict, known: list[np.ndarray]) -> tuple:
    """What scores a tree: the cuts of its levels, if each has one, or its nodes, and the values; cuts are places among the known borders."""
    feature, left, right = tree["feature"].astype(np.intp), tree["left"], tree["right"]
    cut = np.array([np.searchsorted(known[f], e) if down >= 0 else 0 for f, e, down in zip(feature, tree["border"], left)], np.uint8)
    level, cuts = np.zeros(1, np.intp), []
    while (left[level] >= 0).all():
        if len({*zip(feature[level], cut[level])}) > 1:
            break
        cuts.append((int(feature[level[0]]), int(cut[level[0]])))
        level = np.stack([left[level], right[level]], axis=1).reshape(-1)
    if (left[level] < 0).all() and len(cuts) <= 8:
        return cuts, None, tree["value"][level]
    # a leaf is its own child on either side, whatever is compared
    nodes = np.arange(len(left))
    inner = left >= 0
    down = np.stack([np.where(inner, left, nodes), np.where(inner, right, nodes)], axis=1).reshape(-1).astype(np.intp)
    depth, at = 0, np.zeros(1, np.intp)
    while inner[at].any():
        at, depth = np.unique(down.reshape(-1, 2)[at]), depth + 1
    return None, (np.where(inner, feature, 0), cut, down, depth), tree["value"]


def _placed(cells: np.ndarray, cuts: list[tuple[int, int]], sides: dict) -> np.ndarray:
    """The leaf that each row ends in, where a level has one cut; ``sides`` keeps what was compared."""
    at = np.zeros(cells.shape[1], np.uint8)
    for k, cut in cuts:
        if (k, cut) not in sides:
            sides[k, cut] = (cells[k] > cut).view(np.uint8)
        at <<= 1
        at |= sides[k, cut]
    return at


def _routed(cells: np.ndarray, shape: tuple, rows: np.ndarray) -> np.ndarray:
    feature, cut, down, depth = shape
    start, flat = feature * cells.shape[1], cells.reshape(-1)
    at = np.zeros(len(rows), np.intp)
    for _ in range(depth):
        above = flat.take(start.take(at) + rows) > cut.take(at)
        at = down.take(2 * at + above)
    return at


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def _add_rows(total: np.ndarray, shape: tuple, nodes: list[int], cells: np.ndarray, g: np.ndarray, h: np.ndarray) -> None:
    """Add a block's sums by node, feature and bin."""
    place = np.full(len(shape[0]), -1, np.int64)
    place[nodes] = np.arange(len(nodes))
    at = place[_route(shape, cells, shape[1])]
    seen = np.flatnonzero(at >= 0)
    if not len(seen):
        return
    _, width, bins, _ = total.shape
    key = (at[seen] * (width * bins))[None, :] + (np.arange(width) * bins)[:, None] + cells[:, seen]
    key = key.reshape(-1)
    size = total.shape[0] * width * bins
    for k, weight in enumerate((g[seen], h[seen], None)):
        spread = None if weight is None else np.broadcast_to(weight, (width, len(seen))).reshape(-1)
        total[..., k] += np.bincount(key, spread, size).reshape(total.shape[:3])


class FittedBooster(FittedColumns):
    """The trees of one model; scores rows in Arrow batches."""

    @classmethod
    def made(cls, kind: str, base: np.ndarray, lines: list[list[dict]], borders: list[np.ndarray]) -> FittedBooster:
        trees = [t for line in lines for t in line]
        sizes = [len(t["feature"]) for t in trees]
        joined = {n: np.concatenate([t[n] for t in trees]) if trees else np.zeros(0) for n in ("feature", "bin", "left", "right", "value", "gain")}
        feature, cut = joined["feature"].astype(np.int32), joined["bin"].astype(np.int32)
        border = np.array([borders[f][b] if f >= 0 else 0.0 for f, b in zip(feature, cut)])
        gains = np.bincount(feature[feature >= 0], joined["gain"][feature >= 0], len(borders)) if len(borders) else np.zeros(0)
        held = io.BytesIO()
        np.savez_compressed(
            held, feature=feature, border=border, left=joined["left"].astype(np.int32), right=joined["right"].astype(np.int32),
            value=joined["value"], sizes=np.array(sizes, np.int64), lines=np.array([len(line) for line in lines], np.int64),
        )
        total = gains.sum()
        return cls.of(
            kind=kind,
            base=base.tolist(),
            importances=(gains / total if total else gains).tolist(),
            trees=base64.b64encode(held.getvalue()).decode(),
        )

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802
        return DenseVector(self.state["importances"])

    def trees(self) -> list[list[dict[str, np.ndarray]]]:
        """The trees of each class."""
        with np.load(io.BytesIO(base64.b64decode(self.state["trees"]))) as held:
            arrays = {n: held[n] for n in held.files}
        ends = np.cumsum(arrays["sizes"])
        names = ("feature", "border", "left", "right", "value")
        flat = [{n: arrays[n][e - s : e] for n in names} for s, e in zip(arrays["sizes"], ends)]
        out, at = [], 0
        for n in arrays["lines"]:
            out.append(flat[at : at + n])
            at += n
        return out

    def _scorer(self) -> Callable[[pa.Array], pa.Array]:
        trees, base = self.trees(), np.array(self.state["base"])
        width = len(self.state["importances"])
        held = [(t["feature"][inner], t["border"][inner]) for line in trees for t in line if (inner := t["left"] >= 0).any()]
        features, borders = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, int), np.zeros(0))
        known = [np.unique(borders[features == k]) for k in range(width)]
        plans = [[_plan(t, known) for t in line] for line in trees]

        def scored(cells: np.ndarray, n: int) -> np.ndarray:
            """A line per class; ``cells`` are the places of the values among the known borders."""
            out, sides = np.repeat(base[:, None], n, axis=1), {}
            rows = np.arange(n)
            for line, plan in zip(out, plans):
                for cuts, shape, value in plan:
                    line += value.take(_placed(cells, cuts, sides) if shape is None else _routed(cells, shape, rows))
            return out

        def placed(values: np.ndarray, n: int) -> np.ndarray:
            return np.array([np.searchsorted(e, x, side="left") for e, x in zip(known, values)], np.uint8).reshape(width, n)

        many = [len(e) + 1 for e in known]
        table = None
        if math.prod(many) <= TABLE_CELLS:  # all answers are known beforehand
            grid = np.meshgrid(*[np.arange(m) for m in many], indexing="ij")
            table = scored(np.array([x.reshape(-1) for x in grid], np.uint8).reshape(width, -1), math.prod(many))

        def work(x: pa.Array) -> pa.Array:
            n = len(x)
            out = np.zeros((len(base), 0))
            if n:
                cells = placed(x.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).T, n)
                if table is None:
                    out = scored(cells, n)
                else:
                    at = np.zeros(n, np.intp)
                    for m, held in zip(many, cells):
                        at = at * m + held
                    out = table[:, at]
            flat = pa.array(np.ascontiguousarray(out.T).reshape(-1))
            return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(base)), flat)

        return work

    def _rewrite(self, df: DataFrame) -> DataFrame:
        work = self._scorer()

        @F.arrow_udf("array<double>")
        def raw(x: pa.Array) -> pa.Array:
            return work(x)

        scored = df.withColumn("_raw", raw(vector_to_array("features")))
        kind = self.state["kind"]
        if kind == REGRESSION:
            return scored.withColumn("prediction", F.col("_raw")[0]).drop("_raw")
        if kind == BINARY:
            p = 1 / (1 + F.exp(-F.col("_raw")[0]))
            shares = F.array(1 - p, p)
        else:
            most = F.array_max("_raw")
            powers = F.transform("_raw", lambda s: F.exp(s - most))
            shares = F.transform(powers, lambda e: e / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))
        return (
            scored.withColumn("_shares", shares)
            .withColumn("probability", array_to_vector("_shares"))
            .withColumn("prediction", (F.array_position("_shares", F.array_max("_shares")) - 1).cast("double"))
            .drop("_raw", "_shares")
        )

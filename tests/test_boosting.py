"""Boosted trees: sums and cuts by hand, one block against many, all shapes and problems."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabulon.operators import boosting
from tabulon.operators.boosting import EVEN, LEAF, LEVEL, Booster, Growth, best_cuts


def _table(spark, rows):
    held = [(float(y), k % 3, Vectors.dense(x)) for k, (y, x) in enumerate(rows)]
    return spark.createDataFrame(held, ["label", "fold", "features"]).withColumn("fold", F.col("fold").cast("int"))


def _rows(n, target):
    draw = np.random.default_rng(1)
    x = draw.integers(0, 12, (n, 4)).astype(float)
    return [(target(v), v.tolist()) for v in x]


def test_first_tree_holds_the_sums_of_the_derivatives(spark):
    rows = [(y, [x, 1.0]) for x, y in [(1, 1.0), (1, 3.0), (2, 2.0), (5, 10.0), (6, 12.0), (6, 8.0)]]
    model = Booster(Growth(rounds=1, step=0.5, depth=1, ridge=1.0)).fit(_table(spark, rows))
    [[tree]] = model.trees()
    assert tree["feature"].tolist() == [0, -1, -1] and tree["border"][0] == 2.0
    mean = 6.0
    left, right = sum(mean - y for y in (1, 3, 2)), sum(mean - y for y in (10, 12, 8))
    assert tree["value"][1:].tolist() == pytest.approx([-0.5 * left / 4, -0.5 * right / 4])
    assert model.featureImportances.toArray().tolist() == [1.0, 0.0]
    three = [(y, [x]) for x, y in [(0, 0), (0, 0), (1, 1), (1, 1), (1, 2), (2, 2)]]
    held = Booster(Growth(rounds=1, step=1.0, depth=1, ridge=0.0), 3).fit(_table(spark, three)).trees()
    p = np.array([2, 2, 2]) / 6
    g = p[0] - np.array([1, 1, 0, 0, 0, 0])  # class 0, cut behind the first two rows
    h = p[0] * (1 - p[0]) * 3 / 2
    assert held[0][0]["value"][1:].tolist() == pytest.approx([-g[:2].sum() / (2 * h), -g[2:].sum() / (4 * h)])


@pytest.mark.parametrize("kind", [LEVEL, LEAF, EVEN])
@pytest.mark.parametrize("classes", [0, 2, 3])
def test_shapes_learn_and_blocks_agree(spark, monkeypatch, kind, classes):
    def target(v):
        inside = int(v[0] > 5) ^ int(v[1] > 3)
        return inside + (v[2] > 8) if classes == 3 else inside

    rows = _rows(600, target)
    df = _table(spark, rows)
    growth = Growth(rounds=8, step=0.5, kind=kind, depth=3, leaves=8, ridge=0.5)
    whole = Booster(growth, classes).fit_folds(df, 3)
    monkeypatch.setattr(boosting, "BLOCK_CELLS", 400)
    monkeypatch.setattr(boosting, "WRITE_ROUNDS", 3)
    monkeypatch.setattr(boosting, "CHUNK_FEATURES", 2 if kind != EVEN else 512)
    parts = Booster(growth, classes).fit_folds(df.repartition(4), 3)
    assert len(whole) == len(parts) == 4
    for a, b in zip(whole, parts):
        got = [[r["prediction"] for r in m.transform(df).select("prediction").collect()] for m in (a, b)]
        assert got[0] == pytest.approx(got[1])
    made = whole[3].transform(df)
    if classes:
        assert made.where("label = prediction").count() >= 590
        shares = [r["probability"].toArray() for r in made.select("probability").collect()]
        assert all(len(s) == classes and abs(s.sum() - 1) < 1e-12 for s in shares)
    else:
        assert made.where("abs(label - prediction) < 0.3").count() >= 590
    top = whole[3].featureImportances.toArray()
    assert top[0] + top[1] > 0.5 and top[3] < 0.05 and abs(top.sum() - 1) < 1e-9


def test_a_few_blocks_are_grown_by_a_task_per_model(spark, monkeypatch):
    df = _table(spark, _rows(300, lambda v: v[0] - v[1]))
    growth = Growth(rounds=3)
    whole = Booster(growth).fit_folds(df, 3)
    monkeypatch.setattr(boosting, "BLOCK_CELLS", 400)  # 1,200 cells, in several partitions
    monkeypatch.setattr(Booster, "_level_by_level", None)
    again = Booster(growth).fit_folds(df.repartition(4), 3)
    for a, b in zip(whole, again):
        got = [[r["prediction"] for r in m.transform(df).select("prediction").collect()] for m in (a, b)]
        assert got[0] == pytest.approx(got[1])


def test_best_leaf_growth_equals_a_search_one_by_one():
    draw = np.random.default_rng(2)
    cells = draw.integers(0, 16, (5, 400)).astype(np.uint8)
    g, h = draw.normal(size=400), np.ones(400)
    growth = Growth(kind=LEAF, leaves=9, ridge=1.0, bins=16, least_rows=5)
    tree = boosting.Tree(growth)
    while wanted := tree.wanted():
        total = np.zeros((len(wanted), 5, 16, 3))
        boosting._add_rows(total, tree.shape(), wanted, cells, g, h)
        for node, cut in zip(wanted, best_cuts(total, growth)):
            tree.learn(node, dict(zip(boosting._CUT_NAMES, cut)))
    done = tree.finish()
    leaves = [np.arange(400)]

    def cut_of(rows):
        total = np.zeros((1, 5, 16, 3))
        boosting._add_rows(total, (np.array([-1]), np.array([-1]), np.array([-1]), np.array([-1])), [0], cells[:, rows], g[rows], h[rows])
        return best_cuts(total, growth)[0]

    while len(leaves) < 9:
        cuts = [cut_of(rows) for rows in leaves]
        best = max(range(len(leaves)), key=lambda k: cuts[k][0])
        rows = leaves.pop(best)
        below = cells[cuts[best][1], rows] <= cuts[best][2]
        leaves += [rows[below], rows[~below]]
    at = boosting._route((done["feature"], None, done["left"], done["right"]), cells, done["bin"])
    assert {tuple(np.flatnonzero(at == n)) for n in np.unique(at)} == {tuple(sorted(r)) for r in leaves}


def test_nothing_to_cut(spark):
    flat = _table(spark, [(2.0, [1.0]), (4.0, [1.0]), (6.0, [1.0])])
    model = Booster(Growth(rounds=2)).fit(flat)
    assert {r["prediction"] for r in model.transform(flat).collect()} == {4.0}
    assert model.transform(flat.where("false")).count() == 0
    lone = _table(spark, [(0, [1.0]), (0, [2.0]), (0, [3.0])])
    model = Booster(Growth(rounds=2), 2).fit(lone)
    assert model.transform(lone).agg(F.max("prediction")).first()[0] == 0.0


def test_stored_trees_score_the_same(spark, tmp_path):
    df = _table(spark, _rows(90, lambda v: v[0] * 2 - v[1]))
    model = Booster(Growth(rounds=4)).fit(df)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = boosting.FittedBooster.load(str(tmp_path / "m"))
    assert [r["prediction"] for r in again.transform(df).collect()] == [r["prediction"] for r in model.transform(df).collect()]


@pytest.mark.parametrize("kind", [LEVEL, LEAF, EVEN])
def test_the_rows_of_a_model_give_the_trees_of_plain_sums(kind):
    draw = np.random.default_rng(5)
    cells = np.array([draw.integers(0, n, 500) for n in (40, 2, 2, 3, 1, 12)]).astype(np.uint8)
    borders = [np.arange(n - 1.0) for n in (40, 2, 2, 3, 1, 12)]
    labels = (cells[0] > 20) * 2.0 + (cells[1] == cells[2]) + cells[5] / 7
    growth = Growth(kind=kind, depth=4, leaves=9, ridge=1.0, step=0.5)
    mine, line = np.zeros((1, 500)), np.zeros(500)
    part = boosting._Rows(labels, np.zeros(500, np.int8), cells, mine, borders)
    for turn in range(4):
        tree = boosting.Tree(growth)
        while wanted := tree.wanted():
            total = np.zeros((len(wanted), 6, growth.bins, 3))
            boosting._add_rows(total, tree.shape(), wanted, cells, line - labels, np.ones(500))
            for node, cut in zip(wanted, best_cuts(total, growth)):
                tree.learn(node, dict(zip(boosting._CUT_NAMES, cut)))
        done = tree.finish()
        line += done["value"][boosting._route((done["feature"], None, done["left"], done["right"]), cells, done["bin"])]
        [row] = part.turn(turn, 0, 0, boosting.REGRESSION, growth)
        got = {n: np.frombuffer(row[3 + k], t) for k, (n, t) in enumerate(boosting._ARRAYS.items())}
        for n in ("feature", "bin", "left", "right"):
            assert got[n].tolist() == done[n].tolist()
        assert got["value"] == pytest.approx(done["value"])
        assert mine[0] == pytest.approx(line)


def test_models_of_one_block_are_tasks_of_their_own(spark):
    """They met in one task before, as their rows are few."""
    df = _table(spark, _rows(90, lambda v: v[0] * 2 - v[1]))
    booster = Booster(Growth(rounds=2))
    held = df.select("label", "fold", F.col("features").alias("f"))
    made = []
    gathered = booster._gathered
    booster._gathered = lambda grown, models: made.append(grown.rdd.getNumPartitions()) or gathered(grown, models)
    assert len(booster.fit_folds(held.withColumnRenamed("f", "features"), 3)) == 4
    assert made == [4]


def test_several_blocks_meet_in_the_task_of_a_model(spark, monkeypatch):
    """They were one block before, packed by one task, and of half as many rows at most."""
    df = _table(spark, _rows(3000, lambda v: v[0] - v[1]))
    growth = Growth(rounds=3, kind=EVEN)
    whole = Booster(growth).fit_folds(df, 3)
    monkeypatch.setattr(boosting, "BLOCK_CELLS", 2100)  # 2,022 by their bytes, but 6 blocks of rows
    monkeypatch.setattr(Booster, "_level_by_level", None)
    again = Booster(growth).fit_folds(df.repartition(4), 3)
    for a, b in zip(whole, again):
        got = [[r["prediction"] for r in m.transform(df).select("prediction").collect()] for m in (a, b)]
        assert got[0] == pytest.approx(got[1])


@pytest.mark.parametrize("growth", [Growth(8, 0.3, LEVEL, least_hessian=1.0), Growth(8, 0.1, LEAF, ridge=0.0, least_rows=5), Growth(8, 0.3, EVEN)])
@pytest.mark.parametrize("classes", [2, 3])
def test_cells_that_few_cuts_make_give_the_trees_of_the_rows(spark, monkeypatch, growth, classes):
    df = _table(spark, _rows(900, lambda v: (v[0] > 3) + (v[0] > 8 and classes == 3))).cache()
    rows = Booster(growth, classes).fit_folds(df, 3)
    monkeypatch.setattr(boosting, "MANY_ROWS", 100)
    monkeypatch.setattr(Booster, "_in_one_block", None)
    cells = Booster(growth, classes).fit_folds(df.repartition(3), 3)
    for a, b in zip(rows, cells):
        for one, other in zip(sum(a.trees(), []), sum(b.trees(), [])):
            assert one["feature"].tolist() == other["feature"].tolist() and one["border"].tolist() == other["border"].tolist()
            assert one["value"] == pytest.approx(other["value"])


def test_too_many_cells_are_grown_from_rows(spark, monkeypatch):
    df = _table(spark, _rows(600, lambda v: int(v[0] + v[1] + v[2]) % 3))
    growth = Growth(4, 0.3, LEAF, leaves=8)
    rows = Booster(growth, 3).fit_folds(df, 3)
    monkeypatch.setattr(boosting, "MANY_ROWS", 100)
    monkeypatch.setattr(boosting, "MOST_COUNTS", 5_000)
    again = Booster(growth, 3).fit_folds(df, 3)
    got = [[r["prediction"] for r in m.transform(df).select("prediction").collect()] for m in (rows[3], again[3])]
    assert got[0] == got[1]


def test_rounding_is_no_gain():
    """Every row of a node had the same derivatives; what was left of the difference was taken for a gain, and the node cut."""
    n = np.random.default_rng(3).integers(1e5, 1e7, (20, 1, 8)).astype(float)
    sums = np.stack([n * 0.7, n * 0.1, n], axis=3)
    assert [cut[0] for cut in best_cuts(sums, Growth(kind=LEAF, ridge=0.0))] == [0.0] * 20


@pytest.mark.parametrize("kind", [LEVEL, LEAF, EVEN])
@pytest.mark.parametrize("most", [0, 10**6])
def test_scores_are_the_sums_of_the_leaves(spark, monkeypatch, kind, most):
    monkeypatch.setattr(boosting, "TABLE_CELLS", most)
    df = _table(spark, _rows(400, lambda v: v[0] * v[1] - v[2]))
    model = Booster(Growth(rounds=6, kind=kind, depth=4, leaves=9)).fit(df)
    odd = [[float("nan"), 1.0, 2.0, 3.0], [-1.0, float("inf"), 5.5, 0.0], *[x for _, x in _rows(50, lambda v: 0)]]
    want = []
    for x in odd:
        total = model.state["base"][0]
        for t in model.trees()[0]:
            n = 0
            while t["left"][n] >= 0:
                n = t["left"][n] if x[t["feature"][n]] <= t["border"][n] else t["right"][n]
            total += t["value"][n]
        want.append(total)
    got = model.transform(_table(spark, [(0.0, x) for x in odd]))
    assert [r["prediction"] for r in got.collect()] == pytest.approx(want)

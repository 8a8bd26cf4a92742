import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.operators import correlation
from tabulon.plans import exploration


@pytest.mark.parametrize("tile, panel", [(128, 8), (4, 2), (3, 1), (1, 3)])
def test_tiles_and_panels_give_the_same_pairs(spark, monkeypatch, tile, panel):
    draw = np.random.default_rng(3)
    x = draw.normal(1e7, 1, size=(200, 11))
    x[:, 10] = -2 * x[:, 0] + draw.normal(size=200)
    x[draw.random(x.shape) < 0.2] = np.nan
    x[:, 4] = 5.1
    df = spark.createDataFrame(x.tolist(), ", ".join(f"c{k} double" for k in range(11))).repartition(5)
    monkeypatch.setattr(correlation, "TILE", tile)
    monkeypatch.setattr(correlation, "PANEL_TILES", panel)
    held = df.toPandas()
    rows = correlation.correlations(df, df.columns).collect()
    assert sorted((r["i"], r["j"]) for r in rows) == [(i, j) for i in range(11) for j in range(i + 1, 11)]
    for r in rows:
        want = held[r["col1"]].corr(held[r["col2"]])
        if 4 in (r["i"], r["j"]):
            assert r["correlation"] is None
        else:
            assert r["correlation"] == pytest.approx(want, abs=1e-9)


def test_sorted_values_a_late_first_value_and_no_rows(spark):
    df = spark.range(0, 1000, 1, 7).select(
        F.col("id").cast("double").alias("a"),
        (F.col("id") * 3 + F.col("id") % 2).alias("b"),
        F.when(F.col("id") > 900, F.col("id") + 1e9).alias("late"),
        F.lit(None).cast("double").alias("never"),
    )
    held = df.toPandas()
    found = {(r["col1"], r["col2"]): r["correlation"] for r in correlation.correlations(df, df.columns).collect()}
    for x, y in (("a", "b"), ("a", "late"), ("b", "late")):
        assert found[x, y] == pytest.approx(held[x].corr(held[y]), abs=1e-9)
    assert found["a", "never"] is None
    empty = correlation.correlations(df.where("id < 0"), ["a", "b"]).collect()
    assert [(r["i"], r["j"], r["correlation"]) for r in empty] == [(0, 1, None)]
    assert correlation.correlations(df, ["a"]).count() == 0


def test_wide_table_pairs_come_as_a_table(spark):
    df = spark.range(0, 400, 1, 4).select(
        *[((F.col("id") * (2 * k + 1)) % 401 + F.rand(k)).alias(f"c{k}") for k in range(299)],
        (F.col("id") % 401 + F.rand(0)).alias("twin"),
    )
    strong = correlation.correlations(df, df.columns).where(F.abs("correlation") > 0.999)
    assert [(r["i"], r["j"]) for r in strong.collect()] == [(0, 299)]


def test_exploration_adds_up_pairs_once(spark, monkeypatch):
    calls, real = [], correlation.correlations
    monkeypatch.setattr(correlation, "correlations", lambda *given: calls.append(given) or real(*given))
    df = spark.range(200).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2.5).alias("b"))
    report = exploration.explore(df)
    assert len(calls) == 1 and report["correlation_matrix"].count() == 4
    assert [tuple(r) for r in report["correlated_pairs"].select("col1", "col2", F.round("correlation", 9)).collect()] == [("a", "b", 1.0)]

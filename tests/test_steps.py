"""Properties of the fitted steps, quantiles, splits and metrics."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from tabulon.operators import correlation, metrics, quantiles, selection, split
from tabulon.operators.encoders import CategoryEncoder, HashEncoder, hash_names
from tabulon.operators.engineering import FeatureEngineer
from tabulon.operators.imputers import ConstantImputer, MedianImputer
from tabulon.operators.outliers import OutlierClipper
from tabulon.operators.scalers import MINMAX, ROBUST, STANDARD, AutoScaler, scaling_table
from tabulon.session import scratch_path


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.integers(-5, 5).map(float), st.floats(-1e6, 1e6)), min_size=1, max_size=60))
def test_narrowing_is_exact(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
    limits = quantiles.BRACKET_ROWS, quantiles.SKETCH_ACCURACY
    quantiles.BRACKET_ROWS, quantiles.SKETCH_ACCURACY = 4, 8
    try:
        got = quantiles.quantiles(df, {"x": F.col("x")}, probs)["x"]
    finally:
        quantiles.BRACKET_ROWS, quantiles.SKETCH_ACCURACY = limits
    assert np.allclose(got, np.quantile(values, probs), rtol=1e-12, atol=1e-9)


def test_quantiles_read_the_source_three_times_at_most(spark, monkeypatch):
    reads, real = [], quantiles._narrow
    monkeypatch.setattr(quantiles, "BRACKET_ROWS", 20)
    monkeypatch.setattr(quantiles, "SKETCH_ACCURACY", 20)
    monkeypatch.setattr(quantiles, "_narrow", lambda source, *more: reads.append(source.columns) or real(source, *more))
    df = spark.range(0, 20_000, 1, 4).select(((F.col("id") * 7919) % 20_011).cast("double").alias("x"), F.col("id").alias("y"))
    held = df.toPandas()
    got = quantiles.quantiles(df, {"x": F.col("x"), "y": F.col("y")}, (0.25, 0.5, 0.751))
    for n, found in got.items():
        assert found == pytest.approx([held[n].quantile(p) for p in (0.25, 0.5, 0.751)], rel=1e-13)
    assert reads[0] == ["x0", "x1"] and len(reads) > 2 and all(r == ["k", "x"] for r in reads[1:])


def test_narrowing_with_a_hot_value_and_nulls(spark):
    df = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, 7.0).when(F.col("id") % 11 != 0, F.col("id").cast("double")).alias("x"),
        F.lit(None).cast("double").alias("none"),
    )
    exprs = {"x": F.col("x"), "none": F.col("none")}
    limits = quantiles.BRACKET_ROWS, quantiles.SKETCH_ACCURACY
    quantiles.BRACKET_ROWS, quantiles.SKETCH_ACCURACY = 50, 100
    try:
        got = quantiles.quantiles(df, exprs, (0.01, 0.3, 0.5, 0.9))
    finally:
        quantiles.BRACKET_ROWS, quantiles.SKETCH_ACCURACY = limits
    assert got == quantiles.quantiles(df, exprs, (0.01, 0.3, 0.5, 0.9))
    assert got["none"] == [None] * 4


def test_clip_keeps_nulls_and_bounds(spark):
    df = spark.createDataFrame([(float(v),) for v in range(20)] + [(1000.0,), (None,)], "x double")
    fitted = OutlierClipper(inputCols=["x"]).fit(df)
    [record] = fitted.state["records"]
    out = [r[0] for r in fitted.transform(df).collect()]
    assert out.count(None) == 1 and max(v for v in out if v is not None) == record["upper"]
    assert record["outliers_detected"] == 1 and record["outlier_percentage"] == pytest.approx(100 / 22)
    nulled = OutlierClipper(inputCols=["x"], clip_outliers=False).fit(df).transform(df)
    assert nulled.where("x is null").count() == 2


def test_clip_uses_training_bounds(spark):
    train = spark.createDataFrame([(float(v),) for v in range(10)], "x double")
    fitted = OutlierClipper(inputCols=["x"]).fit(train)
    assert fitted.transform(spark.createDataFrame([(99.0,)], "x double")).first()[0] == fitted.state["records"][0]["upper"]


def test_scalers(spark):
    df = spark.createDataFrame([(float(v * v),) for v in range(30)], "x double")
    out = {
        m: np.array([r[0] for r in AutoScaler(inputCols=["x"], method=m).fit(df).transform(df).collect()])
        for m in (STANDARD, MINMAX, ROBUST)
    }
    assert abs(out[STANDARD].mean()) < 1e-9 and out[STANDARD].std() == pytest.approx(1)
    assert (out[MINMAX].min(), out[MINMAX].max()) == (0, 1)
    assert np.median(out[ROBUST]) == pytest.approx(0)


def test_scaler_choice(spark):
    rng = np.random.default_rng(7)
    rows = [
        (float(n), float(e), float(u), float(h))
        for n, e, u, h in zip(
            rng.normal(100, 30, 400), rng.exponential(100, 400), rng.uniform(0, 1, 400),
            np.where(np.arange(400) % 5 == 0, 10000.0, rng.normal(50, 1, 400)),
        )
    ]
    df = spark.createDataFrame(rows, "normal double, skewed double, bounded double, heavy double")
    got = {r["column"]: r["method"] for r in scaling_table(df, df.columns)}
    assert got == {"normal": STANDARD, "skewed": ROBUST, "bounded": MINMAX, "heavy": ROBUST}
    assert scaling_table(df.limit(9), ["skewed"])[0]["method"] == STANDARD


def test_scaler_choice_does_not_depend_on_the_number_of_rows(spark):
    df = spark.range(5001).select(F.col("id").cast("double").alias("x"))
    chosen = {scaling_table(part, ["x"])[0]["method"] for part in (df, df.limit(5000), df.limit(500))}
    assert chosen == {STANDARD}


def test_quantiles_of_a_column_that_is_half_zero(spark):
    df = spark.range(100_000).select(F.when(F.col("id") % 2 == 0, 0.0).otherwise(F.rand(3)).alias("x"))
    values = np.array([r["x"] for r in df.collect()])
    limit, quantiles.BRACKET_ROWS = quantiles.BRACKET_ROWS, 50
    try:
        got = quantiles.quantiles(df, {"x": F.col("x")}, (0.1, 0.5, 0.500001, 0.9))["x"]
    finally:
        quantiles.BRACKET_ROWS = limit
    assert np.allclose(got, np.quantile(values, (0.1, 0.5, 0.500001, 0.9)), rtol=1e-12, atol=0)


def test_encoder_routes(spark):
    df = spark.range(3000).select(
        (F.col("id") % 3).cast("string").alias("few"), (F.col("id") % 50).cast("string").alias("some"),
        F.col("id").cast("string").alias("all"),
    )
    fitted = CategoryEncoder(inputCols=["few", "some", "all"]).fit(df)
    assert fitted.feature_names() == ["few_1", "few_2", "some_freq", *hash_names("all")]
    assert fitted.described()["all"] == "Hash (cardinality: 3000)"
    out = fitted.transform(df)
    assert out.agg(F.sum("some_freq")).first()[0] == 3000 * 60
    unseen = fitted.transform(spark.createDataFrame([("9", "x", "y"), (None, None, None)], "few string, some string, all string"))
    assert [(r["few_1"], r["few_2"], r["some_freq"]) for r in unseen.collect()] == [(0.0, 0.0, 0.0)] * 2


def test_steps_save_and_load(spark):
    df = spark.createDataFrame(
        [(float(k), "ab"[k % 2], f"v{k % 12}", f"2024-01-{k % 28 + 1:02d}") for k in range(40)] + [(None, None, None, None)],
        "x double, c string, m string, d string",
    )
    chain = Pipeline(
        stages=[
            FeatureEngineer(inputCols=["x", "d"]), OutlierClipper(inputCols=["x"]), MedianImputer(inputCols=["x"]),
            AutoScaler(inputCols=["x"]), ConstantImputer(inputCols=["c", "m"]), CategoryEncoder(inputCols=["c", "m"]),
            HashEncoder(inputCols=["m"], buckets=4),
        ]
    ).fit(df)
    path = scratch_path(spark, "chain")
    chain.write().save(path)
    before, after = (m.transform(df).orderBy("d").collect() for m in (chain, PipelineModel.load(path)))
    assert before == after and before[1]["d_day"] == 1


def test_selector_steps(spark):
    random.seed(3)
    rows = [(float(k), float(k) * 2 + random.random(), 1.0, random.gauss(0, 5), float(k > 50)) for k in range(100)]
    df = spark.createDataFrame(rows, "a double, b double, flat double, noise double, label double")
    fitted = selection.FeatureSelector(inputCols=["a", "b", "flat", "noise"], max_features=1, labelCol="label").fit(df)
    assert fitted.state["removed_constant"] == ["flat"] and fitted.state["removed_correlated"] == ["b"]
    assert fitted.state["selected"] == ["a"] and fitted.transform(df).columns == ["a", "label"]
    assert selection.low_variance(df, ["flat"]) == []


def test_correlation_filter_agrees_for_many_columns(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(200, 30))
    base[:, 7] = base[:, 3] + 0.01 * base[:, 7]
    base[:, 29] = -base[:, 7]
    df = spark.createDataFrame([tuple(map(float, r)) for r in base], ", ".join(f"c{k} double" for k in range(30)))
    assert selection.correlated(df, df.columns) == ["c7", "c29"]


def test_correlations_agree_with_pandas_and_with_any_fan_in(spark):
    rng = np.random.default_rng(2)
    rows = [
        tuple(None if rng.random() < 0.1 else float(v) for v in r)
        for r in rng.normal(1e6, 1, size=(300, 4)) @ np.array([[1, 1, 0, 0], [0, 1, 1, 0], [0, 0, 1, 0], [0, 0, 0, 0]])
    ]
    df = spark.createDataFrame(rows, "a double, b double, c double, flat double").repartition(3)
    held = df.toPandas()
    found = {(r["col1"], r["col2"]): r["correlation"] for r in correlation.correlations(df, df.columns).collect()}
    for (x, y), r in found.items():
        want = held[x].corr(held[y])
        assert (r is None) == (want != want or "flat" in (x, y)) and (r is None or r == pytest.approx(want, abs=1e-9))
    fan, correlation.FAN_IN = correlation.FAN_IN, 2
    try:
        again = {(r["col1"], r["col2"]): r["correlation"] for r in correlation.correlations(df, df.columns).collect()}
    finally:
        correlation.FAN_IN = fan
    assert again.keys() == found.keys() and all(again[k] == pytest.approx(r, abs=1e-12) for k, r in found.items() if r is not None)


def test_split_is_exact_disjoint_and_stable(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("y"))
    marked = split.split(df, 0.25, ["id"], "y").cache()
    assert marked.count() == 1000 and marked.select("id").distinct().count() == 1000
    sizes = marked.groupBy("y").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()
    assert all(abs(r["t"] - r["n"] * 0.25) <= 0.5 for r in sizes)
    again = split.split(df.repartition(13), 0.25, ["id"], "y", rows=10**9)  # many more buckets
    assert sorted(marked.collect()) == sorted(again.collect())


def test_split_in_place_marks_the_same_rows(spark):
    y = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 != 0, (F.col("id") % 7).cast("string"))
    df = spark.range(1000).select("id", y.alias("y"), F.lit("text").alias("_other"))
    df = df.unionByName(spark.createDataFrame([(2000, "alone", "text"), (2001, "two", "t"), (2002, "two", "t")], df.schema))
    for by in ("y", None):
        whole = split.split(df, 0.25, ["id"], by).select("id", "y", "_other", "is_test", "position")
        for rows in (None, 10**9):
            marked = split.split_in_place(df, 0.25, ["id"], by, rows=rows)
            assert sorted(map(repr, marked.drop("_split_key").collect())) == sorted(map(repr, whole.drop("position").collect()))
            for side in (True, False):
                held = split.places(marked.where(F.col("is_test") == side), "_split_key", [by] if by else [], 10**7)
                wanted = whole.where(F.col("is_test") == side).select("id", "position")
                assert sorted(held.select("id", "position").collect()) == sorted(wanted.collect())
    assert split.split_in_place(df.limit(0), 0.25, ["id"], "y").count() == 0
    copies = spark.range(300).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("x"))
    assert split.split_in_place(copies, 0.2).where("is_test").count() == 60


def test_split_spreads_copies(spark):
    """A third of the rows are one and the same; none is lost and the sizes are exact."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("x"))
    marked = split.split(df, 0.2)
    assert marked.where("is_test").count() == 600 and marked.where("x = -1").count() == 1000
    assert 120 < marked.where("x = -1 and is_test").count() < 280


def test_folds_partition_the_rows(spark):
    df = spark.range(103).select("id", (F.col("id") % 2).alias("y"))
    sizes = [r["count"] for r in split.folds(df, 5, ["id"], "y").groupBy("fold").count().collect()]
    assert sum(sizes) == 103 and max(sizes) - min(sizes) <= 2
    with pytest.raises(ValueError):
        split.folds(df, 2)
    with pytest.raises(ValueError):
        split.split(df, 0.6)


def test_auc_against_pairs(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 300)
    s = np.round(rng.normal(y * 0.4, 1), 1)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double")
    wins = (s[y == 1][:, None] > s[y == 0]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0]).mean()
    assert metrics.roc_auc_binary(df).first()[0] == pytest.approx(wins)


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.3), (1, 0.4)], "label int, score double")
    assert metrics.roc_auc_binary(df).first()[0] is None


def test_metrics_of_a_class_never_predicted(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "label int, prediction int")
    assert tuple(metrics.classification_metrics(df).first()) == (0.5, 0.0, 0.0, 0.0)

"""Preparation, training, stored models, prediction and streaming."""

import threading

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import functions as F

from registered import views as v
from tabulon.operators.least_squares import LeastSquares
from tabulon.plans import mixed, prediction, training
from tabulon.plans.preparation import class_labels, numeric_label, prepare
from tabulon.plans.quality import quality_report
from tabulon.session import scratch_path
from tabulon.sources import readers, registry
from tabulon.streaming.scoring import score_stream


@pytest.fixture(scope="module")
def parts(spark, sf):
    return v.table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")


@pytest.fixture(scope="module")
def trained(spark, parts):
    made = prepare(parts, "p_retailprice", key=["p_partkey"])
    makers = training.candidates("regression", ["Linear Regression", "SVM"])
    makers["boosted"] = lambda *_: GBTRegressor(maxIter=2, seed=42)
    makers["broken"] = lambda *_: LinearRegression(featuresCol="nowhere")
    return made, training.train_models(made, 3, makers=makers)


def test_leaderboard(trained):
    _, done = trained
    rows = done.leaderboard.collect()
    assert [r["model_name"] for r in rows] == ["Linear Regression", "SVM", "boosted"]
    assert [r["is_best"] for r in rows].count(True) == 1
    best = next(r for r in rows if r["is_best"])
    assert best["metrics"]["r2_score"] == max(r["metrics"]["r2_score"] for r in rows)
    assert {"cv_r2_mean", "cv_r2_std", "mean_absolute_error"} <= set(best["metrics"])
    [error] = done.errors.collect()
    assert error["model_name"] == "broken"
    summary = done.summary.first()
    assert (summary["models_trained"], summary["models_attempted"], summary["models_failed"]) == (3, 4, 1)
    assert summary["test_size"] == pytest.approx(0.2)


def test_stored_model_predicts_the_same(spark, parts, trained):
    made, done = trained
    root = scratch_path(spark, "models")
    kept = registry.save_model(spark, root, done.best_model, training.metadata_of(spark, made, done), quality_report(parts, made.info))
    got = prediction.predict(spark, kept, parts.drop("p_retailprice"), root)
    assert got.columns == ["p_partkey", "p_brand", "p_type", "p_size", "prediction"]
    want = prediction.score(done.best_model, parts.drop("p_retailprice"))
    assert sorted(got.collect()) == sorted(want.collect())
    assert got.select("p_partkey", "p_size").exceptAll(parts.select("p_partkey", "p_size")).count() == 0
    assert registry.list_models(spark, root).first()["feature_count"] == len(made.feature_names)
    assert spark.read.parquet(f"{root}/{kept}/quality/score").count() == 1
    registry.write_report(registry.load_model(spark, kept, root)[1], f"{root}/report")
    assert '"best_model"' in spark.read.text(f"{root}/report").first()[0]
    with pytest.raises(ValueError):
        registry.load_model(spark, "unknown", root)
    with pytest.raises(ValueError):
        registry.load_dataset(spark, "unknown", root)
    assert registry.list_models(spark, f"{root}-none").count() == 0


def test_records_and_streams_score_like_tables(spark, parts, trained):
    _, done = trained
    rows = [r.asDict() for r in parts.limit(5).collect()]
    records = readers.from_records(spark, rows, parts.schema)
    assert prediction.score(done.best_model, records).count() == 5
    source, target = scratch_path(spark, "in"), scratch_path(spark, "out")
    parts.write.parquet(source)
    query = score_stream(done.best_model, spark.readStream.schema(parts.schema).parquet(source), target, once=True)
    query.awaitTermination(120)
    want = prediction.score(done.best_model, parts).select("p_partkey", F.round("prediction", 6))
    got = spark.read.parquet(target).select("p_partkey", F.round("prediction", 6))
    assert sorted(got.collect()) == sorted(want.collect())


def test_importance(spark, trained):
    made, done = trained
    table = prediction.feature_importance(spark, done.best_model, made.feature_names).collect()
    assert {r["feature"] for r in table} == set(made.feature_names)
    assert [r["importance"] for r in table] == sorted((r["importance"] for r in table), reverse=True)
    unnamed = prediction.feature_importance(spark, done.best_model, ["one"]).collect()
    assert {r["feature"] for r in unnamed} == {f"feature_{k}" for k in range(len(table))}


def test_candidates_are_fitted_side_by_side_and_keep_their_order(trained):
    made, _ = trained
    met = threading.Barrier(2)

    def waiting(*_):
        met.wait(60)  # the other candidate has begun, too
        return LeastSquares()

    done = training.train_models(made, 3, makers={"b": waiting, "a": waiting})
    assert [r["model_name"] for r in done.leaderboard.collect()] == ["b", "a"] and done.errors.count() == 0
    assert done.best_name == "b"


def test_classes_come_back_as_text(spark, parts):
    made = prepare(parts.withColumn("kind", F.when(F.col("p_size") > 25, "large").otherwise("small")), "kind", key=["p_partkey"])
    assert made.problem_type == "classification" and made.labels == ["large", "small"]
    done = training.train_models(made, 3, makers={"lr": lambda *_: LogisticRegression(maxIter=5)})
    got = prediction.score(done.best_model, parts)
    assert {r["prediction"] for r in got.select("prediction").distinct().collect()} <= {"large", "small"}
    assert len(got.first()["probabilities"]) == 2
    assert {"accuracy", "precision", "recall", "f1_score", "roc_auc"} <= set(done.leaderboard.first()["metrics"])


def test_preparation_can_be_refitted_per_fold(trained):
    made, done = trained
    again = training.train_models(made, 3, ["Linear Regression"], refit_preparation=True)
    once, anew = (d.leaderboard.first()["metrics"] for d in (done, again))
    assert anew["r2_score"] == pytest.approx(once["r2_score"])
    assert anew["cv_r2_mean"] == pytest.approx(once["cv_r2_mean"], abs=0.05)


def test_three_classes_are_scored_one_vs_rest(spark, parts):
    made = prepare(parts, "p_type", key=["p_partkey"])
    makers = {"lr": lambda *_: LogisticRegression(maxIter=5), **training.candidates("classification", ["SVM"])}
    done = training.train_models(made, 3, makers=makers)
    rows = {r["model_name"]: r["metrics"] for r in done.leaderboard.collect()}
    assert "roc_auc" in rows["lr"] and "roc_auc" in rows["SVM"]
    assert len(prediction.score(done.best_model, parts).first()["probabilities"]) == len(made.labels)


def test_svm_leaves_for_huge_targets(spark, parts):
    huge = parts.withColumn("p_retailprice", F.col("p_retailprice") * 1e7)
    made = prepare(huge, "p_retailprice", "regression", key=["p_partkey"])
    done = training.train_models(made, 3, ["Linear Regression", "SVM"])
    summary = done.summary.first()
    assert summary["models_excluded"] == 1 and summary["models_attempted"] == 2
    assert "SVM excluded" in summary["warnings"][0]


def test_all_candidates_failing_is_an_error(trained):
    made, _ = trained
    with pytest.raises(ValueError):
        training.train_models(made, 3, makers={"broken": lambda *_: LinearRegression(featuresCol="nowhere")})
    with pytest.raises(ValueError):
        training.train_models(made, 2)


def test_bad_targets(spark):
    df = spark.createDataFrame([("1",), ("x",)], "y string")
    with pytest.raises(ValueError):
        numeric_label(df, "y")
    with pytest.raises(ValueError):
        class_labels(spark.createDataFrame([("a",), (None,)], "y string"), "y")


def test_mixed_columns_prepare_as_numbers(spark, sf):
    whole = F.floor("value").cast("string")
    df = v.table(spark, sf, "events").select(
        "event_id", "value", F.when(F.col("value") > 150, "n/a").otherwise(whole).alias("clean")
    )
    made = prepare(df, "value", "regression", key=["event_id"])
    assert "clean" in made.routes.numerical
    table = {r["strategy"]: r["r2"] for r in mixed.compare_mixed_strategies(df, "clean", "value", key=["event_id"]).collect()}
    assert table["clean numeric"] > 0 and table["numeric + error flag"] >= table["clean numeric"]


def test_csv_reading(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes('a,b,c,d,e,f\n1,x,NA,1.5,True,"q ""w"" ,e"\n2,,3,null,false,z\n'.encode())
    df = readers.read_table(spark, str(path))
    assert [t for _, t in df.dtypes] == ["bigint", "string", "bigint", "double", "boolean", "string"]
    assert [tuple(r) for r in df.collect()] == [(1, "x", None, 1.5, True, 'q "w" ,e'), (2, None, 3, None, False, "z")]
    bad = tmp_path / "l.csv"
    bad.write_bytes("a\ncaf\xe9\n".encode("latin-1"))
    assert readers.text_encoding(spark, str(bad)) == "ISO-8859-1" and readers.text_encoding(spark, str(path)) == "UTF-8"
    assert readers.read_csv(spark, str(bad)).first()[0] == "café"
    with pytest.raises(ValueError):
        readers.read_table(spark, str(tmp_path / "t.xlsx"))


def test_records_from_json_texts(spark):
    texts = ['{"a": 1, "b": "x"}', '{"b": null, "c": 3}', ' {"a": "word", "b": "\\"q"}', "{}", None]
    df = spark.createDataFrame([(t, 1) for t in texts], "body string, a int")
    rows = readers.read_records(df, "body", "a int, b string").collect()
    assert [tuple(r) for r in rows] == [(1, "x"), (None, None), (None, '"q'), (None, None), (None, None)]
    for bad in ("[1]", '{"a": ', "word", ""):
        with pytest.raises(Exception, match="no JSON object"):
            readers.read_records(spark.createDataFrame([(bad,)], "body string"), "body", "a int").collect()

"""Decision rules at, just below and just above each limit."""

import os

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tabulon import session
from tabulon.functions import coercion, grading
from tabulon.operators import cells, eda, inference, metrics, outliers, profile, split
from tabulon.operators.engineering import interaction_plan
from tabulon.operators.scalers import scaling_report
from tabulon.plans import prediction, quality
from tabulon.plans.exploration import explore
from tabulon.plans.preparation import prepare, route_columns, separate
from tabulon.sources import readers


def graded(spark, rule, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    return [r[0] for r in df.select(rule(F.col("v"))).collect()]


def test_missing_severity(spark):
    got = graded(spark, grading.missing_severity, [50.1, 50, 20.1, 20, 5.1, 5, 0])
    assert got == ["Critical", "High", "High", "Medium", "Medium", "Low", "Low"]


def test_outlier_severity(spark):
    assert graded(spark, grading.outlier_severity, [15.1, 15, 5.1, 5]) == ["High", "Medium", "Medium", "Low"]


def test_score_grade(spark):
    got = graded(spark, grading.score_grade, [90, 89.99, 80, 70, 69.99, 60, 59.9])
    assert got == ["Excellent", "Good", "Good", "Fair", "Poor", "Poor", "Critical"]


def test_cardinality(spark):
    assert graded(spark, grading.cardinality_class, [10, 11, 1000, 1001]) == ["Low", "Medium", "Medium", "High"]


@pytest.mark.parametrize(
    "text, number",
    [(" 5 ", 5.0), ("1e3", 1000.0), ("+3", 3.0), (".5", 0.5), ("5.", 5.0), ("1d", None), ("5f", None),
     ("nan", None), ("inf", None), ("", None), ("1,000", None), ("--1", None)],
)
def test_coercion(spark, text, number):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(coercion.text_to_number(F.col("t"))).first()[0] == number


def detect(spark, values, schema="v string"):
    df = spark.createDataFrame([(x,) for x in values], schema)
    return inference.column_types(df).first().asDict()


def test_type_by_conversion_rate(spark):
    words = [f"w{k}" for k in range(40)]
    numbers = [str(k) for k in range(100)]
    assert detect(spark, numbers[:80] + words[:20])["detected_type"] == "numerical"
    assert detect(spark, numbers[:79] + words[:21])["detected_type"] == "categorical"
    assert detect(spark, numbers[:79] + ["Unknown "] + words[:20])["detected_type"] == "numerical"
    assert detect(spark, numbers[:60] + ["a", "b", "c"] * 10)["detected_type"] == "numerical"
    assert detect(spark, numbers[:60] + ["a", "b", "c", "d"] * 8)["detected_type"] == "categorical"
    assert detect(spark, numbers[:50] + words + ["x"] * 11)["detected_type"] == "text"


def test_type_by_cardinality(spark):
    assert detect(spark, [f"w{k}" for k in range(19)])["detected_type"] == "categorical"
    assert detect(spark, [f"w{k}" for k in range(20)])["detected_type"] == "text"
    assert detect(spark, [f"w{k % 20}" for k in range(201)])["detected_type"] == "categorical"
    assert detect(spark, [f"w{k % 20}" for k in range(200)])["detected_type"] == "text"


def test_long_texts_count_whole(spark):
    """Texts that differ only after a long common start stay apart, long numbers stay numbers."""
    start = "x" * 500
    found = detect(spark, [start + str(k % 3) for k in range(9)])
    assert found["distinct_count"] == 3 and found["top_count"] == 3
    found = detect(spark, ["0" * 100 + str(k) for k in range(5)])
    assert found["convertible"] == 5 and found["detected_type"] == "numerical"


def test_long_text_comes_back_whole(spark):
    texts = ["a" * 200 + "1", "a" * 200 + "2", "short"]
    df = spark.createDataFrame([(t,) for t in texts * 2 + texts[:1]], "t string")
    assert {r["value"] for r in cells.top_values(df, ["t"]).collect()} == set(texts)
    assert cells.top_values(df, ["t"], 1).first()["value"] == texts[0]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "v double")
    found = profile.profile(df).first()
    assert (found["missing_count"], found["distinct_count"]) == (2, 1)
    assert profile.missing_by_column(df).first()["missing_count"] == 2


def test_empty_and_all_null(spark):
    empty = spark.createDataFrame([], "a int, b string")
    assert [r["rows"] for r in profile.profile(empty).collect()] == [0, 0]
    assert [r["detected_type"] for r in inference.column_types(empty).orderBy("ordinal").collect()] == ["numerical", "text"]
    nulls = spark.createDataFrame([(None,), (None,)], "a double")
    assert profile.numeric_profile(nulls).first()["median"] is None
    assert inference.column_verdicts(nulls).first()["should_drop"]
    assert profile.duplicates(empty).first()["duplicate_rows"] == 0


def test_wide_tables(spark):
    df = spark.range(30).select(*[(F.col("id") % (k + 1)).alias(f"c{k}") for k in range(70)])
    found = {r["column"]: r["distinct_count"] for r in profile.profile(df).collect()}
    assert found == {f"c{k}": min(k + 1, 30) for k in range(70)}


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1.0, "x"), (2.0, "y")], "`a.b c` double, `d'e` string")
    assert {r["column"] for r in inference.column_verdicts(df).collect()} == {"a.b c", "d'e"}


def test_duplicates_tell_null_positions_apart(spark):
    df = spark.createDataFrame([(None, 1), (1, None), (None, 1), (0, 1)], "a int, b int")
    assert profile.duplicates(df).first()["duplicate_rows"] == 1


def test_verdict_limits(spark):
    df = spark.range(100).select(
        F.when(F.col("id") >= 50, 1).alias("half"),
        F.when(F.col("id") >= 51, 1).alias("more"),
        F.when(F.col("id") < 95, "x").otherwise("y").alias("at95"),
        F.when(F.col("id") < 96, "x").otherwise("y").alias("over95"),
    )
    found = {r["column"]: r["should_drop"] for r in inference.column_verdicts(df).collect()}
    assert found == {"half": False, "more": True, "at95": False, "over95": True}


def test_target_suggestions(spark):
    df = spark.range(40).select(
        F.col("id").alias("row"), (F.col("id") % 7).alias("size"), F.lit(1).alias("one"),
        F.lit("p").alias("Label"), F.lit("q").alias("last"),
    )
    got = inference.target_suggestions(inference.column_types(df)).orderBy("ordinal").collect()
    assert [(r["column"], r["reason"]) for r in got] == [
        ("size", "varied number"), ("Label", "keyword"), ("last", "last column"),
    ]


def test_problem_types(spark):
    df = spark.range(400).select(
        F.col("id").alias("wide"), (F.col("id") % 2).alias("bit"), (F.col("id") % 2 + 1).alias("pair"),
        (F.col("id") % 12 * 0.5).alias("dozen"), (F.col("id") % 21).alias("many"), (F.col("id") > 5).alias("flag"),
    )
    got = {c: inference.problem_type(df, c).first()["problem_type"] for c in df.columns}
    assert got == {
        "wide": "regression", "bit": "classification", "pair": "classification", "dozen": "classification",
        "many": "regression", "flag": "classification",
    }
    assert inference.problem_type(df, None).first()["problem_type"] == "auto_detect"


def test_interaction_limit(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0), (5.0, 6.0, 7.0, 8.0)], "a double, b double, c double, d double")
    names = [p[0] for p in interaction_plan(df, ["a", "b", "c", "d"])]
    assert names == ["a_x_b", "a_div_b", "a_x_c", "a_div_c", "a_x_d", "a_div_d"]
    zero = df.withColumn("b", F.lit(0.0))
    assert "a_div_b" not in [p[0] for p in interaction_plan(zero, ["a", "b", "c", "d"])]


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert [tuple(r) for r in eda.histograms(df, ["v"]).collect()] == [("v", 1, 2)]


def test_missing_patterns_without_missing(spark):
    assert eda.missing_patterns(spark.range(5).toDF("a")).count() == 0
    assert eda.missing_pattern_class(spark.range(5).toDF("a")).first()["pattern"] == "No missing data"


def test_quality_score_floor(spark):
    df = spark.createDataFrame([(None,), (None,), (None,)], "a int")
    found = quality.quality_score(df).first()
    assert (found["overall_score"], found["grade"]) == (20.0, "Critical")


def test_report_tables(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "n int, t string")
    report = quality.quality_report(df, {"scaling": {"n": "StandardScaler"}, "selection": {"removed_constant": ["x"]}})
    assert {k: t.count() for k, t in report.items()} == {
        "overview": 1, "columns": 2, "missing": 1, "missing_columns": 1, "missing_pattern": 1, "score": 1,
        "recommendations": 1, "outliers": 0, "actions": 2,
    }


def test_bad_arguments(spark):
    df = spark.range(5).toDF("a")
    with pytest.raises(ValueError):
        separate(df, "missing")
    with pytest.raises(ValueError):
        prepare(df, "missing")
    with pytest.raises(ValueError):
        outliers.outlier_table(df, ["a"], method="guess")


def test_routes_apply_drop_before_hash():
    rows = [
        {"ordinal": 0, "column": "a", "detected_type": "numerical", "should_drop": True, "should_hash_encode": False},
        {"ordinal": 1, "column": "b", "detected_type": "text", "should_drop": False, "should_hash_encode": True},
        {"ordinal": 2, "column": "c", "detected_type": "datetime", "should_drop": False, "should_hash_encode": False},
        {"ordinal": 3, "column": "t", "detected_type": "numerical", "should_drop": False, "should_hash_encode": False},
    ]
    routes = route_columns(rows, "t")
    assert (routes.dropped, routes.hash_encoded, routes.numerical, routes.categorical) == (["a"], ["b"], [], [])


def test_exploration_tables(spark):
    df = spark.range(40).select(
        F.col("id").cast("double").alias("n"), (F.col("id") * 2).cast("string").alias("as_text"),
        F.concat(F.lit("k"), F.col("id") % 3).alias("kind"), F.expr("timestamp'2024-01-01' + make_interval(0,0,0,id)").alias("at"),
        F.concat(F.lit("words "), F.col("id")).alias("words"),
    )
    report = explore(df)
    assert [r["column"] for r in report["numerical"].orderBy("ordinal").collect()] == ["n", "as_text"]
    assert [(r["col1"], r["col2"]) for r in report["correlated_pairs"].collect()] == [("n", "as_text")]
    assert report["datetime"].first()["date_range_days"] == 39
    assert report["text"].first()["column"] == "words" and report["category_chart"].count() == 3
    assert {k: t.count() for k, t in report.items()}["correlation_matrix"] == 4
    assert "text" not in explore(df.drop("words"))


def edge_tables(spark):
    schema = "n double, i int, t string, d date, flat double, none double"
    row = (1.5, 2, "x", None, 3.0, None)
    return {
        "empty": spark.createDataFrame([], schema),
        "one row": spark.createDataFrame([row], schema),
        "constant": spark.createDataFrame([row] * 30, schema),
    }


@pytest.mark.parametrize("name", ["empty", "one row", "constant"])
def test_edge_tables(spark, name):
    """Nothing divides by zero or fails on empty, single-row or constant tables."""
    df = edge_tables(spark)[name]
    for table in explore(df).values():
        table.collect()
    for table in quality.quality_report(df, {"outliers": outliers.outlier_table(df, ["n", "none"], method="both")}).values():
        table.collect()
    assert inference.column_verdicts(df).count() == 6
    assert profile.moments(df).count() == 4
    assert scaling_report(df, ["n", "flat", "none"]).where("scale = 0").count() == 0
    assert inference.problem_type(df, "i").first()["problem_type"] in ("classification", "regression")
    inference.dataset_info(df, name).collect()


def test_scratch_is_cleared_on_demand(spark, monkeypatch):
    monkeypatch.setattr(session, "_GIVEN", {})
    held = session.settle(spark.range(3))
    path = held.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("//", "")
    path = path if path.startswith("/") else "/" + path
    assert os.path.isdir(path)
    assert session.clear_scratch(spark) == 1 and not os.path.exists(path)
    assert session.clear_scratch(spark) == 0


def test_keyless_split_does_not_depend_on_partitions(spark):
    rows = [(k % 50, "x") for k in range(150)] + [(7, "hot")] * 100
    df = spark.createDataFrame(rows, "n int, s string")
    sides = [
        sorted(tuple(r) for r in split.split(df.repartition(parts), 0.2).where("is_test").select("n", "s").collect())
        for parts in (2, 5)
    ]
    assert sides[0] == sides[1] and len(sides[0]) == 50


def test_scores_keep_every_given_column(spark):
    df = spark.createDataFrame([(float(k), float(k % 2), f"p{k}", k) for k in range(20)], "x double, label double, prediction string, probability int")
    chain = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"), LogisticRegression()])
    model = chain.fit(df.select("x", "label"))
    out = prediction.score(model, df)
    assert out.columns == ["x", "label", "prediction", "probability", "model_prediction", "probabilities"]
    assert {r["prediction"] for r in out.collect()} == {f"p{k}" for k in range(20)}


def test_texts_of_any_length_follow_one_rule(spark):
    for width in (3, 90):
        word = "w" * width
        spelled = [word, word.upper(), f" {word}", f"{word} "]
        rows = [(x,) for x in ["1", "2", "3", "4", "5", "6", *spelled]]
        found = inference.column_types(spark.createDataFrame(rows, "c string")).first()
        assert (found["text_kinds"], found["detected_type"]) == (1, "numerical")
        names = [f"{c}{word}" for c in "bacde"]
        tops = cells.top_values(spark.createDataFrame([(n,) for n in names], "c string"), ["c"], 3)
        assert [r["value"] for r in tops.orderBy("rank").collect()] == sorted(names)[:3]


def test_dates_in_other_spellings(spark):
    texts = ["2020-01-31", "2020/1/31", "01/31/2020", "31/01/2020", "31.01.2020", "Jan 31, 2020", "January 31 2020", "31 Jan 2020 10:30"]
    no = ["1995", "12:30", "31.31.2020", "hello", "", "2020-01-31 noon"]
    df = spark.createDataFrame([(t,) for t in texts + no], "t string")
    got = [r[0] for r in df.select(coercion.text_to_timestamp(F.col("t")).cast("date").cast("string")).collect()]
    assert got == ["2020-01-31"] * len(texts) + [None] * len(no)


def test_auc_of_many_rows_does_not_overflow(spark):
    rows = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, 0.4), (0, 0.4)], "label int, score double")
    assert metrics.roc_auc_binary(rows).first()["roc_auc"] == pytest.approx(0.875)
    limit, metrics.RANGE_SCORES = metrics.RANGE_SCORES, 1
    try:
        assert metrics.roc_auc_binary(rows).first()["roc_auc"] == pytest.approx(0.875)
    finally:
        metrics.RANGE_SCORES = limit


def test_line_breaks_inside_quotes_are_read_by_default(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('id,t\n1,"a\nb"\n2,"c"\n')
    assert [tuple(r) for r in readers.read_table(spark, str(path)).collect()] == [(1, "a\nb"), (2, "c")]

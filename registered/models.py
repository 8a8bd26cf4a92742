"""Metrics, models, leaderboards, stored models and predictions."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Window
from pyspark.sql import functions as F

from registered import views as v
from registered.base import registrar
from registered.features import _ranked_sql
from registered.profiles import rounded
from tabulon.operators import metrics, split
from tabulon.operators.boosting import Booster, Growth
from tabulon.plans import mixed, prediction, training
from tabulon.plans.preparation import prepare
from tabulon.session import scratch_path, settle, small_table
from tabulon.sources import registry

REGISTERED, register = registrar()


def _binary_sql(label, prediction):
    return f"""SELECT round(avg(CAST({label} = {prediction} AS DOUBLE)), 6) AS accuracy, round(p, 6) AS precision, round(r, 6) AS recall,
        round(2 * p * r / (p + r), 6) AS f1_score FROM {v.SQL_LINEITEM_PREDICTED}, (SELECT
            count(*) FILTER (WHERE {label} = 1 AND {prediction} = 1) / count(*) FILTER (WHERE {prediction} = 1) AS p,
            count(*) FILTER (WHERE {label} = 1 AND {prediction} = 1) / count(*) FILTER (WHERE {label} = 1) AS r
            FROM {v.SQL_LINEITEM_PREDICTED}) GROUP BY p, r"""


@register("a31_binary_metrics", _binary_sql("label", "prediction"))
def a31(spark, sf):
    return rounded(metrics.classification_metrics(v.lineitem_predicted(spark, sf)))


@register(
    "a31_multiclass_metrics",
    f"""WITH c AS (SELECT label3 AS l, prediction3 AS p, count(*) AS n FROM {v.SQL_LINEITEM_PREDICTED} GROUP BY 1, 2),
        k AS (SELECT x.l AS k, (SELECT sum(n) FROM c WHERE c.l = x.l) AS s, (SELECT sum(n) FROM c WHERE c.p = x.l) AS q,
            (SELECT sum(n) FROM c WHERE c.l = x.l AND c.p = x.l) AS h FROM (SELECT DISTINCT l FROM c) x)
        SELECT round(sum(h) / sum(s), 6) AS accuracy, round(sum(h / q * s) / sum(s), 6) AS precision, round(sum(h / s * s) / sum(s), 6) AS recall,
            round(sum(2 * h / (s + q) * s) / sum(s), 6) AS f1_score FROM k""",
)
def a31_multi(spark, sf):
    return rounded(metrics.classification_metrics(v.lineitem_predicted(spark, sf), "label3", "prediction3"))


def _auc_sql(positive, score="score"):
    return f"""SELECT (sum(r) FILTER (WHERE y) - CAST(p AS DOUBLE) * (p + 1) / 2) / (CAST(p AS DOUBLE) * q) AS a FROM (
        SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS r,
            count(*) FILTER (WHERE y) OVER () AS p, count(*) FILTER (WHERE NOT y) OVER () AS q
        FROM (SELECT {positive} AS y, {score} AS s FROM {v.SQL_LINEITEM_PREDICTED})) GROUP BY p, q"""


@register("a32_roc_auc", f"SELECT round(a, 6) AS roc_auc FROM ({_auc_sql('label = 1')})")
def a32(spark, sf):
    return rounded(metrics.roc_auc_binary(v.lineitem_predicted(spark, sf)))


@register("w04_auc_of_distinct_scores", f"SELECT round(a, 6) AS roc_auc FROM ({_auc_sql('label = 1', 'y')})")
def w04(spark, sf):
    return rounded(metrics.roc_auc_binary(v.lineitem_predicted(spark, sf), "label", "y"))


_SCORES3 = ("score", "y", "yhat")


@register(
    "a32_roc_auc_one_vs_rest",
    "SELECT round(avg(a), 6) AS roc_auc FROM ("
    + " UNION ALL ".join(_auc_sql(f"label3 = {k}", s) for k, s in enumerate(_SCORES3))
    + ")",
)
def a32_multi(spark, sf):
    df = v.lineitem_predicted(spark, sf).select("label3", F.array(*_SCORES3).alias("scores"))
    return rounded(metrics.roc_auc_one_vs_rest(df, "label3", "scores", 3))


@register(
    "a33_regression_metrics",
    f"""SELECT round(1 - sum((y - yhat)^2) / sum((y - m)^2), 6) AS r2_score, round(avg((y - yhat)^2), 2) AS mean_squared_error,
        round(avg(abs(y - yhat)), 4) AS mean_absolute_error, round(sqrt(avg((y - yhat)^2)), 4) AS root_mean_squared_error
        FROM {v.SQL_LINEITEM_PREDICTED}, (SELECT avg(y) AS m FROM {v.SQL_LINEITEM_PREDICTED})""",
)
def a33(spark, sf):
    found = metrics.regression_metrics(v.lineitem_predicted(spark, sf), "y", "yhat")
    return found.select(
        F.round("r2_score", 6).alias("r2_score"), F.round("mean_squared_error", 2).alias("mean_squared_error"),
        F.round("mean_absolute_error", 4).alias("mean_absolute_error"),
        F.round("root_mean_squared_error", 4).alias("root_mean_squared_error"),
    )


@register(
    "a34_fold_summary",
    """SELECT round(avg(s), 6) AS cv_mean, round(stddev_pop(s), 6) AS cv_std FROM (SELECT l_linenumber, avg(CAST((l_returnflag = 'R') = (l_tax > 0.04) AS DOUBLE)) AS s
       FROM lineitem GROUP BY l_linenumber)""",
)
def a34(spark, sf):
    df = v.table(spark, sf, "lineitem").select(
        F.col("l_linenumber").alias("fold"),
        (F.col("l_returnflag") == "R").cast("double").alias("label"),
        (F.col("l_tax") > 0.04).cast("double").alias("prediction"),
    )
    return rounded(metrics.fold_summary(training.fold_scores(df, "classification")))


@register(
    "a35_confusion_matrix",
    f"""SELECT label3 AS label, count(*) FILTER (WHERE prediction3 = 0) AS "0", count(*) FILTER (WHERE prediction3 = 1) AS "1",
        count(*) FILTER (WHERE prediction3 = 2) AS "2" FROM {v.SQL_LINEITEM_PREDICTED} GROUP BY label3""",
)
def a35(spark, sf):
    return metrics.confusion_matrix(v.lineitem_predicted(spark, sf), [0, 1, 2], "label3", "prediction3")


def _rules(spark, sf):
    """Three rules for l_returnflag = 'R' as candidates of a leaderboard."""
    df = v.table(spark, sf, "lineitem")
    hit = (F.col("l_returnflag") == "R").cast("int")
    rules = [("tax", F.col("l_tax") > 0.04), ("discount", F.col("l_discount") > 0.08), ("quantity", F.col("l_quantity") < 10)]
    scores = df.agg(*[F.avg((hit == r.cast("int")).cast("double")).alias(n) for n, r in rules])
    return scores.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(k).alias("candidate"), F.lit(n).alias("model_name"), F.create_map(F.lit("accuracy"), F.col(n)).alias("metrics"))
                    for k, (n, _) in enumerate(rules)
                ]
            )
        )
    )


_RULES_SQL = """(SELECT 0 AS candidate, 'tax' AS model_name, avg(CAST((l_returnflag = 'R') = (l_tax > 0.04) AS DOUBLE)) AS s FROM lineitem UNION ALL
    SELECT 1, 'discount', avg(CAST((l_returnflag = 'R') = (l_discount > 0.08) AS DOUBLE)) FROM lineitem UNION ALL
    SELECT 2, 'quantity', avg(CAST((l_returnflag = 'R') = (l_quantity < 10) AS DOUBLE)) FROM lineitem)"""


@register(
    "m29_w05_best_model",
    f"SELECT model_name, row_number() OVER (ORDER BY s DESC, candidate) = 1 AS is_best FROM {_RULES_SQL}",
)
def m29(spark, sf):
    return training.best_model(_rules(spark, sf), "classification").select("model_name", "is_best")


@register("t08_model_comparison", f"SELECT model_name, round(s, 6) AS score FROM {_RULES_SQL}")
def t08(spark, sf):
    return rounded(training.comparison(_rules(spark, sf), "classification"))


def _linear(df, inputs, label):
    pack = VectorAssembler(inputCols=inputs, outputCol="features")
    return Pipeline(stages=[pack, LinearRegression(solver="normal", labelCol=label)]).fit(df)


_LINE = """SELECT regr_slope(o_totalprice, o_custkey) AS b, regr_intercept(o_totalprice, o_custkey) AS a FROM orders"""


@register(
    "m21_linear_regression",
    "SELECT round(regr_slope(p_retailprice, p_partkey), 6) AS slope, round(regr_intercept(p_retailprice, p_partkey), 4) AS intercept FROM part",
)
def m21(spark, sf):
    model = _linear(v.table(spark, sf, "part"), ["p_partkey"], "p_retailprice").stages[-1]
    return rounded(
        small_table(spark, [(float(model.coefficients[0]), round(float(model.intercept), 4))], "slope double, intercept double")
    )


@register(
    "s06_s07_stored_model",
    f"SELECT o_orderkey, round(a + b * o_custkey, 2) AS prediction FROM orders, ({_LINE})",
)
def s06(spark, sf):
    df = v.table(spark, sf, "orders")
    root = scratch_path(spark, "models")
    kept = registry.save_model(
        spark, root, _linear(df, ["o_custkey"], "o_totalprice"), {"problem_type": "regression", "best_model_name": "Linear Regression"}
    )
    return prediction.predict(spark, kept, df, root).select("o_orderkey", F.round("prediction", 2).alias("prediction"))



@register(
    "m25_svm_exclusion",
    """SELECT name, CASE WHEN s > 1e8 OR r > 1e9 THEN 'SVM excluded due to extreme target scale (max: ' || printf('%.2e', s) || ')' END AS warning FROM (
        SELECT 'o_totalprice' AS name, max(abs(o_totalprice)) AS s, max(o_totalprice) - min(o_totalprice) AS r FROM orders UNION ALL
        SELECT 'in cents', max(abs(o_totalprice * 1000)), max(o_totalprice * 1000) - min(o_totalprice * 1000) FROM orders)""",
)
def m25(spark, sf):
    df = v.table(spark, sf, "orders")
    rows = [
        ("o_totalprice", training.svm_warning(df, "o_totalprice")),
        ("in cents", training.svm_warning(df.select((F.col("o_totalprice") * 1000).alias("y")), "y")),
    ]
    return small_table(spark, rows, "name string, warning string")


_FOLDED = f"""(SELECT o_totalprice AS y, o_custkey AS x, (rn - 1) % 5 AS fold FROM {_ranked_sql('orders', 'o_orderkey')})"""


@register(
    "m27_cross_validation",
    "\nUNION ALL\n".join(
        f"""SELECT CAST({k} AS INTEGER) AS fold, round(1 - sum((y - a - b * x)^2) / (var_pop(y) * count(*)), 6) AS score FROM {_FOLDED},
            (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM {_FOLDED} WHERE fold <> {k}) WHERE fold = {k}"""
        for k in range(5)
    ),
)
def m27(spark, sf):
    dealt = split.folds(v.table(spark, sf, "orders"), 5, ["o_orderkey"])
    packed = VectorAssembler(inputCols=["o_custkey"], outputCol="features").transform(dealt)
    data = packed.select("features", F.col("o_totalprice").alias("label"), "fold")
    makers = training.candidates("regression", ["Linear Regression"])
    scores, _ = training.cross_validate(makers["Linear Regression"], data, "regression", 0, training.fold_sides(data, 5), data.count())
    return rounded(scores)


_MIXED_SPLIT = f"""(SELECT *, {v.number('raw')} AS x, rn <= ceil(total * CAST(0.2 AS DOUBLE)) AS is_test
    FROM {_ranked_sql(v.SQL_EVENTS_MIXED, 'event_id')})"""


@register(
    "m33_mixed_strategies",
    f"""WITH d AS (SELECT value AS y, x IS NULL AS bad, is_test, coalesce(x, (SELECT median(x) FROM {_MIXED_SPLIT} WHERE NOT is_test)) AS x FROM {_MIXED_SPLIT}),
        plain AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM d WHERE NOT is_test),
        good AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM d WHERE NOT is_test AND NOT bad),
        rest AS (SELECT avg(y) AS m FROM d WHERE NOT is_test AND bad)
        SELECT 'one-hot' AS strategy, (SELECT count(DISTINCT raw) FROM {v.SQL_EVENTS_MIXED}) AS features, CAST(NULL AS DOUBLE) AS r2 UNION ALL
        SELECT 'clean numeric', 1, round(1 - sum((y - a - b * x)^2) / (var_pop(y) * count(*)), 6) FROM d, plain WHERE is_test UNION ALL
        SELECT 'numeric + error flag', 2, round(1 - sum((y - CASE WHEN bad THEN m ELSE a + b * x END)^2) / (var_pop(y) * count(*)), 6)
            FROM d, good, rest WHERE is_test""",
)
def m33(spark, sf):
    return rounded(mixed.compare_mixed_strategies(v.events_mixed(spark, sf), "raw", "value", key=["event_id"]))


def _labelled(spark, sf):
    return v.table(spark, sf, "documents").join(v.table(spark, sf, "labels"), "doc_id")


def _prepared(spark, sf):
    return prepare(_labelled(spark, sf), "quality", "classification", key=["doc_id"])


def _fitted(spark, sf, name):
    """Test rows scored by one candidate."""
    made = _prepared(spark, sf)
    maker = training.candidates("classification", [name])[name]
    train = settle(made.train)
    rows = train.count()
    return maker(rows, len(made.labels)).fit(training.compact(train, rows)), made


_TEST_SIDE = """SELECT CAST(quality AS DOUBLE) AS label, CAST(round(count(*) * CAST(0.2 AS DOUBLE)) AS BIGINT) AS test_rows, true AS consistent
    FROM documents JOIN labels USING (doc_id) GROUP BY quality"""


def _test_side(model, made, column, middle):
    """Test rows by label, and whether every prediction is a known class and follows from its score."""
    p, guess = vector_to_array(column)[1], F.col("prediction")
    follows = ((p >= middle) | (guess == 0)) & ((p <= middle) | (guess == 1))
    return model.transform(made.test).groupBy("label").agg(
        F.count(F.lit(1)).alias("test_rows"), F.bool_and(guess.isin(0.0, 1.0) & p.isNotNull() & follows).alias("consistent")
    )


@register("m20_logistic_regression", _TEST_SIDE)
def m20(spark, sf):
    return _test_side(*_fitted(spark, sf, "Logistic Regression"), "probability", 0.5)


@register("m22_random_forest", _TEST_SIDE)
def m22(spark, sf):
    return _test_side(*_fitted(spark, sf, "Random Forest"), "probability", 0.5)


@register("m23_boosted_trees", _TEST_SIDE)
def m23(spark, sf):
    return _test_side(*_fitted(spark, sf, "GBT flat"), "probability", 0.5)


@register("m24_support_vectors", _TEST_SIDE)
def m24(spark, sf):
    return _test_side(*_fitted(spark, sf, "SVM"), "rawPrediction", 0.0)


def _boards(done, metric):
    """Per candidate: whether its metrics are whole and ``is_best`` marks the first of the largest."""
    first = Window.orderBy(F.desc("score"), "place")
    scored = done.leaderboard.select("model_name", "is_best", F.col("metrics")[metric].alias("score")).withColumn(
        "place", F.monotonically_increasing_id()
    )
    return scored.select("model_name", ((F.row_number().over(first) == 1) == F.col("is_best")).alias("best_agrees"), F.col("score").isNotNull().alias("scored"))


@register(
    "m26_multiclass_models",
    """SELECT name AS model_name, true AS best_agrees, true AS scored, classes FROM (SELECT count(DISTINCT p_type) AS classes FROM part),
        (VALUES ('Logistic Regression'), ('Random Forest'), ('GBT fast'), ('GBT flat'), ('GBT long'), ('SVM')) t(name)""",
)
def m26(spark, sf):
    """A text target with several classes, remapped once for every candidate."""
    made = prepare(v.table(spark, sf, "part"), "p_type", key=["p_partkey"])
    done = training.train_models(made, 3)
    return _boards(done, "accuracy").withColumn("classes", F.lit(len(made.labels)).cast("bigint"))


_SIX = "('Logistic Regression'), ('Random Forest'), ('GBT fast'), ('GBT flat'), ('GBT long'), ('SVM')"


@register(
    "m28_m30_leaderboard",
    f"""SELECT name AS model_name, true AS best_agrees, true AS scored, CAST(NULL AS VARCHAR) AS error_type FROM (VALUES {_SIX}) t(name)
        UNION ALL SELECT 'broken', false, false, 'IllegalArgumentException' FROM (SELECT 1 FROM labels LIMIT 1)""",
)
def m28(spark, sf):
    """All six candidates, and one that cannot be fitted: it is recorded and skipped."""
    makers = training.candidates("classification")
    makers["broken"] = lambda *_: LinearRegression(featuresCol="no_such_column")
    done = training.train_models(_prepared(spark, sf), 3, makers=makers)
    failed = done.errors.select("model_name", F.lit(False).alias("best_agrees"), F.lit(False).alias("scored"), "error_type")
    return _boards(done, "accuracy").withColumn("error_type", F.lit(None).cast("string")).unionByName(failed)


@register(
    "m30_training_summary",
    """SELECT 'regression' AS problem_type, CAST(6 AS INTEGER) AS models_attempted, CAST(0 AS INTEGER) AS models_failed, CAST(3 AS INTEGER) AS cv_folds,
        round(ceil(count(*) * CAST(0.2 AS DOUBLE)) / count(*), 6) AS test_size, true AS best_listed FROM part""",
)
def m30(spark, sf):
    """The summary of a regression with all six candidates."""
    made = prepare(v.table(spark, sf, "part"), "p_retailprice", key=["p_partkey"])
    done = training.train_models(made, 3)
    names = [r["model_name"] for r in done.leaderboard.collect()]  # one row per candidate
    return rounded(
        done.summary.select(
            "problem_type", "models_attempted", "models_failed", "cv_folds", "test_size", F.col("best_model").isin(names).alias("best_listed")
        )
    )


def _regressed(spark, sf):
    made = prepare(v.table(spark, sf, "part"), "p_retailprice", key=["p_partkey"])
    return made, training.train_models(made, 3, ["Linear Regression", "SVM"])


_SEASON = "CASE WHEN month(o_orderdate) <= 4 THEN 'early' WHEN month(o_orderdate) <= 8 THEN 'middle' ELSE 'late' END"
_SEASON_ROWS = f"""(SELECT *, round(total * CAST(0.2 AS DOUBLE)) AS cut FROM
    {_ranked_sql(f"(SELECT *, {_SEASON} AS kind FROM orders)", "o_orderkey", "kind")})"""
_SEASON_SQL = f"SELECT kind AS label, rn AS position, kind AS prediction FROM {_SEASON_ROWS} WHERE rn <= cut"


def _seasons(spark, sf):
    """Orders with a class that their date decides."""
    return v.table(spark, sf, "orders").withColumn("kind", F.expr(_SEASON))


def _by_rule(spark, sf, name):
    """Each test row's class and the class one candidate finds; they have to be equal."""
    made = prepare(_seasons(spark, sf), "kind", "classification", key=["o_orderkey"])
    maker = training.candidates("classification", [name])[name]
    train = settle(made.train)
    rows = train.count()
    model = maker(rows, len(made.labels)).fit(training.compact(train, rows))
    names = F.array(*[F.lit(x) for x in made.labels])
    return model.transform(made.test).select(
        names[F.col("label").cast("int")].alias("label"), "position", names[F.col("prediction").cast("int")].alias("prediction")
    )


@register("m20_known_rule", _SEASON_SQL)
def m20_rule(spark, sf):
    return _by_rule(spark, sf, "Logistic Regression")


@register("m22_known_rule", _SEASON_SQL)
def m22_rule(spark, sf):
    return _by_rule(spark, sf, "Random Forest")


@register("m23_known_rule", _SEASON_SQL)
def m23_rule(spark, sf):
    return _by_rule(spark, sf, "GBT flat")


@register(
    "m23_first_cut",
    """WITH d AS (SELECT CAST(p_size AS DOUBLE) AS x, p_retailprice - avg(p_retailprice) OVER () AS r FROM part),
        c AS (SELECT x, sum(r) AS r, CAST(count(*) AS DOUBLE) AS n FROM d GROUP BY x),
        s AS (SELECT x, sum(r) OVER w AS lr, sum(n) OVER w AS ln, sum(r) OVER () AS tr, sum(n) OVER () AS tn FROM c
              WINDOW w AS (ORDER BY x ROWS UNBOUNDED PRECEDING)),
        g AS (SELECT *, lr * lr / (ln + 1) + (tr - lr) * (tr - lr) / (tn - ln + 1) AS gain FROM s WHERE tn > ln)
        SELECT x AS border, round(lr / (ln + 1) / 2, 6) AS below, round((tr - lr) / (tn - ln + 1) / 2, 6) AS above
        FROM g ORDER BY gain DESC, x LIMIT 1""",
)
def m23_cut(spark, sf):
    """The first tree of depth one: its border, and the leaf values that the sums of residuals give."""
    df = VectorAssembler(inputCols=["p_size"], outputCol="features").transform(v.table(spark, sf, "part"))
    model = Booster(Growth(rounds=1, step=0.5, depth=1, ridge=1.0)).fit(df.withColumn("label", F.col("p_retailprice")))
    [[tree]] = model.trees()
    row = (float(tree["border"][0]), float(tree["value"][1]), float(tree["value"][2]))
    return rounded(small_table(spark, [row], "border double, below double, above double"))


_RING = """(SELECT o_orderkey, o_orderkey % 101 / CAST(50 AS DOUBLE) - 1 AS x, o_custkey % 97 / CAST(48 AS DOUBLE) - 1 AS y FROM orders)"""


@register(
    "m24_ring",
    f"""SELECT o_orderkey, CAST(x * x + y * y < 0.5 AS DOUBLE) AS prediction FROM {_RING} WHERE abs(x * x + y * y - 0.5) > 0.1""",
)
def m24_ring(spark, sf):
    """Classes that no line parts: every order away from the ring's border on its side."""
    df = v.table(spark, sf, "orders").select(
        "o_orderkey", (F.col("o_orderkey") % 101 / 50.0 - 1).alias("x"), (F.col("o_custkey") % 97 / 48.0 - 1).alias("y")
    )
    far = F.col("x") * F.col("x") + F.col("y") * F.col("y")
    rows = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(df.withColumn("label", (far < 0.5).cast("double")))
    model = training.candidates("classification", ["SVM"])["SVM"](0, 2).fit(settle(rows.select("features", "label")))
    return model.transform(rows).where(F.abs(far - 0.5) > 0.1).select("o_orderkey", "prediction")


@register(
    "m28_known_rule",
    f"SELECT name AS model_name, true AS accurate, true AS ordered, true AS best_agrees FROM (VALUES {_SIX}) t(name) WHERE (SELECT count(*) FROM orders) > 0",
)
def m28_rule(spark, sf):
    """All six candidates on classes that the date decides: hardly a row may be wrong."""
    made = prepare(_seasons(spark, sf), "kind", "classification", key=["o_orderkey"])
    done = training.train_models(made, 3)
    m = F.col("metrics")
    right = F.array_min(F.array(m["accuracy"], m["f1_score"], m["precision"], m["recall"], m["cv_accuracy_mean"])) > 0.98
    return done.leaderboard.select("model_name", right.alias("accurate"), (m["roc_auc"] > 0.99).alias("ordered")).join(
        _boards(done, "accuracy").select("model_name", "best_agrees"), "model_name"
    )


_SUM = "CAST(2 * o_custkey + 100 * month(o_orderdate) AS DOUBLE)"


def _summed(spark, sf):
    """Orders with a number that two of their columns add up to, and the models of it."""
    df = v.table(spark, sf, "orders").withColumn("y", F.expr(_SUM)).drop("o_totalprice")
    made = prepare(df, "y", "regression", key=["o_orderkey"])
    return df, made, training.train_models(made, 3, ["Linear Regression"])


@register("m31_known_rule", f"SELECT o_orderkey, {_SUM} AS prediction FROM orders")
def m31_rule(spark, sf):
    """Predictions of a stored model, to the cent."""
    df, made, done = _summed(spark, sf)
    root = scratch_path(spark, "models")
    kept = registry.save_model(spark, root, done.best_model, training.metadata_of(spark, made, done))
    return prediction.predict(spark, kept, df.drop("y"), root).select("o_orderkey", F.round("prediction", 2).alias("prediction"))


@register(
    "m32_known_weights",
    f"""SELECT 'o_custkey' AS feature, round(2 * stddev_pop(o_custkey), 2) AS importance FROM {_ranked_sql('orders', 'o_orderkey')}
        WHERE rn > ceil(total * CAST(0.2 AS DOUBLE)) UNION ALL
        SELECT 'o_orderdate_month', round(100 * stddev_pop(month(o_orderdate)), 2) FROM {_ranked_sql('orders', 'o_orderkey')}
        WHERE rn > ceil(total * CAST(0.2 AS DOUBLE))""",
)
def m32_rule(spark, sf):
    """Weights of the two columns behind the number; all others weigh nothing."""
    _, made, done = _summed(spark, sf)
    found = prediction.feature_importance(spark, done.best_model, made.feature_names)
    return found.where("importance > 0.01").select("feature", F.round("importance", 2).alias("importance"))


@register("m31_predictions", "SELECT *, true AS predicted FROM part")
def m31(spark, sf):
    made, done = _regressed(spark, sf)
    root = scratch_path(spark, "models")
    kept = registry.save_model(spark, root, done.best_model, training.metadata_of(spark, made, done))
    return prediction.predict(spark, kept, v.table(spark, sf, "part"), root).withColumn("predicted", F.col("prediction").isNotNull()).drop("prediction")


@register(
    "m32_t04_importance",
    """SELECT CAST(least(15, 4 + (SELECT count(DISTINCT p_type) - 1 FROM part)) AS BIGINT) AS features, true AS descending, true AS known""",
)
def m32(spark, sf):
    """Absolute coefficients, the largest 15: how many, whether they descend, whether their features are the model's."""
    made, done = _regressed(spark, sf)
    top = prediction.feature_importance(spark, done.best_model, made.feature_names, top=15).collect()  # 15 rows at most
    sizes = [r["importance"] for r in top]
    known = {r["feature"] for r in top} <= set(made.feature_names)
    return small_table(
        spark, [(len(top), sizes == sorted(sizes, reverse=True), known)], "features bigint, descending boolean, known boolean"
    )


@register(
    "a36_j05_coefficients",
    """SELECT 'o_custkey' AS feature, round(abs(regr_slope(o_totalprice, o_custkey)), 6) AS importance FROM orders""",
)
def a36(spark, sf):
    model: PipelineModel = _linear(v.table(spark, sf, "orders"), ["o_custkey"], "o_totalprice")
    return rounded(prediction.feature_importance(spark, model, ["o_custkey"]))


@register(
    "a36_multiclass_importance",
    "SELECT f AS feature, true AS weighed FROM (VALUES ('p_partkey'), ('p_size'), ('p_retailprice')) t(f) WHERE (SELECT count(*) FROM part) > 0",
)
def a36_multi(spark, sf):
    """Mean absolute coefficient over the classes."""
    df = v.table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice", "p_type")
    made = prepare(df, "p_type", key=["p_partkey"])
    maker = training.candidates("classification", ["Logistic Regression"])["Logistic Regression"]
    model = maker(made.train.count(), len(made.labels)).fit(made.train)
    found = prediction.feature_importance(spark, PipelineModel([model]), made.feature_names)
    return found.select("feature", (F.col("importance") > 0).alias("weighed"))


def _stored(spark, sf):
    """Two stored models of the orders, the second newer."""
    df = v.table(spark, sf, "orders")
    root = scratch_path(spark, "models")
    for k, column in enumerate(("o_custkey", "o_orderkey")):
        model = _linear(df, [column], "o_totalprice")
        error = model.transform(df).agg(F.avg(F.abs(F.col("o_totalprice") - F.col("prediction")))).first()[0]
        registry.save_model(
            spark,
            root,
            model,
            {
                "training_id": f"by_{column}", "problem_type": "regression", "best_model_name": "Linear Regression",
                "feature_names": [column], "timestamp": float(k + 1), "original_columns": {"numerical": [column]},
                "model_performances": [
                    {"model_name": "Linear Regression", "metrics": {"mean_absolute_error": round(error, 2)}, "training_time": 0.0, "is_best": True}
                ],
            },
        )
    return root


@register(
    "s08_t05_model_list",
    """SELECT * FROM (VALUES ('by_o_orderkey', 'regression', 'Linear Regression', CAST(2.0 AS DOUBLE), CAST(1 AS INTEGER)),
        ('by_o_custkey', 'regression', 'Linear Regression', CAST(1.0 AS DOUBLE), CAST(1 AS INTEGER)))
        t(training_id, problem_type, best_model, timestamp, feature_count) WHERE (SELECT count(*) FROM orders) > 0""",
)
def s08(spark, sf):
    return registry.list_models(spark, _stored(spark, sf))


@register(
    "s09_training_report",
    f"""SELECT 'by_o_custkey' AS training_id, 'Linear Regression' AS model_name, round(avg(abs(o_totalprice - a - b * o_custkey)), 2) AS mean_absolute_error,
        'o_custkey' AS numerical FROM orders, ({_LINE})""",
)
def s09(spark, sf):
    _, metadata = registry.load_model(spark, "by_o_custkey", _stored(spark, sf))
    report = registry.training_report(metadata)
    return report.select(
        "training_summary.training_id",
        F.col("model_performances")[0]["model_name"].alias("model_name"),
        F.col("model_performances")[0]["metrics"]["mean_absolute_error"].alias("mean_absolute_error"),
        F.col("data_info.original_columns.numerical")[0].alias("numerical"),
    )

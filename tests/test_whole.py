"""Queries and operators do the whole job: every column, every part, every candidate."""

from types import SimpleNamespace

import pytest

from registered import features, models
from registered import views as v
from tabulon.operators import correlation
from tabulon.plans import training
from tabulon.plans.preparation import prepare


def test_labelled_documents_are_prepared_with_their_text(spark, sql_sf):
    made = models._prepared(spark, sql_sf)
    hashed = [k for k, n in enumerate(made.feature_names) if n.startswith("text_hash_")]
    assert made.routes.hash_encoded == ["text"] and len(hashed) == 32
    vectors = [r["features"].toArray() for r in made.test.select("features").collect()]
    assert len({int(x[hashed].argmax()) for x in vectors}) > 1 and all(x[hashed].any() for x in vectors)


def test_full_preparation_has_the_features_of_the_text(spark, sql_sf):
    want = len(models._prepared(spark, sql_sf).feature_names)
    assert {r["width"] for r in features.m18(spark, sql_sf).collect()} == {want}


def test_correlations_add_up_every_part_however_the_plan_was_counted(spark, monkeypatch):
    df = spark.range(0, 300, 1, 3).selectExpr("cast(id as double) a", "cast(id * id % 101 as double) b")
    held = df.toPandas()
    monkeypatch.setattr(type(df), "rdd", property(lambda _: SimpleNamespace(getNumPartitions=lambda: 1)))
    [row] = correlation.correlations(df, ["a", "b"]).collect()
    assert row["correlation"] == pytest.approx(held["a"].corr(held["b"]), abs=1e-9)


class Caught(Exception):
    pass


@pytest.mark.parametrize("query, classes", [(models.m26, 6), (models.m28, 2), (models.m30, 0)])
def test_leaderboards_train_all_candidates_at_their_defaults(spark, sf, monkeypatch, query, classes):
    def caught(prepared, folds, models=None, makers=None):
        assert models is None
        pool = makers or training.candidates(prepared.problem_type)
        made = {n: maker(1000, classes) for n, maker in pool.items() if n != "broken"}
        raise Caught({n: getattr(m, "getClassifier", lambda m=m: m)() for n, m in made.items()})

    monkeypatch.setattr(training, "train_models", caught)
    with pytest.raises(Caught) as held:
        query(spark, sf)
    [made] = held.value.args
    assert len(made) == 6 and {n: made[n].growth.rounds for n in training.BOOSTED} == {"GBT fast": 100, "GBT flat": 100, "GBT long": 1000}
    assert (made["Random Forest"].getNumTrees(), made["Random Forest"].getMaxDepth()) == (100, 10)


def test_boosters_train_on_many_classes(spark, sf):
    made = prepare(v.table(spark, sf, "part").select("p_partkey", "p_size", "p_type"), "p_type", key=["p_partkey"])
    rows = training.compact(made.train, made.train.count())
    maker = training.candidates("classification", ["GBT fast"], boosting_rounds=1)["GBT fast"]
    model = maker(0, len(made.labels)).fit(rows)
    assert len(made.labels) > 2 and len(model.trees()) == len(made.labels)
    assert model.transform(made.test).where("prediction is null").count() == 0

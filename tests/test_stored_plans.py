"""Fitted objects of every kind are stored, loaded and give the same; broken saves are never read."""

import datetime as dt
import decimal

import pytest
from pyspark.sql import functions as F

from tablewright.operators import calibration, encode, ensemble, impute, models, scale, text
from tablewright.plans.features import FeatureOptions, fit_features
from tablewright.plans.training import TrainingOptions, score_stored, train
from tablewright.session import scratch_path
from tablewright.sources import stored_plans


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(400).select(
        F.col("id").alias("key"), F.when(F.col("id") % 7 != 0, F.col("id") % 31).cast("double").alias("x"),
        F.when(F.col("id") % 5 != 0, F.col("id") % 17).cast("double").alias("y"),
        F.when(F.col("id") % 11 != 0, F.concat(F.lit("c"), (F.col("id") % 4).cast("string"))).alias("kind"),
        F.concat_ws(" ", F.lit("some words about"), (F.col("id") % 9).cast("string"), F.lit("things and others")).alias("words"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 90).cast("int")).alias("day"))
    return df.withColumn("good", ((F.col("key") % 31) + (F.col("key") % 4) > 17).cast("int")).cache()


def again(spark, plan, root=None):
    root = root or scratch_path(spark, "plans")
    stored_plans.save_plan(spark, plan, root, "p")
    return stored_plans.load_plan(spark, root, "p")


def same(one, two):
    assert one.schema == two.schema
    assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))


def test_feature_operators(spark, rows):
    for fitted in (impute.fit_fill(rows, "median", add_indicator=True), impute.fit_neighbours(rows, ["x", "y"]), impute.fit_chained(rows, ["x", "y"]),
                   *[scale.fit_scaler(rows, s, ["x", "y"], n_quantiles=20) for s in ("standard", "robust", "power", "quantile", "none")],
                   *[encode.fit_encoder(rows, ["kind"], s, "good") for s in encode.STRATEGIES]):
        same(fitted.transform(rows), again(spark, fitted).transform(rows))
    words = text.fit_text(rows, "words", max_features=12)
    same(words.tfidf(rows, "key"), again(spark, words).tfidf(rows, "key"))


@pytest.mark.parametrize("way", ["knn", "iterative"])
def test_whole_feature_plan(spark, rows, way):
    fitted = fit_features(rows, "good", True, FeatureOptions(numeric_impute=way, text_features=10, max_features=15), key="key")
    loaded = again(spark, fitted)
    assert loaded.outputs == fitted.outputs and loaded.options == fitted.options
    same(fitted.transform(rows), loaded.transform(rows))
    with pytest.raises(ValueError, match="missing at transform"):
        loaded.transform(rows.drop("words"))


def test_models_and_calibrators(spark, rows):
    ready = models.assemble(rows, ["x", "y"], "good", ["key"]).cache()
    makers = [lambda: models.logistic(1.0, 400), lambda: models.forest("classification", numTrees=3, maxDepth=3)]
    stacked = ensemble.fit_stack(ready, "key", makers, True, 2, 2)
    loaded = again(spark, stacked)
    pick = lambda m: models.scored_rows(m, ready, "classification", 2, ["key"])
    same(pick(stacked), pick(loaded))
    scored = pick(stacked).select("y_true", F.col("p1").alias("score"))
    for method in ("isotonic", "sigmoid"):
        fitted = calibration.fit_calibrator(scored, method)
        same(fitted.transform(scored), again(spark, fitted).transform(scored))


def test_trained_run_is_scored_from_the_store(spark, rows):
    store, registry = scratch_path(spark, "store"), scratch_path(spark, "registry")
    named = rows.withColumn("good", F.when(F.col("good") == 1, "yes").otherwise("no"))
    trained = train(named, "good", "key", "classification", FeatureOptions(text=False, generate=False),
                    TrainingOptions(models=("linear",), folds=2, n_trials=0, stack=False), registry=registry, run_id="r1", store=store)
    fresh = named.drop("good")
    scored = score_stored(spark, store, "r1", fresh, ["key"], path=scratch_path(spark, "scores"))
    same(trained.score(fresh, ["key"]), scored)
    assert scored.columns == ["key", "prediction", "proba_class_0", "proba_class_1"]
    assert {r.prediction for r in scored.select("prediction").distinct().collect()} == {"yes", "no"}
    assert scored.join(named, "key").where("prediction = good").count() > 300
    kinds = {r.kind for r in spark.read.parquet(registry).select("kind").distinct().collect()}
    assert kinds == {"params", "metrics", "features", "importances"}
    with pytest.raises(ValueError, match="not carried"):
        trained.score(fresh, ["colour"])


def test_versions(spark):
    root = scratch_path(spark, "plans")
    plan = lambda v: impute.FilledValues({"a": v}, ("a",))
    values = [1.5, float("nan"), dt.date(2024, 5, 6), dt.datetime(2024, 5, 6, 7, 8, 9, 10), decimal.Decimal("1.20"), "x\n\"y", None, True, 7]
    for i, v in enumerate(values, 1):
        assert stored_plans.save_plan(spark, plan(v), root, "fill", {"n": i}) == i
        assert repr(stored_plans.load_plan(spark, root, "fill")) == repr(plan(v))
    assert stored_plans.load_plan(spark, root, "fill", 3) == plan(values[2])
    assert [r.version for r in stored_plans.plan_versions(spark, root, "fill").orderBy("version").collect()] == list(range(1, 10))
    assert stored_plans.list_plans(spark, root) == ["fill"]
    with pytest.raises(FileNotFoundError):
        stored_plans.load_plan(spark, root, "fill", 99)
    with pytest.raises(FileNotFoundError):
        stored_plans.load_plan(spark, root, "other")
    with pytest.raises(TypeError, match="storable"):
        stored_plans.save_plan(spark, plan(object()), root, "fill")
    assert stored_plans.load_plan(spark, root, "fill") == plan(7)               # what the failed save left is not read
    assert stored_plans.delete_plans(spark, root, "fill", keep=2) == list(range(1, 8))
    assert stored_plans.load_plan(spark, root, "fill") == plan(7) and stored_plans.save_plan(spark, plan(0), root, "fill") == 10


def test_writers_that_race(spark, monkeypatch):
    """A writer that saw an old list of versions takes the next free number."""
    root = scratch_path(spark, "plans")
    one = impute.FilledValues({"a": 1})
    assert stored_plans.save_plan(spark, one, root, "fill") == 1
    monkeypatch.setattr(stored_plans, "_numbers", lambda *_: [])
    assert stored_plans.save_plan(spark, one, root, "fill") == 2


def test_foreign_classes_are_refused(spark):
    reader = stored_plans._Reader(spark, "nowhere")
    for name in ("os:system", "tablewrighted.x:y", "pyspark.sql:DataFrame"):
        with pytest.raises(ValueError):
            reader.decode({"$part": name, "fields": {}})
        with pytest.raises(ValueError):
            reader.decode({"$model": "models/1", "class": name})

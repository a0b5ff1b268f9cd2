"""Metrics, quality rules, drift, monitoring, models and streams on small tables."""

import pytest
from pyspark.sql import functions as F

from tablewright.functions.tails import chi_square_tail
from tablewright.operators import (
    calibration, drift, ensemble, explain, metrics, models, performance, quality, tune, types,
)
from tablewright.plans.monitoring import monitor
from tablewright.sources import artifacts, readers


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.4), (0, 0, 0.4), (0, 1, 0.7), (0, 0, 0.1)], "y_true int, y_pred int, s double")
    row = metrics.class_metrics(df).first()
    assert row["accuracy"] == pytest.approx(0.6) and row["balanced_accuracy"] == pytest.approx((1 / 2 + 2 / 3) / 2)
    ranked = metrics.ranking_metrics(df, F.col("y_true") == 1, F.col("s")).first()
    # Positive scores .9 and .4 against .4, .7, .1: 3 wins, then 1 win and a tie.
    assert ranked["roc_auc"] == pytest.approx((3 + 1.5) / 6)
    assert ranked["average_precision"] == pytest.approx(0.5 * 1.0 + 0.5 * 2 / 4)


def test_metrics_of_an_empty_table_and_of_one_class(spark):
    empty = spark.createDataFrame([], "y_true int, y_pred int")
    assert metrics.class_metrics(empty).first()["accuracy"] is None
    one = spark.createDataFrame([(1, 1, 0.5), (1, 1, 0.5)], "y_true int, y_pred int, s double")
    assert metrics.ranking_metrics(one, F.col("y_true") == 1, F.col("s")).first()["roc_auc"] is None
    assert metrics.class_metrics(one).first()["mcc"] == 0.0


def test_an_edge_score_belongs_to_the_lower_bin(spark):
    df = spark.createDataFrame([(1, 0.1), (0, 0.3), (1, 0.30000001), (0, 0.0)], "y_true int, score double")
    assert [r["bin"] for r in calibration.curve(df).orderBy("bin").collect()] == [0, 2, 3]


def test_quality_report(spark):
    df = spark.createDataFrame([(1.0, "x", None)] * 5, "a double, b string, c double")
    rules = {(r["severity"], r["rule"]) for r in quality.quality_report(df, "gone").collect()}
    assert {("error", "insufficient_samples"), ("error", "missing_target"), ("warning", "high_duplicates"),
            ("warning", "constant_column"), ("warning", "high_null_column")} <= rules
    with pytest.raises(quality.QualityError):
        quality.quality_report(df, "gone", raise_on_error=True)
    assert quality.autofix(df).columns == ["a", "b"] and quality.autofix(df).count() == 1


def test_types_of_constant_and_date_text(spark):
    rows = [("2024-01-%02d" % (i % 28 + 1), "same text each time here", i % 2, None) for i in range(120)]
    df = spark.createDataFrame(rows, "d string, t string, b int, n string")
    found = dict(map(tuple, types.detect_types(df).collect()))
    assert found == {"d": "datetime", "t": "constant", "b": "boolean", "n": "constant"}


def test_no_drift_against_itself_and_drift_of_a_shift(spark):
    df = spark.range(500).select((F.col("id") % 50).cast("double").alias("x"), (F.col("id") % 3).cast("string").alias("c"))
    same = {r["column"]: r for r in drift.column_drift(df, df).collect()}
    assert same["x"]["statistic"] == 0 and not same["x"]["drifted"] and not same["c"]["drifted"]
    moved = df.select((F.col("x") + 30).alias("x"), F.lit("0").alias("c")).limit(200)
    assert all(r["drifted"] for r in drift.column_drift(df, moved).collect())


def test_drift_flag_and_trigger_differ_at_the_limit(spark):
    columns = spark.createDataFrame([("a", True)] * 3 + [("b", False)] * 7, "column string, drifted boolean")
    row = drift.dataset_drift(columns, 10, 0.3).first()
    assert row["drift_share"] == 0.3 and not row["dataset_drift"]
    signals = spark.createDataFrame([(0.3, False, 1)], "drift_share double, degraded boolean, days_since_training int")
    assert performance.retrain_decision(signals).first()["should_retrain"]


def test_chi_square_tail_values():
    assert chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert chi_square_tail(18.307038053275146, 10) == pytest.approx(0.05)
    assert chi_square_tail(0.0, 3) == 1.0 and chi_square_tail(None, 3) is None


def test_monitoring_needs_both_metric_tables(spark):
    df = spark.range(300).select(F.col("id").cast("double").alias("x"))
    base = spark.createDataFrame([("rmse", 1.0), ("r2", 0.9)], "metric string, value double")
    worse = spark.createDataFrame([("rmse", 1.2), ("r2", 0.9)], "metric string, value double")
    result = monitor(df, df, 1, base, worse)
    assert result.decision.first()["reasons"] == ["performance_degradation"]
    with pytest.raises(ValueError):
        monitor(df, df, 1, base)


def test_sampled_shapley_adds_up(spark):
    df = spark.range(40).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"))
    values = explain.sampled_attributions(df, "id", ["a", "b"], df, lambda d: d.withColumn("score", 2 * F.col("a") - F.col("b")), 60)
    exact = explain.linear_attributions(df, ["id"], {"a": 2.0, "b": -1.0})
    joined = values.join(exact.withColumnRenamed("contribution", "exact"), ["id", "feature"])
    assert joined.count() == 80 and joined.agg(F.avg(F.abs(F.col("contribution") - F.col("exact")))).first()[0] < 0.6


@pytest.fixture(scope="module")
def points(spark):
    df = spark.range(300).select("id", *[F.randn(seed=i).alias(f"f{i}") for i in range(4)])
    df = df.withColumn("label", (F.col("f0") + 0.5 * F.col("f1") > 0).cast("double")).withColumn("y", 3 * F.col("f0") - F.col("f2"))
    return df.cache()


def test_models_learn(spark, points):
    features = ["f0", "f1", "f2", "f3"]
    rows = models.assemble(points, features, "label", ["id"])
    folded = tune.with_folds(rows, "id", "classification", 3)
    best = tune.select_models(folded, ["linear", "forest"], "classification", params={"forest": {"numTrees": 5, "maxDepth": 3}})
    assert best[0].value > 0.8 and best[0].rank_key >= best[1].rank_key
    stacked = ensemble.fit_stack(rows, "id", [lambda: models.logistic(1.0, 300), lambda: models.forest("classification", numTrees=5, maxDepth=3)], True, 2, 3)
    scored = models.scored_rows(stacked, rows, "classification")
    assert scored.where(F.abs(F.col("p0") + F.col("p1") - 1) > 1e-9).count() == 0
    assert models.metric_table(scored, "classification").first()["roc_auc"] > 0.8
    numbers = models.assemble(points, features, "y")
    ridge = models.linear("ridge", 1.0, n_rows=300).fit(numbers)
    assert models.metric_table(models.scored_rows(ridge, numbers, "regression"), "regression").first()["r2"] > 0.99
    assert models.importances(ridge, features, spark).first()["feature"] == "f0"


def test_search_ranks_errors_so_that_small_wins(spark, points):
    folded = tune.with_folds(models.assemble(points, ["f0", "f2"], "y", ["id"]), "id", "regression", 2)
    trials = tune.search(folded, "forest", "regression", {"numTrees": [2], "maxDepth": [1, 5]}, n_trials=4)
    assert trials[0].value == min(t.value for t in trials)
    bad = tune.search(folded, "forest", "regression", {"maxDepth": [999]}, n_trials=1)
    assert bad[0].value is None


def test_files_and_names(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", float("nan")), (2, "b", 1.0)], "`My Id` int, `my id` string, x double")
    clean = readers.clean_names(df)
    assert clean.columns == ["my_id", "my_id_1", "x"]
    for fmt in ("csv", "parquet", "jsonl", "orc", "feather"):
        path = f"{tmp_path}/t.{fmt}"
        readers.write_table(clean, path)
        back = readers.read_table(spark, path)
        assert back.count() == 2 and back.where("x IS NULL").count() == 1, fmt
    (tmp_path / "a.json").write_text('[{"k": 1}, {"k": 2}]')
    assert readers.read_table(spark, f"{tmp_path}/a.json").count() == 2
    with pytest.raises(ValueError):
        readers.read_table(spark, "table.xlsx")


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = spark.range(100).select("id", (F.col("id") * 0.5).alias("x"))
    one = artifacts.table_fingerprint(df).first()["fingerprint"]
    assert one == artifacts.table_fingerprint(df.orderBy(F.desc("id")).repartition(5)).first()["fingerprint"]
    assert one != artifacts.table_fingerprint(df.withColumn("x", F.col("x") + 0.01)).first()["fingerprint"]


def test_registry_and_feature_tables(spark, tmp_path):
    artifacts.record_run(spark, f"{tmp_path}/reg", "r1", "metrics", {"auc": 0.9, "none": None})
    assert spark.read.parquet(f"{tmp_path}/reg").count() == 2
    artifacts.save_feature_table(spark.createDataFrame([(1, "train"), (2, "test")], "a int, split string"), str(tmp_path), "t")
    assert artifacts.load_feature_table(spark, str(tmp_path), "t", "test").first()["a"] == 2
    with pytest.raises(FileNotFoundError):
        artifacts.load_feature_table(spark, str(tmp_path), "t", "val")



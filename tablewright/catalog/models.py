"""Queries that train models, search parameters and run streams.

Learnt output differs between engines; these report summaries with a quality floor.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tablewright.catalog.base import query, table
from tablewright.operators import boosting, ensemble, models, score, tune
from tablewright.operators.schema import small_frame
from tablewright.plans.features import FeatureOptions
from tablewright.plans.training import TrainingOptions, score_stored, train
from tablewright.session import hold, scratch_path
from tablewright.streaming import monitor

_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "ship_month"]

# Fewer, larger steps of the presets in fit_gbt and fit_leafwise.
_STEPS = {"trees": 20, "rate": 0.2}


def _lineitem(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("ship_month", F.month("l_shipdate"))
    return li.withColumn("dear", (F.col("l_extendedprice") > 30000).cast("int")).withColumn(
        "band", F.when(F.col("l_extendedprice") < 20000, 0).when(F.col("l_extendedprice") < 45000, 1).otherwise(2))


def _orders(spark, sf_dir):
    """Orders with what their lines add up to: a keyed table with a learnable target."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("price"),
        F.avg("l_discount").alias("discount"))
    joined = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left").fillna(0, ["n_lines", "quantity", "price", "discount"])
    return joined.withColumn("large", (F.col("price") > 150000).cast("int"))


def _order_rows(spark, sf_dir, label):
    return hold(models.assemble(_orders(spark, sf_dir), ["n_lines", "quantity", "discount"], label, ["o_orderkey"]))


def _floors(table, **floors):
    """Whether each metric reaches its floor, as one row of booleans."""
    return table.select(*[(F.col(c) >= floor).alias(f"{c}_reached") for c, floor in floors.items()])


@query("fit_logistic", "SELECT true AS accuracy_reached, true AS roc_auc_reached")
def fit_logistic(spark, sf_dir):
    rows = _order_rows(spark, sf_dir, "large")
    model = models.logistic(1.0, rows.count()).fit(rows)
    scored = hold(models.scored_rows(model, rows, "classification"))
    return _floors(models.metric_table(scored, "classification"), accuracy=0.8, roc_auc=0.9)


@query("fit_linear", "SELECT * FROM (VALUES ('ridge', true), ('lasso', true), ('elasticnet', true)) t(model, r2_reached)")
def fit_linear(spark, sf_dir):
    rows = _order_rows(spark, sf_dir, "price")
    n = rows.count()
    found = []
    for kind in ("ridge", "lasso", "elasticnet"):
        model = models.linear(kind, 0.1, 0.5, n).fit(rows)
        scored = models.scored_rows(model, rows, "regression")
        found.append(_floors(models.metric_table(scored, "regression"), r2=0.7).select(F.lit(kind).alias("model"), "r2_reached"))
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("model_importance", "SELECT * FROM (VALUES ('logistic', 3, true, NULL), ('forest', 3, true, true), ('boosting', 3, true, true)) "
       "t(model, n_features, positive, lines_first)")
def model_importance(spark, sf_dir):
    """Importances of a linear model, a forest and a booster; for the trees the number of lines leads."""
    rows, names = _order_rows(spark, sf_dir, "large"), ["n_lines", "quantity", "discount"]
    fitted = {
        "logistic": models.logistic(1.0, rows.count()).fit(rows),
        "forest": models.forest("classification", numTrees=10, maxDepth=4).fit(rows),
        "boosting": models.boosted("classification", "xgboost", trees=10, depth=3).fit(rows)}
    out = []
    for name, model in fitted.items():
        found = models.importances(model, names, spark).collect()
        first = found[0]["feature"] == "n_lines" if name != "logistic" else None        # coefficients depend on units
        out.append((name, len(found), all(r["importance"] >= 0 for r in found), first))
    return small_frame(spark, out, "model string, n_features int, positive boolean, lines_first boolean")


def _with_validation(spark, sf_dir, label):
    """Orders as training rows, every fifth of them for validation."""
    orders = _orders(spark, sf_dir).withColumn("is_val", F.col("o_orderkey") % 5 == 0).withColumn(
        "band", F.when(F.col("price") < 80000, 0).when(F.col("price") < 180000, 1).otherwise(2))
    return hold(models.assemble(orders, ["n_lines", "quantity", "discount", "o_totalprice"], label, ["o_orderkey", "is_val"]))


def _preset(spark, sf_dir, name, task, label, n_classes, steps=None, **floors):
    """One preset judged on the validation rows: as defined, or with the ``steps`` given while all its other options are kept."""
    rows = _with_validation(spark, sf_dir, label)
    model = models.boosted(task, name, n_classes, validation="is_val", **(steps or {})).fit(rows)
    scored = hold(models.scored_rows(model, rows.where("is_val"), task, n_classes))
    kept = model.options == replace(boosting.PRESETS[name], **(steps or {}))
    ended = len(model.curve) - model.best_round == model.options.patience or len(model.curve) == model.options.trees
    return _floors(models.metric_table(scored, task, n_classes), **floors).select(
        F.lit(name).alias("preset"), F.lit(kept).alias("options_kept"), F.lit(ended).alias("ended_by_rule"), "*")


@query("fit_gbt", "SELECT 'catboost' AS preset, true AS options_kept, true AS ended_by_rule, true AS accuracy_reached, true AS roc_auc_reached")
def fit_gbt(spark, sf_dir):
    return _preset(spark, sf_dir, "catboost", "classification", "large", 2, _STEPS, accuracy=0.75, roc_auc=0.85)


@query("fit_multiclass", "SELECT 'xgboost' AS preset, true AS options_kept, true AS ended_by_rule, true AS accuracy_reached, true AS f1_reached")
def fit_multiclass(spark, sf_dir):
    return _preset(spark, sf_dir, "xgboost", "classification", "band", 3, accuracy=0.6, f1=0.6)


@query("fit_leafwise", "SELECT 'lightgbm' AS preset, true AS options_kept, true AS ended_by_rule, true AS r2_reached")
def fit_leafwise(spark, sf_dir):
    return _preset(spark, sf_dir, "lightgbm", "regression", "price", 1, _STEPS, r2=0.6)


@query("fit_early_stopping", "SELECT * FROM (VALUES ('noise', true, true), ('signal', false, true)) t(target, stopped_early, cut_to_best)")
def fit_early_stopping(spark, sf_dir):
    """A target without any signal has to stop early; one that gets better each round must not."""
    orders = _orders(spark, sf_dir).withColumn("is_val", F.col("o_orderkey") % 5 == 0).withColumn(
        "noise", F.pmod(F.xxhash64("o_orderkey"), F.lit(1000)) / 1000.0).withColumn("signal", 3.0 * F.col("quantity"))
    out = []
    for label in ("noise", "signal"):
        rows = hold(models.assemble(orders, ["n_lines", "quantity", "discount"], label, ["is_val"]))
        model = models.boosted("regression", "xgboost", validation="is_val", trees=20, depth=2, patience=4).fit(rows)
        best = min(range(len(model.curve)), key=lambda i: model.curve[i]) + 1
        out.append((label, len(model.curve) < 20, model.n_rounds == best))
    return small_frame(spark, out, "target string, stopped_early boolean, cut_to_best boolean")


@query("fit_mlp")
def fit_mlp(spark, sf_dir):
    rows = models.assemble(_lineitem(spark, sf_dir), _FEATURES, "dear")      # fitting counts them, scoring reads them again
    model = models.perceptron(len(_FEATURES), 2, [16, 8], maxIter=30).fit(rows)
    scored = hold(models.scored_rows(model, rows, "classification"))
    return models.metric_table(scored, "classification").select(
        F.round("accuracy", 2).alias("accuracy"), F.round("roc_auc", 2).alias("roc_auc"))


@query("stack_oof")
def stack_oof(spark, sf_dir):
    rows = _order_rows(spark, sf_dir, "large")
    n = rows.count()
    makers = [lambda: models.logistic(1.0, n), lambda: models.forest("classification", numTrees=10, maxDepth=5)]
    stacked = ensemble.fit_stack(rows, "o_orderkey", makers, True, 2, 3, fit_all=models.run_parallel)
    scored = models.scored_rows(stacked, rows, "classification")
    return models.metric_table(scored, "classification").select(F.round("accuracy", 2).alias("accuracy"), F.round("roc_auc", 2).alias("roc_auc"))


@query("select_model")
def select_model(spark, sf_dir):
    folded = hold(tune.with_folds(_order_rows(spark, sf_dir, "price"), "o_orderkey", "regression", 3))
    best = tune.select_models(folded, ["linear", "forest"], "regression", params={"forest": {"numTrees": 10, "maxDepth": 4}})
    return small_frame(spark, [(i, c.name, c.metric, round(c.value, 0)) for i, c in enumerate(best)],
                       "place int, model string, metric string, value double")


@query("hpo_search")
def hpo_search(spark, sf_dir):
    folded = hold(tune.with_folds(_order_rows(spark, sf_dir, "large"), "o_orderkey", "classification", 3))
    trials = tune.search(folded, "forest", "classification", {"numTrees": [5, 10], "maxDepth": (2, 5)}, n_trials=3, metric="accuracy")
    return small_frame(spark, [(i, t.params["numTrees"], t.params["maxDepth"], round(t.value, 3)) for i, t in enumerate(trials)],
                       "place int, trees int, depth int, accuracy double")


@query("train_workflow")
def train_workflow(spark, sf_dir):
    orders = _orders(spark, sf_dir).drop("price", "o_custkey")
    trained = train(
        orders, "large", "o_orderkey", "classification", FeatureOptions(text=False, generate=False, max_features=12),
        TrainingOptions(models=("linear", "forest"), params={"forest": {"numTrees": 10, "maxDepth": 5}}, folds=2, n_trials=1,
                        space={"numTrees": [10], "maxDepth": [4]}),
        registry=scratch_path(spark, "registry"))
    rows = [(k, round(float(v), 2)) for k, v in sorted(trained.metrics.items()) if k in ("accuracy", "f1", "roc_auc")]
    return small_frame(spark, rows, "metric string, value double")


@query("stored_run_score", "SELECT o_orderkey, true AS same FROM orders")
def stored_run_score(spark, sf_dir):
    """A trained run stored as a version, loaded again, and held against the run in memory on every row."""
    # Sums of doubles follow the order in which a shuffle brings them: both runs have to read the same rows.
    path = scratch_path(spark, "orders")
    _orders(spark, sf_dir).drop("price", "o_custkey").write.parquet(path)
    orders = spark.read.parquet(path)
    store = scratch_path(spark, "store")
    trained = train(orders, "large", "o_orderkey", "classification", FeatureOptions(text=False, generate=False),
                    TrainingOptions(models=("linear",), folds=2, n_trials=0, stack=False), run_id="orders", store=store)
    fresh, now = orders.drop("large"), ["prediction", "proba_class_0", "proba_class_1"]
    stored = score_stored(spark, store, "orders", fresh, ["o_orderkey"], path=scratch_path(spark, "scores"))
    held = trained.score(fresh, ["o_orderkey"]).select("o_orderkey", *[F.col(c).alias(f"held_{c}") for c in now])
    same = F.forall(F.array(*[F.col(c).eqNullSafe(F.col(f"held_{c}")) for c in now]), lambda x: x)
    return stored.join(held, "o_orderkey").select("o_orderkey", same.alias("same"))


@query("score_model")
def score_model(spark, sf_dir):
    """A fitted model applied to a whole table and stored as CSV."""
    rows = _order_rows(spark, sf_dir, "large")
    model = models.logistic(1.0, rows.count()).fit(rows)
    path = scratch_path(spark, "scores")
    scored = score.score_batch(rows, model, n_classes=2, path=path)
    return scored.select("o_orderkey", F.col("prediction").cast("int").alias("prediction"))


# --- streams ---------------------------------------------------------------------

def _event_files(spark, sf_dir):
    """Predictions over events as several files, oldest first."""
    path = scratch_path(spark, "events")
    events = table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", F.col("value").alias("y_true"), (10 + (F.col("event_id") % 17).cast("double")).alias("y_pred"))
    events.repartitionByRange(6, "ts").write.parquet(path)
    return path, events.schema


@query("stream_window_equals_batch", """
SELECT CAST(CAST(w AS DATE) AS VARCHAR) AS window_start, count(*) AS n, round(avg(abs(value - 10 - (event_id % 17))), 6) AS mae,
       round(sqrt(avg(pow(value - 10 - (event_id % 17), 2))), 6) AS rmse
FROM (SELECT *, TIMESTAMP '1970-01-01' + INTERVAL 1 DAY * (7 * (date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) // 7)) AS w FROM events) GROUP BY w""")
def stream_window_equals_batch(spark, sf_dir):
    path, schema = _event_files(spark, sf_dir)
    stream = monitor.windowed_errors(monitor.file_stream(spark, path, schema, files_per_batch=6), late="30 days")
    out, checkpoint = scratch_path(spark, "windows"), scratch_path(spark, "stream")
    held: dict[int, None] = {}

    def save(batch, batch_id):
        held[batch_id] = None
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    running = stream.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()
    running.awaitTermination()
    last = spark.read.parquet(f"{out}/batch={max(held)}")
    return last.select(F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "n", F.round("mae", 6).alias("mae"),
                       F.round("rmse", 6).alias("rmse"))


@query("stream_last_n", """
SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn <= 20""")
def stream_last_n(spark, sf_dir):
    path, schema = _event_files(spark, sf_dir)
    state = scratch_path(spark, "state")
    monitor.keep_last_n(monitor.file_stream(spark, path, schema, files_per_batch=2), scratch_path(spark, "stream"), state,
                        "user_id", "ts", "event_id", 20)
    return monitor.latest_state(spark, state).select("user_id", "event_id")


@query("stream_scored", "SELECT event_id, round(value * 0.5 + 1, 6) AS score FROM events")
def stream_scored(spark, sf_dir):
    path, schema = _event_files(spark, sf_dir)
    out = scratch_path(spark, "scored")
    monitor.score_stream(
        monitor.file_stream(spark, path, schema, files_per_batch=3),
        lambda rows: score.linear_scores(rows, {"y_true": 0.5}, 1.0).select("event_id", "score"), scratch_path(spark, "stream"), out)
    return spark.read.parquet(out).select("event_id", F.round("score", 6).alias("score"))


@query("stream_drift")
def stream_drift(spark, sf_dir):
    path, schema = _event_files(spark, sf_dir)
    out = scratch_path(spark, "drift")
    monitor.drift_per_batch(monitor.file_stream(spark, path, schema, files_per_batch=3), spark.read.parquet(path),
                            ["y_true", "y_pred"], ["y_pred"], scratch_path(spark, "stream"), out)
    return spark.read.parquet(out).select("batch", "column", "test", F.round("statistic", 4).alias("statistic"),
                                          F.round("p_value", 4).alias("p_value"))

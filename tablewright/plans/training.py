"""The training workflow: choose, tune, fit, stack, evaluate and record."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators.boosting import HistogramBooster
from tablewright.operators.ensemble import StackedModel, fit_stack
from tablewright.operators.metrics import signed
from tablewright.operators.models import assemble, importances, make_model, metric_table, run_parallel, scored_rows
from tablewright.operators.split import random_split, stratified_split
from tablewright.operators.tune import Candidate, FoldFits, default_metric, search, select_models, settings, with_folds
from tablewright.plans.features import FeatureOptions, FittedFeatures, fit_features
from tablewright.session import hold
from tablewright.sources.artifacts import record_run
from tablewright.sources.stored_plans import load_plan, save_plan, storable


@dataclass(frozen=True)
class TrainingOptions:
    models: tuple[str, ...] = ("linear", "forest", "xgboost", "lightgbm", "catboost")
    params: dict = field(default_factory=dict)
    folds: int = 3
    n_best: int = 3
    n_trials: int = 50
    space: dict | None = None
    stack: bool = True
    metric: str | None = None


@storable
@dataclass(frozen=True)
class TrainedModel:
    """Fitted features and model, with how they were chosen."""

    features: FittedFeatures
    model: object
    chosen: str
    params: dict
    candidates: tuple[Candidate, ...]
    metrics: dict[str, float]
    label_order: tuple[str, ...]
    task: str = "classification"

    def score(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """``keep`` columns, ``prediction`` (the class name, or a number) and a probability for each class."""
        ready = self.features.transform(df)
        lost = [c for c in keep if c not in ready.columns]
        if lost:
            raise ValueError(f"columns not carried by the feature plan: {lost}")
        scored = self.model.transform(assemble(ready, self.features.outputs, None, list(keep)))
        if self.task == "regression":
            return scored.select(*keep, "prediction")
        names = F.array(*[F.lit(v) for v in self.label_order])
        columns = [F.get(names, F.col("prediction").cast("int")).alias("prediction")]
        for source in ("probability", "rawPrediction"):
            if source in scored.columns:
                p = vector_to_array(source)
                columns += [F.get(p, F.lit(i)).alias(f"proba_class_{i}") for i in range(len(self.label_order))]
                break
        return scored.select(*keep, *columns)


def score_stored(spark: SparkSession, root: str, name: str, df: DataFrame, keep: Sequence[str] = (), version: int | None = None,
                 path: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Score rows with a stored run; with a path, written there and read back."""
    scored = load_plan(spark, root, name, version).score(df, keep)
    if path is None:
        return scored
    scored.write.mode("overwrite").format(fmt).option("header", True).save(path)
    return spark.read.format(fmt).option("header", True).schema(scored.schema).load(path)


def train(df: DataFrame, target: str, key: str, task: str, features: FeatureOptions = FeatureOptions(),
          options: TrainingOptions = TrainingOptions(), exclude: Sequence[str] = (), registry: str | None = None,
          run_id: str = "run", store: str | None = None) -> TrainedModel:
    """Split, fit features on the training part, choose and tune a model, and test it.

    The stack replaces the tuned model only where it is better on the validation rows. With
    ``registry`` the run's names and values are recorded, importances included; with ``store`` the
    fitted run is stored there under ``run_id`` and can be loaded again.
    """
    metric = options.metric or default_metric(task)
    # The rows may come out of joins; labels, cuts, features and the feature table all read them.
    whole = base = hold(df.drop(*exclude).where(F.col(target).isNotNull()))
    labels: tuple[str, ...] = ()
    if task == "classification":
        label = F.col(target).cast("string")
        labels = tuple(sorted(r[0] for r in base.select(label.alias("label")).distinct().collect()))
        code = F.array_position(F.array(*[F.lit(v) for v in labels]), label) - 1
        base = base.withColumn(target, code.cast("int"))
        parts = stratified_split(base, key, target)
    else:
        parts = random_split(base, key)
    n_classes = max(2, len(labels))
    fitted = fit_features(parts.where("split = 'train'"), target, task == "classification", features, key, ["split"])
    rows = hold(assemble(fitted.transform(parts), fitted.outputs, target, [key, "split"]))
    train_rows = rows.where("split = 'train'").drop("split")
    folded = hold(with_folds(train_rows, key, task, options.folds))
    n_rows = folded.count()

    fits = FoldFits()
    best = select_models(folded, options.models, task, metric, n_classes, options.n_best, options.params, n_rows, fits)
    winner = best[0]
    if options.n_trials:
        tuned = search(folded, winner.name, task, options.space, options.n_trials, metric, n_classes, n_rows=n_rows, fits=fits)
        if tuned and tuned[0].rank_key > winner.rank_key:
            winner = tuned[0]
    estimator = make_model(winner.name, task, n_classes, n_rows, winner.params)
    if isinstance(estimator, HistogramBooster):                          # boosting stops by the validation rows
        estimator = HistogramBooster(task, estimator.options, n_classes, "is_val")
        model: object = estimator.fit(rows.where("split IN ('train', 'val')").withColumn("is_val", F.col("split") == "val"))
    else:
        model = estimator.fit(train_rows)
    chosen, params = winner.name, winner.params

    def value(m, part: str, only: str | None = None) -> dict[str, float]:
        return metric_table(scored_rows(m, rows.where(F.col("split") == part), task, n_classes), task, n_classes, only=only).first().asDict()

    if options.stack and len(best) >= 2:
        makers = [lambda c=c: make_model(c.name, task, n_classes, n_rows, c.params) for c in best]
        done = {settings(estimator): model} if settings(estimator) else {}
        stacked: StackedModel = fit_stack(
            train_rows, key, makers, task == "classification", n_classes, options.folds, fit_all=run_parallel, folded=folded,
            left_out=[fits.of(make()) for make in makers], whole=[done.get(settings(make())) for make in makers])
        if signed(metric, value(stacked, "val", metric)[metric]) > signed(metric, value(model, "val", metric)[metric]):
            model, chosen, params = stacked, "stack", {"bases": [c.name for c in best]}
    metrics = value(model, "test")
    if registry is not None:
        record_run(df.sparkSession, registry, run_id, "params", {"model": chosen, **params})
        record_run(df.sparkSession, registry, run_id, "metrics", metrics)
        record_run(df.sparkSession, registry, run_id, "features", {f: i for i, f in enumerate(fitted.outputs)})
        if chosen != "stack":
            weights = {r["feature"]: r["importance"] for r in importances(model, fitted.outputs, df.sparkSession).collect()}
            record_run(df.sparkSession, registry, run_id, "importances", weights)
    trained = TrainedModel(fitted, model, chosen, params, tuple(best), metrics, labels, task)
    if store is not None:
        save_plan(df.sparkSession, trained, store, run_id, {"model": chosen, "metrics": {k: v for k, v in metrics.items() if isinstance(v, float)}})
    for table in (folded, rows, whole):
        table.unpersist()
    return trained

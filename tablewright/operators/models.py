"""Model factories over Spark ML, their presets, outputs and importances."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators.boosting import PRESETS, HistogramBooster
from tablewright.operators.metrics import class_metrics, ranking_metrics, regression_metrics, roc_auc_ovr
from tablewright.operators.perceptron import Perceptron
from tablewright.operators.schema import small_frame

SEED = 42

#: Names that Spark's own boosters use for some options.
_SPARK_NAMES = {"maxIter": "trees", "stepSize": "rate", "maxDepth": "depth", "subsamplingRate": "row_share", "minInstancesPerNode": "min_rows"}
# Hidden layers and training limits of the neural classifier.
MLP_LAYERS = (256, 128, 64)
MLP_BLOCK, MLP_EPOCHS = 512, 200


def assemble(df: DataFrame, features: Sequence[str], label: str | None, keep: Sequence[str] = ()) -> DataFrame:
    """Rows for training: the kept columns, ``features`` and a double ``label`` (for scoring: none)."""
    labels = [] if label is None else [F.col(label).cast("double").alias("label")]
    rows = df.select(*keep, *[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(f"_f{i}") for i, c in enumerate(features)], *labels)
    assembler = VectorAssembler(inputCols=[f"_f{i}" for i in range(len(features))], outputCol="features")
    return assembler.transform(rows).select(*keep, "features", *(["label"] if labels else []))


def logistic(c: float = 1.0, n_rows: int = 1, **params) -> LogisticRegression:
    """L2 logistic regression; C is per data set, Spark's strength is per row."""
    return LogisticRegression(family="auto", standardization=False, elasticNetParam=0.0,
                              regParam=1.0 / (c * max(1, n_rows)), **{"maxIter": 100, **params})


def linear(kind: str = "ridge", alpha: float = 1.0, l1_ratio: float = 0.5, n_rows: int = 1) -> LinearRegression:
    """ridge (default), lasso or elasticnet; ridge's strength is spread over the rows."""
    if kind in ("auto", "ridge"):
        mix, strength = 0.0, alpha / max(1, n_rows)
    elif kind == "lasso":
        mix, strength = 1.0, alpha
    elif kind == "elasticnet":
        mix, strength = l1_ratio, alpha
    else:
        raise ValueError(f"unknown linear model {kind!r}")
    return LinearRegression(elasticNetParam=mix, regParam=strength, standardization=False)


def boosted(task: str, preset: str = "xgboost", n_classes: int = 2, validation: str | None = None, **params):
    """Gradient-boosted trees on histograms; more than two classes share one softmax.

    With ``validation`` (a boolean column) boosting stops when those rows no longer improve, and the
    model is cut to its best round. ``params`` are fields of ``BoostOptions`` over the preset's.
    """
    settings = {_SPARK_NAMES.get(k, k): v for k, v in params.items()}
    return HistogramBooster(task, replace(PRESETS[preset], seed=SEED, **settings), n_classes, validation)


def forest(task: str, **params):
    kind = RandomForestRegressor if task == "regression" else RandomForestClassifier
    return kind(**{"numTrees": 100, "maxDepth": 8, "seed": SEED, **params})


def perceptron(n_features: int, n_classes: int, hidden: Sequence[int] = MLP_LAYERS, **params) -> Perceptron:
    return Perceptron(MultilayerPerceptronClassifier(layers=[n_features, *hidden, n_classes], blockSize=MLP_BLOCK, seed=SEED,
                                                     **{"maxIter": MLP_EPOCHS, **params}))


# Users add a model by adding a factory: name -> (task, n_classes, n_rows, params) -> estimator.
REGISTRY: dict[str, Callable] = {
    "linear": lambda task, n_classes, n_rows, p: (
        linear(p.get("kind", "ridge"), p.get("alpha", 1.0), p.get("l1_ratio", 0.5), n_rows) if task == "regression"
        else logistic(p.get("C", 1.0), n_rows)),
    "forest": lambda task, n_classes, n_rows, p: forest(task, **p),
    "xgboost": lambda task, n_classes, n_rows, p: boosted(task, "xgboost", n_classes, **p),
    "lightgbm": lambda task, n_classes, n_rows, p: boosted(task, "lightgbm", n_classes, **p),
    "catboost": lambda task, n_classes, n_rows, p: boosted(task, "catboost", n_classes, **p),
}


def make_model(name: str, task: str, n_classes: int, n_rows: int, params: dict | None = None):
    if name not in REGISTRY:
        raise ValueError(f"unknown model {name!r}; known: {sorted(REGISTRY)}")
    return REGISTRY[name](task, n_classes, n_rows, params or {})


def run_parallel(jobs: Sequence[Callable[[], object]], threads: int = 4) -> list:
    """Start independent fits from the driver side by side, so the cluster stays busy."""
    with ThreadPoolExecutor(max_workers=threads) as pool:
        return list(pool.map(lambda job: job(), jobs))


def scored_rows(model, df: DataFrame, task: str, n_classes: int = 2, keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., y_true, y_pred[, p0, p1, ...]) from a fitted model."""
    scored = model.transform(df)
    columns = [F.col("label").alias("y_true"), F.col("prediction").alias("y_pred")]
    if task == "classification" and "probability" in scored.columns:
        p = vector_to_array("probability")
        columns += [F.get(p, F.lit(i)).alias(f"p{i}") for i in range(n_classes)]
    elif task == "classification" and "rawPrediction" in scored.columns:
        p = vector_to_array("rawPrediction")
        columns += [F.get(p, F.lit(i)).alias(f"p{i}") for i in range(n_classes)]
    return scored.select(*keep, *columns)


def metric_table(scored: DataFrame, task: str, n_classes: int = 2, by: Sequence[str] = (), only: str | None = None) -> DataFrame:
    """One row of metrics per group; classes ranked by score add ROC AUC.

    With ``only``, a metric of either kind, the other kind is left out where it would be worked out for nothing.
    """
    if task == "regression":
        return regression_metrics(scored, with_median=False, by=by)
    result = class_metrics(scored, by=by)
    if "p1" not in scored.columns or only in result.columns:
        return result
    if n_classes == 2 and only in ("roc_auc", "average_precision"):
        return ranking_metrics(scored, F.col("y_true") == 1.0, F.col("p1"), by).select(*by, "roc_auc", "average_precision")
    if n_classes == 2:
        ranked = ranking_metrics(scored, F.col("y_true") == 1.0, F.col("p1"), by).select(*by, "roc_auc", "average_precision")
    elif not by:
        ranked = roc_auc_ovr(scored, {float(i): F.col(f"p{i}") for i in range(n_classes)}).withColumnRenamed("roc_auc_ovr", "roc_auc")
    else:
        return result
    # One row per group on both sides.
    return result.join(ranked, list(by)) if by else result.withColumns({
        c: F.lit(v).cast("double") for c, v in ranked.first().asDict().items()})


def importances(model, features: Sequence[str], spark) -> DataFrame:
    """(feature, importance), largest first: tree gain, or mean absolute coefficient over classes."""
    if hasattr(model, "featureImportances"):
        weights = model.featureImportances.toArray()
    elif hasattr(model, "coefficientMatrix"):
        weights = abs(model.coefficientMatrix.toArray()).mean(axis=0)
    elif hasattr(model, "coefficients"):
        weights = abs(model.coefficients.toArray())
    elif hasattr(model, "models"):
        weights = sum(m.featureImportances.toArray() for m in model.models) / len(model.models)
    else:
        raise ValueError("the model has no importances")
    rows = [(f, float(w)) for f, w in zip(features, weights, strict=True)]
    return small_frame(spark, rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")

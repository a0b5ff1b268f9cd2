"""Blending and stacking of scored models."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators.split import kfold, stratified_kfold
from tablewright.session import hold
from tablewright.sources.stored_plans import storable


def weighted_average(columns: Sequence[Column], weights: Sequence[float] | None = None) -> Column:
    weights = list(weights or [1.0] * len(columns))
    total = sum(weights)
    return reduce(lambda a, b: a + b, [F.lit(w) * c for w, c in zip(weights, columns, strict=True)]) / F.lit(total)


def blend(df: DataFrame, probabilities: dict[object, Sequence[Column]], weights: Sequence[float] | None = None) -> DataFrame:
    """Average class probabilities of several models; the class is the most probable one.

    Probabilities are averaged, not labels; ties go to the first class.
    """
    classes = list(probabilities)
    out = df.withColumns({f"proba_class_{c}": weighted_average(p, weights) for c, p in probabilities.items()})
    best = F.greatest(*[F.col(f"proba_class_{c}") for c in classes]) if len(classes) > 1 else F.col(f"proba_class_{classes[0]}")
    prediction = F.lit(classes[-1])
    for c in reversed(classes[:-1]):
        prediction = F.when(F.col(f"proba_class_{c}") == best, F.lit(c)).otherwise(prediction)
    return out.withColumn("prediction", prediction)


def model_scores(model, df: DataFrame, classification: bool, prefix: str, n_classes: int) -> DataFrame:
    """Add the model's outputs as plain columns and drop its own."""
    scored = model.transform(df)
    if classification:
        p = vector_to_array("probability")
        columns = [F.get(p, F.lit(i)).alias(f"{prefix}_{i}") for i in range(n_classes)]
    else:
        columns = [F.col("prediction").alias(prefix)]
    return scored.select(*df.columns, *columns)


@storable(fields=("bases", "meta", "classification", "n_classes", "passthrough"))
class StackedModel:
    """Base models, and a meta-learner over their out-of-fold scores."""

    def __init__(self, bases, meta, classification: bool, n_classes: int, passthrough: Sequence[str]):
        self.bases, self.meta = bases, meta
        self.classification, self.n_classes, self.passthrough = classification, n_classes, tuple(passthrough)

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for i, model in enumerate(self.bases):
            out = model_scores(model, out, self.classification, f"_base{i}", self.n_classes)
        out = VectorAssembler(inputCols=_score_columns(out, self.passthrough), outputCol="_meta").transform(out)
        return self.meta.transform(out).drop("_meta", *[c for c in out.columns if c.startswith("_base")])


def _score_columns(df: DataFrame, passthrough: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c.startswith("_base")] + list(passthrough)


def fit_stack(df: DataFrame, key: str, estimators: Sequence[Callable[[], object]], classification: bool, n_classes: int = 2,
              folds: int = 5, label: str = "label", passthrough: Sequence[str] = (), fit_all: Callable | None = None,
              folded: DataFrame | None = None, left_out: Sequence[dict[int, object]] = (), whole: Sequence[object] = ()) -> StackedModel:
    """Out-of-fold scores of every base model train the meta-learner; bases are refitted on all rows.

    The rows carry ``features`` and ``label``. Scores are added to the rows themselves,
    so combining models needs no join. ``fit_all`` may fit several estimators at once.
    ``folded`` are the same rows where the folds are known already, ``left_out`` each estimator's
    models by the fold they have not seen and ``whole`` those of all rows (or None): only the others are fitted.
    """
    run = fit_all or (lambda jobs: [job() for job in jobs])
    if folded is None:
        folded = hold(stratified_kfold(df, key, label, folds) if classification else kfold(df, key, folds))
    m = len(estimators)
    known: dict[tuple[int | None, int], object] = {(k, i): model for i, models in enumerate(left_out) for k, model in models.items()}
    known.update({(None, i): model for i, model in enumerate(whole) if model is not None})
    open_ = [(k, i) for k in (*range(folds), None) for i in range(m) if (k, i) not in known]
    known.update(zip(open_, run([
        lambda k=k, make=estimators[i]: make().fit(folded if k is None else folded.where(F.col("fold") != k)) for k, i in open_]), strict=True))
    parts = []
    for k in range(folds):
        part = folded.where(F.col("fold") == k)
        for i in range(m):
            part = model_scores(known[k, i], part, classification, f"_base{i}", n_classes)
        parts.append(part)
    scores = reduce(DataFrame.unionByName, parts)
    rows = VectorAssembler(inputCols=_score_columns(scores, passthrough), outputCol="_meta").transform(scores)
    meta = LogisticRegression(featuresCol="_meta", labelCol=label, regParam=0.001) if classification else LinearRegression(
        featuresCol="_meta", labelCol=label, elasticNetParam=0.0, regParam=0.001)
    return StackedModel([known[None, i] for i in range(m)], meta.fit(rows), classification, n_classes, passthrough)

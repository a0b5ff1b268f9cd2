"""Quality metrics of predictions.

Class metrics come from one table of counts per (truth, prediction); ranking metrics
from counts per distinct score and running sums; regression metrics from one aggregate
(medians by exact selection). Nothing is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators.order import quantiles, running_sums

EPSILON = 2.220446049250313e-16

# Which metrics improve when they grow.
HIGHER_IS_BETTER = {
    "accuracy": True, "balanced_accuracy": True, "precision": True, "recall": True, "f1": True,
    "mcc": True, "cohen_kappa": True, "roc_auc": True, "average_precision": True, "log_loss": False,
    "brier": False, "rmse": False, "mse": False, "mae": False, "median_ae": False, "mape": False,
    "r2": True, "explained_variance": True, "max_error": False,
}


def signed(metric: str, value: float | None) -> float | None:
    """The value turned so that larger is better."""
    return value if value is None or HIGHER_IS_BETTER[metric] else -value


def confusion_counts(df: DataFrame, truth: str = "y_true", predicted: str = "y_pred", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, F.col(truth).alias("y_true"), F.col(predicted).alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, labels: Sequence | None = None, truth: str = "y_true", predicted: str = "y_pred",
                     max_labels: int = 1_000) -> DataFrame:
    """Rows = truth, one column per predicted label, over the sorted union of labels."""
    counts = confusion_counts(df, truth, predicted)
    union = counts.select(F.explode(F.array("y_true", "y_pred")).alias("label")).distinct()
    if labels is None:
        found = [r["label"] for r in union.limit(max_labels + 1).collect()]
        if len(found) > max_labels:
            raise ValueError(f"more than {max_labels} labels")
        labels = sorted(found)
    pivoted = counts.groupBy("y_true").agg(*[
        F.coalesce(F.sum(F.when(F.col("y_pred") == label, F.col("n"))), F.lit(0)).alias(f"pred_{label}") for label in labels])
    rows = df.sparkSession.createDataFrame([(x,) for x in labels], counts.select("y_true").schema)
    return rows.join(pivoted, "y_true", "left").fillna(0)


def _by_class(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per class: true rows t, predicted rows p, hits; still one small row per class."""
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(F.lit(0).cast("bigint"))
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("y_true").alias("class"), F.col("n").alias("t"), zero.alias("p"), hit.alias("hit")),
        F.struct(F.col("y_pred").alias("class"), zero.alias("t"), F.col("n").alias("p"), zero.alias("hit")),
    )
    return counts.select(*by, F.inline(sides)).groupBy(*by, "class").agg(
        F.sum("t").cast("double").alias("t"), F.sum("p").cast("double").alias("p"), F.sum("hit").cast("double").alias("hit"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def class_metrics(df: DataFrame, truth: str = "y_true", predicted: str = "y_pred", by: Sequence[str] = ()) -> DataFrame:
    """accuracy, balanced accuracy, weighted precision / recall / F1, Matthews, kappa.

    ``by`` gives one row per group (split, fold, segment) from the same job.
    """
    classes = _by_class(confusion_counts(df, truth, predicted, by), by)
    t, p, hit = F.col("t"), F.col("p"), F.col("hit")
    precision, recall = _ratio(hit, p), _ratio(hit, t)
    f1 = _ratio(2.0 * hit, t + p)
    total, hits = F.sum(t), F.sum(hit)
    tt, pp, tp = F.sum(t * t), F.sum(p * p), F.sum(t * p)
    chance = F.try_divide(tp, total * total)
    accuracy = F.try_divide(hits, total)
    spread = F.sqrt((total * total - pp) * (total * total - tt))
    return classes.groupBy(*by).agg(
        accuracy.alias("accuracy"),
        F.avg(F.when(t > 0, recall)).alias("balanced_accuracy"),
        F.try_divide(F.sum(precision * t), total).alias("precision"),
        F.try_divide(F.sum(recall * t), total).alias("recall"),
        F.try_divide(F.sum(f1 * t), total).alias("f1"),
        _ratio(hits * total - tp, spread).alias("mcc"),
        F.try_divide(accuracy - chance, 1.0 - chance).alias("cohen_kappa"),
    )


def _score_counts(df: DataFrame, positive: Column, score: Column, by: Sequence[str]) -> DataFrame:
    """Positives and negatives per distinct score, best score first (``order`` ascending)."""
    return (
        df.select(*by, (-score).alias("order"), positive.cast("bigint").alias("_y"))
        .where(F.col("order").isNotNull() & F.col("_y").isNotNull())
        .groupBy(*by, "order")
        .agg(F.sum("_y").alias("pos"), F.sum(1 - F.col("_y")).alias("neg"))
    )


def ranking_metrics(df: DataFrame, positive: Column, score: Column, by: Sequence[str] = ()) -> DataFrame:
    """ROC AUC (ties count half) and average precision (step sum), with the support."""
    runs = running_sums(_score_counts(df, positive, score, by), by, "order", ["pos", "neg"])
    # Descending scores: the negatives ranked above a positive are those already run past.
    above = F.col("run_neg") - F.col("neg")
    beaten = F.sum(F.col("pos") * (above + F.col("neg") / 2.0))
    pos, neg = F.sum("pos"), F.sum("neg")
    precision = F.col("run_pos") / (F.col("run_pos") + F.col("run_neg"))
    return runs.groupBy(*by).agg(
        (1.0 - F.try_divide(beaten, pos.cast("double") * neg)).alias("roc_auc"),
        F.try_divide(F.sum(F.col("pos") * precision), pos.cast("double")).alias("average_precision"),
        pos.alias("n_pos"), neg.alias("n_neg"),
    )


def roc_auc_ovr(df: DataFrame, scores: dict[object, Column], truth: str = "y_true") -> DataFrame:
    """One class against the rest, weighted by class size; all classes in one long job."""
    cells = F.array(*[
        F.struct(F.lit(str(c)).alias("class"), (F.col(truth) == F.lit(c)).alias("hit"), s.cast("double").alias("score"))
        for c, s in scores.items()])
    long = df.select(F.inline(cells))
    per_class = ranking_metrics(long, F.col("hit"), F.col("score"), ["class"])
    return per_class.agg(
        F.try_divide(F.sum(F.col("roc_auc") * F.col("n_pos")), F.sum(F.when(F.col("roc_auc").isNotNull(), F.col("n_pos"))).cast("double"))
        .alias("roc_auc_ovr"))


def roc_points(df: DataFrame, positive: Column, score: Column) -> DataFrame:
    """(threshold, fpr, tpr): one point per distinct score."""
    counts = _score_counts(df, positive, score, [])
    runs = running_sums(counts, [], "order", ["pos", "neg"])
    total = runs.agg(F.max("run_pos").alias("p"), F.max("run_neg").alias("n")).first()
    return runs.select(
        (-F.col("order")).alias("threshold"),
        F.try_divide(F.col("run_neg"), F.lit(float(total["n"] or 0))).alias("fpr"),
        F.try_divide(F.col("run_pos"), F.lit(float(total["p"] or 0))).alias("tpr"),
    )


def log_loss(df: DataFrame, true_probability: Column, epsilon: float = EPSILON) -> DataFrame:
    """Mean of -ln p(truth), with probabilities kept off 0 and 1."""
    clipped = F.least(F.greatest(true_probability, F.lit(epsilon)), F.lit(1.0 - epsilon))
    return df.agg((-F.avg(F.log(clipped))).alias("log_loss"))


def regression_metrics(df: DataFrame, truth: str = "y_true", predicted: str = "y_pred", by: Sequence[str] = (),
                       with_median: bool = True) -> DataFrame:
    """rmse, mse, mae, mape, r2, explained variance, max error (and median error overall)."""
    y, e = F.col(truth).cast("double"), F.col(truth).cast("double") - F.col(predicted).cast("double")
    known = y.isNotNull() & e.isNotNull()
    rows = df.where(known).select(*by, y.alias("_y"), e.alias("_e"))
    y, e = F.col("_y"), F.col("_e")
    mse = F.avg(e * e)
    result = rows.groupBy(*by).agg(
        F.sqrt(mse).alias("rmse"), mse.alias("mse"), F.avg(F.abs(e)).alias("mae"),
        F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(EPSILON))).alias("mape"),
        (1.0 - F.try_divide(mse, F.var_pop(y))).alias("r2"),
        (1.0 - F.try_divide(F.var_pop(e), F.var_pop(y))).alias("explained_variance"),
        F.max(F.abs(e)).alias("max_error"),
    )
    if not with_median or by:
        return result
    middle = quantiles(rows, {"e": F.abs(e)}, [0.5])["e"][0]
    return result.withColumn("median_ae", F.lit(middle).cast("double"))


def long_form(row: DataFrame, by: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """One metrics row per group as (by..., metric, value)."""
    names = [c for c in row.columns if c not in by]
    value = (lambda c: F.round(c, digits)) if digits is not None else F.col
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), value(c).cast("double").alias("value")) for c in names])
    return row.select(*by, F.inline(cells))


def evaluate(df: DataFrame, task: str, score: Column | None = None, positive: Column | None = None,
             truth: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """All metrics of the task as (metric, value)."""
    if task == "regression":
        return long_form(regression_metrics(df, truth, predicted))
    if task != "classification":
        raise ValueError(f"unknown task {task!r}")
    result = long_form(class_metrics(df, truth, predicted))
    if score is not None:
        positive = positive if positive is not None else F.col(truth) == 1
        ranking = ranking_metrics(df, positive, score).select("roc_auc", "average_precision")
        result = result.unionByName(long_form(ranking))
        result = result.unionByName(long_form(log_loss(df, F.when(positive, score).otherwise(1.0 - score))))
    return result


def fold_summary(per_fold: DataFrame, fold: str = "fold") -> DataFrame:
    """Mean and population deviation of every metric over the folds."""
    return long_form(per_fold, [fold]).groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))

"""Metrics per sensitive group and their spread between groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def group_metrics(df: DataFrame, features: Sequence[str], truth: str = "y_true", predicted: str = "y_pred",
                  positive: object = 1) -> DataFrame:
    """(feature, group, n, accuracy, selection_rate); features that are absent are skipped.

    All features are grouped in one long job with map-side combine.
    """
    present = [f for f in features if f in df.columns]
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("group")) for f in present])
    hit = (F.col(truth) == F.col(predicted)).cast("double")
    chosen = (F.col(predicted) == F.lit(positive)).cast("double")
    return (
        df.select(hit.alias("_hit"), chosen.alias("_chosen"), F.inline(cells)).where(F.col("group").isNotNull())
        .groupBy("feature", "group")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("_hit").alias("accuracy"), F.avg("_chosen").alias("selection_rate"))
    )


def _spread(groups: DataFrame, difference: bool) -> DataFrame:
    def spread(c: str):
        return F.max(c) - F.min(c) if difference else F.try_divide(F.min(c), F.max(c))

    return groups.groupBy("feature").agg(
        spread("accuracy").alias("accuracy"), spread("selection_rate").alias("selection_rate"))


def group_difference(groups: DataFrame) -> DataFrame:
    """Largest minus smallest group value per feature."""
    return _spread(groups, True)


def group_ratio(groups: DataFrame) -> DataFrame:
    """Smallest over largest group value per feature; of selection rates: disparate impact."""
    return _spread(groups, False)


def accuracy_report(groups: DataFrame) -> DataFrame:
    """Spread of accuracies alone: ratio (null if all are 0) and difference."""
    return groups.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.try_divide(F.min("accuracy"), F.max("accuracy")).alias("disparate_impact_ratio"),
        (F.max("accuracy") - F.min("accuracy")).alias("accuracy_difference"))

"""Calibration of probabilities: Brier score, curve, error, isotonic and sigmoid maps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.sources.stored_plans import storable


def brier(df: DataFrame, truth: str = "y_true", score: str = "score") -> DataFrame:
    gap = F.col(score) - F.col(truth).cast("double")
    return df.agg(F.avg(gap * gap).alias("brier"))


def uniform_bin(score: Column, bins: int = 10) -> Column:
    """Number of inner edges strictly below the score: an edge belongs to the lower bin."""
    return sum(((score > i / bins).cast("int") for i in range(1, bins)), F.lit(0))


def curve(df: DataFrame, truth: str = "y_true", score: str = "score", bins: int = 10) -> DataFrame:
    """(bin, mean_score, positive_share, n) of the bins that hold any row."""
    return df.groupBy(uniform_bin(F.col(score), bins).alias("bin")).agg(
        F.avg(score).alias("mean_score"), F.avg(F.col(truth).cast("double")).alias("positive_share"),
        F.count(F.lit(1)).alias("n"))


def calibration_error(df: DataFrame, truth: str = "y_true", score: str = "score", bins: int = 10) -> DataFrame:
    """Mean gap over the bins, plain and weighted by rows."""
    gap = F.abs(F.col("positive_share") - F.col("mean_score"))
    return curve(df, truth, score, bins).agg(
        F.avg(gap).alias("ece"), F.try_divide(F.sum(gap * F.col("n")), F.sum("n").cast("double")).alias("ece_weighted"))


@storable
@dataclass(frozen=True)
class Calibrator:
    """A fitted map from raw score to probability."""

    model: object
    method: str
    score: str

    def transform(self, df: DataFrame, output: str = "calibrated") -> DataFrame:
        if self.method == "isotonic":
            return self.model.transform(df).withColumnRenamed("prediction", output)
        rows = VectorAssembler(inputCols=[self.score], outputCol="_v").transform(df)
        scored = self.model.transform(rows).withColumn(output, F.get(vector_to_array("probability"), F.lit(1)))
        return scored.select(*df.columns, output)


def fit_calibrator(df: DataFrame, method: str = "isotonic", truth: str = "y_true", score: str = "score") -> Calibrator:
    """Fit on held-out scores.

    Isotonic regression sees one weighted row per distinct score, so that repeated
    scores do not enlarge its input.
    """
    if method == "isotonic":
        grouped = df.groupBy(score).agg(
            F.avg(F.col(truth).cast("double")).alias("_label"), F.count(F.lit(1)).cast("double").alias("_weight"))
        model = IsotonicRegression(featuresCol=score, labelCol="_label", weightCol="_weight").fit(grouped)
    elif method == "sigmoid":
        rows = VectorAssembler(inputCols=[score], outputCol="_v").transform(
            df.select(score, F.col(truth).cast("double").alias("_label")))
        model = LogisticRegression(featuresCol="_v", labelCol="_label", regParam=0.0).fit(rows)
    else:
        raise ValueError(f"unknown method {method!r}")
    return Calibrator(model, method, score)

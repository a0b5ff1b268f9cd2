"""Error analysis: overall error, worst rows, error per feature quintile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators.order import quantiles
from tablewright.operators.schema import numeric_columns


def error_column(task: str, truth: str = "y_true", predicted: str = "y_pred") -> Column:
    """1 for a wrong class; absolute error for a number."""
    if task == "classification":
        return (F.col(truth) != F.col(predicted)).cast("double")
    return F.abs(F.col(truth).cast("double") - F.col(predicted).cast("double"))


def overall_error(df: DataFrame, task: str, truth: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    return df.agg(F.avg(error_column(task, truth, predicted)).alias("error"), F.count(F.lit(1)).alias("n"))


def worst_rows(df: DataFrame, task: str, key: Sequence[str], n: int = 20, truth: str = "y_true",
               predicted: str = "y_pred") -> DataFrame:
    """The n largest errors, ties by key: a top-k, not a sort of the table."""
    return df.withColumn("error", error_column(task, truth, predicted)).orderBy(F.desc("error"), *key).limit(n)


def error_by_bucket(df: DataFrame, task: str, columns: Sequence[str] | None = None, buckets: int = 5,
                    truth: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """(feature, bucket, low, high, mean_error, n) for exact quintiles of each feature.

    Equal edges are merged; a bucket is open on the left, the first one also includes
    its low edge. All features are counted in one long job.
    """
    columns = list(columns or [c for c in numeric_columns(df) if c not in (truth, predicted)])
    values = {c: F.col(c).cast("double") for c in columns}
    edges = {
        c: sorted({e for e in q if e is not None})
        for c, q in quantiles(df, values, [i / buckets for i in range(buckets + 1)]).items()
    }
    cells = []
    for c in columns:
        inner = edges[c][1:-1]
        bucket = sum(((values[c] > e).cast("int") for e in inner), F.lit(0))
        cells.append(F.struct(F.lit(c).alias("feature"), F.when(values[c].isNotNull(), bucket).alias("bucket"),
                              error_column(task, truth, predicted).alias("error")))
    edge_map = F.create_map(*[x for c in columns for x in (F.lit(c), F.array(*[F.lit(float(e)) for e in edges[c]]))])
    bounds = edge_map[F.col("feature")]
    return (
        df.select(F.inline(F.array(*cells))).where(F.col("bucket").isNotNull())
        .groupBy("feature", "bucket").agg(F.avg("error").alias("mean_error"), F.count(F.lit(1)).alias("n"))
        .select("feature", "bucket", F.get(bounds, F.col("bucket")).alias("low"),
                F.coalesce(F.get(bounds, F.col("bucket") + 1), F.get(bounds, F.col("bucket"))).alias("high"), "mean_error", "n")
    )

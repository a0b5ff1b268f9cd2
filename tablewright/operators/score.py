"""Batch scoring of tables and JSON records."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def linear_scores(df: DataFrame, coefficients: dict[str, float], intercept: float = 0.0, output: str = "score") -> DataFrame:
    """A fixed linear scorer as one column expression; missing inputs count as 0."""
    total = F.lit(intercept)
    for c, w in coefficients.items():
        total = total + F.lit(w) * F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return df.withColumn(output, total)


def logistic_scores(df: DataFrame, coefficients: dict[str, float], intercept: float = 0.0, threshold: float = 0.5) -> DataFrame:
    """prediction and proba_class_0 / proba_class_1 of a fixed logistic scorer."""
    scored = linear_scores(df, coefficients, intercept, "_z")
    p = 1.0 / (1.0 + F.exp(-F.col("_z")))
    return scored.withColumn("proba_class_1", p).withColumn("proba_class_0", 1.0 - F.col("proba_class_1")).withColumn(
        "prediction", (F.col("proba_class_1") > threshold).cast("int")).drop("_z")


def score_batch(df: DataFrame, model, features=None, n_classes: int = 0, path: str | None = None, fmt: str = "csv") -> DataFrame:
    """features.transform -> model.transform -> prediction (and probabilities); optionally written.

    One narrow job, whatever the size of the input. With a path, the written rows are returned,
    so that scoring does not run again.
    """
    prepared = features.transform(df) if features is not None else df
    scored = model.transform(prepared)
    kept = [c for c in scored.columns if not isinstance(scored.schema[c].dataType, _vector_type())]
    columns = [F.col(f"`{c}`") for c in kept]
    if n_classes and "probability" in scored.columns:
        p = vector_to_array("probability")
        columns += [F.get(p, F.lit(i)).alias(f"proba_class_{i}") for i in range(n_classes)]
    result = scored.select(*columns)
    if path is not None:
        spark, as_csv = df.sparkSession, fmt == "csv"
        writer, reader = result.write.mode("overwrite").format(fmt), spark.read.format(fmt).schema(result.schema)
        (writer.option("header", True) if as_csv else writer).save(path)
        return (reader.option("header", True) if as_csv else reader).load(path)
    return result


def _vector_type():
    from pyspark.ml.linalg import VectorUDT

    return VectorUDT


def parse_records(df: DataFrame, column: str, schema: T.StructType | str) -> DataFrame:
    """JSON records in a text column to columns of the fitted input schema."""
    return df.withColumn("_record", F.from_json(column, schema)).select(*df.columns, "_record.*")

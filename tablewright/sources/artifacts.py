"""Feature tables, the run registry, load metadata and table fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.quality import distinct_row_count

REGISTRY_SCHEMA = "run_id string, kind string, name string, value string, ts timestamp"


def save_feature_table(df: DataFrame, root: str, name: str, split_column: str = "split") -> str:
    """Store a feature table partitioned by split; readers prune to the split asked for."""
    path = f"{root.rstrip('/')}/{name}"
    df.write.mode("overwrite").partitionBy(split_column).parquet(path)
    return path


def load_feature_table(spark: SparkSession, root: str, name: str, split: str | None = None,
                       split_column: str = "split") -> DataFrame:
    """Read a stored feature table; a missing table or split is an error."""
    path = f"{root.rstrip('/')}/{name}"
    df = spark.read.parquet(path)
    if split is None:
        return df
    part = df.where(F.col(split_column) == split)
    if part.isEmpty():
        raise FileNotFoundError(f"feature table {name!r} has no split {split!r}")
    return part.drop(split_column)


def record_run(spark: SparkSession, path: str, run_id: str, kind: str, values: dict[str, object]) -> None:
    """Append one run's names and values (parameters, metrics, features) to the registry."""
    rows = [(run_id, kind, name, None if v is None else str(v)) for name, v in values.items()]
    frame = spark.createDataFrame(rows, "run_id string, kind string, name string, value string")
    frame.withColumn("ts", F.current_timestamp()).write.mode("append").parquet(path)


def latest_entries(registry: DataFrame, entity: str, order: list[str], columns: list[str]) -> DataFrame:
    """The newest record of every entity, as a map-side combined ``max_by``."""
    newest = F.max_by(F.struct(*columns), F.struct(*order)).alias("_latest")
    return (
        registry.groupBy(entity).agg(newest, F.count(F.lit(1)).alias("n_entries"))
        .select(entity, *[F.col(f"_latest.{c}").alias(c) for c in columns], "n_entries")
    )


def delete_entries(registry: DataFrame, entity: str, names: list[str]) -> DataFrame:
    """The registry without the named entities; write it to a new version of the table."""
    return registry.where(~F.col(entity).isin(names))


def save_fitted(model, path: str) -> None:
    """Store a fitted Spark ML model beside the registry, replacing an older copy."""
    model.write().overwrite().save(path)


def load_metadata(df: DataFrame) -> DataFrame:
    """One row about a loaded table: shape, names, types, missing cells, duplicate rows."""
    nulls = sum((F.col(c).isNull().cast("bigint") for c in df.columns), F.lit(0).cast("bigint"))
    counted = distinct_row_count(df, extra=[nulls.alias("_nulls")])
    cells = F.col("n_rows") * len(df.columns)
    return counted.select(
        "n_rows",
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        F.lit(",".join(df.columns)).alias("column_names"),
        F.lit(",".join(f.dataType.simpleString() for f in df.schema.fields)).alias("dtypes"),
        F.col("_nulls").alias("null_count"),
        F.coalesce(F.round(F.try_divide(F.col("_nulls") * 100.0, cells), 2), F.lit(0.0)).alias("null_pct"),
        (F.col("n_rows") - F.col("n_distinct")).alias("duplicate_rows"),
    )


def table_fingerprint(df: DataFrame) -> DataFrame:
    """A content hash that ignores row order and partitioning.

    Every row's md5 prefix is summed exactly; doubles enter as DECIMAL, whose text
    form is the same in every engine.
    """
    texts = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            column = column.cast("decimal(28,6)")
        texts.append(F.coalesce(column.cast("string"), F.lit("<null>")))
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", *texts)), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.coalesce(F.sum(digest), F.lit(0).cast("decimal(38,0)")).cast("string").alias("fingerprint"),
    )

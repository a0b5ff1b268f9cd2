"""Schema rules: column kinds, downcast, size, categorical candidates, task inference."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.session import spread

# Inclusive limits of the signed integer widths, narrowest first.
INTEGER_WIDTHS = (
    ("tinyint", -128, 127),
    ("smallint", -32768, 32767),
    ("int", -2147483648, 2147483647),
    ("bigint", -9223372036854775808, 9223372036854775807),
)
FLOAT_LIMIT = 3.4028234663852886e38

# Bytes held by one value of a fixed-width type.
_WIDTHS = {
    T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8,
    T.FloatType: 4, T.DoubleType: 8, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8,
}


def numeric_columns(df: DataFrame) -> list[str]:
    """Numbers only: booleans and dates are not numbers here."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def datetime_columns(df: DataFrame) -> list[str]:
    kinds = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def select_kind(df: DataFrame, kind: str) -> DataFrame:
    """Project the columns of one kind: ``numeric``, ``string`` or ``datetime``."""
    pick = {"numeric": numeric_columns, "string": string_columns, "datetime": datetime_columns}
    if kind not in pick:
        raise ValueError(f"unknown kind {kind!r}")
    return df.select(*pick[kind](df))


def drop_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.drop(*names)


def downcast_plan(df: DataFrame, narrow_floats: bool = False) -> DataFrame:
    """Per numeric column the narrowest type that holds its range, in one aggregate job.

    Doubles keep their type unless ``narrow_floats`` (float32 loses precision).
    """
    spark = df.sparkSession
    fields = [f for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    if not fields:
        return spark.createDataFrame([], "column string, from_type string, to_type string")
    limits = df.agg(*[a for i, f in enumerate(fields) for a in
                      (F.min(f.name).alias(f"lo{i}"), F.max(f.name).alias(f"hi{i}"))]).first()
    rows = []
    for i, field in enumerate(fields):
        low, high = limits[f"lo{i}"], limits[f"hi{i}"]
        source = field.dataType.simpleString()
        target = source
        if low is not None and isinstance(field.dataType, T.IntegralType):
            target = next(t for t, lo, hi in INTEGER_WIDTHS if lo <= low and high <= hi)
        elif narrow_floats and low is not None and isinstance(field.dataType, T.DoubleType):
            target = "float" if max(abs(low), abs(high)) <= FLOAT_LIMIT else source
        rows.append((field.name, source, target))
    return spark.createDataFrame(rows, "column string, from_type string, to_type string")


def apply_downcast(df: DataFrame, plan: DataFrame) -> DataFrame:
    """Cast as planned; the plan has one row per column."""
    target = {r["column"]: r["to_type"] for r in plan.collect()}
    return df.select(*[F.col(c).cast(target[c]).alias(c) if c in target else F.col(c) for c in df.columns])


def size_estimate(df: DataFrame) -> DataFrame:
    """Bytes per column: text by its length in bytes, the rest by its width."""
    aggs = []
    for i, field in enumerate(df.schema.fields):
        if isinstance(field.dataType, T.StringType):
            size = F.coalesce(F.sum(F.octet_length(field.name)), F.lit(0))
        else:
            size = F.count(F.lit(1)) * _WIDTHS.get(type(field.dataType), 8)
        aggs.append(F.struct(F.lit(field.name).alias("column"), size.cast("bigint").alias("bytes")))
    return (
        df.agg(F.array(*aggs).alias("_sizes")).select(F.inline("_sizes"))
        .withColumn("mb", F.round(F.col("bytes") / (1024.0 * 1024.0), 6))
    )


def distinct_counts(df: DataFrame, columns: list[str], tag: str = "column") -> DataFrame:
    """Exact distinct non-null values per column: (column, n_distinct).

    Columns are unpivoted to ``(position, value)`` and combined map-side twice, so a
    wide table needs one job and a frequent value costs no more than a rare one.
    """
    return (
        value_counts(df, columns)
        .groupBy("column").agg(F.count("value").alias("n_distinct"))
        .withColumnRenamed("column", tag)
    )


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows per (column, value as text); missing values are counted under NULL."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), _as_text(df, c).alias("value")) for c in columns
    ])
    return spread(df.select(*columns)).select(F.inline(cells)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def _as_text(df: DataFrame, column: str):
    value = F.col(column)
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        value = F.when(~F.isnan(value), value)
    return value.cast("string")


def categorical_candidates(df: DataFrame, max_distinct: int = 50) -> DataFrame:
    """Text columns with few distinct values, flagged for nominal treatment."""
    return distinct_counts(df, string_columns(df)).withColumn(
        "is_categorical", F.col("n_distinct") <= max_distinct
    )


def infer_task(df: DataFrame, targets: list[str], max_classes: int = 20) -> DataFrame:
    """Few distinct target values mean classification, many mean regression."""
    return distinct_counts(df, targets, tag="target").withColumn(
        "task", F.when(F.col("n_distinct") <= max_classes, "classification").otherwise("regression")
    )


def infer_task_by_type(df: DataFrame, target: str, max_classes: int = 10) -> str:
    """The looser rule for interactive use: numeric and many values mean regression."""
    if target not in numeric_columns(df):
        return "classification"
    distinct = distinct_counts(df, [target]).first()["n_distinct"]
    return "regression" if distinct > max_classes else "classification"


def small_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A result table built on the driver from a bounded number of rows."""
    return spark.createDataFrame(rows, schema)

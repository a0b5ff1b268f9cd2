"""Semantic column types, decided by rules over one row of statistics per column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.order import clean_number
from tablewright.operators.schema import distinct_counts

# Text forms of dates that are recognised.
DATE_PATTERNS = (
    "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy",
)
DATE_START = r"^\s*\d{1,4}[-/]\d{1,2}[-/]\d{1,4}"


def parse_datetime(column: Column, patterns: tuple[str, ...] = DATE_PATTERNS) -> Column:
    """Text to TIMESTAMP; what no pattern fits is NULL.

    Only text that starts like a date is tried: failed attempts are the slow part.
    """
    tries = [F.try_to_timestamp(column), *[F.try_to_timestamp(column, F.lit(p)) for p in patterns]]
    return F.when(column.rlike(DATE_START), F.coalesce(*tries))


def detect_types(
    df: DataFrame,
    target: str | None = None,
    max_low: int = 50,
    id_share: float = 0.95,
    id_min: int = 100,
    text_length: float = 20.0,
    date_share: float = 0.80,
) -> DataFrame:
    """(column, semantic_type): one aggregate job plus one distinct count for all columns.

    Date strings are judged on all values rather than on the first few, so the answer
    does not depend on row order.
    """
    kinds, cells = {}, []
    for field in df.schema.fields:
        column, kind = F.col(field.name), _physical(field.dataType)
        kinds[field.name] = kind
        nothing = F.lit(None)
        binary, whole, length, dates = nothing.cast("boolean"), nothing.cast("boolean"), \
            nothing.cast("double"), nothing.cast("double")
        value = column
        if kind == "numeric":
            value = clean_number(column, field.dataType)
            binary, whole = F.bool_and(value.isin(0, 1)), F.bool_and(value == F.floor(value))
        elif kind == "text":
            length = F.avg(F.length(column).cast("double"))
            dates = F.avg(parse_datetime(column).isNotNull().cast("double") + F.when(column.isNull(), None).otherwise(0.0))
        cells.append(F.struct(
            F.lit(field.name).alias("column"), F.lit(kind).alias("kind"),
            F.count(value).alias("n"), binary.alias("binary"), whole.alias("whole"),
            length.alias("length"), dates.alias("dates"),
        ))
    stats = df.agg(F.array(*cells).alias("_cells")).select(F.inline("_cells"))
    facts = stats.join(distinct_counts(df, df.columns), "column")

    distinct, kind = F.col("n_distinct"), F.col("kind")
    looks_id = (distinct >= id_share * F.col("n")) & (distinct > id_min)
    numeric = (
        F.when(F.col("binary"), "boolean")
        .when(looks_id, "id")
        .when(F.col("whole") & (distinct <= max_low), "numeric_discrete")
        .otherwise("numeric_continuous")
    )
    text = (
        F.when(F.col("dates") >= date_share, "datetime")
        .when(looks_id, "id")
        .when((F.col("length") > text_length) & (distinct > max_low), "text")
        .when(distinct <= max_low, "categorical_low")
        .otherwise("categorical_high")
    )
    semantic = (
        F.when(distinct <= 1, "constant")
        .when(kind == "boolean", "boolean")
        .when(kind == "datetime", "datetime")
        .when(kind == "numeric", numeric)
        .when(kind == "text", text)
        .otherwise("unknown")
    )
    if target is not None:
        semantic = F.when(F.col("column") == target, "target").otherwise(semantic)
    return facts.select("column", semantic.alias("semantic_type"))


def columns_of_type(types: DataFrame, *wanted: str) -> list[str]:
    """Names of the columns of the wanted types (one row per column: a small collect)."""
    return [r["column"] for r in types.where(F.col("semantic_type").isin(*wanted)).collect()]


def _physical(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(data_type, T.NumericType):
        return "numeric"
    return "text" if isinstance(data_type, T.StringType) else "unknown"

"""Filling missing values: constants fitted in one pass, neighbours, chained regressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.chained import ChainedFill, fit_chained
from tablewright.operators.neighbours import NeighbourFill, fit_neighbours
from tablewright.operators.order import clean_number, quantiles
from tablewright.operators.quality import missing
from tablewright.operators.schema import numeric_columns, value_counts
from tablewright.sources.stored_plans import storable

__all__ = ["ChainedFill", "FilledValues", "NeighbourFill", "fit_chained", "fit_fill", "fit_neighbours", "modes", "nulls_remaining"]

NUMERIC_STRATEGIES = ("mean", "median", "zero", "constant", "knn", "iterative", "none")
CATEGORICAL_STRATEGIES = ("most_frequent", "constant", "none")


def _value(df: DataFrame, column: str) -> Column:
    return F.when(~missing(df, column), F.col(column))


@storable
@dataclass(frozen=True)
class FilledValues:
    """Fill value per column; a column with nothing to learn from stays missing."""

    fills: dict[str, object]
    indicators: tuple[str, ...] = ()

    def transform(self, df: DataFrame) -> DataFrame:
        columns = []
        for name in df.columns:
            fill = self.fills.get(name)
            if fill is None:
                columns.append(_value(df, name).alias(name))
            else:
                data_type = df.schema[name].dataType
                if isinstance(data_type, T.IntegralType) and float(fill) != int(fill):
                    data_type = T.DoubleType()
                columns.append(F.coalesce(_value(df, name), F.lit(fill)).cast(data_type).alias(name))
        marks = [missing(df, c).cast("int").alias(f"{c}__missing") for c in self.indicators]
        return df.select(*columns, *marks)


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """Most frequent value per column as text, ties to the smallest."""
    if not columns:
        return {}
    counts = value_counts(df, list(columns)).where(F.col("value").isNotNull())
    best = counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("order"), "value"))["value"].alias("value"))
    found = {r["column"]: r["value"] for r in best.collect()}
    return {c: found.get(c) for c in columns}


def _typed(df: DataFrame, column: str, text: str | None) -> object:
    data_type = df.schema[column].dataType
    if text is None or isinstance(data_type, T.StringType):
        return text
    if isinstance(data_type, T.BooleanType):
        return text == "true"
    return df.sparkSession.range(1).select(F.lit(text).cast(data_type).alias("v")).first()["v"]


def fit_fill(
    df: DataFrame,
    numeric: str = "median",
    categorical: str = "most_frequent",
    fill_value: object = None,
    columns: Sequence[str] | None = None,
    add_indicator: bool = False,
) -> FilledValues:
    """Learn fill values on one table to apply to any other.

    Numbers take mean, exact median, zero or a constant; every other type takes its
    most frequent value or a constant.
    """
    if numeric not in NUMERIC_STRATEGIES or categorical not in CATEGORICAL_STRATEGIES:
        raise ValueError(f"unknown strategy {numeric!r} / {categorical!r}")
    columns = list(columns or df.columns)
    numbers = [c for c in numeric_columns(df) if c in columns]
    others = [c for c in columns if c not in numbers]
    fills: dict[str, object] = {}
    if numbers:
        values = {c: clean_number(F.col(c), df.schema[c].dataType).cast("double") for c in numbers}
        if numeric == "mean":
            row = df.agg(*[F.avg(v).alias(c) for c, v in values.items()]).first()
            fills.update({c: row[c] for c in numbers})
        elif numeric == "median":
            fills.update({c: q[0] for c, q in quantiles(df, values, [0.5]).items()})
        elif numeric == "zero":
            fills.update(dict.fromkeys(numbers, 0.0))
        elif numeric == "constant":
            if isinstance(fill_value, bool) or not isinstance(fill_value, (int, float)):
                raise ValueError("a constant for numeric columns must be a number")
            fills.update(dict.fromkeys(numbers, float(fill_value)))
        elif numeric != "none":
            raise ValueError(f"{numeric!r} has its own fit: fit_neighbours / fit_chained")
    if categorical == "most_frequent":
        fills.update({c: _typed(df, c, v) for c, v in modes(df, others).items()})
    elif categorical == "constant":
        text = "MISSING" if fill_value is None or numeric == "constant" else str(fill_value)
        fills.update({c: text for c in others if isinstance(df.schema[c].dataType, T.StringType)})
    marks: tuple[str, ...] = ()
    if add_indicator:
        counted = df.agg(*[F.max(missing(df, c)).alias(c) for c in numbers]).first() if numbers else {}
        marks = tuple(c for c in numbers if counted[c])
    return FilledValues(fills, marks)


def nulls_remaining(df: DataFrame, columns: Sequence[str] | None = None) -> int:
    columns = list(columns or df.columns)
    gone = sum((missing(df, c).cast("bigint") for c in columns), F.lit(0).cast("bigint"))
    return df.agg(F.coalesce(F.sum(gone), F.lit(0)).alias("n")).first()["n"]

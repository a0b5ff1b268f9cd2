"""Calendar features as plain column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators.schema import datetime_columns, string_columns
from tablewright.operators.types import DATE_PATTERNS, parse_datetime

# The parts extracted by default and the periods of the cyclical ones.
DEFAULT_PARTS = (
    "year", "month", "day", "hour", "minute", "dayofweek", "quarter", "weekofyear",
    "is_weekend", "dayofyear", "days_in_month",
)
PERIODS = {"month": 12, "dayofweek": 7, "hour": 24, "minute": 60, "dayofyear": 365, "weekofyear": 52}


def _quarter_start(t: Column) -> Column:
    return F.trunc(t.cast("date"), "quarter")


PARTS = {
    "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute,
    "second": F.second, "dayofweek": F.weekday, "quarter": F.quarter, "weekofyear": F.weekofyear,
    "dayofyear": F.dayofyear,
    "days_in_month": lambda t: F.dayofmonth(F.last_day(t)),
    "is_weekend": lambda t: (F.weekday(t) >= 5).cast("int"),
    "is_month_start": lambda t: (F.dayofmonth(t) == 1).cast("int"),
    "is_month_end": lambda t: (t.cast("date") == F.last_day(t)).cast("int"),
    "is_quarter_start": lambda t: (t.cast("date") == _quarter_start(t)).cast("int"),
    "is_quarter_end": lambda t: (t.cast("date") == F.date_sub(F.add_months(_quarter_start(t), 3).cast("date"), 1)).cast("int"),
}


def part(time: Column, name: str) -> Column:
    """One calendar part as INT; NULL for a missing time."""
    if name not in PARTS:
        raise ValueError(f"unknown date part {name!r}; known: {sorted(PARTS)}")
    return PARTS[name](time).cast("int")


def date_features(df: DataFrame, columns: Sequence[str] | None = None, parts: Sequence[str] = DEFAULT_PARTS,
                  cyclical: bool = True, drop: bool = True) -> DataFrame:
    """Add ``{column}_{part}`` and, for periodic parts, ``_sin`` and ``_cos`` of them."""
    columns = list(columns if columns is not None else datetime_columns(df))
    added = []
    for column in columns:
        time = F.col(column)
        if column in string_columns(df):
            time = parse_datetime(time)
        for name in parts:
            value = part(time, name)
            added.append(value.alias(f"{column}_{name}"))
            if cyclical and name in PERIODS:
                angle = 2.0 * math.pi * value.cast("double") / float(PERIODS[name])
                added += [F.sin(angle).alias(f"{column}_{name}_sin"), F.cos(angle).alias(f"{column}_{name}_cos")]
    kept = [c for c in df.columns if not (drop and c in columns)]
    return df.select(*kept, *added)


def detect_date_columns(df: DataFrame, share: float = 0.80) -> DataFrame:
    """(column, parse_share, is_datetime): date types, and text that mostly parses as dates."""
    text, dates = string_columns(df), datetime_columns(df)
    cells = []
    for column in text + dates:
        if column in dates:
            rate = F.lit(1.0)
        else:
            parsed = F.when(F.col(column).isNotNull(), parse_datetime(F.col(column)).isNotNull().cast("double"))
            rate = F.coalesce(F.avg(parsed), F.lit(0.0))
        cells.append(F.struct(F.lit(column).alias("column"), rate.alias("parse_share")))
    return (
        df.agg(F.array(*cells).alias("_cells")).select(F.inline("_cells"))
        .withColumn("is_datetime", F.col("parse_share") >= share)
    )


__all__ = ["DATE_PATTERNS", "DEFAULT_PARTS", "PARTS", "PERIODS", "date_features", "detect_date_columns", "parse_datetime", "part"]

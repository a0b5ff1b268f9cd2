"""Data quality rules, gathered as findings; one aggregate job feeds most of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.operators.schema import distinct_counts, string_columns

FINDINGS_SCHEMA = "severity string, rule string, column string, value double"


@dataclass(frozen=True)
class Limits:
    """Thresholds of the rules."""

    min_rows: int = 100
    min_columns: int = 2
    max_null_share: float = 0.95
    max_duplicate_share: float = 0.50
    max_cardinality: int = 10_000


class QualityError(ValueError):
    """Raised when a report has errors and the caller asked for an exception."""


def missing(df: DataFrame, column: str) -> Column:
    """True where the value is NULL or NaN."""
    test = F.col(column).isNull()
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        test = test | F.isnan(column)
    return test


def distinct_row_count(df: DataFrame, extra: list[Column] | None = None) -> DataFrame:
    """One row (n_rows, n_distinct, sums of the extra columns); NULLs are equal.

    Identical rows are combined map-side, so a heavily repeated row moves once per task.
    """
    extra = extra or []
    keyed = df.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(df.columns)], *extra)
    names = keyed.columns[len(df.columns):]
    grouped = keyed.groupBy(*keyed.columns[: len(df.columns)]).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(n).alias(n) for n in names]
    )
    return grouped.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.count(F.lit(1)).alias("n_distinct"),
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names],
    )


def size_findings(n_rows: int, n_columns: int, limits: Limits = Limits()) -> list[tuple]:
    found = []
    if n_rows < limits.min_rows:
        found.append(("error", "insufficient_samples", None, float(n_rows)))
    if n_columns < limits.min_columns:
        found.append(("error", "insufficient_features", None, float(n_columns)))
    return found


def check_size(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Too few rows or columns."""
    found = size_findings(df.count(), len(df.columns), limits)
    return df.sparkSession.createDataFrame(found, FINDINGS_SCHEMA)


def column_facts(df: DataFrame) -> tuple[int, dict[str, tuple[int, bool]]]:
    """Row count and per column (missing count, is constant), in one aggregate job.

    Constancy needs no distinct count: the minimum equals the maximum.
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, column in enumerate(df.columns):
        gone = missing(df, column)
        value = F.when(~gone, F.col(column))
        aggs.append(F.coalesce(F.sum(gone.cast("bigint")), F.lit(0)).alias(f"m{i}"))
        aggs.append(F.coalesce(F.min(value) == F.max(value), F.lit(True)).alias(f"k{i}"))
    row = df.agg(*aggs).first()
    facts = {c: (row[f"m{i}"], row[f"k{i}"]) for i, c in enumerate(df.columns)}
    return row["n"], facts


def check_nulls(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Columns whose missing share is above the limit."""
    shares = df.agg(*[F.avg(missing(df, c).cast("double")).alias(c) for c in df.columns])
    cells = F.array(*[
        F.struct(F.lit("warning").alias("severity"), F.lit("high_null_column").alias("rule"),
                 F.lit(c).alias("column"), F.col(c).alias("value")) for c in df.columns
    ])
    return shares.select(F.inline(cells)).where(F.col("value") > limits.max_null_share)


def duplicate_summary(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Rows that repeat an earlier row, their share, and whether it is too high."""
    counted = distinct_row_count(df)
    repeats = F.col("n_rows") - F.col("n_distinct")
    share = F.coalesce(F.try_divide(repeats.cast("double"), F.col("n_rows").cast("double")), F.lit(0.0))
    return counted.select(
        "n_rows", repeats.alias("duplicate_rows"), share.alias("duplicate_share"),
        (share > limits.max_duplicate_share).alias("high_duplicates"),
    )


def check_constant(df: DataFrame) -> DataFrame:
    """Columns with at most one distinct value (entirely missing ones included)."""
    cells = []
    for column in df.columns:
        value = F.when(~missing(df, column), F.col(column))
        cells.append(F.struct(
            F.lit("warning").alias("severity"), F.lit("constant_column").alias("rule"),
            F.lit(column).alias("column"),
            F.coalesce(F.min(value) == F.max(value), F.lit(True)).alias("_constant"),
            F.when(F.count(value) > 0, 1.0).otherwise(0.0).alias("value"),
        ))
    return (
        df.agg(F.array(*cells).alias("_cells")).select(F.inline("_cells"))
        .where("_constant").select("severity", "rule", "column", "value")
    )


def check_cardinality(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Text columns with very many distinct values."""
    return (
        distinct_counts(df, string_columns(df))
        .where(F.col("n_distinct") > limits.max_cardinality)
        .select(F.lit("warning").alias("severity"), F.lit("high_cardinality").alias("rule"),
                "column", F.col("n_distinct").cast("double").alias("value"))
    )


def target_facts(df: DataFrame, target: str) -> DataFrame:
    """(n_rows, n_missing, null_share, n_classes) of the target."""
    gone = missing(df, target)
    value = F.when(~gone, F.col(target))
    by_value = df.groupBy(value.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    absent = F.coalesce(F.sum(F.when(F.col("_v").isNull(), F.col("_n"))), F.lit(0))
    total = F.coalesce(F.sum("_n"), F.lit(0))
    return by_value.agg(
        total.alias("n_rows"), absent.alias("n_missing"),
        F.coalesce(F.try_divide(absent.cast("double"), total.cast("double")), F.lit(0.0)).alias("null_share"),
        F.count("_v").alias("n_classes"),
    )


def target_findings(df: DataFrame, target: str) -> list[tuple]:
    if target not in df.columns:
        return [("error", "missing_target", target, None)]
    facts = target_facts(df, target).first()
    found = []
    if facts["n_missing"]:
        found.append(("error", "target_nulls", target, float(facts["n_missing"])))
    if facts["n_classes"] < 2:
        found.append(("error", "single_class_target", target, float(facts["n_classes"])))
    return found


def check_target(df: DataFrame, target: str) -> DataFrame:
    return df.sparkSession.createDataFrame(target_findings(df, target), FINDINGS_SCHEMA)


def quality_report(
    df: DataFrame, target: str | None = None, limits: Limits = Limits(), raise_on_error: bool = False
) -> DataFrame:
    """All findings as one small table; it has passed when no severity is ``error``.

    Three jobs: one aggregate over all columns, one row-distinct count and one
    distinct count over the text columns.
    """
    n_rows, facts = column_facts(df)
    found = size_findings(n_rows, len(df.columns), limits)
    for column, (gone, constant) in facts.items():
        share = gone / n_rows if n_rows else 0.0
        if share > limits.max_null_share:
            found.append(("warning", "high_null_column", column, share))
        if constant:
            found.append(("warning", "constant_column", column, 1.0 if gone < n_rows else 0.0))
    if n_rows:
        repeats = duplicate_summary(df, limits).first()
        if repeats["high_duplicates"]:
            found.append(("warning", "high_duplicates", None, repeats["duplicate_share"]))
    if string_columns(df):
        found += [tuple(r) for r in check_cardinality(df, limits).collect()]
    if target is not None:
        found += target_findings(df, target)
    errors = [f for f in found if f[0] == "error"]
    if raise_on_error and errors:
        raise QualityError("; ".join(f"{rule} {column or ''}".strip() for _, rule, column, _ in errors))
    return df.sparkSession.createDataFrame(found, FINDINGS_SCHEMA)


def has_passed(report: DataFrame) -> bool:
    return report.where(F.col("severity") == "error").isEmpty()


def autofix(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Drop columns that are nearly all missing, then rows that repeat another row."""
    n_rows, facts = column_facts(df)
    kept = [c for c, (gone, _) in facts.items() if not n_rows or gone / n_rows <= limits.max_null_share]
    return df.select(*kept).distinct()

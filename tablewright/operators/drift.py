"""Drift between a reference and a current table, all columns of a kind in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.tails import chi_square_tail, kolmogorov_tail
from tablewright.operators.order import clean_number, running_sums
from tablewright.operators.schema import numeric_columns

DRIFT_SCHEMA = "column string, test string, statistic double, p_value double, drifted boolean"


def _sides(reference: DataFrame, current: DataFrame, cells) -> DataFrame:
    """Counts per (column, value) for both tables; each side is combined before the union."""
    parts = []
    for df, mine, other in ((reference, "n_ref", "n_cur"), (current, "n_cur", "n_ref")):
        long = df.select(F.inline(cells(df))).where(F.col("value").isNotNull())
        parts.append(long.groupBy("column", "value").agg(F.count(F.lit(1)).alias(mine)).withColumn(other, F.lit(0).cast("bigint")))
    return parts[0].unionByName(parts[1]).groupBy("column", "value").agg(
        F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur"))


def ks_statistics(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n_ref, n_cur, statistic, p_value): largest gap between the distributions."""

    def cells(df):
        return F.array(*[
            F.struct(F.lit(c).alias("column"), clean_number(F.col(c), df.schema[c].dataType).cast("double").alias("value"))
            for c in columns])

    counts = _sides(reference, current, cells)
    runs = running_sums(counts, ["column"], "value", ["n_ref", "n_cur"])
    totals = runs.groupBy("column").agg(F.max("run_n_ref").alias("t_ref"), F.max("run_n_cur").alias("t_cur"))
    # One row per column: bounded by the schema.
    gaps = runs.join(F.broadcast(totals), "column").where("t_ref > 0 AND t_cur > 0")
    gap = F.abs(F.col("run_n_ref") / F.col("t_ref") - F.col("run_n_cur") / F.col("t_cur"))
    found = gaps.groupBy("column").agg(
        F.first("t_ref").alias("n_ref"), F.first("t_cur").alias("n_cur"), F.max(gap).alias("statistic"))
    return found.withColumn("p_value", kolmogorov_tail(F.col("statistic"), F.col("n_ref"), F.col("n_cur")))


def chi_square_statistics(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, statistic, dof): current counts against the reference mix, one added to each.

    The expected counts are scaled to the current total, so tables may differ in size.
    """

    def cells(df):
        return F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])

    counts = _sides(reference, current, cells)
    one = F.lit(1.0)
    o, e = F.col("n_cur") + one, F.col("n_ref") + one
    # sum (o - e s)^2 / (e s) with s = sum o / sum e, expanded so that one pass is enough.
    sums = counts.groupBy("column").agg(
        F.sum(o * o / e).alias("oo"), F.sum(o).alias("o"), F.sum(e).alias("e"), (F.count(one) - 1).alias("dof"))
    return sums.select("column", (F.col("oo") * F.col("e") / F.col("o") - F.col("o")).alias("statistic"), "dof")


def column_drift(reference: DataFrame, current: DataFrame, columns: Sequence[str] | None = None,
                 threshold: float = 0.05, digits: int = 4) -> DataFrame:
    """(column, test, statistic, p_value, drifted) for the columns both tables have.

    A column without values on one side cannot be tested: not drifted, no p-value.
    """
    names = [c for c in (columns or reference.columns) if c in reference.columns and c in current.columns]
    numeric = [c for c in names if c in numeric_columns(reference) and c in numeric_columns(current)]
    other = [c for c in names if c not in numeric]
    rows: dict[str, tuple] = {c: (c, "ks" if c in numeric else "chi2", None, None, False) for c in names}
    if numeric:
        for r in ks_statistics(reference, current, numeric).collect():
            rows[r["column"]] = (r["column"], "ks", r["statistic"], round(r["p_value"], digits), r["p_value"] < threshold)
    if other:
        for r in chi_square_statistics(reference, current, other).collect():
            p = chi_square_tail(r["statistic"], r["dof"])
            if p is not None:
                rows[r["column"]] = (r["column"], "chi2", r["statistic"], round(p, digits), p < threshold)
    return reference.sparkSession.createDataFrame(list(rows.values()), DRIFT_SCHEMA)


def dataset_drift(columns: DataFrame, n_columns: int, threshold: float = 0.3) -> DataFrame:
    """Share of drifted columns among all reference columns; flagged when strictly above."""
    drifted = F.coalesce(F.sum(F.col("drifted").cast("bigint")), F.lit(0))
    share = drifted / F.lit(float(max(1, n_columns)))
    return columns.agg(
        drifted.alias("n_drifted"), F.lit(n_columns).cast("bigint").alias("n_columns"),
        F.round(share, 4).alias("drift_share"), (share > threshold).alias("dataset_drift"))


def detect_drift(reference: DataFrame, current: DataFrame, threshold: float = 0.05, share: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """(per column, for the dataset)."""
    columns = column_drift(reference, current, threshold=threshold)
    return columns, dataset_drift(columns, len(reference.columns), share)

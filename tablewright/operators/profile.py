"""Profiling: descriptive statistics, top values, missing data, histograms, correlation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.operators.order import clean_number, quantiles
from tablewright.operators.quality import distinct_row_count, missing
from tablewright.operators.schema import (
    numeric_columns, small_frame, string_columns, value_counts,
)

QUARTILES = (0.25, 0.5, 0.75)


def _number(df: DataFrame, column: str) -> Column:
    return clean_number(F.col(column), df.schema[column].dataType)


def _real(df: DataFrame, column: str) -> Column:
    return _number(df, column).cast("double")


def schema_profile(df: DataFrame) -> DataFrame:
    """One row per column: position, type and kind, with the number of rows."""
    numeric, text = set(numeric_columns(df)), set(string_columns(df))
    cells = [
        F.struct(
            F.lit(i).cast("bigint").alias("position"), F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("dtype"),
            F.lit("numeric" if f.name in numeric else "categorical" if f.name in text else "other").alias("kind"),
            F.count(F.lit(1)).alias("n_rows"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return df.agg(F.array(*cells).alias("_cells")).select(F.inline("_cells"))


def missing_counts(df: DataFrame) -> DataFrame:
    """(column, dtype, n_rows, n_missing) for every column in one aggregate job."""
    cells = [
        F.struct(
            F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"),
            F.count(F.lit(1)).alias("n_rows"),
            F.coalesce(F.sum(missing(df, f.name).cast("bigint")), F.lit(0)).alias("n_missing"),
        )
        for f in df.schema.fields
    ]
    return df.agg(F.array(*cells).alias("_cells")).select(F.inline("_cells"))


def _percent(part: str, whole: str) -> Column:
    return F.coalesce(
        F.round(F.try_divide(F.col(part) * 100.0, F.col(whole).cast("double")), 2), F.lit(0.0)
    )


def null_profile(df: DataFrame) -> DataFrame:
    """Missing count and percentage of every column."""
    return missing_counts(df).select("column", "n_missing", _percent("n_missing", "n_rows").alias("missing_pct"))


def missing_share(df: DataFrame) -> DataFrame:
    """Missing percentage of the columns that have any, smallest first."""
    return null_profile(df).where("n_missing > 0").select("column", "missing_pct").orderBy("missing_pct", "column")


def missing_stats(df: DataFrame) -> DataFrame:
    """Missing count, percentage and type of the columns that have any, largest first."""
    return (
        missing_counts(df).where("n_missing > 0")
        .select("column", "dtype", "n_missing", _percent("n_missing", "n_rows").alias("missing_pct"))
        .orderBy(F.desc("n_missing"), "column")
    )


def describe_numeric(df: DataFrame, columns: list[str] | None = None, digits: int = 4) -> DataFrame:
    """count, mean, sample deviation, min, exact quartiles and max per numeric column."""
    columns = columns or numeric_columns(df)
    cuts = quantiles(df, {c: _real(df, c) for c in columns}, QUARTILES)
    cells = []
    for column in columns:
        value = _real(df, column)
        stats = [F.count(value).alias("count")]
        for name, stat in (("mean", F.avg(value)), ("std", F.stddev_samp(value)), ("min", F.min(value))):
            stats.append(F.round(stat, digits).alias(name))
        for name, cut in zip(("p25", "p50", "p75"), cuts[column], strict=True):
            stats.append(F.round(F.lit(cut).cast("double"), digits).alias(name))
        stats.append(F.round(F.max(value), digits).alias("max"))
        cells.append(F.struct(F.lit(column).alias("column"), *stats))
    return df.agg(F.array(*cells).alias("_cells")).select(F.inline("_cells"))


def top_values(df: DataFrame, columns: list[str] | None = None, n: int = 10) -> DataFrame:
    """Most frequent values per column, ties by value.

    The rank limit is applied inside each task first, so one task never sorts all
    values of a column.
    """
    counts = value_counts(df, columns or string_columns(df)).where(F.col("value").isNotNull())
    best = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return (
        counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)
        .select("column", "value", "n", F.col("rank").cast("bigint").alias("rank"))
    )


def target_profile(df: DataFrame, target: str, n_top: int = 20, digits: int = 6) -> DataFrame:
    """Long-form target profile: counts, moments of a numeric target, top values."""
    value = F.when(~missing(df, target), F.col(target))
    by_value = df.groupBy(value.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    known = F.col("_v").isNotNull()
    stats = [
        ("n_unique", F.count("_v").cast("double")),
        ("n_missing", F.coalesce(F.sum(F.when(~known, F.col("_n"))), F.lit(0)).cast("double")),
    ]
    if target in numeric_columns(df):
        x, n = F.col("_v").cast("double"), F.when(known, F.col("_n"))
        total, s1 = F.sum(n), F.sum(n * x)
        mean = F.try_divide(s1, total.cast("double"))
        stats += [("mean", mean), ("min", F.min(x)), ("max", F.max(x))]
    facts = by_value.agg(F.array(*[
        F.struct(F.lit("stat").alias("part"), F.lit(name).alias("key"), F.round(s, digits).alias("value"))
        for name, s in stats
    ]).alias("_cells")).select(F.inline("_cells"))
    if target in numeric_columns(df):
        spread = df.agg(F.round(F.stddev_samp(_real(df, target)), digits).alias("value")).select(
            F.lit("stat").alias("part"), F.lit("std").alias("key"), "value")
        facts = facts.unionByName(spread)
    top = (
        by_value.where(known).orderBy(F.desc("_n"), "_v").limit(n_top)
        .select(F.lit("top").alias("part"), F.col("_v").cast("string").alias("key"),
                F.col("_n").cast("double").alias("value"))
    )
    return facts.unionByName(top)


def describe_all(df: DataFrame) -> DataFrame:
    """Every column in one table: count, unique, top, freq and the numeric block."""
    text = string_columns(df)
    numeric = describe_numeric(df)
    counts = value_counts(df, text).where(F.col("value").isNotNull())
    rows = counts.groupBy("column").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"),
        # Ties go to the smallest value.
        F.min(F.struct((-F.col("n")).alias("order"), "value"))["value"].alias("top"),
        F.max("n").alias("freq"),
    )
    return rows.unionByName(numeric, allowMissingColumns=True)


def overview(df: DataFrame) -> DataFrame:
    """One row: shape, missing cells, duplicate rows, numbers of columns by kind."""
    gone = sum((missing(df, c).cast("bigint") for c in df.columns), F.lit(0).cast("bigint"))
    counted = distinct_row_count(df, extra=[gone.alias("_missing")])
    return counted.select(
        "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        F.col("_missing").alias("missing_cells"),
        (F.col("n_rows") - F.col("n_distinct")).alias("duplicate_rows"),
        F.lit(len(numeric_columns(df))).cast("bigint").alias("numeric_columns"),
        F.lit(len(string_columns(df))).cast("bigint").alias("categorical_columns"),
    )


def dictionary(df: DataFrame) -> DataFrame:
    """Column dictionary: type, non-null count, missing percentage, distinct values."""
    types = F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, f.dataType.simpleString())])
    return (
        value_counts(df, df.columns)
        .groupBy("column").agg(
            F.sum("n").alias("_all"),
            F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("non_null"),
            F.count("value").alias("n_unique"),
        )
        .withColumn("_gone", F.col("_all") - F.col("non_null"))
        .select("column", types[F.col("column")].alias("dtype"), "non_null",
                _percent("_gone", "_all").alias("missing_pct"), "n_unique")
    )


def histogram(df: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """Equal-width bins over [min, max]; the last bin includes its right edge."""
    value = _real(df, column)
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None:
        return small_frame(df.sparkSession, [], "bin bigint, left_edge double, right_edge double, n bigint")
    if low == high:
        number = F.lit(1).cast("bigint")
        width = 0.0
    else:
        number = F.least(F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins).cast("bigint"))
        width = (high - low) / bins
    return (
        df.where(value.isNotNull()).groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        .select("bin", F.round(low + (F.col("bin") - 1) * width, 6).alias("left_edge"),
                F.round(low + F.col("bin") * width, 6).alias("right_edge"), "n")
    )


def correlation_pairs(df: DataFrame, columns: list[str] | None = None, digits: int = 8) -> DataFrame:
    """Pearson correlation of each pair of numeric columns: (column_a, column_b, r).

    Pairs are complete case by case: a row missing one value still serves other pairs.
    A pair with a constant side has no correlation (NULL). Values are centred on the
    column mean; every task reduces its Arrow batches to one set of pair sums by matrix
    products, and only those sums are shuffled.
    """
    columns = columns or numeric_columns(df)
    k = len(columns)
    if k < 2:
        return small_frame(df.sparkSession, [], "column_a string, column_b string, r double")
    values = df.select(*[_real(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    facts = values.agg(*[a for c in values.columns for a in (F.avg(c).alias(f"m{c}"), F.var_pop(c).alias(f"v{c}"))]).first()
    means = [facts[f"m{c}"] or 0.0 for c in values.columns]
    centred = values.select(*[(F.col(c) - F.lit(m)).alias(c) for c, m in zip(values.columns, means, strict=True)])

    def pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, k, k))
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(k)]).astype(float)
            known = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x, nan=0.0)
            total += np.stack([known.T @ known, x.T @ known, (x * x).T @ known, x.T @ x])
        cell = np.arange(k * k)
        yield pa.RecordBatch.from_pydict({
            "i": cell // k, "j": cell % k, "n": total[0].ravel(), "s": total[1].ravel(), "q": total[2].ravel(), "xy": total[3].ravel()})

    sums = centred.mapInArrow(pair_sums, "i bigint, j bigint, n double, s double, q double, xy double").groupBy(
        F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))
    ahead = F.col("i") < F.col("j")
    joined = sums.agg(
        F.sum(F.when(ahead, F.col("n"))).alias("n"), F.sum(F.when(ahead, F.col("xy"))).alias("xy"),
        F.sum(F.when(ahead, F.col("s"))).alias("sa"), F.sum(F.when(ahead, F.col("q"))).alias("qa"),
        F.sum(F.when(~ahead, F.col("s"))).alias("sb"), F.sum(F.when(~ahead, F.col("q"))).alias("qb"),
    ).where("a < b")
    # Rounding leaves a constant column a variance of almost nothing: that counts as none.
    floors = F.array(*[F.lit(1e-14 * (facts[f"v{c}"] or 0.0) + 1e-300) for c in values.columns])
    n = F.col("n")
    spread_a, spread_b = F.col("qa") - F.col("sa") * F.col("sa") / n, F.col("qb") - F.col("sb") * F.col("sb") / n
    varies = (n > 1) & (spread_a > n * F.get(floors, F.col("a"))) & (spread_b > n * F.get(floors, F.col("b")))
    constant = [c for c in values.columns if not facts[f"v{c}"]]
    for c in constant:
        varies = varies & (F.col("a") != values.columns.index(c)) & (F.col("b") != values.columns.index(c))
    r = (F.col("xy") - F.col("sa") * F.col("sb") / n) / F.sqrt(spread_a * spread_b)
    r = F.when(varies, F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0)))
    names = F.array(*[F.lit(c) for c in columns])
    return joined.select(F.get(names, F.col("a")).alias("column_a"), F.get(names, F.col("b")).alias("column_b"),
                         F.round(r, digits).alias("r"))


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> dict[tuple[str, str], float | None]:
    """The same numbers on the driver, for rules over at most a few hundred columns."""
    columns = columns or numeric_columns(df)
    rows = correlation_pairs(df, columns, digits=15).collect()
    return {(r["column_a"], r["column_b"]): r["r"] for r in rows}

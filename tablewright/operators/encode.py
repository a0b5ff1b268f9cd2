"""Categorical encoders: fitted by one grouped aggregate, applied by expression or lookup."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.hashing import hash_slot
from tablewright.operators.lookup import LookupTable
from tablewright.operators.order import running_sums
from tablewright.operators.schema import distinct_counts, string_columns
from tablewright.sources.stored_plans import storable

STRATEGIES = ("onehot", "ordinal", "target", "woe", "binary", "frequency", "hashing")
MAX_ONEHOT = 1_000


def route_columns(df: DataFrame, columns: Sequence[str] | None = None, threshold: int = 20) -> DataFrame:
    """(column, n_distinct, route): columns above the threshold have high cardinality."""
    columns = list(columns or string_columns(df))
    return distinct_counts(df, columns).withColumn(
        "route", F.when(F.col("n_distinct") > threshold, "high").otherwise("low"))


@storable
@dataclass(frozen=True)
class FittedEncoder:
    """One strategy over several columns."""

    strategy: str
    columns: tuple[str, ...]
    tables: dict[str, LookupTable] = field(default_factory=dict)
    categories: dict[str, tuple[str, ...]] = field(default_factory=dict)
    default: float = 0.0
    components: int = 16
    digits: dict[str, int] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        """Replace the columns by their encoding; unknown categories get the default."""
        if self.strategy == "onehot":
            kept = [c for c in df.columns if c not in self.columns]
            dummies = [
                F.coalesce((F.col(c).cast("string") == v).cast("int"), F.lit(0)).alias(f"{c}_{v}")
                for c in self.columns for v in self.categories[c]
            ]
            return df.select(*kept, *dummies)
        if self.strategy == "hashing":
            kept = [c for c in df.columns if c not in self.columns]
            slots = [hash_slot(F.coalesce(F.col(c).cast("string"), F.lit("")), self.components) for c in self.columns]
            sums = [sum((s == i).cast("int") for s in slots).alias(f"hash_{i}") for i in range(self.components)]
            return df.select(*kept, *sums)
        out = df
        for c in self.columns:
            out = self.tables[c].join(out, c, ["code"], f"_{c}_")
        coded = []
        for c in df.columns:
            if c not in self.columns:
                coded.append(F.col(c))
            elif self.strategy == "binary":
                number = F.coalesce(F.col(f"_{c}_code"), F.lit(0))
                top = self.digits[c] - 1
                coded += [F.shiftright(number, top - i).bitwiseAND(F.lit(1).cast("bigint")).cast("int").alias(f"{c}_{i}")
                          for i in range(self.digits[c])]
            else:
                code = F.coalesce(F.col(f"_{c}_code"), F.lit(self.default))
                coded.append(code.cast("int" if self.strategy == "ordinal" else "double").alias(c))
        return out.select(*coded)


def _category_counts(df: DataFrame, column: str) -> DataFrame:
    return (
        df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("key"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _positions(df: DataFrame, column: str) -> DataFrame:
    """Every category with its place in sorted order, from 1."""
    counts = _category_counts(df, column).withColumn("one", F.lit(1))
    return running_sums(counts, [], "key", ["one"]).select("key", "n", F.col("run_one").alias("place"))


def fit_encoder(
    df: DataFrame,
    columns: Sequence[str],
    strategy: str,
    target: str | None = None,
    smoothing: float = 10.0,
    min_samples: int = 20,
    components: int = 16,
) -> FittedEncoder:
    """Learn one encoding; target-based strategies need a numeric (0/1) target column."""
    columns = tuple(columns)
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known: {STRATEGIES}")
    if strategy == "hashing":
        return FittedEncoder(strategy, columns, components=components)
    if strategy in ("target", "woe") and target is None:
        raise ValueError(f"strategy {strategy!r} needs a target")
    tables: dict[str, LookupTable] = {}
    if strategy == "onehot":
        found = {}
        for c in columns:
            rows = _category_counts(df, c).select("key").limit(MAX_ONEHOT + 1).collect()
            if len(rows) > MAX_ONEHOT:
                raise ValueError(f"column {c!r} has more than {MAX_ONEHOT} categories; encode it another way")
            found[c] = tuple(sorted(r["key"] for r in rows))
        return FittedEncoder(strategy, columns, categories=found)
    if strategy == "ordinal":
        for c in columns:
            tables[c] = LookupTable.build(_positions(df, c).select("key", "n", (F.col("place") - 1).alias("code")))
        return FittedEncoder(strategy, columns, tables, default=-1)
    if strategy == "binary":
        digits = {}
        for c in columns:
            tables[c] = LookupTable.build(_positions(df, c).select("key", "n", F.col("place").alias("code")))
            digits[c] = max(1, math.ceil(math.log2(tables[c].n_keys + 1)))
        return FittedEncoder(strategy, columns, tables, digits=digits)
    if strategy == "frequency":
        known = df.agg(*[F.count(c).alias(c) for c in columns]).first()
        for c in columns:
            share = F.col("n") / F.lit(float(known[c] or 1))
            tables[c] = LookupTable.build(_category_counts(df, c).withColumn("code", share))
        return FittedEncoder(strategy, columns, tables)

    y = F.col(target).cast("double")
    total = df.agg(F.count(y).alias("n"), F.sum(y).alias("s"), F.avg(y).alias("mean")).first()
    by_category = {
        c: df.where(F.col(c).isNotNull() & y.isNotNull()).groupBy(F.col(c).cast("string").alias("key"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("s"))
        for c in columns
    }
    if strategy == "target":
        prior = float(total["mean"] or 0.0)
        weight = 1.0 / (1.0 + F.exp(-(F.col("n") - min_samples) / smoothing))
        code = prior * (1.0 - weight) + F.col("s") / F.col("n") * weight
        tables = {c: LookupTable.build(t.withColumn("code", code)) for c, t in by_category.items()}
        return FittedEncoder(strategy, columns, tables, default=prior)
    positives = float(total["s"] or 0.0)
    negatives = total["n"] - positives
    code = F.log(((F.col("s") + 1.0) / (positives + 2.0)) / ((F.col("n") - F.col("s") + 1.0) / (negatives + 2.0)))
    tables = {c: LookupTable.build(t.withColumn("code", code)) for c, t in by_category.items()}
    return FittedEncoder(strategy, columns, tables)


def fit_by_cardinality(df: DataFrame, low: str = "onehot", high: str = "target", target: str | None = None,
                       columns: Sequence[str] | None = None, threshold: int = 20) -> list[FittedEncoder]:
    """Two encoders: one for columns with few categories, one for the others."""
    routes = {r["column"]: r["route"] for r in route_columns(df, columns, threshold).collect()}
    fitted = []
    for route, strategy in (("low", low), ("high", high)):
        chosen = [c for c in df.columns if routes.get(c) == route]
        if chosen:
            fitted.append(fit_encoder(df, chosen, strategy, target))
    return fitted

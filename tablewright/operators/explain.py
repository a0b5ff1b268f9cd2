"""Shapley attributions: exact for linear models, sampled permutations for any model."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.hashing import seeded_hash

BACKGROUND_ROWS = 500


def linear_attributions(df: DataFrame, key: Sequence[str], coefficients: dict[str, float],
                        means: dict[str, float] | None = None) -> DataFrame:
    """(key, feature, contribution): coefficient times distance from the mean."""
    if means is None:
        row = df.agg(*[F.avg(c).alias(c) for c in coefficients]).first()
        means = {c: row[c] for c in coefficients}
    cells = F.array(*[
        F.struct(F.lit(c).alias("feature"), (F.lit(w) * (F.col(c) - F.lit(means[c]))).alias("contribution"))
        for c, w in coefficients.items()])
    return df.select(*key, F.inline(cells))


def sampled_attributions(
    df: DataFrame,
    key: str,
    features: Sequence[str],
    background: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    permutations: int = 10,
    background_rows: int = BACKGROUND_ROWS,
    seed: int = 42,
) -> DataFrame:
    """Monte-Carlo Shapley values of any scorer: (key, feature, contribution).

    The operator draws ``background_rows`` rows by hash order (the caller's bound of a
    broadcast). Every (row, permutation) meets one of them by an equi-join on its number;
    the steps of a permutation are scored as rows and their differences averaged.
    ``score`` adds a double column ``score`` to a table with the feature columns.
    """
    features = list(features)
    k = len(features)
    chosen = (
        background.withColumn("_h", seeded_hash([key], seed)).orderBy("_h", key).limit(background_rows)
        .select(*[F.col(f).cast("double").alias(f"b_{f}") for f in features], "_h", F.col(key).alias("_bk"))
    )
    numbered = chosen.withColumn("_b", F.row_number().over(Window.orderBy("_h", "_bk")) - 1).drop("_h", "_bk")
    size = max(1, numbered.count())
    runs = df.select(F.col(key), *[F.col(f).cast("double").alias(f"x_{f}") for f in features]).withColumn(
        "_m", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    runs = runs.withColumn("_b", F.pmod(seeded_hash([key, "_m"], seed), F.lit(size)).cast("int"))
    # A random order of the features per run: their positions sorted by hash.
    draws = F.array(*[F.struct(seeded_hash([key, "_m", F.lit(f)], seed + 1).alias("h"), F.lit(i).alias("i"))
                      for i, f in enumerate(features)])
    runs = runs.withColumn("_order", F.transform(F.array_sort(draws), lambda d: d["i"]))
    paired = runs.join(F.broadcast(numbered), "_b")
    steps = paired.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(k))))
    mixed = steps.select(key, "_m", "_s", "_order", *[
        F.when(F.array_position("_order", i) <= F.col("_s"), F.col(f"x_{f}")).otherwise(F.col(f"b_{f}")).alias(f)
        for i, f in enumerate(features)])
    scored = score(mixed).select(key, "_m", "_s", "_order", "score")
    # Step s adds feature order[s-1]: it gains score(s) and the next one loses it.
    gains = F.array(
        F.struct(F.when(F.col("_s") > 0, F.get("_order", F.col("_s") - 1)).alias("i"), F.col("score").alias("v")),
        F.struct(F.when(F.col("_s") < k, F.get("_order", F.col("_s"))).alias("i"), (-F.col("score")).alias("v")),
    )
    names = F.array(*[F.lit(f) for f in features])
    return (
        scored.select(key, F.inline(gains)).where(F.col("i").isNotNull())
        .groupBy(key, F.get(names, F.col("i")).alias("feature"))
        .agg((F.sum("v") / permutations).alias("contribution"))
    )


def global_importance(attributions: DataFrame) -> DataFrame:
    """Mean absolute contribution per feature, largest first."""
    return attributions.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("importance")).orderBy(
        F.desc("importance"), "feature")


def top_contributions(attributions: DataFrame, key: Sequence[str], n: int = 15) -> DataFrame:
    """The n strongest contributions of every row with their sign."""
    order = Window.partitionBy(*key).orderBy(F.desc(F.abs("contribution")), "feature")
    return (
        attributions.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
        .withColumn("direction", F.when(F.col("contribution") >= 0, "increases").otherwise("decreases"))
    )


def top_importance(importance: DataFrame, n: int = 20) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(n)

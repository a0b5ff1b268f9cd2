"""Model performance over time, degradation, retraining decisions and alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.operators.metrics import HIGHER_IS_BETTER
from tablewright.operators.order import running_sums

LEVELS = ("INFO", "WARNING", "CRITICAL")


def last_rows(df: DataFrame, time: str, key: str, n: int = 1000) -> DataFrame:
    """The newest n predictions: a top-k, each task keeps n rows."""
    return df.orderBy(F.desc(time), F.desc(key)).limit(n)


def rolling_metrics(df: DataFrame, partition: Sequence[str], time: str, key: str, n: int = 1000,
                    truth: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """mae and rmse over the last n rows of the partition (a model) at every row.

    Rows are numbered and cut into blocks of n. A window that ends inside a block is the end of
    the block before and the start of this one, so one sum from each block's end and one from its
    start give every window: the cost of a row does not depend on n, nothing is subtracted, and
    no group holds more than 2n rows however large a partition is. ``key`` identifies rows. An
    error that is NULL does not count; a window of none has NULL metrics and 0 rows.
    """
    partition = list(partition)
    e = F.col(truth).cast("double") - F.col(predicted).cast("double")
    rows = df.select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(partition)],
                     F.struct(F.col(time).alias("t"), F.col(key).alias("k")).alias("_at"), e.alias("_e"), F.lit(1).cast("bigint").alias("_one"))
    by = [f"_p{i}" for i in range(len(partition))]
    number = F.col("run__one") - 1
    size = F.lit(n).cast("bigint")
    blocks = F.array(F.struct(F.floor(number / size).cast("bigint").alias("_block"), F.lit(False).alias("_guest")),
                     F.struct((F.floor(number / size) + 1).cast("bigint").alias("_block"), F.lit(True).alias("_guest")))
    placed = running_sums(rows, by, "_at", ["_one"]).select(
        *by, "_at", "_e", F.pmod(number, size).alias("_place"), F.inline(blocks)).where(
        ~F.col("_guest") | (F.col("_place") > 0)).repartition(*by, "_block")
    # Guests are summed from their block's end, own rows from their block's start.
    towards = Window.partitionBy(*by, "_block", "_guest").orderBy(F.when(F.col("_guest"), -F.col("_place")).otherwise(F.col("_place")))
    until = towards.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    there = F.col("_e").isNotNull()
    summed = placed.select(*by, "_at", "_block", "_guest", "_place", F.struct(
        F.sum(F.when(there, F.abs("_e")).otherwise(0.0)).over(until).alias("abs"),
        F.sum(F.when(there, F.col("_e") * F.col("_e")).otherwise(0.0)).over(until).alias("sq"),
        F.count("_e").over(until).alias("n")).alias("_s"))
    # The guest one place further on stands right before its own row.
    meeting = Window.partitionBy(*by, "_block").orderBy(F.when(F.col("_guest"), F.col("_place") - 1).otherwise(F.col("_place")), F.desc("_guest"))
    met = summed.withColumn("_g", F.lag(F.when(F.col("_guest"), F.col("_s"))).over(meeting)).where(~F.col("_guest"))

    def total(name: str) -> Column:
        return F.col(f"_s.{name}") + F.coalesce(F.col(f"_g.{name}"), F.lit(0))

    counted = met.withColumn("window_rows", total("n"))
    some = F.col("window_rows") > 0
    return counted.select(
        *[F.col(b).alias(c) for b, c in zip(by, partition)], F.col("_at.k").alias(key), F.col("_at.t").alias(time),
        F.when(some, total("abs") / F.col("window_rows")).alias("mae"),
        F.when(some, F.sqrt(total("sq") / F.col("window_rows"))).alias("rmse"), "window_rows")


def degradation(baseline: DataFrame, current: DataFrame, threshold: float = 0.05) -> DataFrame:
    """(metric, baseline, current, delta, degraded, reason) for two (metric, value) tables.

    Metrics that should fall degrade when they grow by more than the threshold share of
    the baseline; the others when they fall by more than the threshold itself.
    """
    directions = baseline.sparkSession.createDataFrame(list(HIGHER_IS_BETTER.items()), "metric string, higher boolean")
    joined = (
        baseline.select("metric", F.col("value").alias("baseline"))
        .join(current.select("metric", F.col("value").alias("current")), "metric", "full_outer")
        .join(F.broadcast(directions), "metric", "left")
    )
    delta = F.col("current") - F.col("baseline")
    worse = F.when(F.coalesce(F.col("higher"), F.lit(True)), delta < -threshold).otherwise(delta > threshold * F.col("baseline"))
    reason = (
        F.when(F.col("baseline").isNull(), "no baseline").when(F.col("current").isNull(), "no data")
        .when(worse, "degraded").otherwise("ok"))
    return joined.select("metric", "baseline", "current", F.round(delta, 4).alias("delta"),
                         F.coalesce(worse, F.lit(False)).alias("degraded"), reason.alias("reason"))


def history_summary(history: DataFrame, metric: str, time: str = "ts", baseline: float | None = None) -> DataFrame:
    """Last value of one metric, the number of points and the change against the baseline."""
    return history.agg(
        F.max_by(metric, time).alias("last_value"), F.count(metric).alias("n_points"),
        (F.max_by(metric, time) - F.lit(baseline).cast("double")).alias("change"))


def retrain_decision(signals: DataFrame, drift_limit: float = 0.3, max_age_days: int = 30,
                     min_samples: int | None = None) -> DataFrame:
    """Add ``should_retrain`` and ``reasons`` to (drift_share, degraded, days_since_training)."""
    reasons = F.array_compact(F.array(
        F.when(F.col("drift_share") >= drift_limit, "data_drift"),
        F.when(F.col("degraded"), "performance_degradation"),
        F.when(F.col("days_since_training") >= max_age_days, "scheduled"),
    ))
    enough = F.lit(True) if min_samples is None else F.col("n_samples") >= min_samples
    return signals.withColumn("reasons", reasons).withColumn("should_retrain", (F.size("reasons") > 0) & enough)


def alert_records(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """(level, title, message) with the time of the alert."""
    return spark.createDataFrame(rows, "level string, title string, message string").withColumn("ts", F.current_timestamp())


def filter_alerts(alerts: DataFrame, min_level: str = "WARNING") -> DataFrame:
    """Alerts at or above the level; INFO < WARNING < CRITICAL."""
    if min_level not in LEVELS:
        raise ValueError(f"unknown level {min_level!r}; known: {LEVELS}")
    return alerts.where(F.col("level").isin(list(LEVELS[LEVELS.index(min_level):])))

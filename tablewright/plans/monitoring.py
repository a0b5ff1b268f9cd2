"""The monitoring workflow: drift, performance, and the retraining decision."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators.drift import detect_drift
from tablewright.operators.performance import degradation, retrain_decision


@dataclass(frozen=True)
class MonitoringResult:
    column_drift: DataFrame
    dataset_drift: DataFrame
    degradation: DataFrame | None
    decision: DataFrame


def monitor(reference: DataFrame, current: DataFrame, days_since_training: int, baseline: DataFrame | None = None,
            metrics: DataFrame | None = None, drift_limit: float = 0.3, max_age_days: int = 30) -> MonitoringResult:
    """Compare two tables, and two metric tables where given; both metric tables are needed."""
    if (baseline is None) != (metrics is None):
        raise ValueError("give both the baseline and the current metrics, or neither")
    columns, dataset = detect_drift(reference, current, share=drift_limit)
    worse = degradation(baseline, metrics) if baseline is not None else None
    flagged = worse.where("degraded").limit(1).count() > 0 if worse is not None else False
    signals = dataset.select("drift_share", F.lit(flagged).alias("degraded"), F.lit(days_since_training).alias("days_since_training"))
    return MonitoringResult(columns, dataset, worse, retrain_decision(signals, drift_limit, max_age_days))

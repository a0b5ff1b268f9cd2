"""Structured Streaming forms of scoring, windowed metrics, drift checks and last-N state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tablewright.functions.tails import chi_square_tail
from tablewright.operators.drift import chi_square_statistics, ks_statistics
from tablewright.operators.schema import small_frame

_TOP = 1000


def windowed_errors(stream: DataFrame, time: str = "ts", window: str = "7 days", slide: str | None = None,
                    late: str = "1 day", by: tuple[str, ...] = (), truth: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """Error sums per event-time window; works on a stream and on a table alike.

    Rows later than the watermark are dropped; state is one row per open window and group.
    """
    e = F.col(truth).cast("double") - F.col(predicted).cast("double")
    span = F.window("_ts", window, slide) if slide else F.window("_ts", window)
    timed = stream.withColumn("_ts", F.col(time).cast("timestamp"))
    if stream.isStreaming:
        timed = timed.withWatermark("_ts", late)
    return (
        timed.groupBy(span.alias("window"), *by)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs(e)).alias("abs_error"), F.sum(e * e).alias("sq_error"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, "n",
                (F.col("abs_error") / F.col("n")).alias("mae"), F.sqrt(F.col("sq_error") / F.col("n")).alias("rmse"))
    )


def run_available(stream: DataFrame, checkpoint: str, path: str, mode: str = "append") -> StreamingQuery:
    """Process what has arrived and stop; results are files, exactly once."""
    query = (
        stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint)
        .option("path", path).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def score_stream(stream: DataFrame, score: Callable[[DataFrame], DataFrame], checkpoint: str, path: str) -> StreamingQuery:
    """Chunk-wise scoring: every arriving file is scored once and appended."""
    return run_available(score(stream), checkpoint, path)


def keep_last_n(stream: DataFrame, checkpoint: str, state_path: str, model: str, time: str, key: str, n: int = _TOP) -> StreamingQuery:
    """Keep the last n predictions of every model.

    Each batch merges its own newest rows with the stored ones and writes version
    ``batch_id``; a repeated batch rewrites the same version from the one before it, so
    a restart gives the same state.
    """

    def newest(df: DataFrame) -> DataFrame:
        from pyspark.sql import Window

        order = Window.partitionBy(model).orderBy(F.desc(time), F.desc(key))
        return df.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n).drop("_rank")

    def merge(batch: DataFrame, batch_id: int) -> None:
        rows = newest(batch)
        if batch_id > 0:
            rows = newest(rows.unionByName(batch.sparkSession.read.parquet(f"{state_path}/version={batch_id - 1}")))
        rows.write.mode("overwrite").parquet(f"{state_path}/version={batch_id}")

    query = (
        stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def latest_state(spark: SparkSession, state_path: str) -> DataFrame:
    """The newest complete version written by :func:`keep_last_n`."""
    versions = spark.read.parquet(state_path)
    last = versions.agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{state_path}/version={last}")


def drift_per_batch(stream: DataFrame, reference: DataFrame, numeric: list[str], categorical: list[str],
                    checkpoint: str, path: str) -> StreamingQuery:
    """Compare every arriving batch with the fixed reference and append the statistics."""

    def check(batch: DataFrame, batch_id: int) -> None:
        parts = []
        if numeric:
            parts.append(ks_statistics(reference, batch, numeric).select("column", F.lit("ks").alias("test"), "statistic", "p_value"))
        if categorical:
            rows = chi_square_statistics(reference, batch, categorical).collect()       # one for each column
            parts.append(small_frame(
                batch.sparkSession, [(r["column"], "chi2", r["statistic"], chi_square_tail(r["statistic"], r["dof"])) for r in rows],
                "column string, test string, statistic double, p_value double"))
        found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        found.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = stream.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def file_stream(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet", files_per_batch: int = 1,
                **options: object) -> DataFrame:
    """A folder of files as a stream, a bounded number of files per batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).options(**options).format(fmt).load(path)

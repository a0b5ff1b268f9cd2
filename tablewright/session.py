"""Session settings, shared scratch space and reuse of intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
SPREAD_BYTES = 256 << 20


def build_session(app: str = "tablewright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on: UTC dates and AQE.

    Cluster sizing (executors, shuffle partitions, checkpoint folder) is left to
    the caller's ``spark-submit`` settings unless given here.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only where the setting is absent (a single machine, as in tests) a folder of
    our own is made and used.
    """
    folder = spark.conf.get(CHECKPOINT_KEY, None)
    if folder:
        return folder.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tablewright-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder; never reused, so retries cannot clash."""
    return f"{shared_dir(spark)}/tablewright-{label}-{uuid.uuid4().hex}"


def hold(df: DataFrame) -> DataFrame:
    """Keep a table that several jobs read; it spills to disk and can be recomputed."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, for iterative fits."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Give every core work when a small table lies in fewer partitions than there are cores.

    Only tables that the optimiser puts below ``SPREAD_BYTES`` are dealt anew, so the exchange
    stays small; at scale ``spark.sql.files.maxPartitionBytes`` sets the number of tasks.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if size < SPREAD_BYTES and df.rdd.getNumPartitions() < cores else df

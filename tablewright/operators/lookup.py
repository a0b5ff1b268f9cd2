"""Joining a fitted table of values back to the rows, whatever its size and skew."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.session import hold
from tablewright.sources.stored_plans import storable

BROADCAST_ROWS = 200_000
_HOT_SHARE = 0.001
_SALTS = 64


@storable
@dataclass(frozen=True)
class LookupTable:
    """One row per key with fitted values.

    ``table`` has the columns ``key`` (text), ``n`` (rows behind it at fit time) and the
    values. The number of rows is counted once: small tables are broadcast; large ones
    are joined by shuffle with the frequent keys salted. At most ``1 / _HOT_SHARE``
    keys can be frequent, so their list is bounded whatever the data.
    """

    table: DataFrame
    n_keys: int
    hot_keys: tuple[str, ...]

    @staticmethod
    def build(table: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> "LookupTable":
        table = hold(table)
        size = table.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).first()
        hot: tuple[str, ...] = ()
        if size["k"] > broadcast_rows:
            frequent = table.where(F.col("n") >= _HOT_SHARE * size["n"]).select("key").collect()
            hot = tuple(r["key"] for r in frequent if r["key"] is not None)
        return LookupTable(table, size["k"], hot)

    def join(self, df: DataFrame, column: str, values: list[str], prefix: str,
             broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
        """Left join on the text form of ``column``; adds ``prefix + value`` columns."""
        right = self.table.select(
            F.col("key").alias("_key"), *[F.col(v).alias(prefix + v) for v in values]
        ).where(F.col("_key").isNotNull())
        left = df.withColumn("_left", F.col(column).cast("string"))
        if self.n_keys <= broadcast_rows:
            return left.join(F.broadcast(right), left["_left"] == right["_key"], "left").drop("_left", "_key")
        # Frequent (and missing) keys are spread over salts; their rows of the small
        # side are repeated once per salt, all other keys stay as they are.
        hot_left = F.coalesce(F.col("_left").isin(list(self.hot_keys)), F.lit(True))
        hot_right = F.col("_key").isin(list(self.hot_keys))
        spread = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(_SALTS)).cast("int")
        left = left.withColumn("_salt", F.when(hot_left, spread).otherwise(0))
        right = right.withColumn(
            "_salt_r", F.explode(F.when(hot_right, F.sequence(F.lit(0), F.lit(_SALTS - 1))).otherwise(F.array(F.lit(0)))))
        on = (left["_left"] == right["_key"]) & (left["_salt"] == right["_salt_r"])
        return left.join(right, on, "left").drop("_left", "_key", "_salt", "_salt_r")
